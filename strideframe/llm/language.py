"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased and cut into n-grams of one to three characters, hashed
into a fixed number of bins. A bin weighs (share of the text's n-grams) x
(smoothed inverse document frequency). Document frequencies come from every
labelled training text; the weights are learned by follow-the-regularised-
leader with L1 and L2 penalties on a bounded sample per language, and a
temperature fitted on a fifth of that sample calibrates the probabilities.

Defined results: a null text, or one without a letter, is ``und`` with score
0; so is every text when nothing is labelled; with one label all other texts
get it with score 1; of equal probabilities the first label in order wins;
extra columns are ignored or, in ``tag``, carried along.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from strideframe.llm.common import fresh

BITS, ORDERS = 17, 3
BINS = 1 << BITS
#: Rows per language, about, on which weights and temperature are fitted.
SAMPLE = 1000
#: Penalties and step of the regularised leader, passes over the sample, scale of the bins.
L1, L2, STEP, SMOOTH, PASSES, SCALE = 0.02, 0.05, 0.5, 1.0, 3, 100.0
#: Characters worked on at once.
AT_ONCE = 1 << 20
ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def grams(texts: list[str]):
    """Bins of all n-grams of the texts, one array per order, with the text's first place; n-grams never cross texts.

    A place whose n-gram would leave its text holds bin BINS, which weighs nothing.
    """
    low = [t.lower() + "\0" for t in texts]
    lengths = np.fromiter(map(len, low), np.int64, len(low))
    chars = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum(lengths) - lengths
    left = np.repeat(starts + lengths - 1, lengths) - np.arange(len(chars))
    value = np.zeros(len(chars), np.uint32)
    for order in range(1, ORDERS + 1):
        if order > len(chars):
            return
        value = value[: len(chars) - order + 1] * np.uint32(0x01000193) + chars[order - 1 :] + np.uint32(order)
        bins = ((value * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32)
        bins[left[: len(bins)] < order] = BINS
        if len(bins) < len(chars):
            bins = np.concatenate([bins, np.full(order - 1, BINS, np.int32)])
        yield bins, starts, lengths


def pieces(texts: list[str]):
    """Runs of texts with a bounded number of characters together (a longer text stands alone)."""
    start = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > AT_ONCE:
            yield start, k
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def bins_of(text: str) -> np.ndarray:
    found = np.concatenate([b for b, _, _ in grams([text])])
    return found[found < BINS]


def document_frequency(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bin occurs. BINS numbers, at most, reach the driver."""

    def run(batches):
        seen, count, rows = np.zeros(BINS, bool), np.zeros(BINS, np.int64), 0
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in pieces(texts):
                orders = [bins for bins, _, _ in grams(texts[a:b])]
                ends = np.cumsum([len(t.lower()) + 1 for t in texts[a:b]])
                for start, end in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
                    found = np.concatenate([o[start:end] for o in orders])
                    found = found[found < BINS]
                    seen[found] = True
                    count += seen
                    seen[found] = False
                rows += b - a
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, BINS)), pa.array(np.append(count[at], rows))], names=["bin", "n"])

    total, rows = np.zeros(BINS, np.int64), 0
    for r in texts.select("text").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        if r["bin"] == BINS:
            rows = r["n"]
        else:
            total[r["bin"]] = r["n"]
    return total, rows


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(texts: list[str], labels: np.ndarray, classes: int, idf: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights by follow-the-regularised-leader, then a temperature on the rows left aside (every fifth)."""
    z, n = np.zeros((BINS + 1, classes)), np.zeros((BINS + 1, classes))
    rows = []
    for text in texts:
        at, count = np.unique(bins_of(text), return_counts=True)
        value = SCALE * idf[at] * count / max(1, count.sum())
        rows.append((np.append(at, BINS), np.append(value, 1.0)))  # bin BINS: the constant

    def weights(at):
        out = -(z[at] - np.sign(z[at]) * L1) / ((SMOOTH + np.sqrt(n[at])) / STEP + L2)
        return np.where(np.abs(z[at]) <= L1, 0.0, out)

    aside = np.arange(len(rows)) % 5 == 4
    for _ in range(PASSES):
        for k in np.flatnonzero(~aside):
            at, value = rows[k]
            w = weights(at)
            error = softmax(value @ w)
            error[labels[k]] -= 1
            g = value[:, None] * error
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / STEP * w
            n[at] += g * g
    w = weights(slice(None))
    test = np.flatnonzero(aside)
    logits = np.array([rows[k][1] @ w[rows[k][0]] for k in test]).reshape(len(test), classes)
    best, temperature = np.inf, 1.0
    other = 1 / (len(test) + 2)  # probability that n right answers still leave to a wrong one
    for t in np.exp(np.linspace(np.log(0.05), np.log(20), 241)) if len(test) and classes > 1 else ():
        p = np.log(np.maximum(softmax(logits / t), 1e-300))
        own = p[np.arange(len(test)), labels[test]]
        loss = -((1 - other) * own + other / (classes - 1) * (p.sum(1) - own)).sum()
        if loss < best:
            best, temperature = loss, float(t)
    return w, temperature


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # bins x labels, the inverse document frequencies and the scale multiplied in
    constant: np.ndarray
    temperature: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        label, score = ["und"] * len(texts), np.zeros(len(texts))
        live = [k for k, t in enumerate(texts) if self.labels and has_letter(t)]
        told = [texts[k] for k in live]
        for a, b in pieces(told):
            total, size = np.zeros((b - a, len(self.labels))), np.zeros(b - a)
            for bins, starts, lengths in grams(told[a:b]):
                for c in range(len(self.labels)):
                    total[:, c] += np.add.reduceat(self.weights[c][bins], starts, dtype=np.float64)
                size += np.add.reduceat(bins < BINS, starts, dtype=np.int64)
            p = softmax((total / np.maximum(size, 1)[:, None] + self.constant) / self.temperature)
            best = p.argmax(1)
            for k, c, s in zip(live[a:b], best, p.max(1), strict=True):
                label[k], score[k] = self.labels[c], min(1.0, float(s))
        return label, score


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from the text and the non-null lang of the rows given.

    A row enters the fit by a hash of its id and text, at a rate that leaves
    about ``sample`` rows of each language; equal texts enter once.
    """
    rows = docs.where(F.col("lang").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    labels = sorted(counts)
    if not labels:
        return Model([], np.zeros((0, BINS + 1), np.float32), np.zeros(0), 1.0)
    seen, total = document_frequency(rows)
    idf = np.log((1 + total) / (1 + seen)) + 1
    rate = F.create_map(*[x for lang in labels for x in (F.lit(lang), F.lit(min(1.0, sample / counts[lang])))])
    draw = (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)).alias("draw")
    chosen = rows.select("text", "lang", draw).where(F.col("text").isNotNull() & (F.col("draw") < rate[F.col("lang")]))
    chosen = chosen.groupBy("text").agg(F.min(F.struct("draw", "lang")).alias("r")).select("text", "r.draw", "r.lang").repartition(1)

    def run(batches):
        found = [r for batch in batches for r in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True)]
        found = sorted((r for r in found if has_letter(r[0])), key=lambda r: (r[1], r[0]))
        w, t = fit([r[0] for r in found], np.array([labels.index(r[2]) for r in found], np.int64), len(labels), idf)
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float64).tobytes()], pa.binary()), pa.array([t])], names=["w", "t"])

    model = chosen.mapInArrow(run, "w binary, t double").collect()[0]
    w = np.frombuffer(model["w"], np.float64).reshape(BINS + 1, len(labels))
    scaled = np.zeros((len(labels), BINS + 1), np.float32)
    scaled[:, :BINS] = (w[:BINS] * (SCALE * idf)[:, None]).T
    return Model(labels, scaled, w[BINS].copy(), model["t"])


def tag(docs: DataFrame, model: Model) -> tuple[DataFrame, str, str]:
    """All rows and columns, with two more of fresh names: label and score. Needs a column ``text``."""
    prefix = fresh(docs)
    where = docs.columns.index("text")
    names = [*docs.columns, f"{prefix}lang", f"{prefix}score"]
    schema = StructType([*docs.schema.fields, StructField(names[-2], StringType()), StructField(names[-1], DoubleType())])

    def run(batches):
        for batch in batches:
            label, score = model.predict(batch.column(where).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label, pa.string()), pa.array(score)], names=names)

    return docs.mapInArrow(run, schema), names[-2], names[-1]


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Train on the rows that are not held out, predict all."""
    model = train(docs.where(F.coalesce(~held_out(), F.lit(True))), sample)
    tagged, label, score = tag(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return tagged.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col(label).alias("lang_pred"), F.col(score).alias("score"))
