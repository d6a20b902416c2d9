"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, lower-cased. An item's seeds are its
word triples that chance would put into the corpus at most once, judged by the
corpus counts of their words; its rarest triples are always seeds. Where a
seed occurs in a document, the item is aligned with the words around it:
match 2, mismatch -1, gap -1. The score over twice the item's words is the
similarity.

Tables of items go through in blocks of bounded size, each against all
documents. Defined results: null, empty or wordless texts match nothing; an
item of fewer than three words is one seed as a whole; repeated rows are
compared each for itself, equal results are one row; extra columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.bytewise import chunks, mix, prefix_sums, substrings

SEED_WORDS, RARE, ALWAYS = 3, 1.0, 8
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST = 0.5
#: Bytes of item texts in one block, about.
ITEM_BYTES = 4 << 20
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every word of the texts that end at ``ends``, by one prefix sum over all bytes."""
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    on = WORD[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[0] = True
    cut[ends] = True
    first = np.flatnonzero(on & (cut[:-1] | ~np.concatenate([[False], on[:-1]])))
    last = np.flatnonzero(on & (cut[1:] | ~np.concatenate([on[1:], [False]]))) + 1
    return substrings(prefix_sums(data), first, last), np.searchsorted(ends, first, side="right")


def runs(h: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every ``width`` words in a row that lie in one text."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += h[k : n + k] * np.uint64((2 * k + 1) * 0x5851F42D4C957F2D & (1 << 64) - 1)
    at = np.flatnonzero(text[:n] == text[width - 1 :])
    return mix(out[at]), at


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each item with its window; rows of many pairs are filled side by side."""
    scores = np.zeros(len(items), np.int64)
    order = np.argsort([len(w) for w in windows], kind="stable")
    start = 0
    while start < len(order):
        width = len(windows[order[start]])
        end = start
        while end < len(order) and end - start < 256 and len(windows[order[end]]) <= max(64, 2 * width):
            end += 1
        part = order[start : max(end, start + 1)]
        rows, columns = max(len(items[k]) for k in part), max(len(windows[k]) for k in part)
        item, window = np.zeros((len(part), rows), np.uint64), np.zeros((len(part), columns), np.uint64)
        inside, within = np.zeros((len(part), rows), bool), np.zeros((len(part), columns), bool)
        for r, k in enumerate(part):
            item[r, : len(items[k])], inside[r, : len(items[k])] = items[k], True
            window[r, : len(windows[k])], within[r, : len(windows[k])] = windows[k], True
        slope = np.arange(columns) * GAP
        above, best = np.zeros((len(part), columns + 1), np.int32), np.zeros(len(part), np.int32)
        for i in range(rows):
            same = (item[:, i : i + 1] == window) & inside[:, i : i + 1] & within
            row = np.maximum(above[:, :-1] + np.where(same, MATCH, MISMATCH), above[:, 1:] + GAP)
            row = np.maximum(np.maximum.accumulate(np.maximum(row, 0) - slope, axis=1) + slope, 0)
            row[~inside[:, i]] = 0
            above[:, 1:] = row
            best = np.maximum(best, row.max(1, initial=0))
        scores[part] = best
        start = max(end, start + 1)
    return scores


class Items:
    """A block of items: their words, and the places of their seeds."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        raw = [(r[1] or "").lower().encode("utf-8", "surrogatepass") for r in rows]
        ends = np.cumsum([len(t) for t in raw], dtype=np.int64)
        h, text = words(np.frombuffer(b"".join(raw), np.uint8), ends) if raw else (np.empty(0, np.uint64), np.empty(0, np.int64))
        self.words = [h[text == k] for k in range(len(rows))] if len(rows) < 64 else np.split(h, np.searchsorted(text, np.arange(1, len(rows))))
        self.vocabulary = np.unique(h)
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def choose(self, count: np.ndarray, total: int) -> None:
        """Seeds from the corpus counts of the vocabulary's words."""
        share = np.log((count + 1) / (total + 1))
        found: dict[int, list] = {}
        for item, own in enumerate(self.words):
            width = min(SEED_WORDS, len(own))
            if not width:
                continue
            h, at = runs(own, np.zeros(len(own), np.int64), width)
            rare = sum(share[np.searchsorted(self.vocabulary, own[k : k + len(h)])] for k in range(width)) + math.log(total + 1)
            kept = (rare <= math.log(RARE)) | (np.argsort(np.argsort(rare, kind="stable"), kind="stable") < ALWAYS)
            found.setdefault(width, []).append((h[kept], np.full(kept.sum(), item), at[kept]))
        for width, parts in found.items():
            h, item, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            self.seeds[width] = (h[order], item[order], at[order])

    def hits(self, h: np.ndarray, text: np.ndarray):
        """(text, item, place in the text minus place in the item) of every seed found."""
        out = []
        for width, (seeds, item, at) in self.seeds.items():
            found, place = runs(h, text, width)
            maybe = np.zeros(1 << 20, bool)
            maybe[seeds >> np.uint64(44)] = True
            on = np.flatnonzero(maybe[found >> np.uint64(44)])
            low, high = np.searchsorted(seeds, found[on], "left"), np.searchsorted(seeds, found[on], "right")
            times = high - low
            which = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            spot = np.repeat(place[on], times)
            out.append((text[spot], item[which], spot - at[which]))
        return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3


def _regions(items: Items, h: np.ndarray, text: np.ndarray):
    """(text, item, first word, last word, seeds) of the stretches to align."""
    where, item, diagonal = items.hits(h, text)
    order = np.lexsort((diagonal, item, where))
    last = None
    for t, i, d in zip(where[order].tolist(), item[order].tolist(), diagonal[order].tolist(), strict=True):
        size = len(items.words[i])
        slack = size // 4 + 4
        if last and last[:2] == [t, i] and d - slack <= last[3]:
            last[3], last[4] = d + size + slack, last[4] + 1
        else:
            if last:
                yield last
            last = [t, i, d - slack, d + size + slack, 1]
    if last:
        yield last


def _count(items: Items, docs: DataFrame) -> tuple[np.ndarray, int]:
    vocabulary = items.vocabulary

    def run(batches):
        count, total = np.zeros(len(vocabulary) + 1, np.int64), 0
        for batch in batches:
            for _, data, ends in chunks(batch, 0):
                h, _ = words(data, ends)
                at = np.minimum(np.searchsorted(vocabulary, h), max(0, len(vocabulary) - 1))
                total += len(h)
                if len(vocabulary):
                    count[:-1] += np.bincount(at[vocabulary[at] == h], minlength=len(vocabulary))
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(count[at], total))], names=["word", "n"])

    count, total = np.zeros(len(vocabulary), np.int64), 0
    for r in docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        if r["word"] < 0:
            total = r["n"]
        else:
            count[r["word"]] = r["n"]
    return count, total


def _matches(items: Items, docs: DataFrame, least: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = []
            for start, data, ends in chunks(batch, 1):
                h, text = words(data, ends)
                bounds = np.searchsorted(text, np.arange(len(ends) + 1))
                found = list(_regions(items, h, text))
                windows = [h[max(bounds[t], a) : max(bounds[t], min(bounds[t + 1], b))] for t, _, a, b, _ in found]
                scores = align([items.words[i] for _, i, _, _, _ in found], windows) if found else []
                best: dict[tuple, list] = {}
                for (t, i, _, _, seeds), score in zip(found, scores, strict=True):
                    held = best.setdefault((t, i), [0, 0])
                    held[0], held[1] = max(held[0], int(score)), held[1] + seeds
                for (t, i), (score, seeds) in best.items():
                    similarity = score / (MATCH * len(items.words[i]))
                    if similarity >= least:
                        out.append((ids[start + t], items.ids[i], score, similarity, seeds))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "score", "similarity", "seeds"])

    return docs.mapInArrow(run, "doc_id long, item_id long, score long, similarity double, seeds long")


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """Pairs of a document and an item that it holds, whole or edited, with their score."""
    texts = docs.select(F.col("doc_id").cast("long"), F.lower(F.col("text").cast("string")).alias("text"))
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    parts = 1 + size // ITEM_BYTES
    out = None
    for k in range(parts):
        block = Items([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()])
        block.choose(*_count(block, texts))
        found = _matches(block, texts, least)
        out = found if out is None else out.union(found)
    return out.distinct()


def clean_rows(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` whose id has no leak."""
    bad = leaks(docs, benchmark, least).select("doc_id").distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["doc_id"]), "left_anti")
