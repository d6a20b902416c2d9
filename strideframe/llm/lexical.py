"""Ranked lexical search by presence masks.

For every item the documents with the highest scores, a sum over the item's
terms of a weight (rare terms more) times a saturating share of the term's
occurrences, less in long documents; all but the weights in whole numbers.

A first pass counts documents, terms and the documents of each term asked for.
In a second one each task takes its documents in blocks. A block holds a bitmap
for every term, and what each occurrence adds to a score. For an item the
bitmaps of the terms without which nothing reaches the best scores so far are
united; the documents left are grouped by the mask of the terms they hold, and
masks are evaluated in descending order of the most that they can score, until
no mask left can reach the least of the best. Tasks return their best only.

Items are worked on in blocks of about ``ITEM_BYTES`` of text, which tasks hold
whole; a larger table of items takes further passes. Documents are never sent
anywhere. Terms are compared by 64 bits of hash and their length.

Defined results: a null text has no terms; a document or item without terms
does not occur; every row of the items is an item of its own, rows with equal
ids as well; equal scores are ordered by id, null last; repeated documents each
have a rank; extra columns are ignored; without documents or items no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideframe.llm.bytewise import chunks
from strideframe.llm.common import keep, whole_text
from strideframe.llm.words import TERMS, hashed

BEST = 20
ITEM_BYTES = 1 << 23
#: Documents and (document, term) pairs of a block; documents of a round of evaluation.
BLOCK, PAIRS, ROUND = 1 << 15, 1 << 22, 256
#: Bitmaps of a block that are held at once.
MAPS = 1 << 14
#: Part of a score that does not depend on length, in hundredths, and the scale of its saturation.
FLAT, LONG, SATURATION = 75, 25, 12
#: Groups in which the tasks' best meet before all do.
SPREAD = 64


class Vocabulary:
    """Finds hashes among the sorted ones of the terms asked for, by their upper bits."""

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray):
        bits = max(8, int(len(hashes)).bit_length() + 5)
        self.shift = np.uint64(64 - bits)
        self.hashes = np.concatenate([hashes, [np.uint64(2**64 - 1)]])
        self.lengths = np.concatenate([lengths, [-1]])
        self.first = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift)
        self.most = int(np.diff(np.concatenate([self.first, [len(hashes)]])).max()) if len(hashes) else 0

    def __len__(self) -> int:
        return len(self.hashes) - 1

    def find(self, h: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Number of each term, -1 if it is not asked for."""
        at = self.first[(h >> self.shift).astype(np.int64)]
        for _ in range(self.most):
            at = at + (self.hashes[at] < h)
        return np.where((self.hashes[at] == h) & (self.lengths[at] == length), at, -1)


def matches(data: np.ndarray, ends: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text; and text, term and number of occurrences of every pair that occurs."""
    first, stop, row, h = hashed(data, ends, TERMS)
    terms = np.bincount(row, minlength=len(ends))
    number = vocabulary.find(h, stop - first)
    met = number >= 0
    pair, times = np.unique(row[met] * max(1, len(vocabulary)) + number[met], return_counts=True)
    return terms, pair // max(1, len(vocabulary)), pair % max(1, len(vocabulary)), times


def asked(items: list) -> tuple[Vocabulary, list[tuple[np.ndarray, np.ndarray]]]:
    """The terms of all items; and each item's terms (numbers) and their repeats."""
    texts = [t.encode("utf-8", "surrogatepass") for _, t in items]
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    first, stop, row, h = hashed(np.frombuffer(b"".join(texts), np.uint8), ends, TERMS)
    hashes, at = np.unique(h, return_index=True)
    vocabulary = Vocabulary(hashes, (stop - first)[at])
    number = np.searchsorted(hashes, h)
    return vocabulary, [np.unique(number[row == k], return_counts=True) for k in range(len(items))]


def corpus_counts(texts: DataFrame, vocabulary: Vocabulary) -> tuple[int, int, np.ndarray]:
    """Documents with terms, terms of all documents, and documents of each term asked for."""

    def run(batches):
        held = np.zeros(len(vocabulary) + 2, np.int64)
        for batch in batches:
            for _, data, ends in chunks(batch, 1):
                terms, _, number, _ = matches(data, ends, vocabulary)
                held[:-2] += np.bincount(number, minlength=len(vocabulary))
                held[-2:] += [(terms > 0).sum(), terms.sum()]
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["term", "n"])

    out = np.zeros(len(vocabulary) + 2, np.int64)
    for r in texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return int(out[-2]), int(out[-1]), out[:-2]


class Block:
    """Documents of a task with bitmaps of their terms and what each occurrence adds for a weight of one."""

    def __init__(self, ids, unnamed, length, doc, term, times, weights):
        self.ids, self.unnamed = ids, unnamed
        order = np.argsort(term, kind="stable")
        doc, term, times = doc[order], term[order], times[order]
        self.doc, self.adds = doc, weights[term] * (1_000_000_000 * times // (1000 * times + SATURATION * length[doc]))
        self.start = np.searchsorted(term, np.arange(len(weights) + 1))
        self.most = np.zeros(len(weights), np.int64)
        there = np.flatnonzero(np.diff(self.start))
        if len(there):
            self.most[there] = np.maximum.reduceat(self.adds, self.start[there])
        self.words = -(-len(ids) // 64)
        self.maps: dict[int, np.ndarray] = {}

    def map(self, term: int) -> np.ndarray:
        if term not in self.maps:
            if len(self.maps) >= MAPS:
                self.maps.clear()
            flags = np.zeros(self.words * 64, bool)
            flags[self.doc[self.start[term] : self.start[term + 1]]] = True
            self.maps[term] = np.packbits(flags, bitorder="little").view(np.uint64)
        return self.maps[term]

    def scores(self, docs: np.ndarray, terms: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        """Scores of documents (in ascending order)."""
        out = np.zeros(len(docs), np.int64)
        for t, c in zip(terms, repeats, strict=True):
            there, adds = self.doc[self.start[t] : self.start[t + 1]], self.adds[self.start[t] : self.start[t + 1]]
            at = np.minimum(np.searchsorted(there, docs), len(there) - 1)
            out += np.where(there[at] == docs, c * adds[at], 0)
        return out


class Best:
    """The best documents of an item so far."""

    def __init__(self, count: int):
        self.count = count
        self.score, self.ids, self.unnamed = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def least(self) -> int:
        """A score below this changes nothing."""
        return int(self.score[-1]) if len(self.score) == self.count else 1

    def add(self, score: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        good = score >= self.least
        score, ids, unnamed = (np.concatenate([a, b[good]]) for a, b in ((self.score, score), (self.ids, ids), (self.unnamed, unnamed)))
        order = np.lexsort((ids, unnamed, -score))[: self.count]
        self.score, self.ids, self.unnamed = score[order], ids[order], unnamed[order]


def masks(block: Block, terms: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct masks of documents, as rows of flags, and the number of each document's mask."""
    group = np.zeros(len(docs), np.int64)
    flags = np.empty((len(terms), len(docs)), bool)
    for k in range(0, len(terms), 32):
        part = np.zeros(len(docs), np.int64)
        for j, t in enumerate(terms[k : k + 32]):
            flags[k + j] = np.unpackbits(block.map(t).view(np.uint8), bitorder="little")[docs]
            part |= flags[k + j].astype(np.int64) << j
        # a group is less than 2^31, so both fit
        group = np.unique(group << 32 | part, return_inverse=True)[1]
    _, first = np.unique(group, return_index=True)
    return flags[:, first].T, group


def evaluate(block: Block, terms: np.ndarray, repeats: np.ndarray, best: Best) -> None:
    """Update an item's best with a block, mask by mask."""
    most = repeats * block.most[terms]
    order = np.argsort(-most, kind="stable")
    order = order[most[order] > 0]
    terms, repeats, most = terms[order], repeats[order], most[order]
    rest = np.cumsum(most[::-1])[::-1]  # the most that a term and all after it can add
    needed = int((rest >= best.least).sum())
    if not needed:
        return
    some = np.bitwise_or.reduce([block.map(t) for t in terms[:needed]])
    docs = np.flatnonzero(np.unpackbits(some.view(np.uint8), bitorder="little"))
    held, group = masks(block, terms, docs)
    bound = held @ most
    ranked = np.argsort(-bound, kind="stable")
    place = np.empty(len(ranked), np.int64)
    place[ranked] = np.arange(len(ranked))
    by_mask = np.argsort(place[group], kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=len(ranked))[ranked])
    done = mask = 0
    while mask < len(ranked) and bound[ranked[mask]] >= best.least:
        last = int(np.searchsorted(ends, done + ROUND))  # masks up to this one, as long as they can matter
        last = min(max(last, mask), len(ranked) - 1)
        while last > mask and bound[ranked[last]] < best.least:
            last -= 1
        now = np.sort(docs[by_mask[done : ends[last]]])
        best.add(block.scores(now, terms, repeats), block.ids[now], block.unnamed[now])
        done, mask = int(ends[last]), last + 1


def _search(texts: DataFrame, items: list, count: int) -> DataFrame | None:
    """item (number), item_id, doc_id, score: each task's best."""
    vocabulary, wanted = asked(items)
    if not len(vocabulary):
        return None
    many, total, having = corpus_counts(texts, vocabulary)
    if not total:
        return None
    weights = np.array([math.floor(1000 * math.log((2 * many + 2) / (2 * int(n) + 1))) if n else 0 for n in having], np.int64)
    names = [i for i, _ in items]

    def lengths(terms: np.ndarray) -> np.ndarray:
        if int(terms.max(initial=0)) * LONG * many < 2**63:
            return FLAT + LONG * terms * many // total
        return np.array([FLAT + LONG * int(n) * many // total for n in terms], np.int64)

    def run(batches):
        best = [Best(count) for _ in items]
        held: list[tuple] = []
        docs = pairs = 0

        def flush():
            if held:
                block = Block(*[np.concatenate(c) for c in zip(*held, strict=True)], weights)
                for (terms, repeats), b in zip(wanted, best, strict=True):
                    evaluate(block, terms, repeats, b)

        for batch in batches:
            for start, data, ends in chunks(batch, 1):
                terms, row, number, times = matches(data, ends, vocabulary)
                column = batch.column(0).slice(start, len(ends))
                ids = column.fill_null(0).to_numpy(zero_copy_only=False)
                held.append((ids, column.is_null().to_numpy(zero_copy_only=False), lengths(terms), row + docs, number, times))
                docs, pairs = docs + len(ends), pairs + len(row)
                if docs >= BLOCK or pairs >= PAIRS:
                    flush()
                    held.clear()
                    docs = pairs = 0
        flush()
        for k, b in enumerate(best):
            n = len(b.score)
            columns = [pa.array([k] * n, pa.int64()), pa.array([names[k]] * n, pa.int64()), pa.array(b.ids, mask=b.unnamed), pa.array(b.score)]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "item_id", "doc_id", "score"])

    return texts.mapInArrow(run, "item long, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, count: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score: the ``count`` best documents of each item."""
    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    table = items.select(F.col("item_id").cast("long"), whole_text().alias("text"))
    size = table.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).collect()[0][0]
    parts = max(1, -(-size // ITEM_BYTES))
    out = None
    for part in range(parts):
        own = table.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        found = _search(texts, [tuple(r) for r in own], count)
        if found is None:
            continue
        spread = found.withColumn("some", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SPREAD)))
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        first = spread.withColumn("rank", F.row_number().over(Window.partitionBy("item", "some").orderBy(*order))).where(F.col("rank") <= count)
        ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= count)
        ranked = ranked.select("item_id", "rank", "doc_id", "score")
        ranked = ranked if parts == 1 else keep(ranked, "best")
        out = ranked if out is None else out.unionByName(ranked)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
