"""Near copies by minima of universal hashes, bands and alternating stars.

A text's set holds its distinct word shingles. ``BANDS * ROWS`` functions
a * x + b modulo 2^64 (a odd, x a shingle's hash) have their minimum over the
set; two sets agree in each minimum with the probability of their similarity.
The minima of a band together are one key: sets that share a key are candidates
(at a similarity of 0.85 a pair that shares none of 25 keys of 5 minima has a
probability of 4e-7). A byte of each minimum is the signature: candidates that
agree in too few of them are dropped, at a bound six standard deviations below
what links have. The others are compared on their full sets.

Texts of equal sets are one node, named by 128 bits, so copies meet nobody.
Keys with the same nodes are one cell. A small cell meets in one task, where
pairs that are linked already are not compared again: a forest joins each
group. Of a cell with too many rows or bytes first blocks meet (each node in
``TRIES`` such cells at most, dealt anew in each); where that left several
clusters, pairs of blocks meet, but only nodes of different clusters compare.

Defined results: a null text is empty; a text without words has an empty set
and no link; fewer words than a shingle make one; equal ids are rows of their
own and share their smallest component id only if their texts are linked; a
null id is a row like any other and never names a component while another id
does; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideframe.llm.bytewise import chunks, mix
from strideframe.llm.common import keep, whole_text
from strideframe.llm.stars import components, spread_join
from strideframe.llm.words import SPACED, hashed

WORDS, PERCENT = 5, 85
BANDS, ROWS, SEED = 25, 5, 42
#: Nodes and bytes of sets that meet in one block, and cells with several blocks that a node first goes to.
BLOCK, BLOCK_BYTES, TRIES = 1024, 1 << 24, 3
#: Shingles whose hashes are taken at once.
AT_ONCE = 2048


def universal(count: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """a (odd) and b of ``count`` functions."""
    drawn = np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, (2, count), np.uint64)
    return drawn[0] | np.uint64(1), drawn[1]


def shingle_sets(data: np.ndarray, ends: np.ndarray, words: int) -> list[np.ndarray]:
    """The set of each text as sorted hashes of its shingles."""
    _, _, row, h = hashed(data, ends, SPACED)
    turn = mix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    many = np.bincount(row, minlength=len(ends))
    first = np.cumsum(many) - many
    whole = max(0, len(h) - words + 1)
    shingles = np.zeros(whole, np.uint64)
    for k in range(words):
        shingles += h[k : k + whole] * turn[k]
    shingles = mix(shingles)
    out = []
    for at, n in zip(first.tolist(), many.tolist(), strict=True):
        if n >= words:
            part = np.sort(shingles[at : at + n - words + 1])
            out.append(part[np.concatenate([[True], part[1:] != part[:-1]])])
        else:  # the number of words counts too
            out.append(mix((h[at : at + n] * turn[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)) if n else h[:0])
    return out


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    least = np.full(len(a), 2**64 - 1, np.uint64)
    for k in range(0, len(shingles), AT_ONCE):
        np.minimum(least, (shingles[k : k + AT_ONCE, None] * a + b).min(0), out=least)
    return least


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each band of each row of minima; keys of different bands differ."""
    turn = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    return mix((least.reshape(-1, bands, rows) * turn).sum(2, dtype=np.uint64) + mix(np.arange(bands, dtype=np.uint64) + np.uint64(99)))


def least_agreeing(count: int, percent: int) -> int:
    """Bytes of a signature in which linked sets agree, but for six standard deviations."""
    p = percent / 100 + (1 - percent / 100) / 256
    return max(0, int(count * p - 6 * (count * p * (1 - p)) ** 0.5))


def describe(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, node (16 bytes that name the set, null if empty), size, keys and signature of every row."""
    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))

    def run(batches):
        a, b = universal(bands * rows)
        for batch in batches:
            for start, data, ends in chunks(batch, 1):
                sets = shingle_sets(data, ends, words)
                least = np.array([minima(s, a, b) for s in sets]).reshape(len(sets), bands * rows)
                full = [bool(len(s)) for s in sets]
                keys = band_keys(least, bands, rows).view(np.int64)
                marks = (mix(least) >> np.uint64(56)).astype(np.uint8)
                columns = [
                    batch.column(0).slice(start, len(sets)),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if f else None for s, f in zip(sets, full, strict=True)], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * bands, pa.array(keys.ravel())),
                    pa.array([m.tobytes() for m in marks], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "size", "keys", "signature"])

    return texts.mapInArrow(run, "doc_id long, node binary, size long, keys array<long>, signature binary")


def spelled(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """node and its shingles (hashes, 8 bytes each) of every text that has words."""

    def run(batches):
        for batch in batches:
            for _, data, ends in chunks(batch, 1):
                sets = [s.tobytes() for s in shingle_sets(data, ends, words) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return texts.mapInArrow(run, "node binary, shingles binary")


class Cell:
    """Candidates that meet in one task; finds a forest of their links."""

    def __init__(self, rows: list, percent: int):
        self.nodes = [r[0] for r in rows]
        self.root = np.unique(np.array([r[1] for r in rows], object), return_inverse=True)[1]
        self.marks = np.frombuffer(b"".join([r[2] for r in rows]), np.uint8).reshape(len(rows), -1)
        self.sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        self.size = np.array([len(s) for s in self.sets])
        self.percent, self.least = percent, least_agreeing(self.marks.shape[1], percent)
        self.where = None

    def common(self, k: int, among: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of row k with the rows ``among``."""
        if len(among) < 8:
            both = [np.sort(np.concatenate([self.sets[k], self.sets[j]])) for j in among]
            return np.array([int((x[1:] == x[:-1]).sum()) for x in both])
        if self.where is None:  # rows of every shingle, in order of shingle
            joined = np.concatenate(self.sets)
            order = np.argsort(joined, kind="stable")
            self.sorted, self.where = joined[order], np.repeat(np.arange(len(self.sets)), self.size)[order]
        low = np.searchsorted(self.sorted, self.sets[k], side="left")
        many = np.searchsorted(self.sorted, self.sets[k], side="right") - low
        at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return np.bincount(self.where[at], minlength=len(self.sets))[among]

    def links(self) -> list[tuple[bytes, bytes]]:
        out, clusters = [], len(np.unique(self.root))
        for k in range(len(self.nodes) - 1):
            if clusters == 1:
                break
            small, large = np.minimum(self.size[k + 1 :], self.size[k]), np.maximum(self.size[k + 1 :], self.size[k])
            likely = (self.root[k + 1 :] != self.root[k]) & (100 * small >= self.percent * large)
            among = np.flatnonzero(likely) + k + 1
            among = among[(self.marks[among] == self.marks[k]).sum(1) >= self.least]
            if not len(among):
                continue
            common = self.common(k, among)
            for j in among[100 * common >= self.percent * (self.size[k] + self.size[among] - common)]:
                if self.root[j] != self.root[k]:
                    out.append((self.nodes[k], self.nodes[j]))
                    self.root[self.root == self.root[j]] = self.root[k]
                    clusters -= 1
        return out


def verified(cells: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) between nodes of a cell. Takes cell, node, cluster, signature and shingles."""

    def meet(batches):
        cell, held = None, []
        for batch in batches:
            for now, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now != cell and held:
                    yield edges(held)
                    held = []
                cell = now
                held.append(row)
        if held:
            yield edges(held)

    def edges(rows):
        found = Cell(rows, percent).links()
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in range(2)], names=["u", "v"])

    dealt = cells.select("cell", "node", "cluster", "signature", "shingles").repartition("cell").sortWithinPartitions("cell", "node")
    return dealt.mapInArrow(meet, "u binary, v binary").distinct()


def candidates(nodes: DataFrame) -> DataFrame:
    """key, node, blocks: members of the cells that have two nodes or more; of cells with the same nodes, one."""
    keyed = nodes.select("node", "size", F.explode("keys").alias("key"))
    sums = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"x{k}") for k in range(2)]
    cells = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(8 * F.col("size")).alias("bytes"), *sums).where("n > 1")
    alone = keep(cells.groupBy("n", "x0", "x1").agg(F.min("key").alias("key"), F.first("bytes").alias("bytes")), "cells")
    total = nodes.count()
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")
    return spread_join(keyed.select("key", "node"), alone.select("key", "n", blocks), "key", "n", total * BANDS)


def links(docs: DataFrame, rows: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Edges (u, v) that join all nodes whose sets are linked, as few as a forest in each cell. ``rows`` is ``describe`` of ``docs``."""
    nodes = keep(rows.where("size > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("size").alias("size"), F.first("keys").alias("keys"), F.first("signature").alias("signature")), "nodes")
    members = keep(candidates(nodes), "members")
    wanted = keep(members.select("node").distinct().join(nodes.select("node", "doc_id", "signature"), "node"), "wanted")
    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    picked = texts.join(wanted.where("doc_id is not null").select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    if not wanted.where("doc_id is null").isEmpty():
        picked = picked.unionByName(texts.where("doc_id is null"))
    sets = spelled(picked, words).groupBy("node").agg(F.first("shingles").alias("shingles"))
    sets = keep(wanted.drop("doc_id").join(sets, "node"), "sets")

    small = members.where("blocks = 1").select(F.col("key").alias("cell"), "node", F.col("node").alias("cluster"))
    large = members.where("blocks > 1")
    if large.isEmpty():
        return verified(small.join(sets, "node"), percent)
    tries = large.withColumn("turn", F.row_number().over(Window.partitionBy("node").orderBy("key"))).where(F.col("turn") <= TRIES)
    block = F.pmod(F.xxhash64("key", "node"), F.col("blocks"))
    dealt = tries.select(F.xxhash64("key", block).alias("cell"), "node", F.col("node").alias("cluster"))
    first = keep(verified(small.union(dealt).join(sets, "node"), percent), "first_links")
    found = components(first).select("node", F.col("component").alias("cluster"))
    large = large.join(found, "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
    open_ones = large.groupBy("key").agg(F.min("cluster").alias("a"), F.max("cluster").alias("b")).where("a < b").select("key")
    rest = large.join(open_ones, "key", "left_semi").withColumn("mine", block.cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = rest.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"), "node", "cluster")
    return first.unionByName(verified(pairs.join(sets, "node"), percent))


def groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, node, n_shingles and component_id (the smallest id reachable) of every row."""
    rows = keep(describe(docs, words), "described")
    parts = components(links(docs, rows, words, percent))
    named = rows.where("size > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    named = named.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("many"))
    named = keep(named.select("node", "component", "n"), "named")
    total = rows.count()
    found = spread_join(named, least, "component", "many", total).select("node", "component_id", "n")
    plain = rows.select("doc_id", "node", F.col("size").alias("n_shingles"))
    told = spread_join(plain.where("node is not null"), found, "node", "n", total)
    return told.unionByName(plain.where("node is null").withColumn("component_id", F.col("doc_id")))


def classes(docs: DataFrame) -> DataFrame:
    """One row for each document: its set's size, its component, and whether it is the one kept."""
    return groups(docs).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
