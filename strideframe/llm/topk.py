"""Exact top-k by inner product on a bit-sliced index.

Components are quantised to integers. A block of vectors keeps, for each
attribute and bit, a bitmap over its rows (component less the block's least
one, so that bits are never negative). For a query, each of its own bits picks
the attribute's slices at a higher place; full adders over bitmaps (x^y^z and
the majority) add all picked slices into slices of the score. The top rows are
then read off from the most significant slice downward: rows with the bit stay
ahead while they are no more than wanted. Rows left level at the end are equal
in all slices, and the smallest ids among them are taken, so the result is
exact. Bitmap arithmetic has no width limit.

Sets of queries meet blocks of vectors, each pair once. A task holds a slice of
the queries with the best k rows so far and reads its blocks one after another,
so its memory depends neither on the number of blocks nor on that of queries.
The best k of all tasks are kept. Defined results:
vectors that are null or hold null or non-finite components take no part;
missing components of shorter vectors count as 0; components saturate at
+-2^52; a null id is neither query nor candidate; a query's own row is no
candidate, other rows with its id are; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideframe.llm.common import keep

ROWS, QUERIES = 1 << 16, 256
#: Sets of queries that a task holds at most, and cells of queries and blocks wanted at least.
SETS, TASKS = 128, 24
K, SCALE, EVERY = 20, 64, 20


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, a number of its own for each row, and the integers of every sound vector."""
    top = float(1 << 52)
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    q = F.transform(x, lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(top)), F.lit(-top))).cast("long"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(sound)
    return rows.select(F.col("vec_id").cast("long"), F.monotonically_increasing_id().alias("row"), q.alias("q"))


def matrix(lists: pa.Array) -> np.ndarray:
    """Rows of integers, shorter ones filled with 0."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
    return out


class Sliced:
    """Bit slices of a block of vectors, whose rows are in order of id."""

    def __init__(self, values: np.ndarray):
        count, self.size = values.shape
        self.least = values.min(0, initial=0)
        raised = values - self.least
        self.bits = [int(b).bit_length() for b in raised.max(0, initial=0)]
        self.words = (count + 63) // 64
        self.all = self.bitmap(np.ones(count, bool))
        self.first, slices = [], []
        for j in range(self.size):
            self.first.append(len(slices))
            slices += [self.bitmap(raised[:, j] >> b & 1) for b in range(self.bits[j])]
        plain = np.array(slices, np.uint64).reshape(len(slices), self.words)
        self.slices = np.concatenate([plain, plain ^ self.all])  # the second half: each slice's complement
        self.half = len(slices)

    def bitmap(self, on: np.ndarray) -> np.ndarray:
        packed = np.packbits(on.astype(bool), bitorder="little")
        return np.concatenate([packed, np.zeros(self.words * 8 - len(packed), np.uint8)]).view(np.uint64)

    def add(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the score of every row, and what is to be added to it."""
        picked: dict[int, list[int]] = {}
        constant = 0
        for j, q in enumerate(query[: self.size].tolist()):
            if not q:
                continue
            constant += q * int(self.least[j])
            start, factor = self.first[j], abs(q)
            if q < 0:  # -f*u = f*(m - u) - f*m with m all ones
                start += self.half
                constant -= factor * ((1 << self.bits[j]) - 1)
            for a in range(factor.bit_length()):
                if factor >> a & 1:
                    for b in range(self.bits[j]):
                        picked.setdefault(a + b, []).append(start + b)
        out, carried, w = [], [], 0
        while w <= max(picked, default=-1) or carried:
            parts = [self.slices[picked[w]]] if w in picked else []
            stack = np.concatenate(parts + carried) if parts or carried else np.zeros((0, self.words), np.uint64)
            carried = []
            while len(stack) > 2:
                n = len(stack) // 3
                x, y, z = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
                either = x ^ y
                carried.append((x & y) | (z & either))
                stack = np.concatenate([either ^ z, stack[3 * n :]])
            if len(stack) == 2:
                carried.append((stack[0] & stack[1])[None])
                stack = (stack[0] ^ stack[1])[None]
            out.append(stack[0] if len(stack) else np.zeros(self.words, np.uint64))
            w += 1
        return out, constant

    def top(self, query: np.ndarray, k: int, without: int = -1) -> list[tuple[int, int]]:
        """(row, score) of the k highest scores, ties to the smaller row; ``without`` is no candidate."""
        score, constant = self.add(query)
        level, ahead = self.all.copy(), np.zeros(self.words, np.uint64)
        if without >= 0:
            level[without >> 6] &= ~(np.uint64(1) << np.uint64(without & 63))
        for bits in reversed(score):
            with_bit = ahead | (level & bits)
            n = int(np.bitwise_count(with_bit).sum())
            if n > k:
                level &= bits
            else:
                ahead = with_bit
                level &= ~bits
        rows = self.rows(ahead)
        rows += self.rows(level)[: max(0, k - len(rows))]
        found = [(r, constant + sum(int(s[r >> 6] >> np.uint64(r & 63) & np.uint64(1)) << w for w, s in enumerate(score))) for r in rows]
        return sorted(found, key=lambda x: (-x[1], x[0]))

    def rows(self, bitmap: np.ndarray) -> list[int]:
        words = np.flatnonzero(bitmap)
        on = np.unpackbits(bitmap[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, bit = np.nonzero(on)
        return (words[at] * 64 + bit).tolist()


def _packed(rows: DataFrame, blocks: int, tasks: int) -> DataFrame:
    """One row for each block, ``part``: its ids, row numbers and integers in the narrowest type, in order of id. A task holds one block at a time."""

    def packed(block: int, pieces: list) -> pa.RecordBatch:
        table = pa.Table.from_batches(pieces).combine_chunks()
        q = matrix(table["q"].combine_chunks() if isinstance(table["q"], pa.ChunkedArray) else table["q"])
        low, high = q.min(initial=0), q.max(initial=0)
        kind = next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
        ids, own = table["vec_id"].to_numpy(), table["row"].to_numpy()
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int32()), pa.array([ids.tobytes()]), pa.array([own.tobytes()]), pa.array([q.astype(kind).tobytes()]), pa.array([q.shape[1]], pa.int32()), pa.array([kind])],
            names=["part", "ids", "rows", "q", "size", "kind"],
        )

    def run(batches):
        now, pieces = None, []
        for batch in batches:
            block = batch.column(0).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(block) else []
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                if pieces and block[start] != now:
                    yield packed(now, pieces)
                    pieces = []
                now = int(block[start])
                pieces.append(batch.slice(start, end - start))
        if pieces:
            yield packed(now, pieces)

    spot = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    placed = rows.select(spot.alias("block"), "vec_id", "row", "q").repartition(tasks, "block").sortWithinPartitions("block", "vec_id", "row")
    return placed.mapInArrow(run, "part int, ids binary, rows binary, q binary, size int, kind string")


def _unpacked(r: dict):
    ids = np.frombuffer(r["ids"], np.int64)
    return ids, np.frombuffer(r["rows"], np.int64), np.frombuffer(r["q"], r["kind"]).reshape(len(ids), r["size"])


class Asked:
    """A set of queries and the k best rows of each among the blocks met so far."""

    def __init__(self, ids: np.ndarray, own: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.own, self.q, self.k = ids, own, q, k
        self.count = np.zeros(len(ids), np.int64)
        self.best = np.zeros((3, len(ids), k), np.int64)  # score, id and row, best first

    def meet(self, block: Sliced, ids: np.ndarray, own: np.ndarray, place: dict[int, int]) -> None:
        for i, (mine, query) in enumerate(zip(self.own.tolist(), self.q.astype(np.int64), strict=True)):
            found = block.top(query, self.k, place.get(mine, -1))
            if not found:
                continue
            at = [r for r, _ in found]
            score = np.array([max(-(1 << 63), min((1 << 63) - 1, s)) for _, s in found], np.int64)
            all_ = np.concatenate([self.best[:, i, : self.count[i]], np.stack([score, ids[at], own[at]])], axis=1)
            first = np.lexsort((all_[2], all_[1], ~all_[0]))[: self.k]  # ~x falls as x grows, without an overflow
            self.count[i] = len(first)
            self.best[:, i, : len(first)] = all_[:, first]

    def rows(self) -> pa.RecordBatch:
        on = np.arange(self.k)[None, :] < self.count[:, None]
        score, ids, own = (x[on] for x in self.best)
        columns = [np.repeat(self.ids, self.count), np.repeat(self.own, self.count), ids, own, score]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "query_row", "vec_id", "row", "score"])


def search(vectors: DataFrame, k: int = K, scale: int = SCALE, every: int = EVERY) -> DataFrame:
    """The k best rows for each row whose id is divisible by ``every``.

    A task takes a slice of the queries and a group of the blocks: it holds the
    queries and one block at a time, and tells k rows a query for all its blocks.
    """
    spark = vectors.sparkSession
    rows = keep(quantised(vectors, scale), "quantised")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    blocks, sets = -(-rows.count() // ROWS) or 1, -(-asked.count() // QUERIES) or 1
    slices = min(sets, max(-(-sets // SETS), -(-TASKS // blocks)))
    groups = min(blocks, -(-TASKS // slices))

    def run(batches):
        cell, held = None, []
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                if r["cell"] != cell:
                    yield from (a.rows() for a in held)
                    cell, held = r["cell"], []
                ids, own, q = _unpacked(r)
                if r["turn"] == 0:
                    held.append(Asked(ids, own, q, k))
                elif held:
                    block, place = Sliced(q.astype(np.int64)), {int(x): i for i, x in enumerate(own)}
                    for a in held:
                        a.meet(block, ids, own, place)
        yield from (a.rows() for a in held)

    every_group, every_slice = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (groups, slices))
    queries = _packed(asked, sets, max(1, -(-sets * QUERIES // ROWS))).withColumns({"turn": F.lit(0), "group": every_group})
    queries = queries.withColumn("cell", F.pmod("part", F.lit(slices)) * groups + F.col("group"))
    met = _packed(rows, blocks, blocks).withColumns({"turn": F.lit(1), "slice": every_slice})
    met = met.withColumn("cell", F.col("slice") * groups + F.pmod("part", F.lit(groups)))
    columns = ["cell", "turn", "part", "ids", "rows", "q", "size", "kind"]
    dealt = queries.select(*columns).unionByName(met.select(*columns)).repartition(slices * groups, "cell").sortWithinPartitions("cell", "turn", "part")
    found = dealt.mapInArrow(run, "query_id long, query_row long, vec_id long, row long, score long")
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
