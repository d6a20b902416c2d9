"""Exact substring dedup by longest-previous-factor arrays over all texts.

Position i has a previous factor of L bytes when its L-byte string also starts
at a smaller position. In suffix order cut off after L bytes, equal strings
stand together, ordered by position: the previous smaller position of a suffix
in its run is an earlier match, the next one in the run a later match. So the
array, asked only whether it reaches L, is known from the first position (or
the number) of each run of equal strings.

Sorting every suffix of the corpus would move each byte hundreds of times.
Instead each L-byte string names an anchor: the L/3 bytes in it with the least
hash, the leftmost of equals. Equal strings name equal anchors at equal
places, and an anchor serves a stretch of neighbouring strings, so:

1. anchors that occur once in the corpus are dropped, with all their strings;
2. stretches (all bytes of an anchor's strings) that are equal as a whole fall
   into classes;
3. only where an anchor has several classes are single strings compared.

Steps 1 and 2 count by key with partial sums. In step 3 the strings of an
anchor with up to GROUP classes are sorted in one task; those of an anchor with
more are counted by key too, so a passage in a third of all texts meets in no
one task. Equality is that of 128 hash bits. Defined
results: null texts are empty; texts shorter than L lose nothing; equal rows
count each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.bytewise import chunks, prefix_sums, substrings
from strideframe.llm.common import keep, whole_text

LENGTH = 200
#: Bits of the filter that tells tasks which anchors may repeat (8 MB, whatever the input; false alarms cost only time).
FILTER_BITS = 26
#: Classes of an anchor whose strings are compared inside a task, with at most 2/3 L strings each.
GROUP = 20_000
PLACE = np.uint64((1 << 22) - 1)
PIECE = 1 << 19


def stretches(data: np.ndarray, ends: np.ndarray, length: int):
    """(text, first string, number of strings, anchor hash) of every anchor, places counted in ``data``; and its prefix sums."""
    wide = max(1, length // 3)
    total = prefix_sums(data)
    n = len(data) - length + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, np.uint64), total
    at = np.arange(len(data) - wide + 1)
    key = (substrings(total, at, at + wide) & ~PLACE) | at.astype(np.uint64)
    span, least = 1, key
    want = length - wide + 1
    while 2 * span <= want:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < want:
        least = np.minimum(least[: n], least[want - span :][: n])
    anchor = (least[:n] & PLACE).astype(np.int64)
    text = np.searchsorted(ends, np.arange(n), side="right")
    inside = np.arange(n) + length <= ends[np.minimum(text, len(ends) - 1)]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new & inside)
    # strings inside their text come first in it, so a stretch ends at the next one or at the text's last string
    starts = np.append(np.flatnonzero(new), n)
    last = np.minimum(starts[np.searchsorted(starts, first, side="right")], ends[text[first]] - length + 1)
    spot = anchor[first]
    return text[first], first, last - first, substrings(total, spot, spot + wide), total


def pieces(batch: pa.RecordBatch, column: int, length: int):
    """(first row, offset in it, bytes, ends): runs of texts, or a part of a long text that overlaps the next by a string less one byte."""
    for row, data, ends in chunks(batch, column):
        if len(data) <= PIECE:
            yield row, 0, data, ends
            continue
        begin = 0
        for k, end in enumerate(ends):
            for a in range(begin, max(begin + 1, end - length + 1), PIECE - length):
                part = data[a : min(end, a + PIECE - 1)]
                yield row + k, a - begin, part, np.array([len(part)])
            begin = int(end)


def _keyed(docs: DataFrame) -> DataFrame:
    """Texts with a key of two longs that stands for id and text, and whether there is an id."""
    text, named = whole_text(), F.col("doc_id").isNotNull()
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k1"), F.xxhash64(named, text).alias("k2"), text.alias("text"), named.alias("named"))


def _filter(keys: DataFrame) -> bytes:
    """A bit for each key's remainder, put together in Spark; its size is fixed."""
    spot = F.pmod(F.col("hash"), F.lit(1 << FILTER_BITS)) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(spot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("m"))
    out = bytearray(1 << (FILTER_BITS - 3))
    for r in parts.collect():
        start = (r["b"] - 1) * 4096
        out[start : start + 4096] = r["m"]
    return bytes(out)


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    spot = (hashes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
    return (bits[spot >> 3] >> (spot & 7) & 1).astype(bool)


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for _, _, data, ends in pieces(batch, 0, length):
                found = stretches(data, ends, length)[3]
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["hash"])

    return docs.select("text").mapInArrow(run, "hash long")


def _marked(docs: DataFrame, bits: bytes, length: int) -> DataFrame:
    """Every stretch whose anchor passes the filter: anchor, content, and where it is."""

    def run(batches):
        table = np.frombuffer(bits, np.uint8)
        for batch in batches:
            k1, k2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for row, shift, data, ends in pieces(batch, 2, length):
                text, first, count, h, total = stretches(data, ends, length)
                on = _passes(table, h)
                text, first, count, h = text[on], first[on], count[on], h[on]
                content = substrings(total, first, first + count + length - 1)
                start = first - np.concatenate([[0], ends[:-1]])[text] + shift
                columns = [h.view(np.int64), content.view(np.int64), k1[row + text], k2[row + text], start.astype(np.int32), count.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["hash", "content", "k1", "k2", "lo", "n"])

    return docs.select("k1", "k2", "text").mapInArrow(run, "hash long, content long, k1 long, k2 long, lo int, n int")


def _strings(docs: DataFrame, bits: bytes, many: bytes, length: int) -> DataFrame:
    """Stretches that pass the filter, with the hashes of their strings; an equal one is left out if its task has just had it.

    ``many`` tells the anchors (and perhaps others) that have more classes than GROUP.
    """

    def run(batches):
        table, wide, seen = np.frombuffer(bits, np.uint8), np.frombuffer(many, np.uint8), set()
        for batch in batches:
            k1, k2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for row, shift, data, ends in pieces(batch, 2, length):
                text, first, count, h, total = stretches(data, ends, length)
                on = np.flatnonzero(_passes(table, h))
                content = substrings(total, first[on], first[on] + count[on] + length - 1)
                new = np.fromiter((c not in seen and not seen.add(c) for c in content.tolist()), bool, len(content))
                if len(seen) > 500_000:  # what is remembered only spares repetition
                    seen.clear()
                on, content = on[new], content[new]
                times = count[on]
                to = np.cumsum(times)
                start = np.repeat(first[on], times) + np.arange(times.sum()) - np.repeat(to - times, times)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], to]).astype(np.int32)), pa.array(substrings(total, start, start + length).view(np.int64)))
                lo = first[on] - np.concatenate([[0], ends[:-1]])[text[on]] + shift
                columns = [h[on].view(np.int64), content.view(np.int64), k1[row + text[on]], k2[row + text[on]], lo.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in columns], lists, pa.array(_passes(wide, h[on]))], names=["hash", "content", "k1", "k2", "lo", "strings", "many"])

    return docs.select("k1", "k2", "text").mapInArrow(run, "hash long, content long, k1 long, k2 long, lo int, strings array<long>, many boolean")


def _sorted_groups(batches):
    """Rows in order of anchor: strings that two classes of an anchor share, as runs of starts."""

    def told(parts):
        table = pa.Table.from_batches(parts).combine_chunks()
        h, content, k1, k2, lo = (table.column(k).to_numpy() for k in range(5))
        lists = table.column(5).combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        ends = lists.offsets.to_numpy().astype(np.int64)
        ends, w = ends - ends[0], lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(h)), np.diff(ends))
        # in the order of strings, equal ones stand together; one has a match if a neighbour is of another class
        order = np.lexsort((content[row], w, h[row]))
        r, s = row[order], w[order]
        near = (h[r[1:]] == h[r[:-1]]) & (s[1:] == s[:-1])
        other = near & (content[r[1:]] != content[r[:-1]])
        group = np.concatenate([[0], np.cumsum(~near)])
        shared = np.zeros(group[-1] + 1, bool)
        shared[group[1:][other]] = True
        on = np.zeros(len(w), bool)
        on[order] = shared[group]
        begin = on & ~np.concatenate([[False], on[:-1] & (row[1:] == row[:-1])])
        end = on & ~np.concatenate([on[1:] & (row[1:] == row[:-1]), [False]])
        a, b = np.flatnonzero(begin), np.flatnonzero(end)
        at = row[a]
        return pa.RecordBatch.from_arrays([pa.array(k1[at]), pa.array(k2[at]), pa.array((lo[at] + a - ends[at]).astype(np.int32)), pa.array((b - a + 1).astype(np.int32))], names=["k1", "k2", "lo", "n"])

    held, size = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            held.append(batch.slice(start, 2000))
            size += held[-1].num_rows
            h = held[-1].column(0).to_numpy(zero_copy_only=False)
            if size < 4000 or h[0] == h[-1]:
                continue
            cut = int(np.flatnonzero(h != h[-1])[-1]) + 1  # the last anchor may go on
            yield told([*held[:-1], held[-1].slice(0, cut)])
            held = [held[-1].slice(cut)]
            size = held[0].num_rows
    if size:
        yield told(held)


def repeated(docs: DataFrame, length: int = LENGTH, every: bool = True) -> DataFrame:
    """(k1, k2, starts): where strings of ``length`` bytes start that occur elsewhere too (``every``), or earlier (not ``every``).

    Earlier means a smaller (k1, k2, place); ``starts`` are pairs of first start and number.
    """
    several = _anchors(docs, length).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    marks = keep(_marked(docs, _filter(several), length), "stretches")
    here = F.struct("k1", "k2", "lo")
    whose = [] if every else [F.min(here).alias("own")]
    classes = keep(marks.groupBy("hash", "content").agg(F.count(F.lit(1)).alias("times"), *whose), "classes")
    mixed = classes.groupBy("hash").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    # copies of a whole stretch
    copies = marks.join(classes.where("times > 1"), ["hash", "content"])
    copies = copies if every else copies.where(here != F.col("own"))
    copies = copies.select("k1", "k2", "lo", "n")
    # strings shared by stretches that differ elsewhere; all by key if the first of equal ones is to be told
    wide = _filter(mixed.where(F.col("kinds") > GROUP) if every else mixed)
    strings = keep(_strings(docs, _filter(mixed), wide, length), "strings")
    shared = strings.where(~F.col("many")).drop("many").repartition("hash").sortWithinPartitions("hash").mapInArrow(_sorted_groups, "k1 long, k2 long, lo int, n int")
    if any(wide):
        keyed = strings.where("many").join(classes, ["hash", "content"])
        place = F.struct("k1", "k2", "lo") if every else F.col("own")
        keyed = keyed.groupBy("hash", "content").agg(F.min(place).alias("own"), F.any_value("strings").alias("strings"))
        single = keyed.select("hash", "content", "own", F.posexplode("strings").alias("step", "w"))
        place = F.struct("own.k1", "own.k2", (F.col("own.lo") + F.col("step")).cast("int").alias("lo"))
        if every:
            runs = single.groupBy("hash", "w").agg(F.count(F.lit(1)).alias("told")).where("told > 1").select("hash", "w")
            found = single.join(runs, ["hash", "w"]).select(place.alias("p"))
        else:
            runs = single.groupBy("hash", "w").agg(F.min(place).alias("told"))
            found = single.select("hash", "w", place.alias("p")).join(runs, ["hash", "w"]).where("p <> told").select("p")
        shared = shared.union(found.select("p.k1", "p.k2", "p.lo", F.lit(1)))
    return copies.union(shared).groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "n")).alias("starts"))


def cover(starts: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the strings cover."""
    out: list[list[int]] = []
    for a, b in sorted((lo, lo + n + length - 1) for lo, n in starts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def removed(docs: DataFrame, length: int = LENGTH, every: bool = True, digest: bool = False) -> DataFrame:
    """doc_id, its bytes, what is removed of them, and the bytes that stay (``kept``, binary; or their SHA-256)."""
    keyed = _keyed(docs)
    found = keep(repeated(keyed, length, every), "starts")
    bits = _filter(found.select(F.col("k2").alias("hash")))
    kind = "string" if digest else "binary"
    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {kind}"

    def cut(ids, texts, every_starts):
        rows = []
        for text, starts in zip(texts, every_starts, strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            spans = cover([(s["lo"], s["n"]) for s in starts], length) if starts else []
            left = b"".join([raw[a:b] for a, b in zip([0, *[b for _, b in spans]], [*[a for a, _ in spans], len(raw)], strict=True)])
            rows.append((len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest() if digest else left))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        kinds = [pa.int64()] * 3 + [pa.string() if digest else pa.binary()]
        return pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    def chosen(batches, touched):
        table = np.frombuffer(bits, np.uint8)
        for batch in batches:
            on = _passes(table, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            yield batch.filter(pa.array(on == touched))

    def untouched(batches):
        for batch in chosen(batches, False):
            yield cut(pa.compute.if_else(batch.column(3), batch.column(0), pa.scalar(None, pa.int64())), batch.column(2).to_pylist(), [None] * batch.num_rows)

    def touched(batches):
        yield from chosen(batches, True)

    def joined(batches):
        for batch in batches:
            yield cut(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist())

    # texts without a repeat stay where they are; the filter lets few others through
    some = keyed.mapInArrow(touched, keyed.schema).join(found, ["k1", "k2"], "left")
    some = some.select(F.when(F.col("named"), F.col("k1")).alias("doc_id"), "text", "starts").mapInArrow(joined, schema)
    return keyed.mapInArrow(untouched, schema).union(some)


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    return removed(docs, length, digest=True).withColumnRenamed("kept", "kept_sha256")
