"""SimHash fingerprints linked by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Between two
fingerprints at most 3 bits apart, either one segment is equal and another has
at most 1 error, or each has exactly 1 (pigeonhole). A segment, filled up to 23
bits, is decoded to the codewords of the perfect Golay code within distance 4:
one, or six if the nearest is 3 away. Of two words one bit apart, one has even
weight: it takes all those codewords, a word of odd weight only its nearest
one, which is within 4 of the other. Keys are a segment itself with another
one's codeword, and the codewords of all three; so each pair of links shares a
key of 33 bits or more. Rows that share one are compared bit by bit.

Up to 5 bits apart, the two closest segments have at most 2 errors each, and
two words 2 bits apart always share one of their (one or six) codewords: keys
are then the codewords of two segments, 24 bits, more of them and less choosy.

Close fingerprints alone do not make near copies: ``near_copies`` takes them as
candidates and links two texts only if their sets of lower-cased five-word
shingles are alike, intersection over union at least ``ALIKE``. Texts of equal
sets are one node. A group of candidates meets in one task, a large one in
pairs of blocks after most of it was linked through equal minima of its sets.

Fingerprints of texts that are alike to 0.8 are mostly farther apart than any
key of one fingerprint finds. With ``minima`` the same code is laid over bits
that differ less: ``WIDE`` bits, each the parity of the least of one universal
hash of the three-word shingles, which differ in half of what the sets differ
in. They are cut into six segments of 23 bits; a key is a pair of codewords of
two of them, three disjoint pairs in all. Candidates share a key and differ in
at most ``WIDE_LINKED`` of the first 64 bits; the verification is the same.

Defined results: a null or blank text has fingerprint zero; fewer words than a
shingle make one shingle; a null id is a row like any other, but never names
a component while another id does; extra columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate, combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from strideframe.llm.bytewise import AT_ONCE, mix
from strideframe.llm.common import fresh, keep, whole_text
from strideframe.llm.components import components, roots
from strideframe.llm.minhash import minima as least_of, shingle_sets, universal

LINKED, FARTHEST, SEED = 3, 5, 42
#: Bits made from minima, bits of each of their words (two segments), and in how many of the first 64 candidates may differ.
WIDE, WORD, WIDE_LINKED = 138, 46, 10
EXTRA = [f"w{k}" for k in range(WIDE // WORD)]
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Rows of a key that meet in one block; a key with more is cut into pairs of blocks.
BLOCK = 1024
#: Two texts are near copies if their five-word shingles are alike to this part.
ALIKE, WORDS = 0.8, 5
#: Bytes of shingle sets that meet in one block, and multipliers whose minima bring alike sets together.
BLOCK_BYTES, MIXERS = 1 << 24, np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
GENERATOR = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every word shingle, as rows of 8 bytes."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty((0, 8), np.uint8)
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= width:
        found = digest(joined, SEED)
    else:
        ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
        ends.insert(0, -1)
        found = b"".join([digest(joined[a + 1 : b], SEED) for a, b in zip(ends, ends[width:], strict=False)])
    return np.frombuffer(found, np.uint8).reshape(-1, 8)


def fingerprint(text: str | None, width: int = 3) -> int:
    rows = shingle_hashes((text or "").encode("utf-8", "surrogatepass"), width)
    count = np.zeros(64, np.int64)
    for k in range(0, len(rows), 8192):
        count += np.unpackbits(rows[k : k + 8192], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every text."""
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id long, fp long")


class Golay:
    """Tables of the [23, 12, 7] code: syndromes, and the error patterns of weight up to 4 with each syndrome."""

    def __init__(self):
        rest = np.zeros(23, np.int64)  # x^i modulo the generator
        value = 1
        for i in range(23):
            rest[i] = value
            value <<= 1
            if value >> 11:
                value ^= GENERATOR
        self.near = np.zeros(1 << 11, np.int64)
        self.far = np.zeros((1 << 11, 5), np.int64)
        filled = np.zeros(1 << 11, np.int64)
        for weight in range(5):
            for bits in combinations(range(23), weight):
                pattern, s = sum(1 << b for b in bits), int(np.bitwise_xor.reduce(rest[list(bits)])) if bits else 0
                if weight < 4:
                    self.near[s] = pattern
                else:
                    self.far[s, filled[s]] = pattern
                    filled[s] += 1
        part = np.arange(256)
        self.syndromes = [
            np.bitwise_xor.reduce([np.where(part >> b & 1, rest[8 * k + b], 0) for b in range(8) if 8 * k + b < 23], axis=0) for k in range(3)
        ]

    def keys(self, word: np.ndarray, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(row, 12-bit codeword number) for every key of every word."""
        s = self.syndromes[0][word & 255] ^ self.syndromes[1][word >> 8 & 255] ^ self.syndromes[2][word >> 16]
        near = word ^ self.near[s]
        more = np.flatnonzero((np.bitwise_count(self.near[s]) == 3) & ((np.bitwise_count(word) % 2 == 0) | every))
        far = word[more, None] ^ self.far[s[more]]
        rows = np.concatenate([np.arange(len(word)), np.repeat(more, 5)])
        return rows, np.concatenate([near, far.ravel()]) >> 11


def _times(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray], count: int) -> tuple[np.ndarray, np.ndarray]:
    """Every choice of a code of the first and one of the second, row by row."""
    (r, codes), (other, more) = first, second
    many = np.bincount(other, minlength=count)
    times = many[r]
    place = np.repeat((np.cumsum(many) - many)[r] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    return np.repeat(r, times), (np.repeat(codes, times) << 12) | more[place]


def fuzzy_keys(fp: np.ndarray, golay: Golay, linked: int = LINKED) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every fingerprint."""
    unsigned = fp.view(np.uint64)
    whole, near = [], []
    for start, bits in SEGMENTS:
        whole.append(((unsigned >> np.uint64(start)) & np.uint64((1 << bits) - 1)).astype(np.int64))
        rows, codes = golay.keys(whole[-1], linked > LINKED)
        order = np.argsort(rows, kind="stable")
        near.append((rows[order], codes[order]))
    if linked > LINKED:
        found = [_times(near[a], near[b], len(fp)) for a, b in combinations(range(len(SEGMENTS)), 2)]
    else:
        found = [(near[b][0], (whole[a][near[b][0]] << 12) | near[b][1]) for a, b in permutations(range(len(SEGMENTS)), 2)]
        found.append(_times(_times(near[0], near[1], len(fp)), near[2], len(fp)))
    return np.concatenate([r for r, _ in found]), np.concatenate([(np.int64(kind) << 36) | codes for kind, (_, codes) in enumerate(found)])


def minima_bits(sets: list[np.ndarray]) -> np.ndarray:
    """``WIDE`` bits of every set of shingles, as rows of flags; an empty set has none."""
    a, b = universal(WIDE, SEED + 1)
    out = np.zeros((len(sets), WIDE), bool)
    for k, s in enumerate(sets):
        if len(s):
            out[k] = mix(least_of(s, a, b)) & np.uint64(1)
    return out


def as_longs(bits: np.ndarray, size: int) -> np.ndarray:
    """Rows of bits as rows of signed numbers of ``size`` bits each."""
    parts = bits.reshape(len(bits), -1, size).astype(np.uint64)
    return (parts << np.arange(size, dtype=np.uint64)).sum(2, dtype=np.uint64).view(np.int64)


def word_keys(words: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): pairs of codewords of the two segments of every word."""
    rows, keys = [], []
    for kind in range(words.shape[1]):
        near = []
        for part in (words[:, kind] & ((1 << 23) - 1), words[:, kind] >> 23):
            at, codes = golay.keys(part, True)
            order = np.argsort(at, kind="stable")
            near.append((at[order], codes[order]))
        at, codes = _times(*near, len(words))
        rows.append(at)
        keys.append((np.int64(kind) << 36) | codes)
    return np.concatenate(rows), np.concatenate(keys)


def close_pairs(cell: np.ndarray, fp: np.ndarray, linked: int):
    """Edges between rows of equal cell (rows in order of cell) at most ``linked`` bits apart; each component as a star."""
    a, b = [], []
    bits = fp.view(np.uint64)
    edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
    sizes = np.diff(edge)
    small = np.repeat(sizes <= 32, sizes)
    lag = 1
    while lag < 32 and lag < len(cell):
        same = (cell[lag:] == cell[:-lag]) & small[lag:]
        if not same.any():
            break
        at = np.flatnonzero(same)
        at = at[np.bitwise_count(bits[at] ^ bits[at + lag]) <= linked]
        a.append(at)
        b.append(at + lag)
        lag += 1
    for start, size in zip(edge[:-1][sizes > 32], sizes[sizes > 32], strict=True):
        group = bits[start : start + size]
        for k in range(0, size, 256):
            x, y = np.nonzero(np.bitwise_count(group[k : k + 256, None] ^ group[None, :]) <= linked)
            ahead = y > x + k
            a.append(start + k + x[ahead])
            b.append(start + y[ahead])
        a, b = _thin(fp, a, b)
    return roots(fp[np.concatenate(a)], fp[np.concatenate(b)]) if a else (fp[:0], fp[:0])


def _thin(fp, a, b):
    """Many edges of a dense group become a star each, so that they never pile up."""
    if sum(map(len, a)) < 1 << 18:
        return a, b
    a, b = np.concatenate(a), np.concatenate(b)
    values, root = roots(fp[a], fp[b])
    order = np.argsort(fp, kind="stable")
    where = lambda v: order[np.searchsorted(fp[order], v)]
    return [where(values)], [where(root)]


def links(fps: DataFrame, linked: int = LINKED, minima: bool = False) -> DataFrame:
    """Edges (u, v) that join all distinct fingerprints at most ``linked`` (5 or fewer) bits apart, as few as a forest in each cell.

    With ``minima`` the keys come from the words beside the fingerprint.
    """
    if linked > FARTHEST and not minima:
        raise ValueError(f"The keys find links of {FARTHEST} bits at most")
    own = ["fp", *(EXTRA if minima else [])]

    def spread(batches):
        golay = Golay()
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(fp), 10_000):
                part = fp[k : k + 10_000]
                if minima:
                    words = np.stack([batch.column(c).to_numpy(zero_copy_only=False)[k : k + 10_000] for c in range(1, len(own))], axis=1)
                    rows, keys = word_keys(words, golay)
                else:
                    rows, keys = fuzzy_keys(part, golay, linked)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["key", "fp"])

    def meet(batches):
        held = None
        for batch in batches:
            part = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)]
            held = part if held is None else [np.concatenate(x) for x in zip(held, part, strict=True)]
            if len(held[0]) < 50_000:
                continue
            last = np.searchsorted(held[0], held[0][-1])  # the last cell may go on
            if last:
                yield edges(*[x[:last] for x in held])
                held = [x[last:] for x in held]
        if held is not None and len(held[0]):
            yield edges(*held)

    def edges(cell, fp):
        values, root = close_pairs(cell, fp, linked)
        on = values != root
        return pa.RecordBatch.from_arrays([pa.array(values[on]), pa.array(root[on])], names=["u", "v"])

    keyed = fps.select(*own).distinct().mapInArrow(spread, "key long, fp long")
    # choosy keys are mostly alone, and only met ones go on; of the others only the hot ones need their count
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > (1 if linked <= LINKED else BLOCK))
    # a fingerprint makes tens of keys, which Spark cannot foresee: by its size it would send the keys to every task
    cut = keyed.join(counts.hint("merge"), "key", "inner" if linked <= LINKED else "left")
    cut = cut.withColumn("blocks", F.ceil(F.coalesce("n", F.lit(1)) / BLOCK).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    cut = cut.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.when(F.col("blocks") == 1, F.col("key")).otherwise(
        F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
    )
    cells = cut.select(cell.alias("cell"), "fp").repartition("cell").sortWithinPartitions("cell", "fp")
    return cells.mapInArrow(meet, "u long, v long").distinct()


def groups(docs: DataFrame, width: int = 3, linked: int = LINKED) -> DataFrame:
    """doc_id, fp, component (its smallest fp) and component_id (its smallest doc_id) of every row."""
    rows = keep(fingerprints(docs, width), "fingerprints")
    named = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    parts = components(links(rows, linked))
    named = named.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    found = named.select("fp", "component").join(smallest, "component").select("fp", "component", "component_id")
    return rows.join(found, "fp").select("doc_id", "fp", "component", "component_id")


def classes(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---- verified near copies


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of the lower-cased text as sorted hashes."""
    return np.unique(shingle_hashes((text or "").lower().encode("utf-8", "surrogatepass"), words).view(np.uint64))


def mark_of(shingles: np.ndarray) -> int:
    """64 bits that name a set of shingles."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def alike(a: np.ndarray, b: np.ndarray, least: float = ALIKE) -> bool:
    """Whether intersection over union of two sets reaches ``least``."""
    low, high = sorted((len(a), len(b)))
    if low < least * high:
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common >= least * (len(both) - common)


def verified_links(cells: DataFrame, linked: int, least: float = ALIKE) -> DataFrame:
    """Edges (u, v) between marks of a cell whose fingerprints are close and whose shingles are alike.

    Takes cell, mark, fp, cluster and shingles. Pairs that are linked already,
    or of one cluster, are not compared again: a forest joins them.
    """

    def meet(batches):
        cell, held = None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for now, *row in zip(*columns, strict=True):
                if now != cell and held:
                    yield edges(held)
                    held = []
                cell = now
                held.append(row)
        if held:
            yield edges(held)

    def edges(rows):
        mark, fp, cluster = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        root = np.unique(cluster, return_inverse=True)[1]
        size, bits = np.array([len(x) for x in sets]), fp.view(np.uint64)
        u, v = [], []
        for k in range(len(rows) - 1):
            near = (np.bitwise_count(bits[k + 1 :] ^ bits[k]) <= linked) & (root[k + 1 :] != root[k])
            near &= np.minimum(size[k + 1 :], size[k]) >= least * np.maximum(size[k + 1 :], size[k])
            for j in np.flatnonzero(near) + k + 1:
                if root[j] != root[k] and alike(sets[k], sets[j], least):
                    u.append(mark[k])
                    v.append(mark[j])
                    root[root == root[j]] = root[k]
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    dealt = cells.select("cell", "mark", "fp", "cluster", "shingles").repartition("cell").sortWithinPartitions("cell", "mark")
    return dealt.mapInArrow(meet, "u long, v long").distinct()


def sets_of(texts: list[str], words: int) -> list[np.ndarray]:
    """The distinct shingles of lower-cased texts, all at once."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
    return shingle_sets(np.frombuffer(b"".join(raw), np.uint8), ends, words)


def near_copies(docs: DataFrame, width: int = 3, linked: int = FARTHEST, least: float = ALIKE, words: int = WORDS, minima: bool = False) -> DataFrame:
    """doc_id, mark (of the set of shingles) and component (its smallest mark) of every row.

    Two sets are linked if fingerprints of theirs are at most ``linked`` bits
    apart and intersection over union of the sets is at least ``least``. With
    ``minima`` fingerprints are made of minima, and ``linked`` is ``WIDE_LINKED``.
    """
    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    extra = EXTRA if minima else []
    linked = WIDE_LINKED if minima else linked

    def name_minima(batches):
        for batch in batches:
            text, at = batch.column(1).to_pylist(), 0
            while at < len(text):
                upto, size = at, 0
                while upto < len(text) and (upto == at or size + len(text[upto]) < AT_ONCE):
                    size += len(text[upto])
                    upto += 1
                sets = sets_of(text[at:upto], words)
                bits = minima_bits(sets_of(text[at:upto], width))
                found = [as_longs(bits[:, :64], 64)[:, 0], *as_longs(bits, WORD).T]
                columns = [pa.array(found[0]), _signed([mark_of(x) for x in sets]), pa.array([len(x) for x in sets], pa.int64()), *map(pa.array, found[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, upto - at), *columns], names=["doc_id", "fp", "mark", "size", *extra])
                at = upto

    def name(batches):
        for batch in batches:
            text = batch.column(1).to_pylist()
            sets = [shingle_set(t, words) for t in text]
            found = [_signed([fingerprint(t, width) for t in text]), _signed([mark_of(x) for x in sets]), pa.array([len(x) for x in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found], names=["doc_id", "fp", "mark", "size"])

    def spell(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.column(1).slice(k, 1000).to_pylist()
                sets = sets_of(part, words) if minima else [shingle_set(t, words) for t in part]
                least_ones = [[int(x) for x in (x[:, None] * MIXERS).min(0).view(np.int64)] if len(x) else [0] * len(MIXERS) for x in sets]
                columns = [_signed([mark_of(x) for x in sets]), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array(least_ones, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["mark", "shingles", "minima"])

    kinds = "doc_id long, fp long, mark long, size long"
    rows = keep(texts.mapInArrow(name_minima, ", ".join([kinds, *[f"{c} long" for c in extra]])) if minima else texts.mapInArrow(name, kinds), "marks")
    # a set of few shingles is alike to no other set: one shingle more or less is too much
    nodes = keep(rows.where(F.col("size") >= least * (F.col("size") + 1)).groupBy("mark", "fp", *extra).agg(F.min("doc_id").alias("doc_id"), F.max("size").alias("size")), "nodes")
    parts = components(links(nodes, linked, minima)).select(F.col("node").alias("fp"), "component")
    placed = nodes.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    crowds = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum(8 * F.col("size")).alias("bytes")).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")
    wanted = keep(placed.join(crowds.select("component", blocks), "component").select("component", "blocks", "mark", "fp", "doc_id"), "candidates")
    picked = texts.join(wanted.where("doc_id is not null").select("doc_id").distinct(), "doc_id", "left_semi")
    if not wanted.where("doc_id is null").isEmpty():
        picked = picked.unionByName(texts.where("doc_id is null"))
    sets = picked.mapInArrow(spell, "mark long, shingles binary, minima array<long>")
    sets = sets.groupBy("mark").agg(F.first("shingles").alias("shingles"), F.first("minima").alias("minima"))
    full = keep(wanted.drop("doc_id").join(sets, "mark"), "shingles")
    found = verified_links(full.where("blocks = 1").withColumns({"cell": F.col("component"), "cluster": F.col("mark")}), linked, least)
    large = full.where("blocks > 1")
    if not large.isEmpty():
        part = lambda *c: F.pmod(F.xxhash64(*c), F.col("blocks")).cast("int")
        even = large.select("*", F.posexplode("minima").alias("k", "low"))
        even = even.withColumns({"cell": F.xxhash64("component", "k", "low", part("mark", "k")), "cluster": F.col("mark")})
        first = keep(verified_links(even, linked, least), "first_links")
        held = components(first).select(F.col("node").alias("mark"), F.col("component").alias("cluster"))
        rest = large.join(held, "mark", "left").withColumn("cluster", F.coalesce("cluster", "mark"))
        open_ones = rest.groupBy("component").agg(F.min("cluster").alias("a"), F.max("cluster").alias("b")).where("a < b").select("component")
        rest = rest.join(open_ones, "component", "left_semi").withColumn("mine", part("mark"))
        rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rest = rest.withColumn("cell", F.xxhash64("component", F.least("mine", "other"), F.greatest("mine", "other")))
        found = found.unionByName(first).unionByName(verified_links(rest, linked, least))
    joined = components(found).withColumnRenamed("node", "mark")
    return rows.join(joined, "mark", "left").select("doc_id", "mark", F.coalesce("component", "mark").alias("component"))


def one_of_near_copies(docs: DataFrame, width: int = 3, linked: int = FARTHEST, least: float = ALIKE, words: int = WORDS, minima: bool = False) -> DataFrame:
    """One row of ``docs`` for each group of verified near copies: one with its smallest id (null last) and then smallest mark."""
    found = near_copies(docs, width, linked, least, words, minima).withColumnRenamed("mark", "fp")
    return _chosen(docs, keep(found, "groups"), lambda t: mark_of(sets_of([t or ""], words)[0] if minima else shingle_set(t, words)))


def one_of_each(docs: DataFrame, width: int = 3, linked: int = LINKED) -> DataFrame:
    """One row of ``docs`` for each group: one with its smallest id (null last) and then smallest fingerprint."""
    return _chosen(docs, keep(groups(docs, width, linked), "groups"), lambda t: fingerprint(t, width))


def _chosen(docs: DataFrame, found: DataFrame, name) -> DataFrame:
    """The first row of each component of ``found`` (doc_id, fp, component); ``name`` makes fp of a text."""
    ids = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    once, often = ids.where("doc_id is not null and n = 1").select("doc_id"), ids.where("doc_id is null or n > 1").select("doc_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp")).alias("first")
    chosen = keep(found.groupBy("component").agg(first).select("component", "first.doc_id", "first.fp"), "chosen")
    out = docs.join(chosen.join(once, "doc_id", "left_semi").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    if often.isEmpty():
        return out
    # rows that an id does not tell apart are found by what names their text
    prefix = fresh(docs)
    own = chosen.select(F.col("doc_id").alias(f"{prefix}id"), F.col("fp").alias(f"{prefix}fp"), F.col("component").alias(f"{prefix}component"))
    where, names = docs.columns.index("text"), [*docs.columns, f"{prefix}fp"]
    rows = docs.join(often, docs["doc_id"].eqNullSafe(often["doc_id"]), "left_semi")

    def run(batches):
        for batch in batches:
            found = np.array([name(t) for t in batch.column(where).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], names=names)

    tagged = rows.mapInArrow(run, StructType([*docs.schema.fields, StructField(names[-1], LongType())]))
    again = tagged.join(own, tagged["doc_id"].eqNullSafe(own[f"{prefix}id"]) & (tagged[names[-1]] == own[names[-1]]))
    return out.unionByName(again.dropDuplicates([f"{prefix}component"]).select(*docs.columns))
