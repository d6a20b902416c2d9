"""Byte-level BPE: encoding by a segment tree over the ranks of adjacent pairs, and decoding.

A text is cut at the special token, then into pre-tokens. Each distinct
pre-token is encoded once per task's cache. Its bytes are the leaves; leaf i of
the tree holds (rank of pair i, i), an inner node the smaller of its two
children, so the root names the leftmost pair of the lowest rank. A merge
changes three leaves and their paths, until the root says that no pair can
merge. Many words are worked on side by side, one row of a matrix per word;
few words, such as a very long one, one after the other.

Defined results: a null text is empty and gives no ids; ids that the
vocabulary lacks decode to nothing; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.common import whole_text

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Words that a task remembers before it starts anew, and those of each half of what token files remember; bounds memory only.
REMEMBERED, HALF = 200_000, 200_000
#: Words that are merged together at least; fewer have plain trees.
TOGETHER = 50
NONE = np.iinfo(np.int64).max

# Letters and digits that Unicode has only since version 17; the vocabulary's library, at 16, takes them for signs.
NEWER = (
    "\U00000558\U0000058b-\U0000058c\U0000088f\U00000c5c\U00000cdc\U0000208f\U0000209d-\U0000209f"
    "\U0000a7ce-\U0000a7cf\U0000a7d2\U0000a7d4\U0000a7dd\U0000a7e2\U0000a7f1\U0000ab6c-\U0000ab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    "\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    "\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    "\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128"
    "\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    "\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    "\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479"
    "\U0003d000-\U0003fc3f"
)
# The published pre-token pattern of this vocabulary, for all text and (faster) for text below U+0100.
ANY = rf"'(?:[sdmt]|ll|ve|re)| ?(?:(?![{NEWER}])\p{{L}})+| ?(?:(?![{NEWER}])\p{{N}})+| ?(?:[^\s\p{{L}}\p{{N}}]|[{NEWER}])+|\s+(?!\S)|\s+"
L1, N1, S1 = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
LATIN = rf"'(?:[sdmt]|ll|ve|re)| ?[{L1}]+| ?[{N1}]+| ?[^{S1}{L1}{N1}]+|[{S1}]+(?![^{S1}])|[{S1}]+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: itself if printable, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Bpe:
    """A vocabulary and what has been encoded with it so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        letters = byte_letters()
        vocab = model["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.pieces = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.pieces[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        self.alphabet = np.full(256, -1, np.int64)
        for c, b in letters.items():
            if c in vocab:
                self.alphabet[b] = vocab[c]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"])
        table = np.array([(vocab[a], vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)], np.int64)
        self.base = len(self.pieces)
        keys = table[:, 0] * self.base + table[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], table[order, 2], table[:, 3]
        self.any, self.latin = regex.compile(ANY), re.compile(LATIN)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, tuple] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.known: dict[int, int] = {}

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text, special tokens among them."""
        try:
            text.encode("latin-1")
            pattern = self.latin
        except UnicodeEncodeError:
            pattern = self.any
        if self.cut is None or not any(s in text for s in self.special):
            return pattern.findall(text)
        parts = self.cut.split(text)
        return list(chain.from_iterable([p] if k % 2 else pattern.findall(p) for k, p in enumerate(parts)))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or NONE."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words that need trees of one size."""
        flat, ends = self.merge_flat(words)
        flat = flat.tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def merge_one(self, word: bytes) -> np.ndarray:
        """Ids of one word, by a tree of its own."""
        n, base, known, merged = len(word), self.base, self.pairs(), self.merged_ids
        leaves = 1 << max(1, (n - 1).bit_length())
        bits = leaves.bit_length() - 1
        ids = array("q", self.alphabet[np.frombuffer(word, np.uint8)].tobytes())
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        rank = self.rank(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64))
        levels = [np.full(leaves, NONE, np.int64)]
        levels[0][: n - 1] = np.where(rank == NONE, NONE, rank * leaves + np.arange(n - 1))
        while len(levels[0]) > 1:
            levels.insert(0, np.minimum(levels[0][::2], levels[0][1::2]))
        tree = array("q", np.concatenate([[NONE], *levels]).tobytes())

        def put(leaf, value):
            at = leaf + leaves
            tree[at] = value
            while at > 1:
                at >>= 1
                low = min(tree[2 * at], tree[2 * at + 1])
                if tree[at] == low:
                    return
                tree[at] = low

        def pair(i, j):
            found = known.get(ids[i] * base + ids[j], -1) if ids[i] >= 0 and ids[j] >= 0 else -1
            return NONE if found < 0 else found << bits | i

        while (root := tree[1]) != NONE:
            i = root & (leaves - 1)
            j = after[i]
            k = after[j]
            ids[i], ids[j], after[i] = merged[root >> bits], -1, k
            put(j, NONE)
            if k < n:
                before[k] = i
            put(i, pair(i, k) if k < n else NONE)
            if before[i] >= 0:
                put(before[i], pair(before[i], i))
        out = np.array(ids, np.int64)
        return out[out >= 0]

    def pairs(self) -> dict[int, int]:
        """Rank of every pair that merges."""
        if not self.known:
            self.known = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
            self.merged_ids = self.merged.tolist()
        return self.known

    def merge_flat(self, words: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """Ids of all words that need trees of one size, and where each word's end."""
        if len(words) < TOGETHER:
            found = [self.merge_one(w) for w in words]
            return np.concatenate(found), np.cumsum([len(f) for f in found]).tolist()
        count, width = len(words), max(map(len, words))
        leaves = 1 << max(1, (width - 1).bit_length())
        lengths = np.fromiter(map(len, words), np.int64, count)
        spot = np.arange(leaves, dtype=np.int64)
        ids = np.full((count, leaves + 1), -1, np.int64)
        filled = spot[None, :width] < lengths[:, None]
        ids[:, :width][filled] = self.alphabet[np.frombuffer(b"".join(words), np.uint8)]
        after = np.minimum(np.broadcast_to(np.arange(1, leaves + 2), (count, leaves + 1)), lengths[:, None]).astype(np.int64)
        before = np.broadcast_to(np.arange(-1, leaves), (count, leaves + 1)).astype(np.int64)
        tree = np.full((count, 2 * leaves), NONE, np.int64)
        rank = self.rank(ids[:, :-1], ids[:, 1:])
        tree[:, leaves:] = np.where(rank == NONE, NONE, rank * leaves + spot)
        node = leaves
        while node > 1:
            node //= 2
            tree[:, node : 2 * node] = np.minimum(tree[:, 2 * node : 4 * node : 2], tree[:, 2 * node + 1 : 4 * node : 2])
        live = np.flatnonzero(tree[:, 1] != NONE)
        while len(live):
            root = tree[live, 1]
            i, r = root % leaves, root // leaves
            j = after[live, i]
            k = after[live, j]
            ids[live, i], ids[live, j] = self.merged[r], -1
            after[live, i], before[live, k] = k, i
            p = before[live, i]
            # the pair that starts at j is gone, those at i and at its neighbour p are new
            right = np.where(k < lengths[live], ids[live, np.minimum(k, leaves)], -1)
            here = self.rank(ids[live, i], right)
            left = self.rank(np.where(p >= 0, ids[live, p], -1), ids[live, i])
            for at, value in ((j, None), (i, here), (p, left)):
                on = at >= 0 if value is not None else at < leaves
                rows, leaf = live[on], at[on] + leaves
                tree[rows, leaf] = NONE if value is None else np.where(value[on] == NONE, NONE, value[on] * leaves + at[on])
                while len(leaf) and leaf[0] > 1:
                    leaf = leaf >> 1
                    tree[rows, leaf] = np.minimum(tree[rows, 2 * leaf], tree[rows, 2 * leaf + 1])
            live = live[tree[live, 1] != NONE]
        kept = ids[:, :-1] >= 0
        return ids[:, :-1][kept], np.cumsum(kept.sum(1)).tolist()

    def learn(self, words: set[str]) -> None:
        """Encode the words that the cache lacks, those of similar length together."""
        if len(self.cache) + len(words) > REMEMBERED:
            self.cache.clear()
        for word in words & self.special.keys():
            self.remember(word, [self.special[word]])
        for part in self.alike([w for w in words if w not in self.cache]):
            for word, ids in zip(part, self.merge([w.encode() for w in part]), strict=True):
                self.remember(word, ids)

    def alike(self, words: list[str]):
        """Words in groups whose trees have one size; a group's trees have a bounded size together."""
        by_size: dict[int, list[str]] = {}
        for word in words:
            by_size.setdefault((len(word.encode()) - 1).bit_length(), []).append(word)
        for bits, group in by_size.items():
            step = max(1, (1 << 18) >> bits)
            for k in range(0, len(group), step):
                yield group[k : k + step]

    def learn_bytes(self, words: set[str]) -> dict[str, bytes]:
        """The ids of each word as pairs of bytes, the higher first. What is remembered has a new and an old half."""
        if len(self.young) + len(words) > HALF:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = words.difference(young)
        known = missing & old.keys()
        young.update({w: old[w] for w in known})
        missing -= known
        for word in missing & self.special.keys():
            young[word] = self.special[word].to_bytes(2, "big")
        for part in self.alike([w for w in missing if w not in self.special]):
            flat, ends = self.merge_flat([w.encode() for w in part])
            data = flat.astype(">u2").tobytes()
            young.update(zip(part, [data[2 * a : 2 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
        return young

    def remember(self, word: str, found: list[int]) -> None:
        self.cache[word] = (found, ",".join(map(str, found)), self.decode_bytes(found), len(found))

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.pieces[i] for i in ids if 0 <= i < len(self.pieces)])

    def encode(self, text: str) -> list[int]:
        words = self.split(text)
        missing = set(words).difference(self.cache)
        self.learn(missing if len(self.cache) + len(missing) <= REMEMBERED else set(words))
        return list(chain.from_iterable(self.cache[w][0] for w in words))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def open_bpe(path: str, held: dict = {}) -> Bpe:  # noqa: B006  one vocabulary for all tasks of a worker process
    if path not in held:
        held[path] = Bpe(path)
    return held[path]


def _runs(batch: pa.RecordBatch, bpe: Bpe, column: int = 1):
    """(first row, pre-tokens of each text, all of them) for runs of rows of bounded size."""
    texts = batch.column(column).to_pylist()
    start, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size > 2_000_000 or k == len(texts) - 1:
            split = [bpe.split(t) if t else [] for t in texts[start : k + 1]]
            yield start, split, set(chain.from_iterable(split))
            start, size = k + 1, 0


def _pieces(batch: pa.RecordBatch, bpe: Bpe, column: int = 1):
    """(first row, pre-tokens of each text) for runs of rows of bounded size; all their words are in the cache until the next run."""
    for start, split, words in _runs(batch, bpe, column):
        if missing := words.difference(bpe.cache):
            bpe.learn(missing if len(bpe.cache) + len(missing) <= REMEMBERED else words)
        yield start, split


def encoded_pieces(batch: pa.RecordBatch, bpe: Bpe):
    """(first row, ids of each text) for runs of rows of bounded size."""
    for start, split in _pieces(batch, bpe):
        yield start, [np.fromiter(chain.from_iterable([bpe.cache[w][0] for w in words]), np.int32) for words in split]


def encoded_bytes(batch: pa.RecordBatch, bpe: Bpe):
    """(first row, ids of each text as pairs of bytes, the higher first) for runs of rows of bounded size."""
    if len(bpe.pieces) > 1 << 16:
        raise ValueError("The vocabulary has ids of more than two bytes")
    for start, split, words in _runs(batch, bpe):
        known = bpe.learn_bytes(words).__getitem__
        yield start, [b"".join(map(known, w)) for w in split]


def encode_frame(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every text."""
    rows = docs.select(F.col("doc_id"), whole_text().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bpe = open_bpe(path)
        for batch in batches:
            for start, found in encoded_pieces(batch, bpe):
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(found)), ids], names=["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_frame(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of ids."""
    rows = encoded.select("doc_id", "ids")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bpe = open_bpe(path)
        for batch in batches:
            texts = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Number of ids, digest of the ids and digest of the text that they decode to, in one pass over the texts."""
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))

    def run(batches):
        bpe = open_bpe(path)
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for _, split in _pieces(batch, bpe):
                for words in split:
                    found = [bpe.cache[w] for w in words]
                    out[0].append(sum([f[3] for f in found]))
                    out[1].append(hashlib.sha256(",".join([f[1] for f in found]).encode()).hexdigest())
                    text = b"".join([f[2] for f in found]).decode("utf-8", "replace")
                    out[2].append(hashlib.sha256(text.encode()).hexdigest())
            arrays = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, SCHEMA)
