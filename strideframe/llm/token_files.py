"""Document counts of flat, unindexed token files by a separator scan.

A file is nothing but token ids of two bytes, most significant first, with an
end-of-document id after each document. Files are cut into blocks; each block
is searched for the separator by one vector comparison. A block on its own
knows every document that begins and ends inside it. The few numbers it tells
about its edges go through a prefix scan over the file's blocks, which yields
the start of the document that is open at a block's first token and the number
of documents before it.

Defined results: an empty document has 0 tokens; tokens after a file's last
separator are one more document (``ended`` false); an empty file has no
documents; a file of odd length is an error. Own files end after ``ROLL`` bytes
and one document; a file from elsewhere over the two gigabytes that Spark's
binary source reads is an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm.bpe import encoded_bytes, open_bpe
from strideframe.llm.common import whole_text
from strideframe.session import scratch_path

#: Bytes C4 80, the letter U+0100 in UTF-8: an id above the vocabulary that Spark's text writer can put after each row.
END, END_TEXT = 0xC480, "Ā"
#: Tokens in front of a document that hold its id, 15 bits each (the first one also whether it is null).
HEAD = 5
#: Bytes of a block.
BLOCK = 4 << 20
#: Bytes after which a task begins another file.
ROLL = 32 << 20


def heads(keys: pa.Array) -> np.ndarray:
    """``HEAD`` tokens for each id."""
    bits = keys.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
    out = np.empty((len(bits), HEAD), ">u2")
    for k in range(HEAD):
        out[:, HEAD - 1 - k] = bits >> np.uint64(15 * k) & np.uint64(0x7FFF)
    out[keys.is_null().to_numpy(zero_copy_only=False), 0] = 16
    return out


def write_files(docs: DataFrame, vocabulary: str, path: str | None = None, roll: int | None = None) -> str:
    """Encode all texts and write them as flat token files, in a folder for each turn of the tasks' files."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    path, roll = path or scratch_path(docs.sparkSession, "tokens"), roll or ROLL

    def run(batches):
        bpe, written = open_bpe(vocabulary), 0
        if len(bpe.pieces) > END:
            raise ValueError("The vocabulary has the id that ends a document")
        for batch in batches:
            front = heads(batch.column(0)).tobytes()
            for start, found in encoded_bytes(batch, bpe):
                rows = [front[2 * HEAD * k : 2 * HEAD * (k + 1)] + ids for k, ids in enumerate(found, start)]
                ends = np.cumsum([len(r) + 2 for r in rows]) + written
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array((ends - 1) // roll, pa.int64())], names=["row", "roll"])
                written = int(ends[-1])

    rows = texts.mapInArrow(run, "row binary, roll long").select(F.col("row").cast("string").alias("value"), "roll")
    rows.write.partitionBy("roll").option("lineSep", END_TEXT).text(path)
    return path


def blocks(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0")
    numbers = F.sequence(F.lit(0), F.floor((F.col("length") - 1) / block).cast("int"))
    cut = F.transform(numbers, lambda b: F.struct(b.alias("block"), F.substring("content", b * block + 1, F.lit(block)).alias("bytes")))
    return files.select(F.col("path").alias("file"), F.explode(cut).alias("cut")).select("file", "cut.block", "cut.bytes")


def _scan(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    if len(data) % 2:
        raise ValueError("A token file has an odd number of bytes")
    tokens = np.frombuffer(data, ">u2")
    return tokens, np.flatnonzero(tokens == END)


def _edges(batches):
    """One row for each block: its size, its separators, and the first tokens before the first and after the last of them."""
    for batch in batches:
        rows = []
        for file, block, data in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
            tokens, ends = _scan(data)
            first, last = (int(ends[0]), int(ends[-1])) if len(ends) else (len(tokens), -1)
            rows.append((file, block, len(tokens), len(ends), first, last, tokens[: min(first, HEAD)].tolist(), tokens[last + 1 : last + 1 + HEAD].tolist()))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 8
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "block", "size", "ends", "first", "last", "lead", "tail"])


EDGES = "file string, block int, size long, ends long, first long, last long, lead array<int>, tail array<int>"
DOCS = "file string, ordinal long, start long, n_tokens long, head array<int>, ended boolean"


def _stitch(part: pd.DataFrame) -> pd.DataFrame:
    """The prefix scan over one file's blocks: a row for each block that ends an open document, and for an open end of the file."""
    part = part.sort_values("block")
    base = part["size"].cumsum().to_numpy() - part["size"].to_numpy()
    before = part["ends"].cumsum().to_numpy() - part["ends"].to_numpy()
    has = part["ends"].to_numpy() > 0
    # start of the document open at each block's first token: after the last separator of the nearest earlier block with one
    after = np.where(has, base + part["last"].to_numpy() + 1, 0)
    start = np.concatenate([[0], np.maximum.accumulate(after)])
    out, head = [], []
    for k, (lead, tail) in enumerate(zip(part["lead"], part["tail"], strict=True)):
        head = (head + list(lead))[:HEAD]
        if has[k]:
            end = base[k] + part["first"].iloc[k]
            out.append((int(part["block"].iloc[k]), int(before[k]), int(start[k]), int(end - start[k]), head, True))
            head = list(tail)
    total = int(part["size"].sum())
    if total > start[-1]:
        out.append((-1, int(part["ends"].sum()), int(start[-1]), int(total - start[-1]), head, False))
    found = pd.DataFrame(out, columns=["block", "ordinal", "start", "n_tokens", "head", "ended"])
    found.insert(0, "file", part["file"].iloc[0])
    sums = pd.DataFrame({"file": part["file"], "block": part["block"], "ordinal": before, "start": base})
    sums["n_tokens"], sums["head"], sums["ended"] = -1, [[] for _ in range(len(sums))], True
    return pd.concat([found, sums], ignore_index=True)


def _inside(batches):
    """Documents that begin and end in one block, by place in the block."""
    for batch in batches:
        for file, block, data in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
            tokens, ends = _scan(data)
            starts, sizes = ends[:-1] + 1, np.diff(ends) - 1
            heads = [tokens[a : a + min(n, HEAD)].tolist() for a, n in zip(starts, sizes, strict=True)]
            n = len(starts)
            columns = [pa.array([file] * n, pa.string()), pa.array([block] * n, pa.int32()), pa.array(np.arange(1, n + 1)), pa.array(starts), pa.array(sizes), pa.array(heads, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "k", "at", "n_tokens", "head"])


def scan(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """A row for each document of the files: file, ordinal in it, first token, number of tokens, first tokens, whether it was ended."""
    cut = blocks(spark, path, block)
    edges = cut.mapInArrow(_edges, EDGES)
    stitched = edges.groupBy("file").applyInPandas(_stitch, "file string, block int, ordinal long, start long, n_tokens long, head array<int>, ended boolean")
    over = stitched.where("n_tokens >= 0").select("file", "ordinal", "start", "n_tokens", "head", "ended")
    sums = stitched.where("n_tokens < 0").select("file", "block", F.col("ordinal").alias("before"), F.col("start").alias("base"))
    inner = cut.mapInArrow(_inside, "file string, block int, k long, at long, n_tokens long, head array<int>").join(sums, ["file", "block"])
    return over.union(inner.select("file", F.col("before") + F.col("k"), F.col("base") + F.col("at"), "n_tokens", "head", F.lit(True)))


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Tokens of every text, counted from the flat files that hold them."""
    found = scan(docs.sparkSession, write_files(docs, vocabulary))
    bits = [F.shiftleft(F.col("head")[k].cast("long"), 15 * (HEAD - 1 - k)) for k in range(HEAD)]
    key = bits[0]
    for b in bits[1:]:
        key = key.bitwiseOR(b)
    null = F.col("head")[0] >= 16
    return found.select(
        F.when(~null, key).alias("doc_id"), (F.col("n_tokens") - HEAD).alias("n_tokens"),
        F.regexp_extract("file", "([^/]+)$", 1).alias("file"), F.col("ordinal"), F.col("start").alias("first_token"),
    )
