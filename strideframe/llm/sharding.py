"""Sharding by fixed virtual slots and a versioned map from slots to shards.

A record hashes into one of some thousand slots for good. Only the map from
slots to shards changes: each edit is a new version that moves as few slots
as it can. Records carry no state of their own, so a new version touches the
map alone.

Defined results: a null text has size 1 and the checksum of the empty text;
a null id hashes by its text; of rows that share id and text each copy has a
slot of its own, so that no repeated row makes a shard heavy; equal texts under
different ids go where their ids say; an empty table gives an empty result and
a map of empty slots; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideframe.llm.common import keep, whole_text
from strideframe.session import scratch_path

SLOTS = 4096
#: Copies of a row that one task numbers.
COPIES = 10_000


def to_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size in bytes plus one, checksum and virtual slot of every record."""
    text = whole_text()
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit("null"), text)).otherwise(F.xxhash64("doc_id", text))
    named = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        key.alias("key"), F.xxhash64(F.lit(1), text).alias("more"),
    )
    # equal rows are counted first and numbered afterwards, many copies by several tasks
    rows = keep(named.groupBy(*named.columns).agg(F.count(F.lit(1)).alias("n")), "records")
    few, many = rows.where(F.col("n") <= COPIES), rows.where(F.col("n") > COPIES)
    numbered = few.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    if not many.isEmpty():
        first = many.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))).alias("first"))
        spread = first.repartition("key", "first")
        last = F.least(F.col("first") + COPIES, F.col("n")) - 1
        numbered = numbered.unionByName(spread.select("*", F.explode(F.sequence("first", last)).alias("copy")).drop("first"))
    slot = F.when(F.col("copy") == 0, F.col("key")).otherwise(F.xxhash64("key", "copy"))
    return numbered.select("doc_id", "size", "text_crc32", F.pmod(slot, F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_loads(records: DataFrame, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows of each slot: at most ``slots`` numbers reach the driver."""
    size, rows = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for r in records.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        size[r["virtual_slot"]], rows[r["virtual_slot"]] = r["b"], r["n"]
    return size, rows


def first_map(slots: int = SLOTS, shards: int = 8) -> np.ndarray:
    """Version 0: slots dealt in turn."""
    return np.arange(slots) % shards


def rebalance(owner: np.ndarray, size: np.ndarray, shards: int) -> np.ndarray:
    """A new version whose shards are near equal in bytes.

    Shards without slots (new ones) and light shards are filled from the
    heaviest one: each edit moves the slot, or swaps the two slots, whose bytes
    come nearest to half the gap between heaviest and lightest. Every edit
    narrows the gap, and the edits end when none can.
    """
    owner = owner.copy()
    load = np.bincount(owner, weights=size, minlength=shards).astype(np.int64)
    for _ in range(20 * len(owner)):
        high, low = int(load.argmax()), int(load.argmin())
        gap = int(load[high] - load[low])
        giving, taking = np.flatnonzero(owner == high), np.flatnonzero(owner == low)
        giving = giving[np.argsort(size[giving], kind="stable")]
        taking = taking[np.argsort(size[taking], kind="stable")]
        less = np.concatenate([[0], size[taking]])  # nothing comes back, or one slot does
        best, move = gap, None
        for back, lost in enumerate(less):
            at = int(np.searchsorted(size[giving], lost + gap / 2))
            for k in (at - 1, at):
                if 0 <= k < len(giving):
                    moved = int(size[giving[k]] - lost)
                    if 0 < moved < gap and abs(gap - 2 * moved) < best:
                        best, move = abs(gap - 2 * moved), (giving[k], taking[back - 1] if back else None)
            if best <= 1:
                break
        if move is None:
            break
        given, back = move
        owner[given] = low
        if back is not None:
            owner[back] = high
        load = np.bincount(owner, weights=size, minlength=shards).astype(np.int64)
    return owner


def map_frame(spark: SparkSession, versions: list[np.ndarray]) -> DataFrame:
    rows = [(v, slot, int(shard)) for v, owner in enumerate(versions) for slot, shard in enumerate(owner)]
    return spark.createDataFrame(rows, "map_version int, virtual_slot int, shard int")


def store_map(spark: SparkSession, path: str, version: int, owner: np.ndarray) -> None:
    """Add one version to the stored map; earlier versions stay readable."""
    rows = [(slot, int(shard)) for slot, shard in enumerate(owner)]
    spark.createDataFrame(rows, "virtual_slot int, shard int").coalesce(1).write.parquet(f"{path}/map_version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/map_version={version}").collect()
    owner = np.zeros(len(rows), np.int64)
    for r in rows:
        owner[r["virtual_slot"]] = r["shard"]
    return owner


def shard_rows(docs: DataFrame, shards: int = 8, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Every record with its shard (bytes near equal) and its gapless place in the shard."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "slot-map")
    records = to_slots(docs, slots)
    size, rows = slot_loads(records, slots)
    store_map(spark, path, 0, first_map(slots, shards))
    store_map(spark, path, 1, rebalance(load_map(spark, path, 0), size, shards))
    owner = load_map(spark, path, 1)
    before = np.zeros(slots, np.int64)  # rows of the shard's earlier slots
    for shard in range(shards):
        mine = np.flatnonzero(owner == shard)
        before[mine] = np.cumsum(rows[mine]) - rows[mine]
    table = spark.createDataFrame(
        [(s, int(owner[s]), int(before[s])) for s in range(slots)], "virtual_slot int, shard int, before long"
    )
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return records.join(F.broadcast(table), "virtual_slot").select(  # as many rows as slots, whatever the input
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.row_number().over(inside) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(1).alias("map_version"),
    )
