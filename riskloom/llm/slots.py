"""Sharding by fixed virtual slots and a versioned slot-to-shard map (DataFrame functions only).

Every row hashes, by id and text, into one of a fixed number of slots, so neither
a null nor a repeated id fills one. Bytes are summed per slot,
slots are dealt to shards so that bytes are near equal, and the map is a table
with a version. Rebalancing edits the map and leaves the hash alone, so a slot
moves whole or stays.

Defined results: a null id hashes like no other; a null text has no bytes
and size 1; rows of one id and text share a slot; an empty table gives no rows and
a map of empty slots; extra columns are ignored, but kept by :func:`write_shards`.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.shared import free_name, kept, ordered, ranked

SLOTS = 4096
SHARDS = 16
_MAP = "slot_no int, shard int, bytes long, version int"


def slot_of(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    """The slot of a row: its id and text decide, and the number of slots."""
    key = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.pmod(F.xxhash64(key, doc_id.isNull(), F.coalesce(text, F.lit(""))), F.lit(slots)).cast("int")


def sized(docs: DataFrame, slots: int = SLOTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, slot_no`` of every row; the text itself is not carried on."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        slot_of(F.col(doc_id), F.col(text), slots).alias("slot_no"))


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes per slot: at most ``slots`` numbers reach the driver, whatever the input."""
    out = [0] * slots
    for row in rows.groupBy("slot_no").agg(F.sum("size").alias("bytes")).collect():
        out[row["slot_no"]] = row["bytes"]
    return out


def first_map(sizes: list[int], shards: int = SHARDS) -> list[int]:
    """Shard of every slot: the heaviest slot first, each to the lightest shard."""
    heap = [(0, s) for s in range(shards)]
    out = [0] * len(sizes)
    for slot in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + sizes[slot], shard))
    return out


def edited_map(old: list[int], sizes: list[int], shards: int, slack: float = 0.01) -> list[int]:
    """The next version of a map: only slots of shards above the mean (or gone) move.

    ``shards`` may be larger or smaller than before. A shard above ``1 + slack``
    times the mean gives slots away, smallest first, until it is not, and every
    slot given away goes to the lightest shard.
    """
    out, load = list(old), [0] * shards
    free = [k for k, s in enumerate(old) if s >= shards]
    held: list[list[int]] = [[] for _ in range(shards)]
    for k, s in enumerate(old):
        if s < shards:
            load[s] += sizes[k]
            held[s].append(k)
    mean = sum(sizes) / shards
    for s in range(shards):
        for k in sorted(held[s], key=lambda k: (sizes[k], k)):
            if load[s] <= mean * (1 + slack):
                break
            if load[s] - sizes[k] < mean * (1 - slack) and load[s] <= mean + sizes[k]:
                break
            load[s] -= sizes[k]
            free.append(k)
    heap = [(b, s) for s, b in enumerate(load)]
    heapq.heapify(heap)
    for k in sorted(free, key=lambda k: (-sizes[k], k)):
        b, s = heapq.heappop(heap)
        out[k] = s
        heapq.heappush(heap, (b + sizes[k], s))
    return out


def _numbers(spark: SparkSession, values: list[int], name: str, kind: str) -> DataFrame:
    """One number per slot as a table."""
    text = F.split(F.lit(",".join(map(str, values))), ",")
    return spark.range(0, 1, 1, 1).select(F.posexplode(text).alias("slot_no", "v")).select("slot_no", F.col("v").cast(kind).alias(name))


def write_map(spark: SparkSession, path: str, shard_of: list[int], sizes: list[int], version: int) -> None:
    """Store one version of the map; writing a version again replaces it."""
    table = _numbers(spark, shard_of, "shard", "int").join(_numbers(spark, sizes, "bytes", "long"), "slot_no")
    table.select("slot_no", "shard", "bytes", F.lit(version).alias("version")).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(_MAP).parquet(f"{path}/version={version}").select("slot_no", "shard")


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Add ``shard`` and ``slot``: the gapless place of the row in its shard (by slot, then id).

    The map has one row per slot and is broadcast. Places are numbered from one
    global order, so neither a shard nor a slot is gathered in a task.
    """
    placed = rows.join(F.broadcast(slot_map), "slot_no")
    keys = [F.col(c) for c in ("shard", "slot_no", "doc_id", "text_crc32", "size")]
    return ranked(ordered(placed, *keys, name="shards"), F.col("shard"), "slot").drop("__row")


def shard_table(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, slot_no, shard, slot`` of every row.

    With ``map_path`` the map is stored there as version 0 and read back.
    """
    spark = docs.sparkSession
    rows = kept(sized(docs, slots), "sized")
    sizes = slot_bytes(rows, slots)
    shard_of = first_map(sizes, shards)
    if map_path is None:
        slot_map = _numbers(spark, shard_of, "shard", "int")
    else:
        write_map(spark, map_path, shard_of, sizes, 0)
        slot_map = read_map(spark, map_path, 0)
    return place(rows, slot_map)


def rebalanced(docs: DataFrame, map_path: str, version: int, shards: int, slots: int = SLOTS) -> DataFrame:
    """Read the map of ``version``, edit it for the bytes of ``docs`` and ``shards``, and store it as the next version.

    Returns the new map. The old version stays, so readers of it are not disturbed.
    """
    spark = docs.sparkSession
    old = [0] * slots
    for row in read_map(spark, map_path, version).collect():
        old[row["slot_no"]] = row["shard"]
    sizes = slot_bytes(sized(docs, slots), slots)
    write_map(spark, map_path, edited_map(old, sizes, shards), sizes, version + 1)
    return read_map(spark, map_path, version + 1)


def write_shards(docs: DataFrame, path: str, map_path: str, version: int, slots: int = SLOTS, files: int = 8) -> None:
    """Write whole documents as Parquet, one folder ``shard=k`` per shard of the map, under ``path/version=n``.

    A shard is dealt over ``files`` tasks by slot; writing a version again replaces it.
    """
    shard, slot = free_name(docs, "shard"), free_name(docs, "slot_no")
    slot_map = read_map(docs.sparkSession, map_path, version).withColumnsRenamed({"shard": shard, "slot_no": slot})
    placed = docs.withColumn(slot, slot_of(F.col("doc_id"), F.col("text"), slots)).join(F.broadcast(slot_map), slot)
    dealt = placed.repartition(shard, F.pmod(F.col(slot), F.lit(files))).drop(slot)
    dealt.write.mode("overwrite").partitionBy(shard).parquet(f"{path}/version={version}")
