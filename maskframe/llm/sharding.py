"""Sharding by fixed virtual slots.

Records hash into some thousands of slots that never change.  Bytes are summed for each slot, and
a versioned map from slot to shard puts them on shards of near equal bytes.  Rebalancing, and
adding shards, edits the map: only slots that must move do, and the version goes up.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskframe.llm.common import checkpoint_folder, cut, documents

SLOTS = 8192
SHARDS = 40
#: Bytes that a record takes besides its text.
OVERHEAD = 16
#: Rows of a virtual slot are numbered in this many parts, so that no task has a whole slot.
PARTS = 16
_MAP = "version int, virtual_slot int, shard int, bytes long"


def slot_map(slot_bytes: dict[int, int], shards: int, slots: int = SLOTS) -> list[tuple[int, int, int, int]]:
    """Version 1 of a map: (version, virtual slot, shard, bytes); the largest slots go first, each to the least filled shard."""
    heap = [(0, 0, s) for s in range(shards)]
    out = []
    for slot in sorted(range(slots), key=lambda v: (-slot_bytes.get(v, 0), v)):
        filled, n, shard = heapq.heappop(heap)
        size = slot_bytes.get(slot, 0)
        out.append((1, slot, shard, size))
        heapq.heappush(heap, (filled + size, n + 1, shard))
    return sorted(out, key=lambda r: r[1])


def rebalance(current: list[tuple[int, int, int, int]], slot_bytes: dict[int, int], shards: int) -> list[tuple[int, int, int, int]]:
    """The next version for new bytes or another number of shards: slots leave shards above the mean only, for the least filled."""
    version = current[0][0] + 1
    size = {slot: slot_bytes.get(slot, 0) for _, slot, _, _ in current}
    of = {slot: shard for _, slot, shard, _ in current}
    held: dict[int, list[int]] = {s: [] for s in range(shards)}
    homeless = []
    for slot, shard in of.items():
        held[shard].append(slot) if shard < shards else homeless.append(slot)
    filled = {s: sum(size[v] for v in held[s]) for s in held}
    mean = sum(size.values()) / shards
    for shard in held:
        for slot in sorted(held[shard], key=lambda v: (-size[v], v)):  # large ones first: few move
            if size[slot] and filled[shard] - size[slot] >= mean:
                homeless.append(slot)
                filled[shard] -= size[slot]
    heap = [(filled[s], s) for s in held]
    heapq.heapify(heap)
    for slot in sorted(homeless, key=lambda v: (-size[v], v)):
        least, shard = heapq.heappop(heap)
        of[slot] = shard
        heapq.heappush(heap, (least + size[slot], shard))
    return [(version, slot, of[slot], size[slot]) for slot in sorted(of)]


def write_map(spark: SparkSession, rows: list[tuple[int, int, int, int]], path: str) -> None:
    """Append a version to the stored maps."""
    spark.createDataFrame(rows, _MAP).coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> list[tuple[int, int, int, int]]:
    """A stored version, by default the latest."""
    stored = spark.read.parquet(path).select("version", "virtual_slot", "shard", "bytes")
    version = version or stored.agg(F.max("version")).first()[0]
    return sorted((tuple(r) for r in stored.where(F.col("version") == version).collect()), key=lambda r: r[1])


def next_map(spark: SparkSession, slot_bytes: dict[int, int], shards: int, path: str, slots: int = SLOTS) -> list[tuple[int, int, int, int]]:
    """Store the next version for these bytes, and read it: the latest stored one edited by ``rebalance``, or version 1 where ``path`` is not there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    stored = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    made = rebalance(read_map(spark, path), slot_bytes, shards) if stored else slot_map(slot_bytes, shards, slots)
    write_map(spark, made, path)
    return read_map(spark, path, made[0][0])


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of every record; the text is not kept."""
    text = F.coalesce("text", F.lit(""))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    return chosen.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots)).cast("int"))


def bytes_by_slot(records: DataFrame) -> dict[int, int]:
    """Summed sizes; one row a slot is all the driver gets."""
    return {r[0]: r[1] for r in records.groupBy("virtual_slot").agg(F.sum("size")).collect()}


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Every record with its shard, by the law ``bytes``: summed sizes of shards are near equal.

    Returns doc_id, size (UTF-8 bytes of the text and 16), text_crc32 (0 for null), law, shard,
    slot (place of the record in its shard, gapless from 0), grown_shard (null: the law is not
    ``key``), virtual_slot and map_version.  ``path`` is the folder of the stored maps: its latest
    version is edited by ``rebalance``, or version 1 is made where it is not there yet, and the new
    version is stored and read back.  Without a path the map is stored in the checkpoint folder.

    A null text takes 16 bytes; null ids hash like any value.  A record's virtual slot comes from
    its id, checksum and size, so records of one text spread over slots; exact repeats of a row
    share one slot and are numbered in some order.  An empty table gives no rows.  Other columns
    are not looked at.

    Records are numbered in parts of slots; offsets of parts come from a table of one row a part.
    """
    spark = docs.sparkSession
    records = cut(sized(docs, slots).withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int")))
    slot_bytes = bytes_by_slot(records)
    made = next_map(spark, slot_bytes, shards, path or f"{checkpoint_folder(spark)}/shard-maps-{uuid.uuid4().hex}", slots)
    where = F.broadcast(spark.createDataFrame(made, _MAP).select("virtual_slot", "shard"))  # one row a slot
    parts = records.groupBy("virtual_slot", "part").agg(F.count("*").alias("n")).join(where, "virtual_slot")
    offset = F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select("virtual_slot", "part", "shard", F.coalesce(offset, F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    return records.withColumn("place", place).join(offsets, ["virtual_slot", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(made[0][0]).cast("int").alias("map_version"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))
