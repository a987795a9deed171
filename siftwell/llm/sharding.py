"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every shard scores every key; a record goes to the best score. With ``u`` uniform from a hash of
key and shard, the score is -ln(u) / weight and the least wins, so a shard gets its weight's
share, and a new shard takes records only into itself. Key and shards decide alone: no counts,
no order of rows, no state.

Slots number the rows of a shard from 0 without gaps: rows are dealt to ``PARTS`` parts of each
shard by a hash of key, text and the partition they were read in, counted, and numbered inside
their part from the part's offset, so no task holds a shard, or all rows of one key. The parts are
written before they are counted, so slots hold within a run; a run over an input that is split in
another way numbers a shard's rows in another order. Equal rows get slots of their own. A null text has no bytes; a null key hashes as
a string of its own. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import stored

PARTS = 256
ROW_BYTES = 16


def unit_hash(key: Column, salt: str) -> Column:
    """A double in (0, 1): 52 bits of the MD5 of key and salt."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{salt}"))), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: dict[int, float]) -> Column:
    """struct(cost, shard) of the shard that wins the key."""
    scored = [F.struct((-F.log(unit_hash(key, str(s))) / w).alias("cost"), F.lit(s).alias("shard")) for s, w in weights.items()]
    return F.array_min(F.array(*scored))


def shard(docs: DataFrame, weights: dict[int, float], extra: dict[int, float], key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: grown_shard once ``extra`` shards are added."""
    key = F.coalesce(F.col(key_col).cast("string"), F.lit("null key"))
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(key_col).cast("long").alias("doc_id"),
        (F.octet_length(raw) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        rendezvous(key, weights).alias("now"),
        rendezvous(key, extra).alias("new"),
        F.pmod(F.xxhash64(key, raw, F.spark_partition_id()), F.lit(PARTS)).cast("int").alias("part"),
    ).select("doc_id", "size", "text_crc32", F.col("now.shard").alias("shard"), F.least("now", "new")["shard"].alias("grown_shard"), "part")
    rows = stored(rows, "shards")
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    placed = rows.withColumn("inside", inside).join(F.broadcast(offsets), ["shard", "part"])  # at most PARTS rows a shard
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("inside") - 1).cast("long").alias("slot"), "grown_shard")
