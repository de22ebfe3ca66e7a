"""Sharding by rendezvous hashing over weighted shards.

Each pair of a record's key and a shard has a hash, which is read as a number u in (0, 1); the
record goes to the shard with the greatest ``weight / -ln(u)``. So a shard gets a share of the
records in proportion to its weight, and another shard, or a greater weight of one, takes records
only into itself: the scores of the others stay as they were.

Everything is a column expression: a record's shard needs no other record, whatever repeats in the
table. Places within shards need an order over each shard; they come from ranges over (shard, key,
text's hash, row) and the ranges' totals, so no task holds a shard.

Defined cases
-------------
* The key is hashed by its decimal or own text; null keys are one key, which goes to one shard.
* Null and empty texts have size 1 and checksum 0. Equal scores go to the smallest shard number.
* Repeated rows go to the same shard and get places of their own. Further columns are ignored.
* Weights must be above 0, and at least one shard must be named. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table

SHARDS = 16
#: Rows that a range of the places holds, about.
RANGE_ROWS = 2_000_000


def scored(key: Column, shard: int, weight: float, seed: str = "shard") -> Column:
    """(score, -shard) of a key and a shard. The 52 upper bits of the hash, and a half, make u."""
    h = F.xxhash64(F.lit(seed), F.lit(shard), key.cast("string"))
    u = (F.shiftrightunsigned(h, 12).cast("double") + 0.5) / float(1 << 52)
    return F.struct((F.lit(float(weight)) / -F.log(u)).alias("score"), F.lit(-shard).alias("below"))


def shard_of(key: Column, weights: Mapping[int, float], seed: str = "shard") -> Column:
    """Number of the shard of a key: ``weights`` names each shard's weight."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must name a shard at least, each above 0")
    best = [scored(key, s, w, seed) for s, w in sorted(weights.items())]
    return -(F.greatest(*best) if len(best) > 1 else best[0])["below"]


def placed(rows: DataFrame, shard: str, order: list[str], name: str = "slot") -> DataFrame:
    """Numbers the rows of each shard from 0 in the given order; ``rows`` must be a written table.

    The order is total: a row's place in the table comes last, so that even a third of all rows
    with one key is dealt into many ranges.
    """
    spark = rows.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    keys = [shard, *order, "_at"]
    at = F.monotonically_increasing_id()
    dealt = rows.withColumn("_at", at).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    dealt = shared_table(dealt.drop("_at").withColumns({"_range": F.shiftright(at, 33), "_row": at.bitwiseAND((1 << 33) - 1)}), "places")
    # A row a range and shard: where the shard begins in the range, and how many of it are in ranges before.
    before = Window.partitionBy(shard).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_range", shard).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    offsets = totals.select("_range", shard, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"))
    # A range meets few shards: the rows of offsets are at most ranges + shards.
    return dealt.join(F.broadcast(offsets), ["_range", shard]).withColumn(name, F.col("_row") + F.col("_offset")).drop("_range", "_row", "_offset")


def shard_documents(docs: DataFrame, shards: int = SHARDS, weights: Mapping[int, float] | None = None) -> DataFrame:
    """Each document's shard, its place there, and its shard if there was one more of weight 1."""
    weights = dict(weights or dict.fromkeys(range(shards), 1.0))
    grown = weights | {max(weights) + 1: 1.0}
    key, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(
        key.alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"),
        shard_of(key, weights).alias("shard"), shard_of(key, grown).alias("grown_shard"), F.xxhash64(text).alias("_h"),
    )
    out = placed(shared_table(rows, "shards"), "shard", ["doc_id", "_h"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
