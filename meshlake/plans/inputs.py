"""Driver tables and the spatial inputs derived from them, the same on both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fid, lon, lat, h, grp): one point per event, spread over the globe."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("fid"),
        ((F.col("event_id") * 7919) % 360001 / F.lit(1000.0) - 180.0).alias("lon"),
        ((F.col("event_id") * 104729) % 180001 / F.lit(1000.0) - 90.0).alias("lat"),
        F.col("value").alias("h"),
        F.col("event_type").alias("grp"),
    )


PTS = """pts as (
  select event_id as fid, ((event_id * 7919) % 360001) / 1000.0::double - 180.0::double as lon,
         ((event_id * 104729) % 180001) / 1000.0::double - 90.0::double as lat, value as h, event_type as grp
  from events)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, left, right, bottom, top, front, back): a box of a degree at each point."""
    return points(spark, sf_dir).select(
        F.col("fid").alias("id"),
        F.col("lon").alias("left"),
        F.least(F.col("lon") + 1, F.lit(180.0)).alias("right"),
        F.col("lat").alias("bottom"),
        F.least(F.col("lat") + 1, F.lit(90.0)).alias("top"),
        F.lit(0.0).alias("front"),
        F.col("h").alias("back"),
    )


BOXES = PTS + """, boxes as (
  select fid as id, lon as "left", least(lon + 1, 180.0::double) as "right", lat as bottom, least(lat + 1, 90.0::double) as top,
         0.0::double as front, h as back from pts)"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, parent_id, ordinal, depth): world, regions, nations, customers."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    root = spark.range(1).select(F.lit(0).cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.lit(0).cast("long").alias("ordinal"), F.lit(0).alias("depth"))
    levels = (
        (region, F.col("r_regionkey") + 1, F.lit(0), F.col("r_regionkey"), 1),
        (nation, F.col("n_nationkey") + 1001, F.col("n_regionkey") + 1, F.col("n_nationkey"), 2),
        (customer, F.col("c_custkey") + 1_000_001, F.col("c_nationkey") + 1001, F.col("c_custkey"), 3),
    )
    for df, node, parent, ordinal, depth in levels:
        root = root.unionByName(df.select(node.cast("long").alias("node_id"), parent.cast("long").alias("parent_id"), ordinal.cast("long").alias("ordinal"), F.lit(depth).alias("depth")))
    return root


TREE = """tree as (
  select 0::bigint as node_id, null::bigint as parent_id, 0::bigint as ordinal, 0 as depth
  union all select r_regionkey + 1, 0, r_regionkey, 1 from region
  union all select n_nationkey + 1001, n_regionkey + 1, n_nationkey, 2 from nation
  union all select c_custkey + 1000001, c_nationkey + 1001, c_custkey, 3 from customer)"""
