"""Written tables between steps: lineage is cut, and any executor may be lost."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); one is made only for a local master without it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not at:
        at = tempfile.mkdtemp(prefix="meshlake-")  # only where no cluster names a folder
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if a count proves that it has at most ``rows`` rows; else the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side that is never broadcast: for joins where a side is exploded, whose rows Spark counts for no more than the files they come from."""
    return df.hint("merge")


def ranged(df: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """Rows in the order of ``keys``, dealt into ranges: ``_range`` and the row's place in it, ``_row``.

    The sorted rows are written once, since the ranges of a second run could differ.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    return staged(rows.withColumns({"_range": F.shiftright(at, 33), "_row": at.bitwiseAND((1 << 33) - 1)}), "ranged")


def range_offsets(rows: DataFrame, total) -> DataFrame:
    """(_range, _offset): the aggregate ``total`` of all ranges before each; one row a range."""
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_range").agg(total.alias("_size"))
    return sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))


def numbered(df: DataFrame, keys: list[str], name: str = "number", partitions: int | None = None) -> DataFrame:
    """Rows numbered from 0 in the order of ``keys``, without bringing them to one task: the ranges' sizes give the offsets."""
    rows = ranged(df, keys, partitions)
    placed = rows.join(F.broadcast(range_offsets(rows, F.count("*"))), "_range")
    return placed.withColumn(name, F.col("_offset") + F.col("_row")).drop("_range", "_row", "_offset")


def running_totals(df: DataFrame, keys: list[str], totals: dict[str, str]) -> DataFrame:
    """Adds sums over all rows before each in the order of ``keys``: ``totals`` has name -> column. No task sorts more than a range."""
    rows = ranged(df, keys)
    before = Window.partitionBy("_range").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy("_range").agg(*(F.sum(c).alias(f"_{name}") for name, c in totals.items()))
    offsets = per.select("_range", *(F.coalesce(F.sum(f"_{name}").over(ranges), F.lit(0)).alias(f"_{name}") for name in totals))
    out = rows.join(F.broadcast(offsets), "_range")
    out = out.withColumns({name: F.col(f"_{name}") + F.coalesce(F.sum(c).over(before), F.lit(0)) for name, c in totals.items()})
    return out.drop("_range", "_row", *(f"_{name}" for name in totals))
