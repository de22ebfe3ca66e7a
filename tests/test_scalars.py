"""Column functions on values that the small tables don't have."""

from __future__ import annotations

import base64
import math

import duckdb
from pyspark.sql import functions as F

from meshlake.functions import geometry, text
from meshlake.plans import catalogue

from .compare import rows_of_spark, rows_of_sql


def test_base64_of_long_values_is_one_line(spark):
    values = ["", "a", "x" * 57, "x" * 58, "é" * 500]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", text.base64_of(F.col("v").cast("binary")).alias("e")).collect()
    assert {r.v: r.e for r in rows} == {v: base64.b64encode(v.encode()).decode() for v in values}


def test_triangle_inverse(spark):
    rows = [([2.0, 0.0, 0.0, 3.0, 4.0, 0.0, 5.0, 7.0, 8.0],), ([0.0, 0.0, 0.0, 3.0, 1.0, 0.0, 5.0, 7.0, 2.0],)]
    whole, singular = (r.i for r in spark.createDataFrame(rows, "m array<double>").select(geometry.triangle_inverse(F.col("m")).alias("i")).collect())
    assert [round(x, 12) + 0.0 for x in whole] == [0.5, 0.0, 0.0, -0.375, 0.25, 0.0, 0.015625, -0.21875, 0.125]
    assert singular[0] == math.inf and [singular[i] for i in (1, 2, 4, 5, 7, 8)] == [0.0, 0.0, 1.0, 0.0, -3.5, 0.5]


def test_matrix_of_a_zero_value(spark, tmp_path):
    spark.createDataFrame([(1, 0.0), (2, 4.0)], "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: (r.det, r.unit, r.off, r.inv0) for r in catalogue.QUERIES["matrix_ops"](spark, str(tmp_path)).collect()}
    assert got == {1: (0.0, 1.0, 0.0, math.inf), 2: (40.0, 1.0, 0.0, 0.25)}


def test_matrix_of_odd_values_as_its_sql(spark, tmp_path):
    values = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, -1.0, -25.6, 5.12, 640.0, 1e-17, 1e-308, 465093.7227091316, 999988550.2023748, 1e155, -1e200, 1e308]
    spark.createDataFrame(list(enumerate(values)), "event_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    columns, want = rows_of_sql(con, catalogue.ORACLE_SQL["matrix_ops"])
    got = catalogue.QUERIES["matrix_ops"](spark, str(tmp_path))
    assert sorted(got.columns) == columns and rows_of_spark(got) == want
