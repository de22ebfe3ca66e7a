"""Date columns of a layer: converted as a whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import to_iso8601


def date_verdict(df: DataFrame, column: str, mask: str, place: str) -> DataFrame:
    """One row (n_bad, first_bad): how many texts don't fit ``mask``, and the first of them, (place, text), in the order of ``place``.

    Null and empty texts are right as they are.
    """
    bad = F.col(column).isNotNull() & to_iso8601(F.col(column), mask).isNull()
    first = F.min(F.when(bad, F.struct(F.col(place).alias("place"), F.col(column).alias("text"))))
    return df.agg(F.count_if(bad).alias("n_bad"), first.alias("first_bad"))


def convert_date_column(df: DataFrame, column: str, mask: str, place: str, offset_minutes: int = 0) -> DataFrame:
    """Adds ``<column>_iso``, ``<column>_bad`` and ``<column>_first_bad``.

    The verdict on the whole column is a partial aggregate and a scalar of the same plan: if one
    text can't be read, no value is converted, and the first such text is named on each row.
    """
    verdict = date_verdict(df, column, mask, place)
    one = verdict.select(F.struct("n_bad", "first_bad").alias("v")).scalar()
    iso = to_iso8601(F.col(column), mask, offset_minutes)
    out = df.withColumn("_v", one)
    return out.withColumns({f"{column}_iso": F.when(F.col("_v.n_bad") == 0, iso), f"{column}_bad": F.col("_v.n_bad"), f"{column}_first_bad": F.col("_v.first_bad")}).drop("_v")
