"""Column statistics: moments, four kinds of histogram, percentiles, frequent values, datetimes.

Everything is an aggregate, so partial results combine before the shuffle; histograms are rows
(group, bin, count) and go on as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a histogram that a reader is shown, and values of a list of frequent ones.
SHOWN = 256
#: Bins of the generic histogram, and distinct integers that it keeps exactly.
GENERIC_BINS = 8192
GENERIC_DISTINCT = 65536
#: Bytes of distinct strings beyond which there is no frequency list.
STRING_QUOTA = 10 * 1024 * 1024


def range_stats(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """min, max, count, sum, avg, sample stddev and variance; a single value has stddev 0."""
    v = F.col(value)
    sd = F.coalesce(F.stddev_samp(v), F.lit(0.0))
    return df.groupBy(*by).agg(
        F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.count(v).alias("n"), F.sum(v).cast("double").alias("sum_value"),
        F.coalesce(F.avg(v), F.lit(0.0)).alias("avg_value"), sd.alias("stddev"), (sd * sd).alias("variance"),
    )


def scale_stats(stats: DataFrame, factor: float) -> DataFrame:
    """Finished statistics in another unit; a negative factor swaps the ends."""
    lo, hi = ("min_value", "max_value") if factor >= 0 else ("max_value", "min_value")
    s = F.lit(float(factor))
    return stats.withColumns(
        {
            "min_value": F.col(lo) * s, "max_value": F.col(hi) * s, "sum_value": F.col("sum_value") * s,
            "avg_value": F.col("avg_value") * s, "stddev": F.col("stddev") * abs(factor), "variance": F.col("variance") * s * s,
        }
    )


def unsigned_histogram(df: DataFrame, value: str, shift: int) -> DataFrame:
    """(bin, n): values without their ``shift`` low bits."""
    return df.where(F.col(value).isNotNull()).groupBy(F.shiftright(value, shift).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def resample_bins(histo: DataFrame, hint: int = SHOWN) -> DataFrame:
    """Drop empty ends and merge bins so that ``hint`` at most are left: (bin, n, first_bin, step).

    The range is one row; it joins every bin by broadcast.
    """
    ends = histo.where("n > 0").agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin")).where("first_bin is not null")
    width = F.col("last_bin") - F.col("first_bin") + 1
    ends = ends.select("first_bin", F.ceil(width / F.least(width, F.lit(hint))).cast("int").alias("step"))
    at = F.floor((F.col("bin") - F.col("first_bin")) / F.col("step")).cast("int")
    return histo.where("n > 0").join(F.broadcast(ends)).groupBy(at.alias("bin"), "first_bin", "step").agg(F.sum("n").alias("n"))


def bin_moments(histo: DataFrame, low, width) -> DataFrame:
    """(n, avg_value, stddev) by the bins' centres: bin k spans ``width`` from ``low + k * width``."""
    v, n = low + (F.col("bin") + 0.5) * width, F.col("n")
    out = histo.agg(F.sum(n).alias("n"), F.sum(v * n).alias("s1"), F.sum(v * v * n).alias("s2"))
    var = F.when(F.col("n") > 1, F.greatest((F.col("n") * F.col("s2") - F.col("s1") * F.col("s1")) / (F.col("n") * (F.col("n") - 1)), F.lit(0.0))).otherwise(0.0)
    return out.select("n", (F.col("s1") / F.col("n")).alias("avg_value"), F.sqrt(var).alias("stddev"))


def quantized_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin by rounding to the nearest bin edge, clamped to the ends."""
    k = F.floor((value - low) * (F.lit(float(bins)) / (high - low)) + 0.5)
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), k)).cast("int")


def quantized_histogram(df: DataFrame, value: str, bins: int, sigma: float = 4.0) -> DataFrame:
    """(bin, n, low, high) over the mean plus and minus ``sigma`` deviations, within the actual range."""
    v = F.col(value).cast("double")
    sd = F.coalesce(F.stddev_samp(v), F.lit(0.0))
    span = df.agg(F.greatest(F.min(v), F.avg(v) - sd * sigma).alias("low"), F.least(F.max(v), F.avg(v) + sd * sigma).alias("high"))
    # A single value has no width; it goes to the first bin.
    k = F.when(F.col("high") > F.col("low"), quantized_bin(v, F.col("low"), F.col("high"), bins)).otherwise(0)
    return df.where(v.isNotNull()).join(F.broadcast(span)).groupBy(k.alias("bin"), "low", "high").agg(F.count("*").alias("n"))


def bin_percentiles(histo: DataFrame, bins: int, percents: list[float]) -> DataFrame:
    """(percent, value): percentiles of a quantized histogram, linear inside the bin that holds them.

    The histogram, at most ``bins`` rows, becomes one row of arrays, and every percentile is read from it.
    """
    counts = F.map_from_entries(F.collect_list(F.struct(F.col("bin").cast("int"), F.col("n").cast("long"))))
    whole = histo.groupBy("low", "high").agg(counts.alias("counts"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("counts", i), F.lit(0).cast("long")))
    whole = whole.select("low", "high", dense.alias("n"))
    upto = F.transform(F.sequence(F.lit(1), F.lit(bins)), lambda k: F.aggregate(F.slice("n", 1, k), F.lit(0).cast("long"), lambda a, x: a + x))
    whole = whole.select("low", "high", "n", upto.alias("acc"), F.explode(F.array(*(F.lit(float(p)) for p in percents))).alias("percent"))
    lim = F.col("acc")[bins - 1] * (F.col("percent") / 100.0)
    # The position steps past the first bin whose running count reaches the limit.
    hit = whole.withColumn("lim", lim).withColumn("hit", F.least(F.size(F.filter("acc", lambda a: a < F.col("lim"))), F.lit(bins - 1)))
    at = F.least(F.col("hit") + 1, F.lit(bins - 1))
    y2 = F.get("acc", F.col("hit"))
    y1 = y2 - F.get("n", at)
    alpha = F.when(y1 < y2, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("lim") - y1) / (y2 - y1)))).otherwise(1.0)
    pos = (1 - alpha) * F.greatest(at - 1, F.lit(0)) + alpha * at
    return hit.select("percent", (F.col("low") + pos * (F.col("high") - F.col("low")) / bins).alias("value"))


def histogram_quality(histo: DataFrame, bins: int, ideal: float) -> DataFrame:
    """Count over the weighted distance of bin centres from a preferred median, plus one."""
    centre = (F.col("bin") + 0.5) * (F.col("high") - F.col("low")) / bins + F.col("low")
    return histo.agg((F.sum("n") / (F.sum(F.abs(centre - ideal) * F.col("n")) + 1.0)).alias("quality"))


def exact_histogram(df: DataFrame, value: str) -> DataFrame:
    """(value, n) of every distinct value."""
    return df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))


def exact_stats(histo: DataFrame) -> DataFrame:
    """Weighted moments of an exact histogram; sample variance, never negative."""
    v, n = F.col("value").cast("double"), F.col("n")
    out = histo.agg(F.sum(n).alias("n"), F.sum(v * n).alias("s1"), F.sum(v * v * n).alias("s2"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))
    var = F.when(F.col("n") > 1, F.greatest((F.col("n") * F.col("s2") - F.col("s1") * F.col("s1")) / (F.col("n") * (F.col("n") - 1)), F.lit(0.0))).otherwise(0.0)
    return out.select("n", "min_value", "max_value", F.col("s1").alias("sum_value"), (F.col("s1") / F.col("n")).alias("avg_value"), F.sqrt(var).alias("stddev"))


def resample_exact(histo: DataFrame, bins: int = SHOWN) -> DataFrame:
    """Fixed bins from exact values: as they are while the range is below ``bins``; else each value is shared by two neighbours."""
    ends = histo.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    h = histo.join(F.broadcast(ends))
    lossless = (F.col("hi") - F.col("lo")) < bins
    x = F.lit(float(bins)) / (F.col("hi") - F.col("lo") + 1).cast("double") * (F.col("value") - F.col("lo")).cast("double")
    k = F.floor(x).cast("int")
    part = x - F.floor(x)
    whole = F.array(F.struct((F.col("value") - F.col("lo")).cast("int").alias("bin"), F.col("n").cast("long").alias("n")))
    shared = F.array(
        F.struct(k.alias("bin"), F.floor(F.col("n") * (1 - part) + 0.5).cast("long").alias("n")),
        F.struct(F.least(k + 1, F.lit(bins - 1)).alias("bin"), F.floor(F.col("n") * part + 0.5).cast("long").alias("n")),
    )
    return h.select(F.explode(F.when(lossless, whole).otherwise(shared)).alias("x")).groupBy("x.bin").agg(F.sum("x.n").alias("n")).where("n > 0")


def frequent_values(df: DataFrame, value: str, k: int = SHOWN) -> DataFrame:
    """The ``k`` most frequent values; ties by value."""
    return exact_histogram(df, value).orderBy(F.desc("n"), "value").limit(k)


def frequent_strings(df: DataFrame, value: str, k: int = SHOWN, quota: int = STRING_QUOTA) -> DataFrame:
    """Like ``frequent_values``, but no rows where the distinct strings take ``quota`` bytes or more."""
    counts = exact_histogram(df, value)
    fits = counts.agg(F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("bytes")).where(F.col("bytes") < quota)
    return counts.join(F.broadcast(fits)).drop("bytes").orderBy(F.desc("n"), "value").limit(k)


def datetime_stats(df: DataFrame, value: str) -> DataFrame:
    """Smallest and largest non-empty ISO text, the number of values and of distinct ones."""
    v = F.nullif(F.col(value), F.lit(""))
    return df.agg(F.min(v).alias("min_time"), F.max(v).alias("max_time"), F.count(value).alias("n"), F.countDistinct(value).alias("n_distinct"))


def frequent_times(df: DataFrame, value: str, k: int = SHOWN) -> DataFrame:
    """The ``k`` most frequent non-empty ISO texts; ties by text."""
    return frequent_values(df.where(F.col(value) != ""), value, k)


def generic_histogram(df: DataFrame, value: str, integral: bool, bins: int = GENERIC_BINS, distinct: int = GENERIC_DISTINCT) -> DataFrame:
    """Exact bins for integers of few distinct values, else quantized over the mean and four deviations, resampled to be shown.

    Which of the two is decided by one count of distinct values that stops at the bound.
    """
    if integral and df.select(value).distinct().limit(distinct + 1).count() <= distinct:
        return resample_exact(exact_histogram(df, value)).withColumn("exact", F.lit(True))
    v = F.col(value).cast("double")
    span = df.agg((F.avg(v) - F.coalesce(F.stddev_samp(v), F.lit(0.0)) * 4).alias("low"), (F.avg(v) + F.coalesce(F.stddev_samp(v), F.lit(0.0)) * 4).alias("high"))
    k = F.when(F.col("high") > F.col("low"), quantized_bin(v, F.col("low"), F.col("high"), bins)).otherwise(0)
    counted = df.where(v.isNotNull()).join(F.broadcast(span)).groupBy(k.alias("bin")).agg(F.count("*").alias("n"))
    return resample_bins(counted).select("bin", "n", F.lit(False).alias("exact"))
