"""Queries of the column statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import statistics as st
from .inputs import table
from .registry import query

_R = lambda c, n=6: F.round(c, n).alias(c)

_RANGE = """select l_returnflag, round(min(l_quantity), 6) as min_value, round(max(l_quantity), 6) as max_value, count(l_quantity) as n,
  round(sum(l_quantity), 4) as sum_value, round(avg(l_quantity), 6) as avg_value, round(stddev_samp(l_quantity), 6) as stddev,
  round(stddev_samp(l_quantity) * stddev_samp(l_quantity), 5) as variance from lineitem group by 1"""


@query(_RANGE)
def stats_range_stddev(spark, sf):
    out = st.range_stats(table(spark, sf, "lineitem"), "l_quantity", ["l_returnflag"])
    return out.select("l_returnflag", _R("min_value"), _R("max_value"), "n", _R("sum_value", 4), _R("avg_value"), _R("stddev"), _R("variance", 5))


@query("""select l_returnflag, round(max(l_extendedprice) * -0.3048, 5) as min_value, round(min(l_extendedprice) * -0.3048, 5) as max_value, count(*) as n,
  round(sum(l_extendedprice) * -0.3048, 2) as sum_value, round(avg(l_extendedprice) * -0.3048, 5) as avg_value,
  round(stddev_samp(l_extendedprice) * 0.3048, 5) as stddev from lineitem group by 1""")
def stats_scaled(spark, sf):
    out = st.scale_stats(st.range_stats(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"]), -0.3048)
    return out.select("l_returnflag", _R("min_value", 5), _R("max_value", 5), "n", _R("sum_value", 2), _R("avg_value", 5), _R("stddev", 5))


@query("""with d as (select event_type, date_trunc('day', ts) as day, min(value) lo, max(value) hi, count(*) c, sum(value) s, sum(value * value) s2 from events group by 1, 2)
select event_type, min(lo) as min_value, max(hi) as max_value, cast(sum(c) as bigint) as n, round(sum(s) / sum(c), 6) as avg_value,
  round(sqrt(greatest((sum(c) * sum(s2) - sum(s) * sum(s)) / (sum(c) * (sum(c) - 1)), 0)), 5) as stddev from d group by 1""")
def stats_merged_partials(spark, sf):
    """Daily partial statistics merged per event type."""
    v = F.col("value")
    parts = table(spark, sf, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(
        F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("c"), F.sum(v).alias("s"), F.sum(v * v).alias("s2"))
    n, s, s2 = F.sum("c"), F.sum("s"), F.sum("s2")
    return parts.groupBy("event_type").agg(
        F.min("lo").alias("min_value"), F.max("hi").alias("max_value"), n.alias("n"), F.round(s / n, 6).alias("avg_value"),
        F.round(F.sqrt(F.greatest((n * s2 - s * s) / (n * (n - 1)), F.lit(0.0))), 5).alias("stddev"))


@query("select cast(p_size >> 2 as integer) as bin, count(*) as n from part group by 1")
def histo_unsigned(spark, sf):
    return st.unsigned_histogram(table(spark, sf, "part"), "p_size", 2)


@query("""with h as (select cast(p_size >> 1 as integer) as bin, count(*) as n from part group by 1),
e as (select min(bin) as first_bin, max(bin) as last_bin from h),
s as (select first_bin, cast(ceil((last_bin - first_bin + 1)::double / least(last_bin - first_bin + 1, 8)) as integer) as step from e)
select cast((bin - first_bin) // step as integer) as bin, first_bin, step, cast(sum(n) as bigint) as n from h, s group by 1, 2, 3""")
def histo_unsigned_resampled(spark, sf):
    return st.resample_bins(st.unsigned_histogram(table(spark, sf, "part"), "p_size", 1), 8).select("bin", "first_bin", "step", "n")


@query("with h as (select p_size >> 2 as bin, count(*) as n from part group by 1), m as (select sum(n) as n, sum((bin + 0.5) * 4 * n)::double as s1, sum((bin + 0.5) * 4 * ((bin + 0.5) * 4) * n)::double as s2 from h) select n::bigint as n, round(s1 / n, 6) as avg_value, round(sqrt((n * s2 - s1 * s1) / (n * (n - 1))), 6) as stddev from m")
def histo_bin_moments(spark, sf):
    """Mean and deviation as the bins' centres give them."""
    out = st.bin_moments(st.unsigned_histogram(table(spark, sf, "part"), "p_size", 2), F.lit(0.0), F.lit(4.0))
    return out.select("n", F.round("avg_value", 6).alias("avg_value"), F.round("stddev", 6).alias("stddev"))


_QUANT = """r as (select avg(l_extendedprice) a, stddev_samp(l_extendedprice) s, min(l_extendedprice) mn, max(l_extendedprice) mx from lineitem),
b as (select greatest(mn, a - s * 4) as low, least(mx, a + s * 4) as high from r),
h as (select cast(greatest(0, least(63, floor((l_extendedprice - low) * (64.0::double / (high - low)) + 0.5))) as integer) as bin, low, high, count(*) as n
  from lineitem, b group by 1, 2, 3)"""


@query("with " + _QUANT + " select bin, round(low, 6) as low, round(high, 6) as high, n from h")
def histo_quantized(spark, sf):
    return st.quantized_histogram(table(spark, sf, "lineitem"), "l_extendedprice", 64).select("bin", _R("low"), _R("high"), "n")


@query("with " + _QUANT + """, e as (select min(bin) as first_bin, max(bin) as last_bin from h),
s as (select first_bin, cast(ceil((last_bin - first_bin + 1)::double / least(last_bin - first_bin + 1, 10)) as integer) as step from e)
select cast((bin - first_bin) // step as integer) as bin, first_bin, step, cast(sum(n) as bigint) as n from h, s group by 1, 2, 3""")
def histo_quantized_resampled(spark, sf):
    return st.resample_bins(st.quantized_histogram(table(spark, sf, "lineitem"), "l_extendedprice", 64), 10).select("bin", "first_bin", "step", "n")


@query("with " + _QUANT + """, d as (select g.bin, coalesce(h.n, 0) as n from (select cast(range as integer) as bin from range(64)) g left join h on g.bin = h.bin),
run as (select bin, n, sum(n) over (order by bin) as acc, sum(n) over () as total from d),
p as (select unnest([10.0, 50.0, 90.0])::double as percent),
hit as (select percent, min(bin) as hit, any_value(total) * percent / 100.0 as lim from run, p where acc >= total * percent / 100.0 group by percent),
x as (select percent, least(hit + 1, 63) as pos, lim, run.acc as y2 from hit join run on run.bin = hit.hit),
y as (select x.*, y2 - run.n as y1 from x join run on run.bin = x.pos),
z as (select percent, pos, case when y1 < y2 then greatest(0.0, least(1.0, (lim - y1) / (y2 - y1)))::double else 1.0::double end as alpha from y)
select percent, round(low + ((1 - alpha) * greatest(pos - 1, 0) + alpha * pos) * (high - low) / 64, 4) as value from z, b""")
def histo_percentile(spark, sf):
    histo = st.quantized_histogram(table(spark, sf, "lineitem"), "l_extendedprice", 64)
    return st.bin_percentiles(histo, 64, [10.0, 50.0, 90.0]).select("percent", _R("value", 4))


@query("with " + _QUANT + " select round(sum(n) / (sum(abs((bin + 0.5) * (high - low) / 64 + low - 30000.0) * n) + 1.0), 9) as quality from h")
def histo_quality(spark, sf):
    return st.histogram_quality(st.quantized_histogram(table(spark, sf, "lineitem"), "l_extendedprice", 64), 64, 30000.0).select(_R("quality", 9))


@query("select l_linenumber as value, count(*) as n from lineitem group by 1")
def histo_exact(spark, sf):
    return st.exact_histogram(table(spark, sf, "lineitem"), "l_linenumber")


@query("""select count(*) as n, min(p_size) as min_value, max(p_size) as max_value, sum(p_size)::double as sum_value, round(avg(p_size), 6) as avg_value,
  round(stddev_samp(p_size), 6) as stddev from part""")
def histo_exact_stats(spark, sf):
    out = st.exact_stats(st.exact_histogram(table(spark, sf, "part"), "p_size"))
    return out.select("n", "min_value", "max_value", "sum_value", _R("avg_value"), _R("stddev"))


@query("""with h as (select cast(l_quantity as integer) as value, count(*) as n from lineitem group by 1), e as (select min(value) lo, max(value) hi from h),
x as (select n, 16.0::double / (hi - lo + 1) * (value - lo) as x from h, e),
w as (select cast(floor(x) as integer) as bin, floor(n * (1 - (x - floor(x))) + 0.5) as n from x union all select least(cast(floor(x) as integer) + 1, 15), floor(n * (x - floor(x)) + 0.5) from x)
select bin, cast(sum(n) as bigint) as n from w group by bin having sum(n) > 0""")
def histo_resample(spark, sf):
    quantity = table(spark, sf, "lineitem").select(F.col("l_quantity").cast("int").alias("q"))
    return st.resample_exact(st.exact_histogram(quantity, "q"), 16)


@query("""with h as (select p_size as value, count(*) as n from part group by 1)
select cast(value - (select min(value) from h) as integer) as bin, n, true as exact from h""")
def histo_generic_integers(spark, sf):
    return st.generic_histogram(table(spark, sf, "part"), "p_size", True)


@query("""with r as (select avg(value) - 4 * stddev_samp(value) as low, avg(value) + 4 * stddev_samp(value) as high from events),
h as (select cast(greatest(0, least(8191, floor((value - low) * (8192.0::double / (high - low)) + 0.5))) as integer) as bin, count(*) as n from events, r group by 1),
e as (select min(bin) as first_bin, max(bin) as last_bin from h),
s as (select first_bin, cast(ceil((last_bin - first_bin + 1)::double / least(last_bin - first_bin + 1, 256)) as integer) as step from e)
select cast((bin - first_bin) // step as integer) as bin, cast(sum(n) as bigint) as n, false as exact from h, s group by 1""")
def histo_generic_floats(spark, sf):
    return st.generic_histogram(table(spark, sf, "events"), "value", False)


@query("select event_type as value, count(*) as n from events group by 1 order by n desc, value limit 3")
def top_frequent_values(spark, sf):
    return st.frequent_values(table(spark, sf, "events"), "event_type", 3)


@query("select p_brand as value, count(*) as n from part group by 1 order by n desc, value limit 10")
def top_frequent_strings(spark, sf):
    return st.frequent_strings(table(spark, sf, "part"), "p_brand", 10)


@query("select p_name as value, count(*) as n from part where false group by 1")
def top_frequent_strings_over_quota(spark, sf):
    """Too many distinct names for the quota: no list at all."""
    return st.frequent_strings(table(spark, sf, "part"), "p_name", 10, quota=16)


@query("""with t as (select strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') as iso from events)
select min(iso) as min_time, max(iso) as max_time, count(iso) as n, count(distinct iso) as n_distinct from t""")
def datetime_stats(spark, sf):
    iso = table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso"))
    return st.datetime_stats(iso, "iso")


@query("select strftime(date_trunc('day', ts), '%Y-%m-%d') as value, count(*) as n from events group by 1 order by n desc, value limit 5")
def frequent_times(spark, sf):
    """The five busiest days."""
    return st.frequent_times(table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day")), "day", 5)
