"""Envelopes of points and boxes, planar or geographic.

A geographic longitude range may cross the 180th meridian: then its west end is above its east
end. The smallest range around a set is the complement of the largest gap. Gaps are looked for in
two levels, inside cells of a tenth of a degree and between cells, so that a group that holds most
of the rows is still dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS_PER_DEGREE = 10


def planar_envelope(points: DataFrame, by: list[str], x: str = "lon", y: str = "lat", z: str = "h") -> DataFrame:
    return points.groupBy(*by).agg(
        F.min(x).alias("left"), F.max(x).alias("right"), F.min(y).alias("bottom"), F.max(y).alias("top"), F.min(z).alias("front"), F.max(z).alias("back")
    )


def _normal(w: Column, e: Column) -> tuple[Column, Column]:
    """A range ends at 180 and begins at -180, never the other way round."""
    return F.when(w == 180, -180.0).otherwise(w), F.when(e == -180, 180.0).otherwise(e)


def point_longitudes(points: DataFrame, by: str, lon: str = "lon") -> DataFrame:
    """(by, w, e): smallest longitude range around each group's points."""
    x = F.col(lon)
    ends = points.groupBy(by).agg(
        F.min(x).alias("lo"), F.max(x).alias("hi"), F.coalesce(F.min(F.when(x >= 0, x)), F.lit(180.0)).alias("pos"),
        F.coalesce(F.max(F.when(x < 0, x)), F.lit(-180.0)).alias("neg"), F.bool_or((x != 0) & (x != -180)).alias("inner"),
    )
    plain = F.col("hi") <= F.col("lo") + 180
    across = F.col("pos") >= F.col("neg") + 180
    at_edge = (F.col("lo") == -180) & (F.col("hi") == 0) & ~F.col("inner")
    pair = lambda w, e: F.struct(w.alias("w"), e.alias("e"))
    local = (
        F.when(plain & at_edge, pair(F.lit(0.0), F.lit(180.0)))
        .when(plain & (F.col("hi") == -180), pair(F.lit(180.0), F.lit(180.0)))
        .when(plain, pair(F.col("lo"), F.col("hi")))
        .when(across & (F.col("neg") == -180), pair(F.col("pos"), F.lit(180.0)))
        .when(across & (F.col("pos") == 180), pair(F.lit(-180.0), F.col("neg")))
        .when(across, pair(F.col("pos"), F.col("neg")))
    )
    ends = ends.select(by, "lo", "hi", local.alias("local"))
    # Only groups spread over the globe need their gaps.
    spread = ends.where("local is null").select(by, "lo", F.when((F.col("lo") == -180) & (F.col("hi") != 180), 180.0).otherwise(F.col("hi")).alias("hi"))
    lons = points.join(spread.select(by), by, "left_semi").select(by, x.alias("x"))
    lons = lons.unionByName(spread.where("hi = 180").select(by, F.col("hi").alias("x"))).distinct()
    lons = lons.withColumn("cell", F.floor(F.col("x") * CELLS_PER_DEGREE))
    inside = Window.partitionBy(by, "cell").orderBy("x")
    stepped = lons.withColumn("prev", F.lag("x").over(inside))
    gap = F.struct((F.col("x") - F.col("prev")).alias("d"), (-F.col("x")).alias("minus_w"), F.col("prev").alias("e"))
    cells = stepped.groupBy(by, "cell").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.max(F.when(F.col("prev").isNotNull(), gap)).alias("own"))
    along = Window.partitionBy(by).orderBy("cell")
    cells = cells.withColumn("prev", F.lag("b").over(along))
    between = F.struct((F.col("a") - F.col("prev")).alias("d"), (-F.col("a")).alias("minus_w"), F.col("prev").alias("e"))
    largest = cells.groupBy(by).agg(F.max(F.greatest("own", F.when(F.col("prev").isNotNull(), between))).alias("g"))
    # The gap over the 180th meridian wins ties.
    both = spread.join(largest, by)
    wraps = (F.col("lo") - F.col("hi") + 360) >= F.col("g.d")
    w, e = _normal(F.when(wraps, F.col("lo")).otherwise(-F.col("g.minus_w")), F.when(wraps, F.col("hi")).otherwise(F.col("g.e")))
    found = both.select(by, pair(w, e).alias("wide"))
    return ends.join(found, by, "left").select(by, F.coalesce("local", "wide").alias("r")).select(by, "r.w", "r.e")


def geographic_envelope(points: DataFrame, by: str) -> DataFrame:
    """Like ``planar_envelope``, the longitudes by ``point_longitudes``."""
    rest = planar_envelope(points, [by]).drop("left", "right")
    lons = point_longitudes(points, by)
    return lons.join(rest, by).select(by, F.col("w").alias("left"), F.col("e").alias("right"), "bottom", "top", "front", "back")


def merge_longitudes(ranges: DataFrame, by: str, w: str = "left", e: str = "right") -> DataFrame:
    """(by, w, e): smallest range around each group's ranges; the whole circle where no gap is left."""
    r = ranges.select(by, F.col(w).cast("double").alias("w"), F.when(F.col(e) < F.col(w), F.col(e) + 360).otherwise(F.col(e)).cast("double").alias("e"))
    r = r.withColumn("cell", F.floor(F.col("w") * CELLS_PER_DEGREE))
    cells = r.groupBy(by, "cell").agg(F.max("e").alias("reach"))
    along = Window.partitionBy(by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(by)
    cells = cells.select(by, "cell", F.max("reach").over(along).alias("before"), (F.max("reach").over(whole) - 360).alias("wrapped"))
    inside = Window.partitionBy(by, "cell").orderBy("w", F.desc("e")).rowsBetween(Window.unboundedPreceding, -1)
    cover = F.greatest(F.col("before"), F.col("wrapped"), F.max("e").over(inside))
    gaps = r.join(cells, [by, "cell"]).select(by, "w", cover.alias("cover"))
    gap = F.struct((F.col("w") - F.col("cover")).alias("d"), (-F.col("w")).alias("minus_w"), F.col("cover").alias("e"))
    best = gaps.groupBy(by).agg(F.max(gap).alias("g"))
    end = F.col("g.e")
    end = F.when(end > 180, end - 360).when(end < -180, end + 360).otherwise(end)
    start = -F.col("g.minus_w")
    point = (start == end) & (F.abs(start) == 180)
    a, b = _normal(start, end)
    full = F.col("g.d") <= 0
    return best.select(by, F.when(full, -180.0).when(point, 180.0).otherwise(a).alias("w"), F.when(full | point, 180.0).otherwise(b).alias("e"))


def merge_envelopes(boxes: DataFrame, by: str, geographic: bool = True) -> DataFrame:
    rest = boxes.groupBy(by).agg(*(f(c).alias(c) for c, f in (("left", F.min), ("right", F.max), ("bottom", F.min), ("top", F.max), ("front", F.min), ("back", F.max))))
    if not geographic:
        return rest
    lons = merge_longitudes(boxes, by)
    return lons.join(rest.drop("left", "right"), by).select(by, F.col("w").alias("left"), F.col("e").alias("right"), "bottom", "top", "front", "back")


def triangle_longitudes(triangles: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """Adds (left, right): the shorter way around three longitudes, never over more than half the globe."""
    lo, hi = F.least(a, b, c), F.greatest(a, b, c)
    mid = F.col(a) + F.col(b) + F.col(c) - lo - hi
    wrap, first, second = lo - hi + 360, mid - lo, hi - mid
    largest = F.greatest(wrap, first, second)
    w = F.when(largest == wrap, lo).when(largest == first, mid).otherwise(hi)
    e = F.when(largest == wrap, hi).when(largest == first, lo).otherwise(mid)
    w, e = _normal(w, e)
    return triangles.withColumns({"left": w, "right": e})


def inflate(boxes: DataFrame, factor: float) -> DataFrame:
    """Widen geographic boxes by a part of their size on each side, latitudes within the poles."""
    from ..functions.geometry import longitude_expand, longitude_size

    d = longitude_size(F.col("left"), F.col("right")) * factor
    span = (F.col("top") - F.col("bottom")) * factor
    out = boxes.withColumns({"_lon": longitude_expand(F.col("left"), F.col("right"), d, d), "_dlat": span})
    return out.withColumns(
        {"left": F.col("_lon.w"), "right": F.col("_lon.e"), "bottom": F.greatest(F.col("bottom") - F.col("_dlat"), F.lit(-90.0)), "top": F.least(F.col("top") + F.col("_dlat"), F.lit(90.0))}
    ).drop("_lon", "_dlat")
