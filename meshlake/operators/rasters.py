"""Rasters as rows of pixels and grid points: pyramids, stencils, tiles, resampling, tile meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def raster_issues(pixels: DataFrame) -> DataFrame:
    """(code): not square, or a side that is no power of two."""
    size = pixels.agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    codes = F.array(F.when(F.col("w") != F.col("h"), "not square"), F.when(F.bit_count("w") != 1, "not a power of two"))
    return size.select(F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"))


def elevation(raw: DataFrame, unit: float) -> DataFrame:
    """Heights of inverted 16-bit grey values."""
    return raw.select("x", "y", ((F.lit(65535) - F.col("raw")) * F.lit(float(unit))).alias("z"))


def halve_pixels(pixels: DataFrame, rounding: int = 2, channels: str = "rgb") -> DataFrame:
    """Averages of 2 x 2 pixels; ``rounding`` is added to the sum of four before it is divided."""
    at = lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
    return pixels.groupBy(at("x"), at("y")).agg(*(F.floor((F.sum(c) + rounding) / 4).cast("int").alias(c) for c in channels))


def pixel_pyramid(pixels: DataFrame, size: int, smallest: int, rounding: int = 2, channels: str = "rgb") -> DataFrame:
    """All levels from the base (0) to ``smallest``; a pixel of every level comes from the one before."""
    level, out, n = pixels, pixels.withColumn("level", F.lit(0)), 0
    while size > smallest:
        level, size, n = halve_pixels(level, rounding, channels), size // 2, n + 1
        out = out.unionByName(level.withColumn("level", F.lit(n)))
    return out


def halve_grid(grid: DataFrame) -> DataFrame:
    """Every second grid point, averaged with those of its four neighbours that exist.

    A point sends its height to the kept points that it touches: one shuffle, no self-join.
    """
    moves = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))))
    sent = grid.select("x", "y", "z", F.explode(moves).alias("m")).select((F.col("x") + F.col("m.dx")).alias("x"), (F.col("y") + F.col("m.dy")).alias("y"), "z", (F.col("m.dx") == 0).alias("cx"), (F.col("m.dy") == 0).alias("cy"))
    kept = sent.where("x % 2 = 0 and y % 2 = 0").groupBy((F.col("x") / 2).cast("int").alias("x"), (F.col("y") / 2).cast("int").alias("y"))
    # What lies outside the grid got no height of its own and is no point.
    return kept.agg(F.avg("z").alias("z"), F.bool_or(F.col("cx") & F.col("cy")).alias("real")).where("real").drop("real")


def grid_pyramid(grid: DataFrame, size: int, smallest: int) -> DataFrame:
    level, out, n = grid, grid.withColumn("level", F.lit(0)), 0
    while size > smallest:
        level, size, n = halve_grid(level), size // 2, n + 1
        out = out.unionByName(level.withColumn("level", F.lit(n)))
    return out


def tiles(pixels: DataFrame, side: int) -> DataFrame:
    """Pixels by tile, borders averaged with the neighbouring tile's: (tx, ty, u, v, r, g, b).

    Along an inner border both tiles get the average of the two pixels that meet there, at corners
    of the four. Pixels are sent to the borders that they touch, so there is no self-join.
    """
    span = pixels.agg((F.max("x") + 1).alias("w"))
    p = pixels.join(F.broadcast(span))
    last = side - 1

    def partners(c: str):
        """Places along an axis that take this pixel: its own, and across an inner border the other's."""
        own = F.col(c)
        other = F.when((own % side == last) & (own + 1 < F.col("w")), own + 1).when((own % side == 0) & (own > 0), own - 1)
        return F.filter(F.array(own, other), lambda v: v.isNotNull())

    sent = p.select(F.explode(partners("x")).alias("px"), "x", "y", "w", "r", "g", "b").select("px", F.explode(partners("y")).alias("py"), "r", "g", "b")
    return sent.groupBy("px", "py").agg(*(F.floor((F.sum(c) + F.floor(F.count("*") / 2)) / F.count("*")).cast("int").alias(c) for c in "rgb")).select(
        F.floor(F.col("px") / side).cast("int").alias("tx"), F.floor(F.col("py") / side).cast("int").alias("ty"), (F.col("px") % side).alias("u"), (F.col("py") % side).alias("v"), "r", "g", "b"
    )


def resample_bilinear(pixels: DataFrame, sw: int, sh: int, dw: int, dh: int, channels: str = "rgb") -> DataFrame:
    """Bilinear resampling at pixel centres, clamped at the edges: each target pixel joins its four neighbours."""
    spark = pixels.sparkSession
    target = spark.range(dw * dh).select((F.col("id") % dw).cast("int").alias("tx"), F.floor(F.col("id") / dw).cast("int").alias("ty"))

    def axis(t: str, s: int, d: int):
        at = F.greatest(F.lit(0.0), F.least(F.lit(float(s - 1)), (F.col(t) + 0.5) * (s / d) - 0.5))
        lo = F.floor(at).cast("int")
        return F.array(F.struct(lo.alias("at"), (1 - (at - lo)).alias("w")), F.struct(F.least(lo + 1, F.lit(s - 1)).alias("at"), (at - lo).alias("w")))

    t = target.select("tx", "ty", F.explode(axis("tx", sw, dw)).alias("a"), axis("ty", sh, dh).alias("bs")).select("tx", "ty", "a", F.explode("bs").alias("b"))
    t = t.select("tx", "ty", F.col("a.at").alias("x"), F.col("b.at").alias("y"), (F.col("a.w") * F.col("b.w")).alias("w"))
    met = t.join(pixels, ["x", "y"])
    return met.groupBy(F.col("tx").alias("x"), F.col("ty").alias("y")).agg(*(F.floor(F.sum(F.col(c) * F.col("w")) + 1e-9).cast("int").alias(c) for c in channels))


def quadtree(levels: int) -> str:
    """SQL of the nodes of a quadtree: (level, i, j, parent level, parent i, parent j)."""
    return f"""select level, i, j, if(level = 0, null, level - 1) as p_level, if(level = 0, null, i div 2) as p_i, if(level = 0, null, j div 2) as p_j
    from (select level, explode(sequence(0, shiftleft(1, level) - 1)) as i from (select explode(sequence(0, {levels - 1})) as level)) lateral view explode(sequence(0, shiftleft(1, level) - 1)) as j"""


def tile_mesh(grid: DataFrame, cell: float, skirt: float) -> DataFrame:
    """Two triangles per grid cell and skirts that hang down by ``skirt`` along the border: (face, corner, x, y, z)."""
    p = lambda i: F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y"), F.col(f"z{i}").alias("z"))
    moves = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(k).alias("k")) for k, (dx, dy) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))))
    # Each point is a corner of up to four cells.
    sent = grid.select("x", "y", "z", F.explode(moves).alias("m")).select((F.col("x") - F.col("m.dx")).alias("cx"), (F.col("y") - F.col("m.dy")).alias("cy"), F.col("m.k").alias("k"), F.struct((F.col("x") * cell).alias("x"), (F.col("y") * cell).alias("y"), F.col("z").cast("double").alias("z")).alias("p"))
    corner = lambda k: F.max(F.when(F.col("k") == k, F.col("p"))).alias(f"p{k}")
    cells = sent.groupBy("cx", "cy").agg(F.count("*").alias("n"), *map(corner, range(4))).where("n = 4")
    ends = grid.agg(F.max("x").alias("nx"), F.max("y").alias("ny"))
    cells = cells.join(F.broadcast(ends))
    down = lambda c: F.struct(F.col(f"{c}.x").alias("x"), F.col(f"{c}.y").alias("y"), (F.col(f"{c}.z") - skirt).alias("z"))
    c = F.col
    top = F.array(F.array(c("p0"), c("p1"), c("p2")), F.array(c("p0"), c("p2"), c("p3")))
    wall = lambda a, b: F.array(F.array(c(a), down(a), down(b)), F.array(c(a), down(b), c(b)))
    sides = ((c("cy") == 0, "p0", "p1"), (c("cx") == c("nx") - 1, "p1", "p2"), (c("cy") == c("ny") - 1, "p2", "p3"), (c("cx") == 0, "p3", "p0"))
    none = F.filter(top, lambda t: F.lit(False))
    faces = F.concat(top, *(F.when(on, wall(a, b)).otherwise(none) for on, a, b in sides))
    rows = cells.select("cx", "cy", F.posexplode(faces).alias("face", "t")).select("cx", "cy", "face", F.posexplode("t").alias("corner", "p"))
    return rows.select("cx", "cy", "face", "corner", "p.x", "p.y", "p.z")
