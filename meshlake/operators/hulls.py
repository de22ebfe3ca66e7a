"""Directional hulls and bounding volumes of groups of points.

A hull is the interval of the points along each of a set of fixed directions: min and max of dot
products, so partial hulls combine before the shuffle and children's hulls merge into parents'.
Boxes come from the hull and from candidate frames that it suggests; no group is collected.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import SpatialReference
from ..functions.geometry import obb_corners
from .staging import shuffled

#: Axes, edge and corner diagonals of a cube: 13 directions.
DIRECTIONS = tuple(
    tuple(x / math.sqrt(sum(v * v for v in d)) for x in d)
    for d in itertools.product((-1, 0, 1), repeat=3)
    if d > (0, 0, 0)
)


_GOLDEN = (1 + math.sqrt(5)) / 2
#: The ten axes of a dodecahedron's corners and the six of an icosahedron's: 16 directions, the finer set.
ROUND_DIRECTIONS = tuple(
    tuple(x / math.sqrt(sum(v * v for v in d)) for x in d)
    for d in (
        *((x, y, 1.0) for x in (-1.0, 1.0) for y in (-1.0, 1.0)),
        *((0.0, s / _GOLDEN, _GOLDEN)[k:] + (0.0, s / _GOLDEN, _GOLDEN)[:k] for k in range(3) for s in (-1, 1)),
        *((0.0, 1.0, s * _GOLDEN)[k:] + (0.0, 1.0, s * _GOLDEN)[:k] for k in range(3) for s in (-1, 1)),
    )
)


def hull(points: DataFrame, by: list[str], directions=DIRECTIONS) -> DataFrame:
    """(by, n, lo, hi): arrays of the intervals along the directions."""
    along = [F.col("x") * d[0] + F.col("y") * d[1] + F.col("z") * d[2] for d in directions]
    return points.groupBy(*by).agg(F.count("*").alias("n"), F.array(*map(F.min, along)).alias("lo"), F.array(*map(F.max, along)).alias("hi"))


def merge_hulls(hulls: DataFrame, by: list[str], directions=DIRECTIONS) -> DataFrame:
    k = range(len(directions))
    return hulls.groupBy(*by).agg(F.sum("n").alias("n"), F.array(*(F.min(F.col("lo")[i]) for i in k)).alias("lo"), F.array(*(F.max(F.col("hi")[i]) for i in k)).alias("hi"))


def common_widths(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Widths of the hull that holds both, by direction."""
    low, high = F.zip_with(lo1, lo2, lambda a, b: F.least(a, b)), F.zip_with(hi1, hi2, lambda a, b: F.greatest(a, b))
    return F.zip_with(low, high, lambda a, b: b - a)


def cluster_distances(widths: Column) -> Column:
    """How far two clusters are apart, by the widths of their common hull over ``DIRECTIONS``.

    ``mean`` is the sum of squared widths, ``largest`` the largest one; over the fixed frames
    ``area`` is half the least surface and ``diagonal`` the mean diagonal.
    """
    index = {tuple(round(x, 9) for x in d): i for i, d in enumerate(DIRECTIONS)}

    def at(axis) -> int:
        key = tuple(round(x, 9) for x in axis)
        return index[key] if key in index else index[tuple(-x + 0.0 for x in key)]

    sides = [[F.get(widths, F.lit(at(a))) for a in axes] for axes in frames()]
    area = F.least(*(x * y + y * z + z * x for x, y, z in sides))
    squares = [x * x + y * y + z * z for x, y, z in sides]
    return F.struct(
        F.aggregate(widths, F.lit(0.0), lambda s, w: s + w * w).alias("mean"), F.array_max(widths).alias("largest"),
        area.alias("area"), F.sqrt(sum(squares[1:], squares[0]) / float(len(squares))).alias("diagonal"),
    )


def widest_direction(lo: Column, hi: Column) -> Column:
    """Index of the direction with the largest extent; the first of equals."""
    width = F.zip_with(lo, hi, lambda a, b: b - a)
    return F.array_position(width, F.array_max(width)).cast("int") - 1


def straightest_direction(lo: Column, hi: Column, directions=DIRECTIONS) -> Column:
    """Index of the direction that the hull lies along: the widths' squared parts across it are least in sum; the first of equals."""
    squares = [F.pow(F.get(hi, F.lit(j)) - F.get(lo, F.lit(j)), F.lit(2.0)) for j in range(len(directions))]
    across = lambda d, e: 1.0 - sum(a * b for a, b in zip(d, e, strict=True)) ** 2
    costs = F.array(*(sum((squares[j] * across(d, e) for j, e in enumerate(directions)), F.lit(0.0)) for d in directions))
    return F.array_position(costs, F.array_min(costs)).cast("int") - 1


def longest_box_direction(lo: Column, hi: Column) -> Column:
    """Index in ``DIRECTIONS`` of the axis across the smallest face of all boxes in the fixed frames; the first of equals."""
    ends = []
    for axes in frames():
        index = [next(i for i, d in enumerate(DIRECTIONS) if abs(abs(sum(x * y for x, y in zip(d, axis, strict=True))) - 1) < 1e-9) for axis in axes]
        wide = [F.get(hi, F.lit(i)) - F.get(lo, F.lit(i)) for i in index]
        ends += [F.struct((wide[(k + 1) % 3] * wide[(k + 2) % 3]).alias("face"), F.lit(len(ends) + k).alias("rank"), F.lit(index[k]).alias("direction")) for k in range(3)]
    return F.least(*ends)["direction"]


def frames() -> list[tuple]:
    """Orthonormal frames from the directions: upright, and turned by 45 degrees about each axis."""
    h = math.sqrt(0.5)
    return [
        ((1, 0, 0), (0, 1, 0), (0, 0, 1)),
        ((h, h, 0), (-h, h, 0), (0, 0, 1)),
        ((h, 0, h), (0, 1, 0), (-h, 0, h)),
        ((1, 0, 0), (0, h, h), (0, -h, h)),
    ]


def oriented_boxes(points: DataFrame, by: list[str], metric: str = "volume") -> DataFrame:
    """The best box of fixed orientations: (by, center, extents, frame, volume); by volume, area or diagonal.

    Every point adds to the extents in all frames at once, and the smallest box is chosen.
    """
    aggs, boxes = [], []
    for f, axes in enumerate(frames()):
        for a, d in enumerate(axes):
            along = F.col("x") * float(d[0]) + F.col("y") * float(d[1]) + F.col("z") * float(d[2])
            aggs += [F.min(along).alias(f"lo_{f}_{a}"), F.max(along).alias(f"hi_{f}_{a}")]
        half = [(F.col(f"hi_{f}_{a}") - F.col(f"lo_{f}_{a}")) / 2 for a in range(3)]
        mid = [(F.col(f"hi_{f}_{a}") + F.col(f"lo_{f}_{a}")) / 2 for a in range(3)]
        center = [sum((mid[a] * float(axes[a][c]) for a in (1, 2)), mid[0] * float(axes[0][c])) for c in range(3)]
        size = {"volume": half[0] * half[1] * half[2], "area": half[0] * half[1] + half[1] * half[2] + half[2] * half[0], "diagonal": half[0] * half[0] + half[1] * half[1] + half[2] * half[2]}[metric]
        boxes.append(
            F.struct(
                size.alias("size"), F.lit(f).alias("frame"), F.struct(*(center[c].alias(n) for c, n in enumerate("xyz"))).alias("center"),
                F.struct(*(half[a].alias(n) for a, n in enumerate("xyz"))).alias("extents"), (half[0] * half[1] * half[2] * 8).alias("volume"),
            )
        )
    best = points.groupBy(*by).agg(F.count("*").alias("n"), *aggs).select(*by, "n", F.least(*boxes).alias("b"))
    return best.select(*by, "n", "b.frame", "b.center", "b.extents", "b.volume")


def frame_quats() -> list[tuple]:
    """The frames' orientations as quaternions (x, y, z, w)."""
    c, s = math.cos(math.pi / 8), math.sin(math.pi / 8)
    return [(0.0, 0.0, 0.0, 1.0), (0.0, 0.0, s, c), (0.0, -s, 0.0, c), (s, 0.0, 0.0, c)]


def node_volumes(points: DataFrame, by: str) -> DataFrame:
    """(by, n, box, radius): a node's oriented box, and the sphere about its centre that reaches all its points.

    A node whose points are all one place has extents and radius 1.
    """
    boxes = oriented_boxes(points, [by])
    quats = F.array(*(F.struct(*(F.lit(float(v)).alias(k) for k, v in zip("xyzw", q, strict=True))) for q in frame_quats()))
    point = (F.col("extents.x") == 0) & (F.col("extents.y") == 0) & (F.col("extents.z") == 0)
    one = F.struct(*(F.lit(1.0).alias(k) for k in "xyz"))
    box = F.struct("center", F.when(point, one).otherwise(F.col("extents")).alias("extents"), F.get(quats, F.col("frame")).alias("quat"))
    boxes = boxes.select(by, "n", box.alias("box"), point.alias("point"))
    d = [F.col(k) - F.col(f"box.center.{k}") for k in "xyz"]
    far = points.select(by, "x", "y", "z").join(shuffled(boxes.select(by, "box")), by).groupBy(by).agg(F.max(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).alias("radius"))
    return boxes.join(shuffled(far), by).select(by, "n", "box", F.when(F.col("point"), 1.0).otherwise(F.col("radius")).alias("radius"))


def projected_volumes(vertices: DataFrame, by: str, reference: SpatialReference) -> DataFrame:
    """(by, n, center, box, radius) of vertices (by, x, y, z) in a layer's system.

    Vertices are projected, their box and sphere found where distances are metres, and the centre is
    projected back: ``center`` is in the layer's system, ``box`` and ``radius`` are Cartesian.
    """
    p = vertices.select(by, reference.to_cartesian(F.struct("x", "y", "z")).alias("p")).select(by, "p.x", "p.y", "p.z")
    out = node_volumes(p, by)
    return out.select(by, "n", reference.from_cartesian(F.col("box.center")).alias("center"), "box", "radius")


def recentred(vertices: DataFrame, volumes: DataFrame, by: str) -> DataFrame:
    """The vertices with (x, y, z) taken from their node's ``center``, in the layer's system; further columns stay."""
    centres = volumes.select(by, F.col("center").alias("_center"))
    met = vertices.join(shuffled(centres), by)
    return met.withColumns({c: F.col(c) - F.col(f"_center.{c}") for c in "xyz"}).drop("_center")


def parent_volumes(children: DataFrame, by: str) -> DataFrame:
    """(by, n, box, radius) from the corners of the children's boxes (column ``box``); ``n`` is the number of children."""
    corners = children.select(by, F.explode(obb_corners(F.col("box"))).alias("c")).select(by, "c.x", "c.y", "c.z")
    return node_volumes(corners, by).withColumn("n", (F.col("n") / 8).cast("long"))


def bounding_spheres(boxes: DataFrame) -> DataFrame:
    """Adds ``radius``: half the box's diagonal, so that the sphere holds all of it."""
    return boxes.withColumn("radius", F.sqrt(F.col("extents.x") ** 2 + F.col("extents.y") ** 2 + F.col("extents.z") ** 2))


def box_and_radius(points: DataFrame, by: str) -> DataFrame:
    """Axis-aligned box and the largest distance of a point from its centre; a single point has extent 1."""
    ends = points.groupBy(by).agg(*(f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))), F.count("*").alias("n"))
    mid = {c: (F.col(f"lo{c}") + F.col(f"hi{c}")) / 2 for c in "xyz"}
    ends = ends.withColumns({f"m{c}": m for c, m in mid.items()})
    away = F.sqrt(sum(((F.col(c) - F.col(f"m{c}")) ** 2 for c in "yz"), (F.col("x") - F.col("mx")) ** 2))
    far = points.join(shuffled(ends.select(by, "mx", "my", "mz")), by).groupBy(by).agg(F.max(away).alias("radius"))
    return ends.join(shuffled(far), by).withColumn("radius", F.when(F.col("n") == 1, 1.0).otherwise(F.col("radius")))


def layer_extent(corners: DataFrame, holds_centre: Column) -> DataFrame:
    """Extent of geographic corners (lon, lat, h); the whole globe if some box holds the earth's centre."""
    out = corners.agg(
        F.min("lon").alias("left"), F.max("lon").alias("right"), F.min("lat").alias("bottom"), F.max("lat").alias("top"), F.min("h").alias("front"), F.max("h").alias("back"), F.bool_or(holds_centre).alias("all")
    )
    globe = {"left": -180.0, "right": 180.0, "bottom": -90.0, "top": 90.0}
    return out.withColumns({c: F.when(F.col("all"), v).otherwise(F.col(c)) for c, v in globe.items()}).drop("all")
