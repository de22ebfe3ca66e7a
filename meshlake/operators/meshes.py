"""Meshes as rows of vertices, three to a triangle: checks, cleaning and pruning of what a node stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .staging import numbered, small_side, staged

UV_LIMIT = 16365.0
EPSILON = 1e-3

# Attribute flags.
POSITION, NORMAL, UV, COLOR, REGION, FEATURE_ID = 1, 2, 4, 8, 16, 32


def ingest(vertices: DataFrame) -> DataFrame:
    """Soup of triangles with an origin per node: (node_id, vtx, x, y, z absolute) to relative single floats and the origin.

    Nodes whose number of vertices is no multiple of three are left out (see ``ingest_issues``).
    """
    origin = vertices.groupBy("node_id").agg(
        F.count("*").alias("n_vertices"), *(((F.min(c) + F.max(c)) / 2).alias(f"o{c}") for c in "xyz")
    ).where("n_vertices % 3 = 0")
    rel = {f"r{c}": (F.col(c) - F.col(f"o{c}")).cast("float") for c in "xyz"}
    return vertices.join(origin, "node_id").withColumns(rel)


def ingest_issues(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("node_id").agg(F.count("*").alias("n_vertices")).where("n_vertices % 3 != 0")


def gathered(indices: DataFrame, values: DataFrame, scale: float = 1.0) -> DataFrame:
    """(node_id, vtx, x, y, z): a vertex for each entry of an index (node_id, vtx, idx), from values (node_id, idx, x, y, z), scaled.

    Entries beyond the values are errors; they have no vertex here (``gather_issues``).
    """
    met = indices.join(values.select("node_id", "idx", "x", "y", "z"), ["node_id", "idx"])
    return met.select("node_id", "vtx", *((F.col(c) * float(scale)).alias(c) for c in "xyz"))


def gather_issues(indices: DataFrame, values: DataFrame) -> DataFrame:
    """Entries of an index that name no value."""
    return indices.join(values.select("node_id", "idx"), ["node_id", "idx"], "left_anti").select("node_id", "vtx", "idx")


def ingest_points(points: DataFrame) -> DataFrame:
    """Points (node_id, fid, x, y, z) as an origin per node, single-precision differences, and the half widths of their box, 1 for a single place."""
    ends = points.groupBy("node_id").agg(*(((F.min(c) + F.max(c)) / 2).alias(f"o{c}") for c in "xyz"), *(((F.max(c) - F.min(c)) / 2).alias(f"e{c}") for c in "xyz"))
    point = (F.col("ex") == 0) & (F.col("ey") == 0) & (F.col("ez") == 0)
    ends = ends.withColumn("point", point).withColumns({f"e{c}": F.when(F.col("point"), 1.0).otherwise(F.col(f"e{c}")) for c in "xyz"}).drop("point")
    return points.join(ends, "node_id").withColumns({f"r{c}": (F.col(c) - F.col(f"o{c}")).cast("float") for c in "xyz"})


def without(df: DataFrame, *attributes: str) -> DataFrame:
    """Vertices without normals, colours, regions or feature ids, whichever of them there are."""
    columns = {"normals": ("nx", "ny", "nz"), "colors": ("r", "g", "b", "a"), "regions": ("u0", "v0", "u1", "v1"), "fids": ("fid",)}
    return df.drop(*(c for a in attributes for c in columns[a]))


def absolute(relative: DataFrame) -> DataFrame:
    return relative.withColumns({c: F.col(f"o{c}") + F.col(f"r{c}").cast("double") for c in "xyz"})


def sanitized(u: Column, limit: float = UV_LIMIT) -> Column:
    """1 in place of what is not finite or beyond the limit."""
    bad = F.isnan(u) | (F.abs(u) > limit)
    return F.when(bad, F.lit(1.0)).otherwise(u)


def clamped_uv(u: Column) -> Column:
    return g.clamp(u, 0.01, 0.99)


def uv_wrap(vertices: DataFrame) -> DataFrame:
    """(node_id, wrap): bit 1 where u leaves [0, 1], bit 2 where v does."""
    out = lambda c: (F.col(c) < 0) | (F.col(c) > 1)
    return vertices.groupBy("node_id").agg(F.bit_or(F.when(out("u"), 1).otherwise(0).bitwiseOR(F.when(out("v"), 2).otherwise(0))).alias("wrap"))


def without_regions(uv: Column, lo: Column, hi: Column) -> Column:
    """A coordinate within a region of an atlas, whose ends are in units of 1/65535, as an absolute one."""
    return uv * (hi - lo) / 65535.0 + lo / 65535.0


def triangles(vertices: DataFrame) -> DataFrame:
    """(node_id, face, a, b, c): the three points of each face."""
    p = F.struct("x", "y", "z")
    face = F.floor(F.col("vtx") / 3)
    corner = lambda k: F.max(F.when(F.col("vtx") % 3 == k, p))
    return vertices.groupBy("node_id", face.alias("face")).agg(corner(0).alias("a"), corner(1).alias("b"), corner(2).alias("c"))


def degenerate_nodes(vertices: DataFrame) -> DataFrame:
    """(node_id, n_faces, n_good, degenerate): a face is good if all its sides are longer than a thousandth."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    good = (g.distance_l1(a, b) > EPSILON) & (g.distance_l1(b, c) > EPSILON) & (g.distance_l1(c, a) > EPSILON)
    return triangles(vertices).groupBy("node_id").agg(F.count("*").alias("n_faces"), F.count_if(good).alias("n_good"), (~F.bool_or(good)).alias("degenerate"))


def face_normals(vertices: DataFrame, left_handed: bool = False) -> DataFrame:
    """(node_id, face, normal): unit normals of faces."""
    n = g.cross(g.sub(F.col("b"), F.col("a")), g.sub(F.col("c"), F.col("a")))
    n = g.scaled(n, -1.0) if left_handed else n
    return triangles(vertices).select("node_id", "face", g.let(n, g.normalised).alias("normal"))


def implicit_normals(vertices: DataFrame, degrees: float = 1.0) -> DataFrame:
    """(node_id, implicit): all stored normals (nx, ny, nz) lie within some degrees of their face's normal."""
    faces = face_normals(vertices)
    rows = vertices.withColumn("face", F.floor(F.col("vtx") / 3)).join(faces, ["node_id", "face"])
    cosine = g.dot(g.normalised(F.struct(F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("nz").alias("z"))), F.col("normal"))
    return rows.groupBy("node_id").agg(F.bool_and(F.degrees(F.acos(g.clamp(cosine, -1.0, 1.0))) <= degrees).alias("implicit"))


def droppable_colors(vertices: DataFrame) -> DataFrame:
    """(node_id, drop): one colour throughout, and that opaque white or transparent black."""
    color = F.struct("r", "g", "b", "a")
    plain = lambda v, a: F.struct(*(F.lit(x).alias(k) for k, x in zip("rgba", (v, v, v, a))))
    return vertices.groupBy("node_id").agg(
        ((F.min(color) == F.max(color)) & ((F.min(color) == plain(255, 255)) | (F.min(color) == plain(0, 0)))).alias("drop")
    )


def zero_columns(vertices: DataFrame, columns: list[str]) -> DataFrame:
    """(node_id, one flag per column): all values are 0, so the attribute counts as missing."""
    return vertices.groupBy("node_id").agg(*(F.bool_and(F.coalesce(F.col(c) == 0, F.lit(True))).alias(c) for c in columns))


def attribute_mask(vertices: DataFrame, columns: dict[str, int]) -> DataFrame:
    """(node_id, mask) of the attributes that hold something."""
    return vertices.groupBy("node_id").agg(F.bit_or(sum((F.when(F.col(c).isNotNull() & (F.col(c) != 0), f).otherwise(0) for c, f in columns.items()), F.lit(0))).alias("mask"))


def alpha_bits(pixels: DataFrame, by: str, alpha: str = "a") -> DataFrame:
    """(by, bits): 8 if some alpha is between, 0 if all are 255, else 1."""
    a = F.col(alpha)
    return pixels.groupBy(by).agg(F.when(F.bool_or((a > 0) & (a < 255)), 8).when(F.min(a) == 255, 0).otherwise(1).alias("bits"))


def runs(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """(by, first, last, value): islands of equal consecutive values. ``by`` should split what is too large for one task."""
    w = Window.partitionBy(*by).orderBy(order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(order).over(w).isNull()).cast("int")
    marked = df.select(*by, order, value, new.alias("new")).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.first(value).alias("value")).drop("island")


def runs_across(df: DataFrame, order: str, value: str, by: tuple[str, ...] = (), block: int = 100_000) -> DataFrame:
    """Like ``runs`` for sequences of any length: rows are numbered, compared in blocks, and joined at the blocks' seams.

    No task holds a whole sequence, and a block's neighbours are one row a block.
    """
    keys = [*by, order]
    rows = numbered(df.select(*keys, value), keys, "_n").withColumn("_block", F.floor(F.col("_n") / block))
    here = F.struct(*by, F.col(value).alias("_value"))
    tails = rows.groupBy((F.col("_block") + 1).alias("_block")).agg(F.max_by(here, "_n").alias("_tail"))
    rows = rows.join(small_side(tails), "_block", "left")
    w = Window.partitionBy("_block").orderBy("_n")
    before = F.coalesce(F.lag(here).over(w), F.col("_tail"))
    rows = rows.withColumn("_new", before.isNull() | ~here.eqNullSafe(before))
    rows = staged(rows.withColumn("_start", F.max(F.when(F.col("_new"), F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0))), "runs")
    # A run that goes on from earlier blocks has the latest start of any of them.
    opens = rows.groupBy("_block").agg(F.max("_start").alias("_open"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    opens = opens.select("_block", F.max("_open").over(earlier).alias("_open"))
    whole = rows.join(small_side(opens), "_block").withColumn("_start", F.coalesce("_start", "_open"))
    return whole.groupBy(*by, "_start").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.first(value).alias("value")).drop("_start")


def texture_plan(sets: DataFrame, wanted: list[str]) -> DataFrame:
    """(id, reuse, encode): what a set has and what is missing; PNG and JPEG exclude one another."""
    want = F.array(*map(F.lit, wanted))
    want = F.array_remove(want, F.when(F.array_contains("formats", "png"), "jpg").otherwise("png"))
    return sets.select("id", F.sort_array(F.array_intersect(want, "formats")).alias("reuse"), F.sort_array(F.array_except(want, "formats")).alias("encode"))
