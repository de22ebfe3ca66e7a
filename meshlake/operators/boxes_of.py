"""Oriented boxes of arrays of points: for a given orientation, or of eight corners that give it.

Each step is a projection of plain numbers, so that it is computed once and compiled; nothing is
nested in functions over arrays but the dot products of the points themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import matrix_quat

#: Edges shorter than this have no direction.
SHORT = 1e-8
_AXES = [[f"_a{k}{c}" for c in range(3)] for k in range(3)]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[(c + 1) % 3] * b[(c + 2) % 3] - a[(c + 2) % 3] * b[(c + 1) % 3] for c in range(3)]


def _onto(axis: list[Column]):
    return lambda p: _dot([p[c] for c in "xyz"], axis)


def _columns(names: list[str]) -> list[Column]:
    return [F.col(n) for n in names]


def _unit(df: DataFrame, names: list[str], tries: list[list[Column]]) -> DataFrame:
    """Adds the direction of the first of ``tries`` that has one; the last must."""
    long = [_dot(v, v) > SHORT * SHORT for v in tries[:-1]]
    out = []
    for c in range(3):
        pick = tries[-1][c]
        for ok, v in reversed(list(zip(long, tries, strict=False))):
            pick = F.when(ok, v[c]).otherwise(pick)
        out.append(pick)
    raw = [f"_r{c}" for c in range(3)]
    df = df.withColumns(dict(zip(raw, out, strict=True))).withColumn("_l", F.sqrt(_dot(_columns(raw), _columns(raw))))
    return df.withColumns({n: F.col(r) / F.col("_l") for n, r in zip(names, raw, strict=True)}).drop(*raw, "_l")


def _square_to(v: list[Column]) -> list[Column]:
    """A vector square to ``v``, from the axis that ``v`` has least of."""
    x, y, z = (F.abs(c) for c in v)
    is_x, is_y = (x <= y) & (x <= z), (y < x) & (y <= z)
    one = [F.when(is_x, 1.0).otherwise(0.0), F.when(is_y, 1.0).otherwise(0.0), F.when(is_x | is_y, 0.0).otherwise(1.0)]
    return _cross(one, v)


def _around(df: DataFrame, points: Column, out: str, quat: Column) -> DataFrame:
    """Adds the box of ``points`` along the axes in ``_AXES``."""
    along = {f"_p{k}": F.transform(points, _onto(_columns(_AXES[k]))) for k in range(3)}
    df = df.withColumns(along)
    df = df.withColumns({f"_{n}{k}": f(f"_p{k}") for k in range(3) for n, f in (("lo", F.array_min), ("hi", F.array_max))})
    mid = [(F.col(f"_lo{k}") + F.col(f"_hi{k}")) / 2 for k in range(3)]
    center = F.struct(*(sum((mid[k] * F.col(_AXES[k][c]) for k in (1, 2)), mid[0] * F.col(_AXES[0][c])).alias(n) for c, n in enumerate("xyz")))
    extents = F.struct(*(((F.col(f"_hi{k}") - F.col(f"_lo{k}")) / 2).alias(n) for k, n in enumerate("xyz")))
    box = F.struct(center.alias("center"), extents.alias("extents"), quat.alias("quat"))
    return df.withColumn(out, box).drop(*along, *(f"_{n}{k}" for n in ("lo", "hi") for k in range(3)), *(n for axis in _AXES for n in axis))


def boxes_of_points(df: DataFrame, points: str, quat: str, out: str) -> DataFrame:
    """Adds ``out``: the least box of the array ``points`` whose orientation is ``quat``."""
    x, y, z, w = (F.col(f"{quat}.{c}") for c in "xyzw")
    turned = [
        [1 - 2 * (y * y + z * z), 2 * (x * y + w * z), 2 * (x * z - w * y)],
        [2 * (x * y - w * z), 1 - 2 * (x * x + z * z), 2 * (y * z + w * x)],
        [2 * (x * z + w * y), 2 * (y * z - w * x), 1 - 2 * (x * x + y * y)],
    ]
    df = df.withColumns({_AXES[k][c]: turned[k][c] for k in range(3) for c in range(3)})
    return _around(df, F.col(points), out, F.col(quat))


def boxes_of_corners(df: DataFrame, corners: str, out: str) -> DataFrame:
    """Adds ``out``: the box of eight corners in the order of ``obb_corners``, which need not be exactly square.

    The mean edges give the axes: the direction of the x edges is kept, that of the y edges made square
    to it, and z is square to both. Where an edge has no length its direction follows from the others, so
    that flat boxes, segments and points need no rules of their own.
    """
    signs = [[1 if i >> k & 1 else -1 for i in range(8)] for k in range(3)]
    names = [[f"_e{k}{c}" for c in range(3)] for k in range(3)]
    at = [[F.get(F.col(corners), F.lit(i))[c] for c in "xyz"] for i in range(8)]
    df = df.withColumns({names[k][c]: sum((at[i][c] * signs[k][i] for i in range(1, 8)), at[0][c] * signs[k][0]) / 4 for k in range(3) for c in range(3)})
    ex, ey, ez = (_columns(n) for n in names)
    upright = [F.lit(1.0), F.lit(0.0), F.lit(0.0)]
    df = _unit(df, _AXES[0], [ex, _cross(ey, ez), _square_to(ey), _square_to(ez), upright])
    a = _columns(_AXES[0])
    df = df.withColumn("_d", _dot(ey, a))
    df = _unit(df, _AXES[1], [[y - F.col("_d") * u for y, u in zip(ey, a, strict=True)], _cross(ez, a), _square_to(a)])
    b = _columns(_AXES[1])
    df = df.withColumns(dict(zip(_AXES[2], _cross(a, b), strict=True)))
    matrix = F.array(*(F.col(_AXES[k][c]) for c in range(3) for k in range(3)))
    return _around(df, F.col(corners), out, matrix_quat(matrix)).drop("_d", *(n for e in names for n in e))
