"""Colours as column expressions; a colour is a struct (r, g, b, a) of integers from 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colours by level of detail, and the stops of the spectrum.
LOD_COLORS = (
    (255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 0, 255), (0, 255, 255), (255, 255, 0), (102, 0, 102), (0, 153, 0), (0, 0, 153), (255, 255, 255),
)
SPECTRUM = ((0.0, (255, 0, 0)), (0.2, (255, 255, 0)), (0.4, (0, 255, 0)), (0.6, (0, 255, 255)), (0.8, (0, 0, 255)), (1.0, (255, 0, 255)))


def rgba(r, g, b, a=None) -> Column:
    return F.struct(r.alias("r"), g.alias("g"), b.alias("b"), (a if a is not None else F.lit(255)).alias("a"))


def mix(c1: Column, c2: Column, u: Column) -> Column:
    """Linear mix of two colours, truncated."""
    return rgba(*(F.floor(c1[k] * (1 - u) + c2[k] * u).cast("int") for k in "rgba"))


def gradient(i: Column, n: int, c1: Column, c2: Column) -> Column:
    """Colour i of n between two; the first if there is only one."""
    return mix(c1, c2, i / F.lit(float(n - 1))) if n > 1 else c1


def colormap(u: Column, stops=SPECTRUM) -> Column:
    """Colour at ``u`` in [0, 1] between the stops around it."""
    out = None
    lit = lambda c: rgba(*(F.lit(x) for x in c))
    for (p1, c1), (p2, c2) in zip(stops, stops[1:]):
        piece = mix(lit(c1), lit(c2), (u - p1) / (p2 - p1))
        out = F.when(u <= p2, piece) if out is None else out.when(u <= p2, piece)
    return out


def lod_color(lod: Column) -> Column:
    table = F.array(*(rgba(*(F.lit(x) for x in c)) for c in LOD_COLORS))
    return F.element_at(table, (lod % len(LOD_COLORS)).cast("int") + 1)


def swap_red_blue(c: Column) -> Column:
    return rgba(c["b"], c["g"], c["r"], c["a"])


def to_floats(c: Column) -> Column:
    return F.struct(*((c[k] / 255.0).alias(k) for k in "rgba"))


def from_floats(c: Column) -> Column:
    return rgba(*(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(c[k] * 255.0))).cast("int") for k in "rgba"))


def with_alpha(c: Column, alpha: Column) -> Column:
    """A colour of three channels with a fourth."""
    return rgba(c["r"], c["g"], c["b"], alpha)


def without_alpha(c: Column) -> Column:
    return F.struct(c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"))
