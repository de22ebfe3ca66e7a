"""Frames of positions and normals: where a layer's coordinates become Cartesian, and back.

A ``SpatialReference`` is the hook for other systems: two methods that turn a point (x, y, z) into
another, as column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as g


class SpatialReference:
    """A system whose coordinates are Cartesian already; nothing changes."""

    def to_cartesian(self, p: Column) -> Column:
        return p

    def from_cartesian(self, p: Column) -> Column:
        return p


class Geographic(SpatialReference):
    """Longitude, latitude and height, with earth-centred Cartesian coordinates."""

    def to_cartesian(self, p: Column) -> Column:
        return g.let(p, lambda q: g.geodetic_to_ecef(q["x"], q["y"], q["z"]))

    def from_cartesian(self, p: Column) -> Column:
        return g.ecef_to_geodetic(p)


def in_normal_frame(p: Column, frame: Column, origin: Column, reference: SpatialReference) -> Column:
    """A vertex in the frame that normals refer to: ``earth-centered``, ``east-north-up`` of the origin, or ``vertex-reference-frame`` (as it is); null for another."""

    def enu(both: Column) -> Column:
        o = both["o"]
        d = g.sub(reference.to_cartesian(both["p"]), reference.to_cartesian(o))
        return g.let(F.struct(d.alias("d"), o.alias("o")), lambda t: g.ecef_to_enu(t["d"], t["o"]["x"], t["o"]["y"]))

    return (
        F.when(frame == "earth-centered", reference.to_cartesian(p))
        .when(frame == "east-north-up", g.let(F.struct(p.alias("p"), origin.alias("o")), enu))
        .when(frame == "vertex-reference-frame", p)
    )
