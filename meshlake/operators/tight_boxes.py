"""Boxes that lie on a face of the points' hull, and the sphere about their centre.

A group's extreme points along fixed directions are a small set, two for each direction, which
partial aggregates find and merge. The faces of its hull and, in each face's plane, the edges of its
outline give the orientations that are tried; the best one by volume, surface or diagonal is taken,
and the extents are then those of all points. No group is collected: what a task sees of one is the
set of its extreme points.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import conjugate, rotate
from .hulls import DIRECTIONS
from .staging import shuffled

METRICS = {
    "volume": lambda e: e[..., 0] * e[..., 1] * e[..., 2],
    "area": lambda e: e[..., 0] * e[..., 1] + e[..., 1] * e[..., 2] + e[..., 2] * e[..., 0],
    "diagonal": lambda e: (e * e).sum(axis=-1),
    "length": lambda e: e.sum(axis=-1),
}
_EPS = 1e-9
#: Orientations whose metric is within this of the least count as equal: the first one tried is taken.
_CLOSE = 1e-9


def extreme_points(points: DataFrame, by: list[str], directions=DIRECTIONS) -> DataFrame:
    """(by, n, extremes): the distinct outermost points along each direction, the largest (x, y, z) of equals."""
    at = F.struct("x", "y", "z")
    along = [F.col("x") * d[0] + F.col("y") * d[1] + F.col("z") * d[2] for d in directions]
    ends = [F.max(F.struct((s * a).alias("far"), at.alias("at")))["at"] for a in along for s in (1, -1)]
    return points.groupBy(*by).agg(F.count("*").alias("n"), *(e.alias(f"e{i}") for i, e in enumerate(ends))).select(*by, "n", F.array_distinct(F.array(*(f"e{i}" for i in range(len(ends))))).alias("extremes"))


def faces(p: np.ndarray) -> np.ndarray:
    """Unit normals of the planes through three of the points that have all points on one side, each direction once."""
    size = np.ptp(p, axis=0).max()
    tri = np.asarray(list(itertools.combinations(range(len(p)), 3)), np.int64).reshape(-1, 3)
    normal = np.cross(p[tri[:, 1]] - p[tri[:, 0]], p[tri[:, 2]] - p[tri[:, 0]])
    length = np.linalg.norm(normal, axis=1)
    able = length > _EPS * size * size
    normal, base = normal[able] / length[able, None], p[tri[able, 0]]
    side = np.einsum("fc,pc->fp", normal, p) - (normal * base).sum(axis=1)[:, None]
    normal = normal[(side.max(axis=1) <= _EPS * size) | (side.min(axis=1) >= -_EPS * size)]
    lead = np.take_along_axis(normal, np.argmax(np.abs(normal) > 0.1, axis=1)[:, None], axis=1)
    normal = normal * np.sign(lead)
    return normal[np.sort(np.unique(normal.round(7), axis=0, return_index=True)[1])] if len(normal) else normal


def outline(q: np.ndarray) -> np.ndarray:
    """Unit directions of the edges around points of a plane."""
    q = np.unique(q.round(9), axis=0)
    if len(q) < 2:
        return np.array([[1.0, 0.0]])
    ring: list = []
    for half in (q, q[::-1]):
        chain: list = []
        for x in half:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (x[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (x[0] - chain[-2][0]):
                chain.pop()
            chain.append(x)
        ring += chain[:-1]
    ring = np.asarray(ring)
    edges = np.roll(ring, -1, axis=0) - ring
    return edges / np.linalg.norm(edges, axis=1)[:, None]


def orientations(p: np.ndarray) -> np.ndarray:
    """Frames (rows are axes) to try: upright, and for each face one for each edge of the outline on it."""
    out = [np.eye(3)[None]]
    normals = faces(p)
    if not len(normals) and len(p) > 1:  # all points on a line
        i, j = np.unravel_index(np.argmax(((p[:, None] - p[None]) ** 2).sum(axis=2)), (len(p), len(p)))
        line = p[j] - p[i]
        normals = np.cross(line, np.eye(3)[np.argmin(np.abs(line))])[None]
        normals = normals / np.linalg.norm(normals)
    for n in normals:
        u = np.cross(n, np.eye(3)[np.argmin(np.abs(n))])
        u /= np.linalg.norm(u)
        v = np.cross(n, u)
        e = outline(np.stack([p @ u, p @ v], axis=1))
        along = e[:, :1] * u + e[:, 1:] * v
        out.append(np.stack([along, np.cross(n, along), np.broadcast_to(n, along.shape)], axis=1))
    return np.concatenate(out)


def best_frame(p: np.ndarray, metric: str) -> np.ndarray:
    """The frame of the least box around the points."""
    frames = orientations(p)
    along = frames @ p.T
    extents = along.max(axis=2) - along.min(axis=2)
    # A flat set has no volume whichever way it lies on its plane, and a line no surface: the next measure decides.
    for name, power in ((metric, {"volume": 3}.get(metric, 2)), ("area", 2), ("length", 1)):
        cost = METRICS[name](extents)
        if min(cost.min(), np.ptp(cost)) > _EPS * extents.max() ** power:
            break
    return frames[int(np.argmax(cost <= cost.min() * (1 + _CLOSE)))]


def quaternion(frame: np.ndarray) -> tuple[float, float, float, float]:
    """(x, y, z, w) with w >= 0 of the rotation that takes the upright axes to the rows of ``frame``: the leading eigenvector of its symmetric form."""
    m = frame.T
    k = np.empty((4, 4))
    k[:3, :3] = m + m.T - np.trace(m) * np.eye(3)
    k[:3, 3] = k[3, :3] = (m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1])
    k[3, 3] = np.trace(m)
    q = np.linalg.eigh(k)[1][:, -1]
    lead = q[3] if abs(q[3]) > 1e-12 else q[np.argmax(np.abs(q) > 1e-12)]
    return tuple(map(float, q * math.copysign(1.0, lead)))


def tight_volumes(points: DataFrame, by: str, metric: str = "volume") -> DataFrame:
    """(by, n, box, radius): the least box on a face of each group's hull, and the sphere about its centre that reaches all points.

    ``metric`` is volume, area or diagonal. The box holds all points. A group of one place has extents
    and radius 1. Points with a null coordinate don't count.
    """
    points = points.where("x is not null and y is not null and z is not null")
    extremes = extreme_points(points, [by])

    @F.pandas_udf("struct<x:double,y:double,z:double,w:double>")
    def turned(sets: pd.Series) -> pd.DataFrame:
        rows = [quaternion(best_frame(np.array([[e["x"], e["y"], e["z"]] for e in s], np.float64), metric)) for s in sets]
        return pd.DataFrame(rows, columns=["x", "y", "z", "w"])

    quats = extremes.select(by, "n", turned("extremes").alias("quat"))
    local = points.select(by, "x", "y", "z").join(shuffled(quats), by).select(by, "n", "quat", "x", "y", "z", rotate(F.struct("x", "y", "z"), conjugate(F.col("quat"))).alias("p"))
    ends = local.groupBy(by).agg(F.first("n").alias("n"), F.first("quat").alias("quat"), *(f(f"p.{c}").alias(f"{k}{c}") for c in "xyz" for k, f in (("lo", F.min), ("hi", F.max))))
    half = {c: (F.col(f"hi{c}") - F.col(f"lo{c}")) / 2 for c in "xyz"}
    middle = F.struct(*(((F.col(f"hi{c}") + F.col(f"lo{c}")) / 2).alias(c) for c in "xyz"))
    boxes = ends.select(by, "n", "quat", rotate(middle, F.col("quat")).alias("center"), F.struct(*(half[c].alias(c) for c in "xyz")).alias("extents"))
    point = (F.col("extents.x") == 0) & (F.col("extents.y") == 0) & (F.col("extents.z") == 0)
    one = F.struct(*(F.lit(1.0).alias(c) for c in "xyz"))
    boxes = boxes.select(by, "n", F.struct("center", F.when(point, one).otherwise(F.col("extents")).alias("extents"), "quat").alias("box"), point.alias("point"))
    away = [F.col(c) - F.col(f"box.center.{c}") for c in "xyz"]
    met = points.select(by, "x", "y", "z").join(shuffled(boxes), by)
    far = F.max(F.sqrt(away[0] * away[0] + away[1] * away[1] + away[2] * away[2]))
    volumes = met.groupBy(by).agg(F.first("n").alias("n"), F.first("box").alias("box"), F.first("point").alias("point"), far.alias("radius"))
    return volumes.select(by, "n", "box", F.when(F.col("point"), 1.0).otherwise(F.col("radius")).alias("radius"))
