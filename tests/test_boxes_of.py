"""Boxes of corners that are flat, short, a place or not quite square."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlake.operators import boxes_of

CORNERS = [(x, y, z) for z, y, x in itertools.product((-1, 1), repeat=3)]


def rotation(rng):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    return q * np.sign(np.linalg.det(q))


def matrix(q):
    x, y, z, w = q.x, q.y, q.z, q.w
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


def test_boxes_of_corners(spark):
    rng = np.random.default_rng(2)
    cases = {}
    for i, e in enumerate([(3, 2, 1), (1, 2, 3), (0, 2, 1), (2, 0, 1), (2, 1, 0), (0, 0, 3), (0, 3, 0), (3, 0, 0), (0, 0, 0)] * 3):
        cases[i] = np.array(CORNERS) * e @ rotation(rng).T + rng.uniform(-9, 9, 3), e
    skewed = np.array(CORNERS, float) * (3, 2, 1)
    skewed[7] += 0.2
    rows = [(i, [tuple(map(float, c)) for c in p]) for i, (p, _) in cases.items()] + [(99, [tuple(map(float, c)) for c in skewed])]
    df = spark.createDataFrame(rows, "id long, corners array<struct<x:double,y:double,z:double>>")
    got = {r.id: r.o for r in boxes_of.boxes_of_corners(df, "corners", "o").collect()}
    for i, (p, e) in cases.items():
        o, m = got[i], matrix(got[i].quat)
        assert np.allclose(m @ m.T, np.eye(3), atol=1e-9) and np.linalg.det(m) == pytest.approx(1)
        assert (o.extents.x, o.extents.y, o.extents.z) == pytest.approx(e, abs=1e-6)
        back = np.array(CORNERS) * e @ m.T + (o.center.x, o.center.y, o.center.z)
        assert np.abs(np.sort(back, axis=0) - np.sort(p, axis=0)).max() < 1e-6
    o, m = got[99], matrix(got[99].quat)
    local = (skewed - (o.center.x, o.center.y, o.center.z)) @ m
    assert (np.abs(local) <= np.array([o.extents.x, o.extents.y, o.extents.z]) + 1e-9).all()
    again = boxes_of.boxes_of_points(df.join(spark.createDataFrame([(i, tuple(o.quat)) for i, o in got.items()], "id long, q struct<x:double,y:double,z:double,w:double>"), "id"), "corners", "q", "o")
    for r in again.collect():
        assert (r.o.extents.x, r.o.extents.y, r.o.extents.z) == pytest.approx(tuple(got[r.id].extents), abs=1e-9)
        assert tuple(r.o.center) == pytest.approx(tuple(got[r.id].center), abs=1e-9)
    assert df.columns == ["id", "corners"] and boxes_of.boxes_of_corners(df.limit(0), "corners", "o").select(F.col("o.center.x")).count() == 0


def test_projected_volumes_hold_their_vertices(spark):
    import math

    from meshlake.functions.frames import Geographic, SpatialReference
    from meshlake.operators import hulls

    rng = np.random.default_rng(4)
    rows = [(i % 6, float(-179 + 60 * (i % 6) + rng.uniform(0, 0.01)), float(-75 + 30 * (i % 6) + rng.uniform(0, 0.01)), float(rng.uniform(-20, 900))) for i in range(240)]
    rows += [(9, 5.0, 6.0, 7.0)] * 2
    df = spark.createDataFrame(rows, "node long, x double, y double, z double")
    got = {r.node: r for r in hulls.projected_volumes(df, "node", Geographic()).collect()}

    def cartesian(lon, lat, h):
        a, e2 = 6378137.0, 0.0818191908426215**2
        lam, phi = math.radians(lon), math.radians(lat)
        n = a / math.sqrt(1 - e2 * math.sin(phi) ** 2)
        return np.array([(n + h) * math.cos(phi) * math.cos(lam), (n + h) * math.cos(phi) * math.sin(lam), (n * (1 - e2) + h) * math.sin(phi)])

    for node, *p in rows:
        r = got[node]
        d = cartesian(*p) - cartesian(r.center.x, r.center.y, r.center.z)
        assert np.linalg.norm(d) <= r.radius + 1e-3
        if node != 9:
            local = d @ matrix(r.box.quat)
            assert (np.abs(local) <= np.array([r.box.extents.x, r.box.extents.y, r.box.extents.z]) + 1e-3).all()
    assert got[9].radius == 1 and got[9].n == 2
    flat = {r.node: r for r in hulls.projected_volumes(df, "node", SpatialReference()).collect()}
    assert flat[0].center == flat[0].box.center
    moved = hulls.recentred(df.withColumn("more", F.lit(1)), hulls.projected_volumes(df, "node", SpatialReference()), "node")
    assert moved.columns == ["node", "x", "y", "z", "more"] and moved.where("node = 9").distinct().count() == 1
