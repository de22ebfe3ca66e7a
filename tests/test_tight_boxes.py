"""Boxes on faces of hulls against a search over all planes and pairs of points."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from meshlake.operators import hulls, tight_boxes


def rotation(rng):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    return q * np.sign(np.linalg.det(q))


def plain_best(p, metric):
    """Least metric over all planes through three points with the others on one side, and all pairs of points as directions in them."""
    cost = lambda frame: tight_boxes.METRICS[metric](np.ptp(p @ np.asarray(frame).T, axis=0))
    best = cost(np.eye(3))
    for i, j, k in itertools.combinations(range(len(p)), 3):
        n = np.cross(p[j] - p[i], p[k] - p[i])
        if np.linalg.norm(n) < 1e-9:
            continue
        n /= np.linalg.norm(n)
        side = (p - p[i]) @ n
        if side.max() > 1e-9 and side.min() < -1e-9:
            continue
        for a, b in itertools.combinations(range(len(p)), 2):
            u = p[b] - p[a] - ((p[b] - p[a]) @ n) * n
            if np.linalg.norm(u) > 1e-7:
                u /= np.linalg.norm(u)
                best = min(best, cost([u, np.cross(n, u), n]))
    return best


@pytest.mark.parametrize("metric", ["volume", "area", "diagonal"])
def test_best_frame(metric):
    rng = np.random.default_rng(3)
    for n in (4, 5, 9, 12):
        p = rng.normal(size=(n, 3)) * (3, 1, 0.5) @ rotation(rng)
        frame = tight_boxes.best_frame(p, metric)
        assert np.allclose(frame @ frame.T, np.eye(3), atol=1e-9)
        # An outline's edge joins two points, so that the search over all pairs can only be as good.
        assert tight_boxes.METRICS[metric](np.ptp(p @ frame.T, axis=0)) == pytest.approx(plain_best(p, metric), rel=1e-6)


def test_flat_and_thin_sets():
    rng = np.random.default_rng(1)
    turn = rotation(rng)
    square = np.array([[0, 0, 0], [2, 0, 0], [2, 3, 0], [0, 3, 0], [1, 1, 0]], float) @ turn
    assert sorted(np.ptp(square @ tight_boxes.best_frame(square, "area").T, axis=0)) == pytest.approx([0, 2, 3], abs=1e-9)
    line = np.outer([0.0, 1.0, 5.0], turn[0])
    assert sorted(np.ptp(line @ tight_boxes.best_frame(line, "diagonal").T, axis=0)) == pytest.approx([0, 0, 5], abs=1e-9)
    assert tight_boxes.best_frame(np.zeros((1, 3)), "volume").shape == (3, 3)


def test_volumes_of_turned_boxes(spark):
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for node in range(12):
        e, turn, at = np.sort(10 ** rng.uniform(-0.5, 0.7, 3)), rotation(rng), rng.uniform(-50, 50, 3)
        corners = np.array(list(itertools.product((-1, 1), repeat=3))) * e
        p = np.vstack([corners, rng.uniform(-1, 1, (40, 3)) * e]) @ turn + at
        rows += [(node, *map(float, x)) for x in p]
        want[node] = e, at
    rows += [(50, 1.0, 2.0, 3.0)] * 3 + [(51, 0.0, 0.0, 0.0), (51, 1.0, 1.0, 1.0), (51, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "node long, x double, y double, z double").repartition(3)
    got = {r.node: r for r in tight_boxes.tight_volumes(df, "node").collect()}
    for node, (e, at) in want.items():
        b = got[node].box
        assert sorted((b.extents.x, b.extents.y, b.extents.z)) == pytest.approx(list(e), rel=1e-6)
        assert (b.center.x, b.center.y, b.center.z) == pytest.approx(tuple(at), abs=1e-6)
        assert got[node].radius == pytest.approx(float(np.linalg.norm(e)), rel=1e-6) and got[node].n == 48
    assert got[50].radius == 1 and got[50].box.extents.x == 1 and got[51].n == 2 and got[51].radius == pytest.approx(3**0.5 / 2)


def test_no_worse_than_fixed_orientations_and_whole(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i % 9), *map(float, rng.normal(size=3) * (9, 3, 1) @ rotation(np.random.default_rng(i % 9)))) for i in range(700)]
    df = spark.createDataFrame(rows, "node long, x double, y double, z double").repartition(4)
    size = lambda b: b.extents.x * b.extents.y * b.extents.z
    tight = {r.node: r for r in tight_boxes.tight_volumes(df, "node").collect()}
    fixed = {r.node: r for r in hulls.node_volumes(df, "node").collect()}
    assert sum(size(tight[n].box) < size(fixed[n].box) for n in tight) >= 8
    for node, *p in rows:
        b = tight[node].box
        q = np.array([b.quat.x, b.quat.y, b.quat.z, b.quat.w])
        d = np.array(p) - (b.center.x, b.center.y, b.center.z)
        v = -q[:3]
        local = d + 2 * q[3] * np.cross(v, d) + 2 * np.cross(v, np.cross(v, d))
        assert (np.abs(local) <= np.array([b.extents.x, b.extents.y, b.extents.z]) + 1e-6).all()
        assert np.linalg.norm(d) <= tight[node].radius + 1e-6


def test_exploded_points_are_never_broadcast(spark):
    from pyspark.sql import functions as F

    from meshlake.operators import hulls

    # A million points from a hundred rows, which Spark estimates at a few kilobytes.
    points = spark.range(100).select(F.col("id").alias("g"), F.explode(F.sequence(F.lit(1), F.lit(10_000))).alias("k"))
    points = points.select("g", *((F.col("k") % n).cast("double").alias(c) for n, c in ((7, "x"), (11, "y"), (13, "z"))))
    volumes = (tight_boxes.tight_volumes(points, "g"), hulls.node_volumes(points, "g"), hulls.box_and_radius(points, "g"))
    for df in volumes:
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
