"""The bounding hierarchy against a plain recursion over points."""

from __future__ import annotations

import math
import random

import pytest

from meshlake.operators import hierarchy, trees
from meshlake.operators.hulls import DIRECTIONS, frames


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def hull_of(points):
    return [(min(dot(p, d) for p in points), max(dot(p, d) for p in points)) for d in DIRECTIONS]


def spread(points):
    return round(sum((b - a) ** 2 for a, b in hull_of(points)), 9)


def ball(points):
    """Centre and radius from the frame whose box has the least diagonal."""
    best = None
    for axes in frames():
        ends = [(min(dot(p, a) for p in points), max(dot(p, a) for p in points)) for a in axes]
        diagonal = round(sum((b - a) ** 2 for a, b in ends), 9)
        if best is None or diagonal < best[0]:
            best = diagonal, [sum((a + b) / 2 * axis[c] for (a, b), axis in zip(ends, axes, strict=True)) for c in range(3)], math.sqrt(sum((b - a) ** 2 for a, b in ends)) / 2
    return best[1:]


def cells_of(rows, leaf, cell=""):
    """cell -> rows, halved at the median of the widest axis."""
    if len(rows) <= leaf:
        return {cell: rows}
    wide = [max(r[1][c] for r in rows) - min(r[1][c] for r in rows) for c in range(3)]
    axis = wide.index(max(wide))
    rows = sorted(rows, key=lambda r: (r[1][axis], r[0]))
    half = len(rows) // 2
    return cells_of(rows[:half], leaf, cell + "0") | cells_of(rows[half:], leaf, cell + "1")


def plain_hierarchy(rows, scale, leaf, keep):
    """node -> (parent, radius); rows are (fid, (x, y, z))."""
    cells = cells_of(rows, leaf)
    under, kids = {}, {}

    def up(cell):
        here = {f"p{f}": [p] for f, p in cells[cell]} if cell in cells else up(cell + "0") | up(cell + "1")
        names, k = sorted(here), 0
        while len(names) > (keep if cell else 1):
            _, i, j = min((spread(here[names[i]] + here[names[j]]), i, j) for i in range(len(names)) for j in range(i + 1, len(names)))
            new = f"{cell}:{k}"
            k += 1
            kids[new] = names[i], names[j]
            here[new] = under[new] = here[names[i]] + here[names[j]]
            names = [n for n in names if n not in kids[new]] + [new]
        return {n: here[n] for n in names}

    out = {}

    def down(name, parent, of):
        radius = ball(under[name])[1] if name in under else 0.0
        if parent is None or name not in kids or radius < of / scale:
            out[name] = (parent, radius)
            parent, of = name, radius
        for k in kids.get(name, ()):
            down(k, parent, of)

    for top in up(""):
        down(top, None, None)
    return out


@pytest.mark.parametrize("n,leaf,keep,scale", [(90, 8, 4, 2.0), (70, 64, 32, 1.5), (40, 5, 2, 3.0), (1, 8, 4, 2.0)])
def test_hierarchy(spark, n, leaf, keep, scale):
    rng = random.Random(n)
    rows = [(i, tuple(rng.gauss(rng.choice((0, 40)), 5) for _ in range(3))) for i in range(n)]
    rows = [(i, rows[0][1]) if 0 < i % 17 == 3 else (i, p) for i, p in rows]  # some points are equal
    df = spark.createDataFrame([(i, *p) for i, p in rows], "fid long, x double, y double, z double").repartition(4)
    got = hierarchy.bounding_hierarchy(df, scale, leaf, keep).collect()
    want = plain_hierarchy(rows, scale, leaf, keep)
    assert {r.node: r.parent for r in got} == {k: p for k, (p, _) in want.items()}
    assert all(r.radius == pytest.approx(want[r.node][1], abs=1e-9) for r in got)
    assert sorted(r.fid for r in got if r.fid is not None) == list(range(n))
    at = {r.node: r for r in got}
    for r in got:  # a sphere holds the points below it
        up = r
        while r.fid is not None and up.parent is not None:
            up = at[up.parent]
            assert math.dist((up.x, up.y, up.z), (r.x, r.y, r.z)) <= up.radius + 1e-6


@pytest.mark.parametrize("block", [30, 7, 4])
def test_hierarchy_is_the_same_wherever_tasks_take_over(spark, block):
    rng = random.Random(6)
    rows = [(i, tuple(rng.gauss(rng.choice((0, 40)), 5) for _ in range(3))) for i in range(113)]
    df = spark.createDataFrame([(i, *p) for i, p in rows], "fid long, x double, y double, z double").repartition(3)
    got = hierarchy.bounding_hierarchy(df, 2.0, 6, 4, block=block).collect()
    want = plain_hierarchy(rows, 2.0, 6, 4)
    assert {r.node: r.parent for r in got} == {k: p for k, (p, _) in want.items()}
    assert all(r.radius == pytest.approx(want[r.node][1], abs=1e-9) for r in got)


def test_hierarchy_of_nothing(spark):
    df = spark.createDataFrame([], "fid long, x double, y double, z double")
    assert hierarchy.bounding_hierarchy(df).collect() == []
    assert trees.median_cells(df).collect() == []


def test_median_cells_are_the_same_wherever_tasks_take_over(spark):
    rng = random.Random(2)
    rows = [(i, tuple(float(rng.randrange(9)) for _ in range(3))) for i in range(300)]
    df = spark.createDataFrame([(i, *p) for i, p in rows], "fid long, x double, y double, z double")
    want = {i: (cell, len(own)) for cell, own in cells_of(rows, 8).items() for i, _ in own}
    for block in (1000, 60, 1):
        assert {r.fid: (r.cell, r.n) for r in trees.median_cells(df, 8, block=block).collect()} == want
    shallow = trees.median_cells(df, 8, 2, block=100).collect()
    assert {len(r.cell) for r in shallow} == {2} and {r.n for r in shallow} == {75}
