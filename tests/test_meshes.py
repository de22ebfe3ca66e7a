"""Runs of equal values over blocks of a few rows, against a plain loop."""

from __future__ import annotations

import random
from itertools import groupby

from meshlake.operators import joins, meshes


def test_runs_across_blocks_and_groups(spark):
    rng = random.Random(2)
    rows = [(g, i * 3, rng.choice((1, 1, 1, None, 2))) for g in range(4) for i in range(rng.choice((1, 7, 40)))]
    df = spark.createDataFrame(rows, "g int, k long, v int").repartition(4)
    got = {(r.g, r.first, r.last, r.value) for r in meshes.runs_across(df, "k", "v", ("g",), block=3).collect()}
    want = set()
    for (g, v), part in groupby(rows, key=lambda r: (r[0], r[2])):
        part = list(part)
        want.add((g, part[0][1], part[-1][1], v))
    assert got == want
    assert meshes.runs_across(df.limit(0), "k", "v", ("g",)).count() == 0


def test_nearest_cluster_far_from_all_centres(spark):
    rng = random.Random(3)
    place = lambda spread: tuple(rng.uniform(-spread, spread) for _ in range(3))
    centres = [(i, *place(5.0)) for i in range(60)] + [(99, 400.0, 0.0, 0.0)]
    items = [(i, *place(6.0)) for i in range(80)] + [(1000, 900.0, -900.0, 3.0), (1001, -5000.0, 0.0, 0.0)]
    a, b = (spark.createDataFrame(r, "id long, x double, y double, z double") for r in (items, centres))
    want = {i: min((sum((p - q) ** 2 for p, q in zip(at, c[1:], strict=True)) ** 0.5, c[0]) for c in centres) for i, *at in items}
    for most in (100, 5):
        got = {r.id: (r.distance, r.centre) for r in joins.nearest_cluster(a, b, most).collect()}
        assert {i: c for i, (_, c) in got.items()} == {i: c for i, (_, c) in want.items()}
        assert all(abs(got[i][0] - want[i][0]) < 1e-9 for i in want)


def test_nearest_cluster_of_items_and_centres_at_few_places(spark, monkeypatch):
    """Many items and centres at the same places: each place is sought once."""
    from pyspark.sql import functions as F

    sizes, staged = {}, joins.staged

    def counted(df, name):
        out = staged(df, name)
        sizes.setdefault(name, out.count())
        return out

    monkeypatch.setattr(joins, "staged", counted)

    k = F.col("id")
    items = spark.range(20_000).select("id", (k % 9).alias("x"), (k * 7 % 8).alias("y"), (k % 3).alias("z"))
    centres = spark.range(6_000).select("id", (k * 5 % 7).alias("x"), (k % 2).alias("y"), (k % 3).alias("z"))
    plain = {}
    for c in centres.collect():
        plain[c.x, c.y, c.z] = min(c.id, plain.get((c.x, c.y, c.z), c.id))
    got = joins.nearest_cluster(items, centres, 8).collect()
    want = {}
    for p in {(i % 9, i * 7 % 8, i % 3) for i in range(20_000)}:
        want[p] = min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)) ** 0.5, n) for c, n in plain.items())
    assert len(got) == 20_000
    assert all((r.distance, r.centre) == want[r.id % 9, r.id * 7 % 8, r.id % 3] for r in got)
    assert sizes["places"] == 9 * 8 == len({(i % 9, i * 7 % 8, i % 3) for i in range(20_000)}) and sizes["centres"] == len(plain)
