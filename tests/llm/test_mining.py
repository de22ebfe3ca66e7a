"""Collocations, shards and periodic runs against plain Python."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from meshlake.llm import collocations, periodic_runs, queries, sharding
from tests.compare import connection, rows_of_spark, rows_of_sql

from . import brute
from .conftest import SF


# ---------------------------------------------------------------- collocations
def phrases(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def test_collocations_agree_with_sql(spark):
    df = queries.op11_collocations(spark, SF)
    columns, want = rows_of_sql(connection(SF), queries.ORACLE_SQL["op11_collocations"])
    assert sorted(df.columns) == columns
    assert rows_of_spark(df) == want


@pytest.mark.parametrize("shard,range_bits", [(200, 8), (5_000, 12), (1 << 20, 16)])
def test_collocations_of_small_shards_and_crowded_cells(spark, shard, range_bits):
    rng = random.Random(3)
    words = "a b c the x Ä ä it's (x) 10%  |".split(" ")
    rows = [(rng.choice(["en", "xx", None, "und", ""]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "!?", "\n"]) for _ in range(rng.randrange(60)))) for _ in range(150)]
    rows += [("en", None), ("en", ""), (None, None), ("no", " .,\n "), ("long", "one two three. " * 3000), ("once", "w" * 5000 + " x")] + [("cover", "p q r s")] * 5 + [("cover", "p q")] * 1
    docs = spark.createDataFrame([(None, t, x, 1, "n") for x, t in rows], "doc_id long, text string, lang string, a long, phrase string").repartition(7)
    got = phrases(collocations.collocations(docs, top=40, least=4, shard=shard, range_bits=range_bits))
    assert got == sorted(brute.collocations(rows, least=4, top=40))
    assert {r[0] for r in got} == {"en", "xx", "und", "", "long", "cover"}


def test_collocations_of_nothing(nothing):
    assert collocations.collocations(nothing).collect() == []


def test_collocations_of_odd_and_hostile_texts(odd, odd_rows, harsh, harsh_rows):
    assert phrases(collocations.collocations(odd)) == sorted(brute.collocations([(None, t) for _, t in odd_rows]))
    from pyspark.sql import functions as F

    got = phrases(collocations.collocations(harsh.withColumn("lang", F.lit("en"))))
    assert got == sorted(brute.collocations([("en", t) for _, t in harsh_rows]))


def test_the_scores_of_large_counts_are_exact(spark):
    n = 1 << 61
    counts = spark.createDataFrame([("en", "a b", n, 2), ("en", "a", n + 1, 1), ("en", "b", n + 2, 1), ("en", "a b c", n // 2, 3), ("en", "b c", n // 2 + 7, 2), ("en", "c", n, 1)], collocations.COUNTS + ", words int")
    got = {r.phrase: (r.l, r.r, r.score) for r in collocations.scores(counts).collect()}
    assert got["a b"] == (n + 1, n + 2, 2000000 * n // (2 * n + 3))
    assert got["a b c"] == (n, n, 2000000 * (n // 2) // (2 * n))
    assert set(got) == {"a b", "a b c"}  # ``b c`` is covered


# ---------------------------------------------------------------- shards
def test_shards_and_their_places(spark, odd, odd_rows):
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(5000)] + [(7, "again")] * 2000 + odd_rows, "doc_id long, text string").repartition(9)
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == 7000 + len(odd_rows)
    want = sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in [(i, f"text {i % 7}") for i in range(5000)] + [(7, "again")] * 2000 + odd_rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in rows) == want
    for s in range(16):
        own = sorted((r.slot, r.doc_id is not None, r.doc_id or 0) for r in rows if r.shard == s)
        assert [x[0] for x in own] == list(range(len(own)))
        assert own == sorted(own, key=lambda x: x[1:])  # places follow the ids
    of = {}
    for r in rows:
        assert of.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert r.grown_shard in (r.shard, 16) and r.law == "key"
    share = np.bincount([s for s, _ in of.values()], minlength=16) / len(of)
    assert abs(share * 16 - 1).max() < 0.25
    assert 0.6 < 17 * np.mean([g == 16 for _, g in of.values()]) < 1.4


def test_weights_give_shares_and_changes_move_only_what_they_must(spark):
    from pyspark.sql import functions as F

    ids, key = spark.range(20_000), F.col("id")
    before, heavier, fewer = {0: 1.0, 1: 2.0, 5: 5.0}, {0: 1.0, 1: 2.0, 5: 9.0}, {0: 1.0, 5: 5.0}
    rows = ids.select(*[sharding.shard_of(key, w).alias(n) for n, w in (("a", before), ("b", heavier), ("c", fewer))]).collect()
    assert abs(np.mean([r.a == 5 for r in rows]) - 5 / 8) < 0.02
    assert abs(np.mean([r.a == 1 for r in rows]) - 2 / 8) < 0.02
    assert all(r.b in (r.a, 5) for r in rows)
    assert all(r.c == r.a for r in rows if r.a != 1) and all(r.c != 1 for r in rows)
    assert ids.limit(5).select(sharding.shard_of(key, {3: 1.0}).alias("s")).distinct().collect()[0].s == 3
    with pytest.raises(ValueError):
        sharding.shard_of(key, {})
    with pytest.raises(ValueError):
        sharding.shard_of(key, {0: 0.0})


def test_shards_of_nothing_and_of_clashing_columns(nothing, odd, odd_rows):
    assert sharding.shard_documents(nothing).collect() == []
    assert sharding.shard_documents(odd.withColumns({"shard": odd["n"], "slot": odd["n"], "_at": odd["n"]})).count() == len(odd_rows)


# ---------------------------------------------------------------- periodic runs
def test_runs_of_random_sequences():
    rng = random.Random(1)
    for _ in range(800):
        k, words = rng.choice([1, 2, 3, 5]), []
        while len(words) < rng.randrange(0, 150):
            words += [rng.randrange(k) for _ in range(rng.randrange(1, 16))] * rng.choice([1, 1, 1, 2, 4, 5, 9])
            words = words[: len(words) - rng.randrange(0, 2)]
        numbers = periodic_runs.Numbered()
        for w in ([5, 6, 7], words, [], [1] * rng.randrange(7)):
            numbers.add(w)
        found = numbers.runs()
        assert found[1] == brute.runs(words), words
        assert not found[0] and not found[2]


def test_long_hostile_sequences():
    n = 200_000
    for words, want in (
        ([1] * n, [(0, n, 1)]), ([1] * n + [2] + [1] * n, [(0, n, 1), (n + 1, n, 1)]), ([i % 3 for i in range(n)], [(0, n, 3)]),
        ([bin(i).count("1") % 2 for i in range(n)], []), ([i % (n // 4) for i in range(n)], [(0, n, n // 4)]), ([i % (n // 4 + 1) for i in range(n)], []),
    ):
        numbers = periodic_runs.Numbered()
        numbers.add(words)
        assert numbers.runs()[0] == want


def test_run_report(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r) for r in queries.op13_periodic_runs(spark, SF).collect()}
    some = [r for r in rows if len((r[1] or "").split()) < 1500]
    assert len(got) == len(rows) and len(some) > 150
    assert [got[d] for d, _ in some] == [brute.run_report(d, t) for d, t in some]
    assert sum(r[1] > 0 for r in got.values()) > 10


def test_run_report_of_odd_and_hostile_texts(spark, odd, odd_rows, harsh, harsh_rows, nothing):
    assert periodic_runs.run_report(nothing).collect() == periodic_runs.periodic_runs(nothing).collect() == []
    short = [(d, t) for d, t in odd_rows if len(t or "") < 5000]
    got = periodic_runs.run_report(odd.where("text is null or length(text) < 5000"), periodic_runs.looped).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(brute.run_report(d, t)) for d, t in short)
    assert periodic_runs.run_report(odd).count() == len(odd_rows)
    got = {(r.doc_id, r.start, r.length, r.period) for r in periodic_runs.periodic_runs(harsh).collect()}
    assert got == {(1, 1, 20_000, 1), (2, 0, 100_000, 1), (8, 0, 240_000, 2), (9, 0, 100_000, 1), (10, 0, 400_000, 1)}


def test_collapse_keeps_columns_and_texts_without_runs(spark):
    rows = [(2**60, "a  b\tc", 1), (2, "x y " * 9 + "end", None), (None, None, 3), (3, "", 4), (3, "", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long")
    got = sorted(map(tuple, periodic_runs.collapse(docs).collect()), key=str)
    assert got == sorted([(2**60, "a  b\tc", 1), (2, "x y end", None), (None, None, 3), (3, "", 4), (3, "", 4)], key=str)
