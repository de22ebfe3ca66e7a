"""Quality classifier and language ID by held-out accuracy; the pipeline against plain Python."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

import corpus_pipeline
from meshlake.llm import language_id, packing, quality, queries

from . import brute
from .conftest import SF

MIDDLE = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in queries.op3_quality_rules(spark, MIDDLE).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{MIDDLE}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for d, r in rows.items())
    held = [d for d in labels if d in rows and rows[d].held_out]
    good, bad = ([rows[d].score for d in held if labels[d] == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9
    assert np.mean([rows[d].predicted == 1 for d in held if labels[d] == 1]) > 0.9


def test_rules_as_columns_are_the_rules(spark, documents, labels):
    x, y = quality.labelled_sample(documents, labels)
    model = quality.learn(x, y)
    assert 0 < len(model.rules) < 400
    total = model.intercept + sum(w * quality.holds(r, x) for r, w in model.rules)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{s} double" for s in quality.STATISTICS)).coalesce(1)
    assert np.allclose([r[0] for r in df.select(model.score()).collect()], 1 / (1 + np.exp(-total)))


def test_quality_cases(spark, documents, labels, odd, nothing):
    some = quality.quality_report(odd, labels)
    assert some.count() == odd.count() and some.where("score is null or score < 0 or score > 1").count() == 0
    assert {r.score for r in quality.quality_report(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_report(nothing, labels).count() == 0
    clash = labels.selectExpr("doc_id", "quality", "toxic", "'x' as text", "1 as n_chars", "0.5 as score", "2 as row")
    assert quality.keep_good(documents, clash).count() == quality.keep_good(documents, labels).count()
    kept = quality.keep_good(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_language_on_held_out_rows(spark):
    got = {r.doc_id: r for r in queries.op10_language_id(spark, MIDDLE).collect()}
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in docs)
    held = [r for r in docs if got[r.doc_id].held_out and r.lang]
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.95


def test_language_cases(odd, nothing):
    assert {(r.lang_pred, r.score) for r in language_id.language_report(odd).collect()} == {("und", 0.0)}
    assert language_id.language_report(nothing).count() == 0
    rng = np.random.default_rng(0)
    x = rng.integers(97, 110, (60, language_id.WINDOW)).astype(np.uint8)
    x[30:] += 13
    model = language_id.train(x, np.repeat([0, 1], 30), ["a", "b"], steps=60)
    assert (model.log_probs(x).argmax(axis=1) == np.repeat([0, 1], 30)).all()


def test_many_languages(spark):
    """More languages than any bound on rows has: each is learned and predicted."""
    rng = np.random.default_rng(3)
    rows = []
    for lang in range(70):
        alphabet = rng.choice(np.arange(0x100, 0x2000), 12, replace=False)
        rows += [(lang * 100 + i, "".join(map(chr, rng.choice(alphabet, 120))), f"l{lang:02d}") for i in range(30)]
    got = {r.doc_id: r for r in language_id.language_report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {r.lang_pred for r in got.values()} == {lang for _, _, lang in rows}
    assert np.mean([got[d].lang_pred == lang for d, _, lang in rows if got[d].held_out]) > 0.9


def test_undetermined_texts(spark, documents):
    docs = documents.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(10**6, None, None), (10**6 + 1, "", None), (10**6 + 2, "123 _ !?", None), (10**6 + 3, "½ ② Ⅳ ٣ 🙂", None), (10**6 + 4, "½ ª", None)], "doc_id long, text string, lang string"))
    got = {r.doc_id: r.lang_pred for r in language_id.language_report(docs).where("doc_id >= 1000000").collect()}
    assert got.pop(10**6 + 4) != "und"  # ª is a letter
    assert set(got.values()) == {"und"} and len(got) == 4


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after each stage, as the driver of the pipeline sees them."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs.collect())
    from meshlake.llm.common import shared_table

    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        docs = shared_table(f(spark, docs, SF), f"stage-{i}")
        out.append(docs.collect())
    return out


def test_pipeline_stages(spark, stages, documents, labels):
    ids = lambda rows: {r.doc_id for r in rows}
    model = quality.learn_fold(documents, labels)
    x = np.array([quality.statistics(r.text) for r in stages[0]])
    good = 1 / (1 + np.exp(-(model.intercept + sum(w * quality.holds(r, x) for r, w in model.rules)))) >= quality.KEEP
    assert ids(stages[1]) == {r.doc_id for r, g in zip(stages[0], good, strict=True) if g}
    assert len(stages[1]) < len(stages[0])
    groups = brute.jaccard_groups([(r.doc_id, r.text) for r in stages[1]])
    assert ids(stages[2]) == {d for d, _, c in groups if d == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = brute.overlaps([(r.doc_id, r.text) for r in stages[2]], items)
    assert ids(stages[3]) == ids(stages[2]) - {doc for doc, _ in leaks}
    before = {r.doc_id: r for r in stages[3]}
    assert ids(stages[4]) == set(before)
    for r in stages[4]:
        assert not brute.base_secrets(r.text) and r.n_chars == len(r.text)
        if r.text != before[r.doc_id].text:
            assert "[secret]" in r.text
        if brute.base_secrets(before[r.doc_id].text):
            assert r.text != before[r.doc_id].text
    path = queries.tokenizer_path()
    packed = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.sequence_id, r.offset) for r in stages[5]]
    assert sorted(p[:5] for p in packed) == sorted(p for r in stages[4] for p in brute.pieces(r.doc_id, r.text, path, packing.SEQUENCE))
    assert not brute.packing_problems(packed, packing.SEQUENCE)[0]


def test_pipeline_keeps_the_columns(spark, stages, documents):
    for rows in stages[:5]:
        assert list(rows[0].asDict()) == documents.columns
    assert corpus_pipeline.run(spark, SF).count() == len(stages[5])
