"""Jaccard join, sentence spans and decontamination against plain Python."""

from __future__ import annotations

import random
import time

import pytest

from meshlake.llm import decontaminate, jaccard_join, queries, span_dedup

from . import brute
from .conftest import SF

by_text = lambda rows: sorted(rows, key=str)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def near_copies(seed=5, groups=40):
    """Texts with 0 to 12 words changed, so that similarities lie on both sides of the threshold."""
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(5000)}" for _ in range(rng.choice((3, 8, 12, 40, 150, 400)))]
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            out.append((len(out), " ".join(copy)))
    return out


def test_jaccard_groups_on_documents(spark, documents):
    got = [tuple(r) for r in queries.op4_jaccard_join(spark, SF).select("doc_id", "n_shingles", "component_id").collect()]
    assert by_text(got) == by_text(brute.jaccard_groups(pairs(documents)))


def test_jaccard_groups_near_the_threshold(spark):
    rows = near_copies()
    got = jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute.jaccard_groups(rows)
    assert by_text(map(tuple, got.collect())) == by_text(want)
    assert 40 < len({w[2] for w in want}) < len(rows)


@pytest.mark.parametrize(("block", "hot"), [(4, 2), (16, 1)])
def test_jaccard_groups_in_hot_buckets(spark, block, hot):
    """Unequal sets with a common part, some near one another: buckets are salted and refined, and nothing is lost."""
    rng = random.Random(block)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for g in range(150):
        own = [f"g{g}w{i}" for i in range(rng.choice((4, 8, 25)))]
        for _ in range(2):
            rows.append((len(rows), " ".join(common + own)))
            own = own[:-1] + [f"z{rng.randrange(10**6)}"]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.jaccard_groups(df, block=block, hot=hot)
    assert by_text(map(tuple, got.collect())) == by_text(brute.jaccard_groups(rows))


def test_jaccard_odd_rows(odd, odd_rows, nothing):
    got = jaccard_join.jaccard_groups(odd)
    assert by_text(map(tuple, got.collect())) == by_text(brute.jaccard_groups(odd_rows))
    assert jaccard_join.jaccard_groups(nothing).count() == 0
    assert jaccard_join.one_of_each_group(nothing).count() == 0


def test_one_row_of_each_group_stays(spark, odd, odd_rows):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (1, a), (1, b), (0, b), (None, a), (None, a), (None, c), (None, c), (5, None), (5, None), (6, " "), (7, a + " more")]
    kept = jaccard_join.one_of_each_group(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, place int"))
    assert kept.columns == ["doc_id", "text", "place"]
    assert by_text((r.doc_id, r.text) for r in kept.collect()) == by_text([(1, a), (0, b), (None, c), (5, None), (5, None), (6, " ")])
    kept = jaccard_join.one_of_each_group(odd)
    assert kept.columns == odd.columns
    # By brute force: groups of rows, numbered apart from their ids.
    groups = brute.jaccard_groups([(i, t) for i, (_, t) in enumerate(odd_rows)])
    want = []
    for g in sorted({c for _, n, c in groups if n}):
        ids = [odd_rows[i][0] for i, n, c in groups if n and c == g]
        want.append(min((d for d in ids if d is not None), default=None))
    want += [odd_rows[i][0] for i, n, _ in groups if not n]
    assert by_text(r.doc_id for r in kept.collect()) == by_text(want)


def test_span_dedup_on_documents(spark, documents):
    want = brute.removed_sentences(pairs(documents), span_dedup.sentences, span_dedup.LEAST_SENTENCES, span_dedup.LEAST_WORDS)
    want = {d: (text, gone) for (d, text), gone in want.items()}
    got = {r.doc_id: r for r in queries.op7_span_dedup(spark, SF).collect()}
    assert set(got) <= set(want) and got
    for d, (text, gone) in want.items():
        parts = span_dedup.sentences(text)
        removed = [tuple(map(int, s.split("-"))) for s in got[d].removed.split(",")] if d in got else []
        assert all(len(text[a:b].split()) >= span_dedup.LEAST_SPAN for a, b in removed)
        inside = {i for i, p in enumerate(parts) if any(a <= p[0] and p[1] <= b for a, b in removed)}
        # Whole stretches of enough words go, and what goes is such sentences, but for a few that an extension took in.
        stretches, edges = [], []
        for i in sorted(gone):
            if stretches and stretches[-1][-1] == i - 1:
                stretches[-1].append(i)
            else:
                stretches.append([i])
        for s in stretches:
            if sum(parts[i][3] for i in s) >= span_dedup.LEAST_SPAN:
                assert set(s) <= inside
            edges += [s[0], s[-1]]
        assert all(min(abs(i - e) for e in edges) <= span_dedup.FLANK for i in inside - gone)
        assert (got[d].n_removed if d in got else 0) == len(inside & gone)
        left = text
        for a, b in sorted(removed, reverse=True):
            left = left[:a] + left[b:]
        assert d not in got or got[d].text == left.strip()


def test_span_dedup_leaves_short_repetitions(spark):
    notice = "This notice stands in many documents. It is short and says little of note. Nobody would miss it much."
    rows = [(i, f"Document {i} begins with words of its own. {notice} Then it ends as number {i * 7}.") for i in range(9)]
    assert span_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_span_dedup_passage_at_other_sentence_bounds(spark):
    passage = " ".join(f"shared{i}" for i in range(60)) + "."
    rows = [(1, f"Alpha beta gamma. {passage} One two."), (2, f"Delta.\n{passage}\nThree."), (3, "Nothing of the kind here. Nor here either.")]
    got = span_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in got] == [2]
    assert "shared30" not in got[0].text and "Delta." in got[0].text and "Three." in got[0].text and got[0].first_doc_ids == [1]


@pytest.mark.parametrize("before", [1, 5, 11])
def test_span_dedup_passage_inside_long_sentences(spark, before):
    passage = " ".join(f"shared{i}" for i in range(60))
    around = lambda d, n: " ".join(f"d{d}w{i}" for i in range(n))
    rows = [(1, f"{around(1, 30)} {passage} {around(2, 30)}"), (2, f"{around(3, 30 + before)} {passage} {around(4, 30)}")]
    got = span_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.first_doc_ids) for r in got] == [(2, [1])]
    assert got[0].text.split() == f"{around(3, 30 + before)} {around(4, 30)}".split()


def plain_sentences(text):
    """Sentences of up to twelve words, split character by character; None where one is longer."""
    out, start = [], 0
    for i, c in enumerate(text):
        if c == "\n" or (c in ".!?" and i + 1 < len(text) and text[i + 1].isspace()):
            out.append(text[start : i + (c != "\n")])
            start = i + 1
    return [" ".join(s.split()).lower() for s in [*out, text[start:]] if s.split()]


def test_sentences(documents):
    for _, text in pairs(documents):
        parts, end = span_dedup.sentences(text), 0
        for a, b, words, n in parts:
            assert a >= end and " ".join(text[a:b].split()).lower() == words and n == len(words.split()) <= span_dedup.LONGEST
            end = b
        assert " ".join(p[2] for p in parts) == " ".join(text.split()).lower()
        whole = plain_sentences(text)
        assert {p for p in whole if len(p.split()) <= span_dedup.LONGEST} <= {p[2] for p in parts}


def test_span_dedup_hard_texts_are_fast(harsh):
    began = time.monotonic()
    assert {r.doc_id for r in span_dedup.deduplicate(harsh).collect()} == {1, 2, 8, 9, 10}
    assert time.monotonic() - began < 60


def test_span_dedup_rows_of_one_id(spark):
    passage = ". ".join(f"shared{i} one two three four five" for i in range(9)) + "."
    rows = [(None, f"First text {i} stands here.\n{passage}") for i in range(30)] + [(-1, f"First text 3 stands here.\n{passage}")]
    got = span_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in got) == ["-1"] + ["None"] * 29 and all("shared3" not in r.text for r in got)


def test_span_dedup_odd_rows(odd, odd_rows, nothing):
    got = {r.doc_id for r in span_dedup.deduplicate(odd).collect()}
    assert {8, 9} <= got and not got & {1, 2, 3, 4, 5, 6, 7, 10}
    assert span_dedup.deduplicate(nothing).count() == 0


def test_overlaps_on_documents(spark, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.n_matched for r in queries.op6_decontaminate(spark, SF).collect()}
    assert got == brute.overlaps(pairs(documents), items) and got


def leaks(n_items=60, seed=9):
    """Items of 1 to 40 words with a shared preamble for some, and documents that hold them with up to a fifth of the words changed."""
    rng = random.Random(seed)
    words = lambda n: [f"v{rng.randrange(4000)}" for _ in range(n)]
    preamble = words(16)
    items = [(i, " ".join((preamble if i % 7 == 0 else []) + words(rng.choice((1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12, 16, 20, 40))))) for i in range(n_items)]
    docs = []
    for i, text in items:
        leak = text.split()
        for at in rng.sample(range(len(leak)), len(leak) // 5):
            leak[at] = f"changed{at}"
        before, after = " ".join(words(rng.randrange(12))), " ".join(words(rng.randrange(12)))
        docs.append((i, f"{before}\n{' '.join(leak)}\n{after}" if i % 2 else f"{before} {' '.join(leak)} {after}"))
    return docs, items


def test_overlaps_of_items_of_all_lengths(spark):
    docs, items = leaks()
    table = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r.n_matched for r in decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), table).collect()}
    assert got == brute.overlaps(docs, items)
    found = {d for d, _ in got}
    lengths = {i: len(t.split()) for i, t in items}
    assert {i for i, n in lengths.items() if 5 <= n <= 15 or n >= 30 or (n < 5 and i % 2)} <= found
    assert not {i for i, n in lengths.items() if n < 5 and i % 2 == 0} & found  # inside a running line
    assert sum(lengths[i] > 4 for i in found) >= 0.9 * sum(n > 4 for n in lengths.values())


def test_short_items_are_whole_lines(spark):
    docs = [(1, "four words of it"), (2, "so, FOUR words of it follow"), (3, "first\nFour; words, of it!\nlast"), (4, "four\nwords of\nit"), (None, "one"), (5, "one two")]
    items = [(7, "Four words of it"), (8, "one"), (9, "..."), (10, None)]
    found = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.n_matched) for r in found.collect()} == {(1, 7, 4), (3, 7, 4), (4, 7, 4), (None, 8, 1)}
    kept = decontaminate.drop_contaminated(spark.createDataFrame([*docs, (1, "another text")], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(map(str, [docs[1], docs[5], (1, "another text")]))


@pytest.mark.parametrize("at", [2, 5, 9])
def test_overlaps_tolerate_substitutions(spark, at):
    item = [f"bench{i}" for i in range(14)]
    leak = list(item)
    leak[at] = "other"
    docs = spark.createDataFrame([(1, "before it " + " ".join(leak) + " after it"), (2, "nothing " * 30)], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(item).upper()), (9, "too short"), (10, None)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.n_matched) for r in decontaminate.overlaps(docs, items).collect()] == [(1, 7, 13)]


def test_shared_windows_count_for_every_item(spark):
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    preamble = words("shared", 24)
    items = [(3, f"{preamble} {words('first', 12)}"), (4, f"{words('lead', 7)} {preamble} {words('second', 12)}"), (5, words("own", 20)), (6, f"{preamble} {words('first', 12)}".upper()), (None, f"{preamble} {words('last', 5)}")]
    docs = [(1, f"some text {preamble} and more"), (2, f"{words('lead', 7)} {preamble} {words('second', 12)}"), (7, words("own", 20))]
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_item, r.n_matched, r.doc_word, r.item_word) for r in decontaminate.overlaps(*tables, every_item=True).collect()}
    assert set(got) == {(d, i) for d in (1, 2) for i in (3, 4, 6, None)} | {(7, 5)}
    assert got[1, 3] == got[1, 6] == (36, 24, 2, 0) and got[1, 4] == (43, 24, 2, 7) and got[1, None] == (29, 24, 2, 0) and got[2, 4] == (43, 43, 0, 0)
    assert set(got) > {(r.doc_id, r.item_id) for r in decontaminate.overlaps(*tables).collect()}


def test_decontaminate_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame([(1, "the end of the ids is here"), (None, None), (2, "")], "item_id long, text string")
    kept = decontaminate.drop_contaminated(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1
    clash = items.selectExpr("item_id", "text", "1 as doc_id", "2 as text_hash", "3 as seed")
    assert decontaminate.drop_contaminated(odd, clash).count() == odd.count() - 1
    assert decontaminate.drop_contaminated(nothing, items).count() == 0
    assert decontaminate.drop_contaminated(odd, items.limit(0)).count() == odd.count()
