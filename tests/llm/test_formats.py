"""Chat formatting, packing, secrets, licenses and fingerprints."""

from __future__ import annotations

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from meshlake.llm import chat_format, fingerprint, license_scan, packing, queries, secret_scan

from ..compare import connection, rows_of_spark, rows_of_sql
from . import brute
from .conftest import SF


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# ---------------------------------------------------------------- chat
def test_chat_same_rows_as_sql(spark):
    columns, want = rows_of_sql(connection(SF), queries.ORACLE_SQL["op1_chat_format"])
    df = queries.op1_chat_format(spark, SF)
    assert sorted(df.columns) == columns and rows_of_spark(df) == want


def test_chat_cases(spark):
    rows = [
        (0, 0, "user", "hi", "x"), (0, 1, "assistant", "yes", "x"), (1, 0, "user", "hi", "x"), (1, 1, "assistant", "no", "x"), (1, 2, "user", None, "x"),
        (2, 0, None, None, None), (4, 0, "user", "a", None), (5, 0, "user", "a", None), (7, 0, "user", "z", None), (7, 0, "user", "z", None), (None, 0, "user", "lost", None), (9, None, "user", "first", "x"), (9, 0, "assistant", "s", "x"),
    ]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, same string")
    got = {r.pair_id: r for r in chat_format.preference_format(chat_format.pair_neighbours(conv)).collect()}
    assert got[0].prompt == "<|user|>\nhi<|end|>\n" and got[0].n_prompt_turns == 1
    assert got[0].chosen_completion == "<|assistant|>\nyes<|end|>\n" and got[0].chosen_mask == [1] and got[0].rejected_mask == [1, 0]
    assert got[1].rejected_id is None and got[1].prompt == "" and got[1].chosen_completion == "<||>\n<|end|>\n"
    assert got[2].prompt == "<|user|>\na<|end|>\n" and got[2].chosen_completion == "" == got[2].rejected_completion
    assert got[3].chosen_id is None and got[3].rejected_completion.count("z") == 2
    assert got[4].rejected_completion.startswith("<|user|>\nfirst")
    assert set(got) == {0, 1, 2, 3, 4}
    assert chat_format.preference_format(chat_format.pair_neighbours(conv.limit(0))).count() == 0


def test_chat_large_ids(spark):
    conv = spark.createDataFrame([(i, 0, "user", f"t{i}") for i in (*range(2**60, 2**60 + 6), -4, -3, 2**63 - 1)], "conv_id long, turn long, role string, text string")
    got = {(r.pair_id, r.chosen_id, r.rejected_id) for r in chat_format.pair_neighbours(conv).collect()}
    assert got == {*((2**59 + k, 2**60 + 2 * k, 2**60 + 2 * k + 1) for k in range(3)), (-2, -4, -3), (2**62 - 1, None, 2**63 - 1)}


# ---------------------------------------------------------------- packing
def check_packing(df, rows, capacity, **kw):
    path = queries.tokenizer_path()
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.sequence_id, r.offset) for r in packing.pack_documents(df, path, capacity, **kw).collect()]
    assert sorted((g[:5] for g in got), key=str) == sorted((p for d, t in rows for p in brute.pieces(d, t, path, capacity)), key=str)
    wrong, names = brute.packing_problems(got, capacity)
    assert not wrong
    return len(names), -(-sum(g[3] for g in got) // capacity)


def test_packing_round_trip(documents):
    used, least = check_packing(documents, pairs(documents), 2048)
    assert used <= least + 1


def test_packing_merges_groups(documents):
    """Groups of a few dozen pieces, far fewer than in production: rounds must save most of what the groups waste."""
    used, least = check_packing(documents, pairs(documents), 512, group=40, fan_in=3, slack=8, carry=64)
    assert used <= least * 1.03 + 1


def test_packing_odd_rows(odd, odd_rows, nothing):
    check_packing(odd, odd_rows, 64, group=7, fan_in=2)
    assert packing.pack_documents(nothing, queries.tokenizer_path()).count() == 0


# ---------------------------------------------------------------- secrets
def check_secrets(df, rows):
    got = sorted(map(str, (tuple(r)[:5] for r in secret_scan.secret_report(df).collect())))
    want = []
    for doc_id, text in rows:
        spans = brute.base_secrets(text)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()
        want.append(str((doc_id, *(sum(s[1] == i for s in spans) for i in range(3)), digest)))
    assert got == sorted(want)


def test_base_secrets_on_documents(documents):
    check_secrets(documents, pairs(documents))


def test_secrets_odd_rows(odd, odd_rows, nothing):
    check_secrets(odd, odd_rows)
    assert secret_scan.secret_report(nothing).count() == 0


def test_added_rules_and_redaction(spark):
    text = "-----BEGIN RSA PRIVATE KEY----- then ghp_" + "a1B2" * 10 + " 😀 https://me:pass@host SECRET=abcdef, secret=abc"
    docs = spark.createDataFrame([(1, text, 5, 6), (2, None, 5, 6)], "doc_id long, text string, mask int, secret_spans int")
    spans = {r.doc_id: r.spans for r in secret_scan.secret_report(docs).collect()}
    kinds = [s.split(":")[0] for s in spans[1].split(",")]
    assert kinds == ["private_key", "forge_token", "url_login", "assign"] and spans[2] == ""
    for s in spans[1].split(","):
        kind, a, b = s.split(":")
        rule = next(r for r in secret_scan.RULES if r.kind == kind)
        assert re.fullmatch(rule.pattern, text[int(a) : int(b)], re.I if rule.fold else 0)
    clean = {r.doc_id: r for r in secret_scan.redact(docs).collect()}
    assert clean[1].text.count("[secret]") == 4 and clean[1].text.endswith("secret=abc") and clean[2].text is None and clean[1].mask == 5


def added_secrets(text):
    """Spans of the rules that the method adds, by Python's own matcher."""
    return [(m.start(), i, r.kind, m.end()) for i, r in enumerate(secret_scan.RULES) if not r.base for m in re.finditer(r.pattern, text or "") if len(m.group(r.group)) >= r.least]


def test_all_spans_and_redaction(spark, documents, harsh, harsh_rows, odd, odd_rows):
    some = [(90, "ghp_" + "a1B2" * 10 + " xoxb-123456789012-abcdef eyJhb.eyJzd.x_y http://u:p@h x eyJa.eyJb.c.eyJa.eyJb.d"), (91, "-----BEGIN KEY PRIVATE KEY-----" * 3)]
    for df, rows in ((documents, pairs(documents)), (harsh, harsh_rows), (odd, odd_rows), (spark.createDataFrame(some, "doc_id long, text string"), some)):
        want = {}
        for doc_id, text in rows:
            spans = sorted([*brute.base_secrets(text), *added_secrets(text)])
            clean, at = [], 0
            for a, _, _, b in spans:
                if a >= at:
                    clean += [text[at:a], "[secret]"]
                at = max(at, b)
            want[doc_id, text] = (",".join(f"{k}:{a}:{b}" for a, _, k, b in spans), None if text is None else "".join(clean) + text[at:])
        assert sorted((str(r.doc_id), r.spans) for r in secret_scan.secret_report(df).collect()) == sorted((str(d), want[d, t][0]) for d, t in rows)
        assert sorted((str(r.doc_id), str(r.text)) for r in secret_scan.redact(df).collect()) == sorted((str(d), str(want[d, t][1])) for d, t in rows)


def test_rules_without_trigrams_scan_fully():
    assert secret_scan.trigram_query(r"[0-9a-f]+") is True
    assert secret_scan.trigram_query("a(bcd|xyz)?") is True
    assert secret_scan.trigram_query("(password|token)=") == ("or", (("and", ("pas", "ord")), ("and", ("tok", "ken"))))


# ---------------------------------------------------------------- licenses
def phrases(text):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(brute.ASCII_LOWER)) if w]
    found = []
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_license_phrases(spark, documents, odd, odd_rows, nothing):
    for df, rows in ((documents, pairs(documents)), (odd, odd_rows)):
        got = sorted(map(str, (tuple(r)[:6] for r in license_scan.license_scan(df).collect())))
        assert got == sorted(str((d, *phrases(t))) for d, t in rows)
    assert license_scan.license_scan(nothing).count() == 0


def as_expression(template):
    """The template as a regular expression over words that each end with a blank."""
    out = []
    for mark in re.findall(r"\[\[|\]\]|\{\{\w+:\d+\}\}|\||[^\s\[\]{}|]+", template):
        if mark in ("[[", "]]", "|"):
            out.append({"[[": "(?:(?:", "]]": "))?", "|": ")|(?:"}[mark])
        elif mark.startswith("{{"):
            out.append(f"(?:\\S+ ){{1,{mark[2:-2].split(':')[1]}}}")
        else:
            out += [w.decode() + " " for w in license_scan.words_of(mark)]
    return re.compile("(?:^|(?<= ))" + "".join(out))


def template_labels(text, templates=license_scan.TEMPLATES):
    line = "".join(w.decode() + " " for w in license_scan.words_of(text))
    return {label for label, t in templates if as_expression(t).search(line)}


def filled(template, rng):
    """A text that the template accepts: each optional region there or not, each replaceable one filled."""
    text = template
    while "[[" in text:
        text = re.sub(r"\[\[([^\[\]]*)\]\]", lambda m: rng.choice(["", *m.group(1).split("|")]), text)
    return re.sub(r"\{\{\w+:(\d+)\}\}", lambda m: " ".join(f"N{rng.randrange(99)}" for _ in range(rng.randint(1, int(m.group(1))))), text)


def test_license_labels_and_score(spark, documents, odd, odd_rows):
    rng = random.Random(4)
    made = []
    for label, template in license_scan.TEMPLATES:
        for _ in range(6):
            text = filled(template, rng)
            made.append((len(made), f"Some words. {text} More words."))
            words = text.split()
            at = rng.randrange(len(words))
            words[at] = "altered"
            made.append((len(made), " ".join(words)))
        assert label in template_labels(made[-2][1])
    for df, rows in ((documents, pairs(documents)), (odd, odd_rows), (spark.createDataFrame(made, "doc_id long, text string"), made)):
        want = sorted((str(d), ",".join(sorted(template_labels(t) | set(filter(None, phrases(t)[4].split(","))))), bool(template_labels(t))) for d, t in rows)
        got = license_scan.license_scan(df).collect()
        assert sorted((str(r.doc_id), r.labels, r.score == 1) for r in got) == want
        assert all(0 <= r.score <= 1 and (r.n_base == 0 or r.score >= 0.5) for r in got)


def test_license_texts_need_their_whole_wording():
    mit = dict(license_scan.TEMPLATES)["mit"].replace("{{holders:8}}", "the authors").replace("[[(including the next paragraph)]]", "")
    scan = lambda t: license_scan.scan_words(license_scan.words_of(t))
    assert [p[0] for p in scan(mit)[1]] == ["mit"] and scan(mit)[2] == 1
    altered = mit.replace("OTHER DEALINGS", "NO DEALINGS")
    assert scan(altered)[1] == [] and 0.9 < scan(altered)[2] < 1


def test_license_hard_texts_are_fast(harsh, harsh_rows):
    began = time.monotonic()
    got = sorted(map(str, (tuple(r)[:6] for r in license_scan.license_scan(harsh).collect())))
    notices = [(90, "copyright 2020 " * 100_000 + "all rights reserved"), (91, "this is licensed under the gnu general public license " * 20_000)]
    found = [license_scan.scan_words(license_scan.words_of(t)) for _, t in notices]
    assert time.monotonic() - began < 60 and len(found[0][1]) == 3 and len(found[1][0]) == 20_000
    assert got == sorted(str((d, *phrases(t))) for d, t in harsh_rows)


def test_license_templates():
    a = license_scan.TokenAutomaton("copyright [[c]] {{year:2}} {{holder:3}} all rights reserved")
    run = lambda t: a.run([w.encode() for w in t.split()], 0)
    assert run("copyright c 2020 me all rights reserved") == (7, 1)
    assert run("copyright 2020 me and you all rights reserved") == (8, 1)
    assert run("copyright 2020 me and you and more all rights reserved")[0] is None
    assert run("copyright 2020 me all rights") == (None, 0.75)
    b = license_scan.TokenAutomaton("under [[the|a]] mit license")
    assert b.run(b"under a mit license now".split(), 0) == (4, 1) and b.run(b"under mit license".split(), 0) == (3, 1)
    assert b.run(b"under an mit license".split(), 0)[0] is None


# ---------------------------------------------------------------- fingerprints
def plain_fingerprint(text):
    """Sums of +1 and -1 over the paragraphs, one lane at a time; entry 0 counts them."""
    parts = [p.strip() for line in text.split("\n") for p in re.split(r"(?<=[.!?])[^\S\n]+", line)]
    parts = [p[i : i + 400] for p in parts for i in range(0, len(p), 400)]
    total = [len(parts)] + [0] * fingerprint.LANES
    for p in parts:
        bits = int.from_bytes(hashlib.blake2b(p.encode(), digest_size=fingerprint.LANES // 8).digest(), "big")
        for lane in range(fingerprint.LANES):
            total[lane + 1] += 1 if bits >> (fingerprint.LANES - 1 - lane) & 1 else -1
    return total


def plain_likeness(x, y):
    if x == y:
        return 1.0
    square = lambda v: sum(e * e for e in v[1:])
    whole = square(x) + square(y)
    return min(1.0, max(0.0, 1 - square([a - b for a, b in zip(x, y, strict=True)]) / whole)) if whole else 0.0


def check_fingerprints(spark, df, rows, ranges):
    hashes = spark.createDataFrame([(t or "",) for _, t in rows], "t string").selectExpr("t", "xxhash64(t) as h").distinct().collect()
    order = {r.t: r.h for r in hashes}
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, order[r[1] or ""]))
    got = fingerprint.fingerprints(df, ranges).collect()
    want = []
    for i, (doc_id, text) in enumerate(rows):
        old, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(old) // 2
        new = old[: len(old) - half] + after[:half]
        a, b, c = map(plain_fingerprint, (old, new, after))
        sha = hashlib.sha256(new.encode()).hexdigest()
        stored = lambda v: b"".join(bytes((x % 2**64) >> 8 * k & 255 for x in v) for k in range(8))
        vector, name = stored(a), lambda v: hashlib.md5(stored(v)).hexdigest()
        want.append(str((doc_id, len(old), sha, name(a), name(b), round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9), vector)))
    assert sorted(str((*tuple(r)[:5], round(r.near_edited, 9), round(r.near_next, 9), bytes(r.vector))) for r in got) == sorted(want)
    return got


def test_fingerprints_on_documents(spark, documents):
    got = check_fingerprints(spark, documents, pairs(documents), 5)
    texts = dict(pairs(documents))
    by_text = {}
    for r in got:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert queries.op9_fingerprint(spark, SF).count() == len(texts)
    # What is returned takes paragraphs in and gives them back.
    stored = fingerprint.from_bytes(bytes(got[0].vector))
    grown = fingerprint.insert(stored, "One more.")
    assert (grown == fingerprint.fingerprint_of(texts[got[0].doc_id] + "\nOne more.")).all() and (fingerprint.delete(grown, "One more.") == stored).all()


def test_fingerprints_of_one_hot_id(spark):
    rows = [(None, f"text {i % 50}") for i in range(400)] + [(5, "same")] * 300 + [(6, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    check_fingerprints(spark, df, rows, 9)
    sizes = [r[0] for r in fingerprint.in_ranges(df, 9).groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) < 250


def test_fingerprints_odd_rows(spark, odd, odd_rows, nothing):
    check_fingerprints(spark, odd, odd_rows, 3)
    check_fingerprints(spark, odd, odd_rows, 1)
    assert fingerprint.fingerprints(nothing, 3).count() == 0


def test_fingerprints_of_harsh_texts(spark, harsh, harsh_rows):
    short = [r for r in harsh_rows if r[0] != 10]
    check_fingerprints(spark, harsh.where("doc_id != 10"), short, 2)
    got = {r.doc_id: r for r in fingerprint.fingerprints(harsh, 3).collect()}
    assert set(got) == {d for d, _ in harsh_rows}
    f = fingerprint.from_bytes(bytes(got[10].vector))
    assert f[0] == 400_001 and abs(f[1:].view("int64")).min() >= 399_999


def test_many_equal_paragraphs_count():
    f = fingerprint
    for n in (1 << 15, 1 << 16, 1 << 17):
        many = f.fingerprint_of("a\n" * n)
        assert not (many == f.fingerprint_of("")).all() and many[0] == n
        assert f.likeness(many, f.insert(many, "b")) > 0.999
        assert f.likeness(f.insert(many, "b"), f.fingerprint_of("b")) < 0.01
        assert f.likeness(many, f.fingerprint_of("a\n" * (n // 2))) < 0.8 + 1e-9
        assert (f.delete(f.insert(many, "b"), "b") == many).all() and (f.from_bytes(f.as_bytes(many)) == many).all()


def test_fingerprint_of_one_row(spark, odd):
    check_fingerprints(spark, odd.where(F.col("doc_id") == 12).limit(1), [(12, odd.where("doc_id = 12").first().text)], 3)


def test_fingerprint_is_homomorphic():
    f = fingerprint
    a, b = "One thing. Another thing.\nA third.", "New one.\nNewer."
    assert (f.insert(f.fingerprint_of(a), b) == f.fingerprint_of(b + "\n" + a)).all()
    assert (f.delete(f.fingerprint_of(a + "\n" + b), b) == f.fingerprint_of(a)).all()
    assert f.likeness(f.fingerprint_of(a), f.fingerprint_of("A third.\nOne thing.\nAnother thing.")) == 1
    assert 0.4 < f.likeness(f.fingerprint_of(a), f.fingerprint_of("One thing. Another thing.\nChanged.")) < 0.9
