"""Substring deduplication by sliding sentence spans.

From each sentence on, a run of consecutive sentences is hashed: at least ``LEAST_SENTENCES``, and
as many as it takes for ``LEAST_WORDS`` words, so that no chance repetition of short sentences
counts. Runs with one hash meet in a join across all documents. The first of them, by (doc_id,
place), stays; every sentence that any other one covers is in a stretch, which is then extended
word by word to both sides, by up to ``FLANK`` words that follow in the first place too. Stretches
of ``LEAST_SPAN`` words and more are removed.

Sentences end at ``.``, ``!``, ``?`` before white space and at line ends; one of more than
``LONGEST`` words is cut before words whose hash is the least of ``NEAR`` words to both sides, so
that a passage is cut alike wherever it stands, and what is still longer every ``LONGEST`` words
from such a cut. They are compared lower-cased and by words.

Defined cases
-------------
* ``n_removed`` counts whole sentences in the removed stretches; ``removed`` and ``text`` also have the words of the extension.
* Null and empty texts have no sentences. A document shorter than a run is never changed.
* Rows with one id and one text are one document; a null id sorts first and is kept.
* Ties of place can't occur otherwise. Further columns stay as they are (in ``deduplicate``).
* Empty tables give no rows. Texts are taken whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, shared_table
from .hashing import blocks, byte_table, polynomials, words_of

LEAST_SENTENCES = 2
LEAST_WORDS = 20
#: Words of a stretch that is removed, with its extensions; shorter repetitions are ordinary (notices, greetings).
LEAST_SPAN = 45
LONGEST = 12
NEAR = 3
#: No chance repetition is as long, and a repeated passage is cut alike this far from its ends.
FLANK = LEAST_WORDS + LONGEST
#: Code points around a stretch in which its neighbours are sought.
_REACH = 4096
#: Flanks up to which they are broadcast.
BROADCAST_FLANKS = 50_000

RUNS = "hash long, doc_id long, text_hash long, at int, n int"
EDGES = "doc_id long, text_hash long, own int, side int, first_doc long, first_text long, place int"
FLANKS = "first_doc long, first_text long, place int, side int, words string"
CUTS = "doc_id long, n_sentences long, n_removed long, removed string, text string"
#: Words are runs without ASCII white space.
_WORD = re.compile(r"[^\x09-\x0d\x1c-\x20]+")
_WHITE = byte_table((9, 13), (28, 32))
_MARK = byte_table(*((ord(c), ord(c)) for c in ".!?"))


def _cut_texts(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Of lower-cased texts: the words' hashes, the first word of each sentence with the number of words behind, and the sentences' texts."""
    words = words_of(texts, _WHITE)
    n, text = len(words.first), words.text
    h = words.hashes()
    if not n:
        return h, np.zeros(1, np.int64), np.empty(0, np.int64)
    starts = np.ones(n + 1, bool)
    starts[1:n] = words.fresh[1:] | _MARK[words.raw[words.last[:-1]]]
    at = np.flatnonzero(starts)
    size = np.diff(at)
    if (size > LONGEST).any():
        # Words whose hash is the least of NEAR to both sides, away from the ends of a long sentence.
        place, size = np.arange(n) - np.repeat(at[:-1], size), np.repeat(size, size)
        least = (place >= NEAR) & (size - place > NEAR) & (size > LONGEST)
        some = np.flatnonzero(least)
        for k in range(1, NEAR + 1):
            some = some[(h[some] < h[some - k]) & (h[some] <= h[some + k])]
        starts[some] = True
        at = np.flatnonzero(starts)
        size = np.diff(at)
        starts[:n] |= (np.arange(n) - np.repeat(at[:-1], size)) % LONGEST == 0
        at = np.flatnonzero(starts)
    return h, at, text[at[:-1]]


def sentences(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, words in normal form, number of words) of each sentence."""
    out = []
    for start, end in next(places_of(pa.array([text], pa.string()))):
        words = _WORD.findall(text, start, end)
        out.append((start, end, " ".join(words).lower(), len(words)))
    return out


def runs_of(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """(hash, text's number, first sentence, number of sentences) of each run that has enough words, in lower-cased texts."""
    h, at, text = _cut_texts(texts)
    i = np.arange(len(text))
    end = np.maximum(np.searchsorted(at, at[:-1] + LEAST_WORDS), i + LEAST_SENTENCES)
    whole = end <= np.searchsorted(text, text, "right")
    place = i - np.searchsorted(text, text, "left")
    i, end = i[whole], end[whole]
    return polynomials(h, at[i], at[end]), text[whole], place[whole], end - i


def places_of(texts: pa.Array):
    """For each text the (start, end) of its sentences in code points."""
    for _, some in blocks(texts):
        _, at, text = _cut_texts(pc.utf8_lower(some))
        words = words_of(some, _WHITE)
        raw = words.raw
        points = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
        sizes = np.asarray(pc.binary_length(some), np.int64)
        zero = points[np.cumsum(sizes) - sizes][text]
        starts = (points[words.first[at[:-1]]] - zero).tolist()
        ends = (points[words.last[at[1:] - 1] + 1] - zero).tolist()
        bounds = np.searchsorted(text, np.arange(len(some) + 1)).tolist()
        for i, j in zip(bounds, bounds[1:]):
            yield list(zip(starts[i:j], ends[i:j]))


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _lists(batch: pa.RecordBatch, name: str) -> tuple[list[int], pa.StructArray | pa.Array]:
    """Offsets and flat values of a list column; a null list is empty."""
    column = batch.column(name)
    ends = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths().fill_null(0)))]).tolist()
    return ends, column.flatten()


def _fields(values: pa.StructArray, *names: str) -> list[list]:
    """Python values of fields of a struct array; whole columns at a time."""
    return [values.field(n).to_pylist() for n in names]


def _named(docs: DataFrame) -> DataFrame:
    """``doc_id, text, text_hash``: a document is known by its id and a hash of its text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).where("text is not null")


def sentence_runs(docs: DataFrame) -> DataFrame:
    schema = _schema(RUNS)

    def run(batches):
        for batch in batches:
            for lo, texts in blocks(batch.column("text")):
                hashes, text, place, size = runs_of(pc.utf8_lower(texts))
                rows = pa.array(text + lo)
                columns = [hashes.view(np.int64), batch.column("doc_id").take(rows), batch.column("text_hash").take(rows), place.astype(np.int32), size.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return _named(docs).mapInArrow(run, RUNS)


def covered(docs: DataFrame) -> DataFrame:
    """Per document with repeated runs: the sentences that non-first ones cover, and where the first ones are.

    ``(doc_id, text_hash, ranges array<struct<at,n,first>>, first_doc_ids)``; both arrays are bounded
    by the document's number of sentences.
    """
    runs = shared_table(sentence_runs(docs), "sentence-runs")
    place = F.struct("doc_id", "text_hash", "at", "n")
    repeated = runs.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("hash", "first")
    repeated = shared_table(repeated, "repeated-runs")
    others = runs.join(repeated, "hash").where(~F.struct("doc_id", "text_hash", "at", "n").eqNullSafe(F.col("first")))
    return others.groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("at", "n", "first")).alias("ranges"), F.sort_array(F.collect_set("first.doc_id")).alias("first_doc_ids")
    )


def _stretches(ranges: list[tuple[int, int]]) -> list[list[int]]:
    """[first sentence, end] of each stretch of covered sentences (at, number)."""
    out: list[list[int]] = []
    for at, n in sorted(ranges):
        if out and at <= out[-1][1]:
            out[-1][1] = max(at + n, out[-1][1])
        else:
            out.append([at, at + n])
    return out


def _edges(found: DataFrame) -> DataFrame:
    """The runs at both ends of each stretch (side -1 and 1), with the same place in the first copy."""
    schema = _schema(EDGES)

    def run(batches):
        for batch in batches:
            ends, flat = _lists(batch, "ranges")
            ats, ns = _fields(flat, "at", "n")
            first = flat.field("first")
            first_at, first_n = _fields(first, "at", "n")
            rows, taken, own, side, place = [], [], [], [], []
            for i, (lo, hi) in enumerate(zip(ends, ends[1:])):
                stretches = _stretches(list(zip(ats[lo:hi], ns[lo:hi])))
                starts, stops = {a for a, _ in stretches}, {b for _, b in stretches}
                for k in range(lo, hi):
                    if ats[k] in starts:
                        rows.append(i), taken.append(k), own.append(ats[k]), side.append(-1), place.append(first_at[k])
                    if ats[k] + ns[k] in stops:
                        rows.append(i), taken.append(k), own.append(ats[k] + ns[k]), side.append(1), place.append(first_at[k] + first_n[k])
            rows, taken = pa.array(rows, pa.int32()), pa.array(taken, pa.int32())
            columns = [batch.column("doc_id").take(rows), batch.column("text_hash").take(rows), own, side, first.field("doc_id").take(taken), first.field("text_hash").take(taken), place]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return found.select("doc_id", "text_hash", "ranges").mapInArrow(run, EDGES)


def _neighbours(text: str, at: int, side: int) -> list[re.Match]:
    """Up to ``FLANK`` words before or after a place in the text, the nearest first."""
    if side > 0:
        stop = min(len(text), at + _REACH)
        words = list(_WORD.finditer(text, at, stop))
        if stop < len(text) and words and words[-1].end() == stop:
            words.pop()
        return words[:FLANK]
    start = max(0, at - _REACH)
    words = list(_WORD.finditer(text, start, at))
    if start and words and words[0].start() == start:
        words.pop(0)
    return words[::-1][:FLANK]


def _same(x: str, y: str, doc: str = "doc_id", text: str = "text_hash"):
    """The document (doc_id, text_hash) of ``x`` is (doc, text) of ``y``; null ids are equal to one another."""
    return F.col(f"{x}.doc_id").eqNullSafe(F.col(f"{y}.{doc}")) & (F.col(f"{x}.text_hash") == F.col(f"{y}.{text}"))


def _texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``doc_id, text, text_hash`` of the documents named in ``keys``, each once."""
    keys = broadcast_if_small(keys.select("doc_id", "text_hash"))
    return _named(docs).alias("x").join(keys.alias("y"), _same("x", "y"), "left_semi").dropDuplicates(["doc_id", "text_hash"])


def _flanks(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """The words beside each asked place of the first copies."""
    schema = _schema(FLANKS)
    asked = edges.groupBy("first_doc", "first_text").agg(F.collect_set(F.struct("place", "side")).alias("places"))
    asked = shared_table(asked, "asked-places")
    texts = _texts_of(docs, asked.select(F.col("first_doc").alias("doc_id"), F.col("first_text").alias("text_hash")))

    def run(batches):
        for batch in batches:
            ends, flat = _lists(batch, "places")
            places, sides = _fields(flat, "place", "side")
            rows, where, which, words = [], [], [], []
            for i, (text, parts) in enumerate(zip(batch.column("text"), places_of(batch.column("text")), strict=True)):
                text = text.as_py()
                for place, side in zip(places[ends[i] : ends[i + 1]], sides[ends[i] : ends[i + 1]]):
                    near = _neighbours(text, parts[place - 1][1] if side > 0 else parts[place][0], side)
                    if near:
                        rows.append(i), where.append(place), which.append(side), words.append(" ".join(m.group() for m in near).lower())
            rows = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("first_doc").take(rows), batch.column("first_text").take(rows), pa.array(where, pa.int32()), pa.array(which, pa.int32()), pa.array(words, pa.string())], schema=schema)

    met = texts.alias("x").join(asked.alias("y"), _same("x", "y", "first_doc", "first_text"))
    return met.select("x.text", "y.first_doc", "y.first_text", "y.places").mapInArrow(run, FLANKS)


def extensions(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Per document with covered sentences: ``(doc_id, text_hash, beside array<struct<own,side,words>>)``."""
    edges = shared_table(_edges(found), "span-edges")
    flanks = shared_table(_flanks(docs, edges), "span-flanks")
    x, y = edges.alias("x"), broadcast_if_small(flanks, BROADCAST_FLANKS).alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("first_text", "place", "side")]
    met = x.join(y, [F.col("x.first_doc").eqNullSafe(F.col("y.first_doc")), *same])
    return met.groupBy("x.doc_id", "x.text_hash").agg(F.collect_set(F.struct("x.own", "x.side", "y.words")).alias("beside"))


def _cut(text: str, parts: list[tuple[int, int]], ranges: list[tuple[int, int]], beside: list[tuple[int, int, str]]) -> tuple[list[list[int]], str]:
    """The removed stretches (start, end, whole sentences) in code points, and what is left of the text with sentences at ``parts``."""
    flanks: dict[tuple[int, int], list[str]] = {}
    for own, side, words in beside:
        flanks.setdefault((own, side), []).append(words)

    def extended(own: int, side: int, at: int) -> int:
        best = at
        if (own, side) in flanks:
            near = _neighbours(text, at, side)
            for words in flanks[own, side]:
                for m, word in zip(near, words.split(" ")):
                    if m.group().lower() != word:
                        break
                    best = max(best, m.end()) if side > 0 else min(best, m.start())
        return best

    spans: list[list[int]] = []  # start, end, sentences
    for i, j in _stretches(ranges):
        a, b = extended(i, -1, parts[i][0]), extended(j, 1, parts[j - 1][1])
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
            spans[-1][2] += j - i
        else:
            spans.append([a, b, j - i])
    spans = [x for x in spans if len(_WORD.findall(text, x[0], x[1])) >= LEAST_SPAN]
    kept, at = [], 0
    for a, b, _ in spans:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return spans, "".join(kept).strip()


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents that lose sentences: ``doc_id, n_sentences, n_removed, removed, first_doc_ids, text``.

    ``removed`` lists stretches start-end of code points; ``text`` is what is left. Documents
    without a row are unchanged.
    """
    schema = _schema(CUTS + ", first_doc_ids array<long>")
    found = shared_table(covered(docs), "covered-sentences")
    beside = extensions(docs, found)
    whole = found.alias("f").join(beside.alias("b"), _same("f", "b"), "left").select("f.*", "b.beside")
    small = _texts_of(docs, found).alias("x").join(whole.alias("y"), _same("x", "y"))

    def run(batches):
        for batch in batches:
            r_ends, r_flat = _lists(batch, "ranges")
            b_ends, b_flat = _lists(batch, "beside")
            ranges = list(zip(*_fields(r_flat, "at", "n"), strict=True))
            beside = list(zip(*_fields(b_flat, "own", "side", "words"), strict=True))
            cols: list[list] = [[] for _ in range(4)]
            rows = []
            for i, (text, parts) in enumerate(zip(batch.column("text"), places_of(batch.column("text")), strict=True)):
                spans, left = _cut(text.as_py(), parts, ranges[r_ends[i] : r_ends[i + 1]], beside[b_ends[i] : b_ends[i + 1]])
                if spans:
                    rows.append(i)
                    for col, x in zip(cols, (len(parts), sum(n for _, _, n in spans), ",".join(f"{a}-{b}" for a, b, _ in spans), left), strict=True):
                        col.append(x)
            taken = pa.array(rows, pa.int32())
            made = [pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:5], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(taken), *made, batch.column("first_doc_ids").take(taken)], schema=schema)

    ranges = F.transform("y.ranges", lambda r: F.struct(r["at"].alias("at"), r["n"].alias("n")))
    return small.select("x.doc_id", "x.text", ranges.alias("ranges"), "y.beside", "y.first_doc_ids").mapInArrow(run, CUTS + ", first_doc_ids array<long>")
