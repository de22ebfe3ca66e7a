"""Phrase collocation mining: phrases whose words come together far more often than apart.

1. Texts become shards: bodies of one language, about ``SHARD`` bytes each, in which words stand
   between single blanks and pieces between line ends. They are written once, packed.
2. A sketch counts the phrases of one to four words of all shards: each phrase of a language is
   hashed to a cell, whose count is an upper bound of the phrase's. There is a cell for every
   ``LOAD`` phrases of the corpus, so the sketch grows with it, and it is never held in one place: a
   shard sends its distinct cells to the ranges of cells they belong to (as differences, about a
   byte each), a range adds them up, and answers each shard with one bit a cell: whether the bound
   reaches the least count.
3. A shard's phrases whose bit is set are its candidates. They are compiled into an automaton
   with blanks around them, which can't match within a word, and the shard is scanned for all
   overlapping matches. Counts are summed over shards, and now the least count decides exactly.
4. Candidates meet the counts of their parts and of the longer candidates around them by joins and
   one aggregation; the first of each language come from cuts of salted parts of it.

Any phrase that reaches the least count reaches it in its cell, so none is lost; a phrase that
shares a cell with others is counted for nothing and then dropped.

Defined cases
-------------
* Null and empty texts have no words; a language without words has no rows. Null languages are ``und``.
* Ids aren't used, repeated rows count again, further columns are ignored. An empty table gives no rows.
* Pieces and texts of any length are taken whole: a longer piece is a shard of its own.
* One language may hold all texts: nothing is dealt by language but sums and the first ``top`` of it.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table
from .hashing import byte_table, polynomials, words_of

LEAST = 30
LONGEST = 4
TOP = 2000
#: Bytes of a shard's body, about, and of all bodies that a task has open.
SHARD = 2 << 20
OPEN = 16 << 20
#: Bytes of bodies that a scanning task counts together: what it shares is summed before the shuffle.
SCAN_BYTES = 64 << 20
#: Phrases of the corpus per cell, and cells of a range.
LOAD = 8
RANGE_BITS = 23
#: Parts into which each language's phrases are cut for the first of each part.
SALTS = 64

SHARDS = "shard long, lang string, n long, size long, body binary"
CELLS = "shard long, range long, n int, cells binary, counts binary"
BITS = "shard long, range long, bits binary"
COUNTS = "lang string, phrase string, a long"

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_PIECE_END = re.compile(rb"[.,;:!?\x0A-\x0D]+")
_BETWEEN = byte_table((0x20, 0x20), (0x0A, 0x0A))


def pieces_of(text: str) -> list[bytes]:
    """The pieces of a text that have words: their words between single blanks, A-Z in lower case."""
    out = []
    for piece in _PIECE_END.split(text.encode("utf-8", "surrogatepass").translate(_LOWER)):
        words = piece.replace(b"\t", b" ").split(b" ")
        piece = b" ".join([w for w in words if w])
        if piece:
            out.append(piece)
    return out


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def shards_of(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """``SHARDS``: bodies of one language, each piece as `` word word `` and a line end; a written table."""
    schema = _schema(SHARDS)

    def run(batches):
        from pyspark import TaskContext

        name = TaskContext.get().partitionId() << 33
        held: dict[str, list[bytes]] = {}
        bytes_of: dict[str, int] = {}

        def flush(lang: str) -> pa.RecordBatch:
            nonlocal name
            body = b" " + b" \n ".join(held.pop(lang)) + b" \n"
            bytes_of.pop(lang)
            name += 1
            n = body.count(b" ") - body.count(b"\n")  # a piece has a blank more than words
            return _batch([(name, lang, n, len(body), _packed(body))], schema)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for piece in pieces_of(text.as_py()):
                    held.setdefault(lang, []).append(piece)
                    bytes_of[lang] = bytes_of.get(lang, 0) + len(piece) + 3
                    if bytes_of[lang] >= size:
                        yield flush(lang)
                while sum(bytes_of.values()) > OPEN:  # many languages: the largest goes
                    yield flush(max(bytes_of, key=bytes_of.get))
        for lang in list(held):
            yield flush(lang)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, SHARDS)
    return rows


class Phrases:
    """The phrases of one shard: where their words stand, and the distinct cells they fall into."""

    def __init__(self, lang: str, body: bytes, cells: int):
        raw = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, len(body)], np.int32)), pa.py_buffer(body)])
        self.words = w = words_of(raw, _BETWEEN)
        self.body = body
        piece = np.cumsum(np.frombuffer(body, np.uint8) == 10)[w.first]
        seed = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))
        data = w.raw.astype(np.uint64) + np.uint64(1)
        self.start, self.size, found = [], [], []
        for n in range(1, LONGEST + 1):
            if len(w.first) < n:
                break
            at = np.flatnonzero(piece[n - 1 :] == piece[: len(piece) - n + 1])
            found.append(at)
            self.size.append(np.full(len(at), n, np.int8))
        at = np.concatenate(found) if found else np.empty(0, np.int64)
        self.size = np.concatenate(self.size) if found else np.empty(0, np.int8)
        self.start, self.end = w.first[at], w.last[at + self.size - 1] + 1
        h = polynomials(data, self.start, self.end) ^ seed
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        cell = (h ^ (h >> np.uint64(33))) & np.uint64(cells - 1)
        self.cells, self.of, self.counts = np.unique(cell, return_inverse=True, return_counts=True)


def _packed(raw: bytes) -> bytes:
    return pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(raw: bytes, size: int) -> bytes:
    return pa.decompress(raw, size, codec="zstd", asbytes=True)


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers byte by byte, all lowest first: the upper bytes are mostly 0 and pack to nothing."""
    return _packed(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _from_planes(raw: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unpacked(raw, 4 * n), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _cells_of(shards: DataFrame, cells: int, least: int, range_bits: int) -> DataFrame:
    """``CELLS``: each shard's distinct cells in each range, and their counts up to ``least``."""
    schema = _schema(CELLS)

    def run(batches):
        for batch in batches:
            for shard, lang, size, body in zip(*(batch.column(i) for i in range(4)), strict=True):
                p = Phrases(lang.as_py(), _unpacked(body.as_py(), size.as_py()), cells)
                ranges = (p.cells >> np.uint64(range_bits)).astype(np.int64)
                counts = np.minimum(p.counts, least).astype(np.uint8)
                edges = np.r_[0, np.flatnonzero(np.diff(ranges)) + 1, len(ranges)]
                rows = []
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    if lo < hi:
                        at = (p.cells[lo:hi] & np.uint64((1 << range_bits) - 1)).astype(np.int64)
                        rows.append((shard.as_py(), int(ranges[lo]), int(hi - lo), _planes(np.diff(at, prepend=0)), _packed(counts[lo:hi].tobytes())))
                yield _batch(rows, schema)

    return shards.select("shard", "lang", "size", "body").mapInArrow(run, CELLS)


def _bits_of(cells: DataFrame, least: int, range_bits: int) -> DataFrame:
    """``BITS``: of each shard's cells in each range, in order, whether all shards together reach ``least``."""
    schema = _schema(BITS)

    def run(key, table):
        total = np.zeros(1 << range_bits, np.uint8)
        rows = list(zip(table["shard"].to_pylist(), table["n"].to_pylist(), table["cells"], table["counts"], strict=True))
        for _, n, at, counts in rows:
            at = np.cumsum(_from_planes(at.as_py(), n), dtype=np.int64)
            total[at] = np.minimum(total[at].astype(np.uint16) + np.frombuffer(_unpacked(counts.as_py(), n), np.uint8), least)
        out = []
        for shard, n, at, _ in rows:
            at = np.cumsum(_from_planes(at.as_py(), n), dtype=np.int64)
            out.append((shard, key[0].as_py(), np.packbits(total[at] >= least).tobytes()))
        return pa.Table.from_batches([_batch(out, schema)], schema=schema)

    return cells.groupBy("range").applyInArrow(run, BITS)


def _scan(shards: DataFrame, cells: int, range_bits: int) -> DataFrame:
    """``COUNTS`` of each shard's candidates; ``shards`` has their ``bits``, [(range, bits)]."""
    schema = _schema(COUNTS)

    def run(batches):
        for batch in batches:
            for lang, size, body, bits in zip(*(batch.column(i) for i in range(4)), strict=True):
                lang, body = lang.as_py(), _unpacked(body.as_py(), size.as_py())
                p = Phrases(lang, body, cells)
                keep = np.zeros(len(p.cells), bool)
                ranges = p.cells >> np.uint64(range_bits)
                for r in bits.as_py():
                    lo, hi = np.searchsorted(ranges, np.uint64(r["range"])), np.searchsorted(ranges, np.uint64(r["range"]), "right")
                    keep[lo:hi] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=hi - lo).astype(bool)
                # All phrases of the kept cells, each once.
                able = np.flatnonzero(keep[p.of])
                automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
                text = body.decode("utf-8", "surrogatepass")
                phrases = list({body[s:e] for s, e in zip(p.start[able].tolist(), p.end[able].tolist(), strict=True)})
                if not phrases:
                    continue
                for i, phrase in enumerate(phrases):
                    automaton.add_word(f" {phrase.decode('utf-8', 'surrogatepass')} ", i)
                automaton.make_automaton()
                found = np.bincount(np.fromiter((i for _, i in automaton.iter(text)), np.int64), minlength=len(phrases))
                arrays = [pa.array([lang] * len(phrases)), pa.array(phrases).cast(pa.string(), safe=False), pa.array(found, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return shards.select("lang", "size", "body", "bits").mapInArrow(run, COUNTS)


def phrase_counts(docs: DataFrame, least: int = LEAST, shard: int = SHARD, range_bits: int = RANGE_BITS) -> tuple[DataFrame, DataFrame]:
    """``COUNTS`` of all phrases of one to four words that come ``least`` times, and (lang, n): all words of a language."""
    # Few rows of about a MB, packed already: without these a writer would look at its memory after a hundred of them.
    shards = shared_table(shards_of(docs, shard), "phrase-shards", "none", **{"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1})
    words = shards.groupBy("lang").agg(F.sum("n").alias("n"))
    n, size, bodies = shards.agg(F.sum("n"), F.sum("size"), F.count("*")).first()
    cells = 1 << max(range_bits, (max(1, LONGEST * (n or 0) // LOAD) - 1).bit_length())
    bits = _bits_of(_cells_of(shards, cells, least, range_bits), least, range_bits)
    bits = bits.groupBy("shard").agg(F.collect_list(F.struct("range", "bits")).alias("bits"))
    tasks = max(1, -(-(size or 0) // SCAN_BYTES), min(bodies, shards.sparkSession.sparkContext.defaultParallelism))
    counted = _scan(shards.join(bits.hint("shuffle_hash"), "shard").coalesce(tasks), cells, range_bits)
    counts = counted.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    counts = counts.withColumn("words", F.length(F.regexp_replace("phrase", "[^ ]", "")) + 1)
    return shared_table(counts, "phrase-counts"), words


def _wide(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def scores(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of all candidates that no longer one covers."""
    candidates = counts.where("words >= 2")
    words = F.split("phrase", " ")
    own = candidates.select("lang", "phrase", "a")

    def part(first, n):
        return F.array_join(F.slice(words, first, n), " ")

    parts = [F.struct(part(1, k), F.lit(k), F.lit(0)) for k in range(1, LONGEST)] + [F.struct(part(k + 1, LONGEST), F.lit(k), F.lit(1)) for k in range(1, LONGEST)]
    cuts = F.filter(F.array(*[F.struct(p["col1"].alias("part"), p["col2"].alias("k"), p["col3"].alias("side"), F.col("words").alias("of")) for p in parts]), lambda x: x["k"] < x["of"])
    asked = candidates.select("lang", "phrase", F.explode(cuts).alias("x")).select("lang", "phrase", F.col("x.part").alias("part"), F.col("x.k").alias("k"), F.col("x.side").alias("side"))
    answers = asked.join(counts.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")), ["lang", "part"])
    inner = [(at, n, m) for m in range(3, LONGEST + 1) for n in range(2, m) for at in range(1, m - n + 2)]
    covers = F.filter(F.array(*[F.struct(part(at, n).alias("phrase"), F.lit(m).alias("m")) for at, n, m in inner]), lambda x: x["m"] == F.col("words"))
    covered = candidates.where("words >= 3").select("lang", F.explode(covers).alias("x"), F.col("a").alias("longer")).select("lang", F.col("x.phrase").alias("phrase"), "longer")

    met = own.unionByName(answers.select("lang", "phrase", "k", "side", "f"), allowMissingColumns=True).unionByName(covered, allowMissingColumns=True)
    sides = {(k, s): F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f"))) for k in range(1, LONGEST) for s in (0, 1)}
    met = met.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("longer").alias("longer"), *[c.alias(f"f{k}{s}") for (k, s), c in sides.items()])
    met = met.where(F.col("longer").isNull() | (_wide("longer") * 100 < _wide("a") * 80))
    # A cut's score falls as l + r grows, but flooring makes ties: the whole score is compared, then k.
    score = {k: F.expr(f"cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(f{k}0 as decimal(20,0)) + cast(f{k}1 as decimal(20,0)))") for k in range(1, LONGEST)}
    cut = F.array_min(F.filter(F.array(*[F.struct(score[k].alias("score"), F.lit(k).alias("k"), F.col(f"f{k}0").alias("l"), F.col(f"f{k}1").alias("r")) for k in score]), lambda x: x["score"].isNotNull()))
    return met.select("lang", "phrase", "a", cut.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, top: int = TOP, **kw) -> DataFrame:
    """Each language's first phrases: lang, rank, phrase, a, l, r, n, score."""
    counts, words = phrase_counts(docs, **kw)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = scores(counts).withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    for part in (["lang", "_salt"], ["lang"]):
        some = some.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col("rank") <= top)
    return some.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
