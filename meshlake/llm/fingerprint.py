"""Document fingerprints: a homomorphic multiset hash over paragraphs.

Each paragraph is hashed to a wide vector of ``LANES`` entries, +1 or -1; a fingerprint is the sum
of its paragraphs' vectors modulo 2**64, with the number of paragraphs in front. Sums don't depend
on order, and a paragraph is inserted or deleted by adding or subtracting its vector, without the
rest of the text. The squared length of the difference of two fingerprints estimates how many
paragraphs they don't share, which gives their likeness.

Paragraphs are lines, cut at the ends of sentences, and further every ``LONGEST`` code points.

Defined cases
-------------
* Null text counts as empty; an empty text has no paragraphs and a fingerprint of zeros. Two empty
  ones have likeness 1, an empty one and another 0.
* Documents are ordered by (doc_id, xxhash64 of the text), null ids first; repeated rows follow one another.
* A table of one row is its own next document. An empty table gives no rows.
* Further columns are ignored. Texts of any length are taken whole.

The next document is found by one range shuffle, with as many ranges as the data's size asks for:
within a range it is the next row. Each range also gives its first and its last text, and only
these few rows meet in a second, small join. A hot id is divided by the texts' hashes, and many
equal rows by the partitions that they come from.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table

LANES = 512
LONGEST = 400
_SENTENCE_END = re.compile(r"(?<=[.!?])[^\S\n]+")
#: Bytes of text that a range holds, about.
RANGE_BYTES = 64 << 20
RESULT = "doc_id long, n_chars long, edited_sha256 string, vector binary, edited_fingerprint string, near_edited double, near_next double"
ROWS = RESULT + ", part int, seam int, text string"

def paragraphs(text: str) -> list[str]:
    out = []
    for line in text.split("\n"):
        for part in _SENTENCE_END.split(line):
            part = part.strip()
            if len(part) <= LONGEST:
                if part:
                    out.append(part)
            else:
                out += [part[i : i + LONGEST] for i in range(0, len(part), LONGEST)]
    return out


def vectors_sum(parts: list[str]) -> np.ndarray:
    """Sum of the parts' vectors modulo 2**64; entry 0 counts the parts."""
    total = np.zeros(LANES + 1, np.uint64)
    for i in range(0, len(parts), 4096):
        some = parts[i : i + 4096]
        raw = b"".join(hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=LANES // 8).digest() for p in some)
        ones = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(some), -1), axis=1).sum(axis=0, dtype=np.int64)
        total[1:] += (2 * ones - len(some)).view(np.uint64)
        total[0] += np.uint64(len(some))
    return total


def fingerprint_of(text: str | None) -> np.ndarray:
    return vectors_sum(paragraphs(text or ""))


def insert(fp: np.ndarray, text: str) -> np.ndarray:
    """The fingerprint after the paragraphs of ``text`` came in."""
    return fp + fingerprint_of(text)


def delete(fp: np.ndarray, text: str) -> np.ndarray:
    """The fingerprint after the paragraphs of ``text`` went."""
    return fp - fingerprint_of(text)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal multisets, near 0 for disjoint ones."""
    if np.array_equal(a, b):
        return 1.0
    x, y = (v[1:].view(np.int64).astype(np.float64) for v in (a, b))
    apart = (a[1:] - b[1:]).view(np.int64).astype(np.float64)
    whole = float(x @ x + y @ y)
    return min(1.0, max(0.0, 1.0 - float(apart @ apart) / whole)) if whole else 0.0


def as_bytes(fp: np.ndarray) -> bytes:
    """The stored form of a fingerprint, which ``from_bytes`` reads: the lowest bytes of all entries, then the next, and so on.

    Entries are small numbers of either sign, whose upper bytes are all alike and pack to nothing.
    """
    return fp.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def from_bytes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.uint64)


def digest(fp: np.ndarray) -> str:
    """A short name of a fingerprint: md5 of its stored form."""
    return hashlib.md5(as_bytes(fp), usedforsecurity=False).hexdigest()


def edit(text: str, following: str) -> str:
    """``text`` whose last half is replaced by the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _result(doc_id: int | None, text: str, own: np.ndarray, following: str, after: np.ndarray) -> tuple:
    """A row of ``RESULT`` for a text and the next one, with their fingerprints."""
    new = edit(text, following)
    kept = fingerprint_of(new)
    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), sha, as_bytes(own), digest(kept), likeness(own, kept), likeness(own, after)


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """``doc_id, text`` in ``ranges`` partitions that follow one another, each sorted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("h"), F.spark_partition_id().alias("source"))
    return rows.repartitionByRange(ranges, "doc_id", "h", "source").sortWithinPartitions("doc_id", "h", "source").select("doc_id", "text")


def _within_ranges(ranged: DataFrame) -> DataFrame:
    """``ROWS``: results of all rows but the ranges' last ones; each range's first (seam 0) and last (seam 1) text."""
    schema = _schema(ROWS)
    nothing = (None,) * 6

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held = None  # (doc_id, text, fingerprint) that waits for its next document
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                doc_id, text = doc_id.as_py(), text.as_py()
                fp = fingerprint_of(text)
                if held is None:
                    rows.append((doc_id, *nothing, part, 0, text))
                else:
                    rows.append((*_result(*held, text, fp), None, None, None))
                held = doc_id, text, fp
            yield _batch(rows, schema)
        if held is not None:
            yield _batch([(held[0], *nothing, part, 1, held[1])], schema)

    return ranged.mapInArrow(run, ROWS)


def _across_ranges(seams: DataFrame) -> DataFrame:
    """``RESULT`` of each range's last row, whose next text is the first of the following range that has rows."""
    spark = seams.sparkSession
    parts = sorted(r[0] for r in seams.where("seam = 1").select("part").collect())  # a number per range
    order = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    first = seams.where("seam = 0").select(F.col("part").alias("next"), F.col("text").alias("following"))
    met = seams.where("seam = 1").select("part", "doc_id", "text").join(order, "part").join(first, "next")
    schema = _schema(RESULT)

    def run(batches):
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(3)]
            yield _batch([_result(d, t, fingerprint_of(t), f, fingerprint_of(f)) for d, t, f in zip(*cols, strict=True)], schema)

    return met.select("doc_id", "text", "following").mapInArrow(run, RESULT)


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text (``vector``, and its digest), of its edited form, and their likenesses."""
    if ranges is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    rows = shared_table(_within_ranges(in_ranges(docs, ranges)), "fingerprints", compression="zstd")
    names = RESULT.replace(",", " ").split()[::2]
    done = rows.where("seam is null").select(*names).unionByName(_across_ranges(rows.where("seam is not null")))
    return done.select(
        "doc_id", "n_chars", "edited_sha256", F.md5("vector").alias("fingerprint"), "edited_fingerprint", "near_edited", "near_next", "vector"
    )
