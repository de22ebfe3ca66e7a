"""Periodic runs of words: maximal stretches that repeat one period at least four times.

A run is a stretch of consecutive words with smallest period q and a length of at least
max(6, 4q), which no neighbouring word extends. They are found by block matching. For a scale b, a
power of two, the words are cut into aligned blocks of b words. A run of period b <= q < 2b is
longer by 3q than its period, so that it holds two aligned blocks in a row that come again q words
on. The blocks of one scale are the keys of an automaton over word numbers; where it meets one of
them again at a distance that fits the scale, the pair is a seed, extended word by word to both
sides.

What keeps the work near linear:

* a block can only come again within 2b words if each of its words does, so blocks with any other
  word aren't keys, and only the stretch of 3b words behind a block is searched;
* a block that lies with that whole stretch in a run of a smaller period is left out: there it
  comes again at multiples of that period only;
* how far a seed reaches is first bounded by hashes and halving, which never err on the low side;
  only seeds that could be runs are compared word by word.

Defined cases
-------------
* Null, empty and blank texts have no words and no runs; their collapsed text is empty.
* Null ids are kept, repeated rows are rows of their own, further columns are ignored (``collapse``
  keeps them). An empty table gives no rows.
* Texts are taken whole, whatever their length. Each is the work of one task, and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least this many words, and at least this many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Numbers in a key of the automaton at most.
LETTERS = 8
#: Words that are searched together; a longer text is searched alone.
TOGETHER = 400_000

RUNS = "doc_id long, start long, length long, period long"
REPORT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def split_words(text: str | None) -> list[bytes]:
    """Words of UTF-8 bytes between the white space of ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").split()


class Numbered:
    """Words of several texts as numbers; no two texts share a number, so that no run crosses an end."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.ends: list[int] = [0]
        self.known = 0

    def add(self, words: list) -> None:
        number: dict = {}
        self.parts.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)) + self.known)
        self.known += len(number)
        self.ends.append(self.ends[-1] + len(words))

    def runs(self) -> list[list[tuple[int, int, int]]]:
        """(start, length, period) of each text's runs, by start and period."""
        out: list[list] = [[] for _ in self.parts]
        found = runs_of(np.concatenate(self.parts)) if self.parts else []
        of = np.searchsorted(self.ends, [s for s, _, _ in found], "right") - 1
        for i, (s, e, q) in zip(of, found, strict=True):
            out[i].append((s - self.ends[i], e - s, q))
        return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


class Reaches:
    """How far two places of a sequence agree, to the right and to the left."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        base = np.uint64(0x9E3779B97F4A7C15)
        self.up = np.cumprod(np.r_[np.uint64(1), np.full(len(ids), base)], dtype=np.uint64)
        x = ids.astype(np.uint64) + np.uint64(1)
        x = (x ^ (x << np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)  # a sequence of few numbers must not cancel out
        self.sum = np.r_[np.uint64(0), np.cumsum((x ^ (x >> np.uint64(29))) * self.up[:-1], dtype=np.uint64)]

    def _same(self, at: np.ndarray, d: np.ndarray, n: np.ndarray) -> np.ndarray:
        left = (self.sum[at + n] - self.sum[at]) * self.up[d]
        return left == self.sum[at + d + n] - self.sum[at + d]

    def at_most(self, at: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds (first, end) of the stretch around ``at`` in which words ``d`` apart agree: never too narrow."""
        ends = []
        for right in (True, False):
            lo, hi = np.zeros_like(at), len(self.ids) - at - d if right else at.copy()
            while (lo < hi).any():
                mid = (lo + hi + 1) // 2
                same = self._same(at if right else at - mid, d, mid)
                lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
            ends.append(at + lo if right else at - lo)
        return ends[1], ends[0]

    def exactly(self, at: int, d: int, first: int, end: int) -> tuple[int, int]:
        """The stretch itself, from bounds that are mostly right: words are compared, and galloped over where hashes erred."""
        ids = self.ids
        if np.array_equal(ids[first:end], ids[first + d : end + d]):
            return first, end
        apart = np.flatnonzero(ids[first:end] != ids[first + d : end + d]) + first
        i = np.searchsorted(apart, at)
        return (int(apart[i - 1]) + 1 if i else first), (int(apart[i]) if i < len(apart) else end)


def _next_same(ids: np.ndarray) -> np.ndarray:
    """Distance to the next place of each word; a number beyond the end where there is none."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), 2 * len(ids) + 2, np.int64)
    again = ids[order[1:]] == ids[order[:-1]]
    out[order[:-1][again]] = (order[1:] - order[:-1])[again]
    return out


def _keys(gaps: np.ndarray, b: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Numbers of the aligned blocks that can seed a run of a period in [b, 2b)."""
    n = len(gaps) // b
    able = np.maximum.reduceat(gaps[: n * b], np.arange(0, n * b, b)) < 2 * b
    beside = np.zeros(n, bool)
    beside[1:] |= able[:-1]
    beside[:-1] |= able[1:]
    able &= beside
    inside = np.zeros(n + 1, np.int64)  # blocks whose whole stretch lies in one run of a smaller period
    for s, e, _ in found:
        first, last = -(-s // b), (e - 3 * b) // b
        if first <= last:
            inside[first] += 1
            inside[last + 1] -= 1
    return np.flatnonzero(able & (np.cumsum(inside[:-1]) == 0))


def _names(ids: np.ndarray, c: int) -> np.ndarray:
    """Equal numbers for equal windows of ``c`` words, a power of two; the last c - 1 places have none that counts."""
    w = 1
    while w < c:
        pairs = ids[:-w] * (ids.max() + 1) + ids[w:]
        ids = np.zeros(len(ids), np.int64)
        ids[:-w] = np.unique(pairs, return_inverse=True)[1]
        w *= 2
    return ids


def _seeds(ids: np.ndarray, blocks: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of the blocks that come again at a distance in [b, 2b).

    A key has at most ``LETTERS`` numbers: each stands for the words of an equal part of the block.
    Failure links are then short even where a text is one word over and over.
    """
    c = max(1, b // LETTERS)
    fresh = np.flatnonzero(np.diff(blocks, prepend=blocks[0] - 4) >= 3)  # stretches [jb, jb + 3b) that overlap are searched as one
    lows = blocks[fresh] * b
    highs = np.minimum((np.r_[blocks[fresh[1:] - 1], blocks[-1]] + 3) * b, len(ids))
    offsets = np.r_[0, np.cumsum(highs - lows)]
    names = _names(np.concatenate([ids[lo:hi] for lo, hi in zip(lows, highs, strict=True)]), c)
    between = int(names.max()) + 1

    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    key: dict[int, int] = {}
    seen: dict[tuple, int] = {}
    of = np.searchsorted(lows, blocks * b, "right") - 1
    for j, p in zip(blocks.tolist(), (blocks * b - lows[of] + offsets[of]).tolist(), strict=True):
        word = tuple(names[p : p + b : c].tolist())
        key[j] = seen.setdefault(word, len(seen))
        automaton.add_word(word, key[j])
    automaton.make_automaton()

    at, apart = [], []
    for lo, first, end in zip(lows.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        places = end - first - c + 1
        rows = -(-places // c)
        table = np.full((rows + 1) * c, between, np.int64)
        table[:places] = names[first : first + places]
        for end_at, name in automaton.iter(tuple(table.reshape(rows + 1, c).T.ravel().tolist())):  # every c-th place, from each of c places
            residue, row = divmod(end_at, rows + 1)
            x = lo + residue + (row + 1) * c - b
            slot = (x - b) // b
            if key.get(slot) == name:
                at.append(slot * b)
                apart.append(x - slot * b)
    return np.asarray(at, np.int64), np.asarray(apart, np.int64)


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(first, end, period) of all runs of a sequence of numbers in [0, 2**31)."""
    if len(ids) < LEAST_WORDS:
        return []
    ids = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    gaps, reach = _next_same(ids), None
    found: dict[tuple[int, int], int] = {}
    b = 1
    while LEAST_PERIODS * b <= len(ids):
        blocks = _keys(gaps, b, [(s, e, q) for (s, e), q in found.items()])
        if len(blocks):
            at, d = _seeds(ids, blocks, b)
            if len(at):
                reach = reach or Reaches(ids)
                first, end = reach.at_most(at, d)
                able = np.flatnonzero(end - first + d >= np.maximum(LEAST_WORDS, LEAST_PERIODS * d))
                able = able[np.argsort(d[able], kind="stable")]
                able = able[np.unique(first[able] * (len(ids) + 1) + end[able] + d[able], return_index=True)[1]]
                for i in able[np.argsort(d[able], kind="stable")].tolist():
                    q, s, e = int(d[i]), int(first[i]), int(end[i])
                    if (s, e + q) in found:  # a run whose smallest period is a divisor of this one
                        continue
                    s, e = reach.exactly(int(at[i]), q, s, e)
                    if e + q - s >= max(LEAST_WORDS, LEAST_PERIODS * q):
                        found.setdefault((s, e + q), q)
        b *= 2
    return [(s, e, q) for (s, e), q in found.items()]


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: not those that a run contains after its first period."""
    gone = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return np.cumsum(gone[:-1]) == 0


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    return [w for w, stays in zip(words, kept(len(words), runs).tolist(), strict=True) if stays] if runs else words


def looped(doc_id: int | None, words: list) -> list:
    """The words with a planted loop for a tenth of the ids, as ``op13``'s contract has it; a null id has none."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _each(docs: DataFrame, result: str, rows: Callable, change: Callable | None = None) -> DataFrame:
    """``rows(doc_id, words, runs)`` of each document, searched ``TOGETHER`` words at a time."""
    schema = _schema(result)

    def run(batches):
        held, numbers = [], Numbered()

        def done() -> pa.RecordBatch:
            out = [row for (doc_id, words), runs in zip(held, numbers.runs(), strict=True) for row in rows(doc_id, words, runs)]
            columns = zip(*out, strict=True) if out else [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                doc_id, words = doc_id.as_py(), split_words(text.as_py())
                words = change(doc_id, words) if change else words
                held.append((doc_id, words))
                numbers.add(words)
                if numbers.ends[-1] >= TOGETHER:
                    yield done()
                    held, numbers = [], Numbered()
        yield done()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, result)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, period): one row per run; words are numbered from 0."""
    return _each(docs, RUNS, lambda doc_id, words, runs: [(doc_id, *r) for r in runs])


def collapse(docs: DataFrame) -> DataFrame:
    """The documents, their texts without what runs repeat; a text without runs stays as it is."""
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(place).to_pylist():
                words, numbers = split_words(text), Numbered()
                numbers.add(words)
                runs = numbers.runs()[0]
                out.append(b" ".join(collapsed(words, runs)).decode("utf-8", "surrogatepass") if runs else text)
            yield batch.set_column(place, batch.schema.field(place), pa.array(out, batch.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)


def _report(doc_id: int | None, words: list, runs: list[tuple[int, int, int]]) -> list[tuple]:
    longest = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return [
        (
            doc_id, len(runs), *(longest or (None,) * 3), 1000 * longest[1] // longest[2] if longest else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest(),
        )
    ]


def run_report(docs: DataFrame, change: Callable | None = None) -> DataFrame:
    """Number of runs, the longest, and digests of all runs and of the collapsed text; ``change(doc_id, words)`` comes first."""
    return _each(docs, REPORT, _report, change)
