"""Benchmark decontamination by spaced-seed hashing.

A mask names the word positions of a window that count; the others may differ. For every window
and mask, the counted words give one hash, in the benchmark and in the documents. The two meet in
a join on the hash, and around each hit the aligned words are compared, ignored ones too: a hit
stands where at least ``LIKE`` hundredths of the window's words agree, or of the window and its
flanks. Hits of one document on one item and one diagonal make an overlap.

Masks. A window of n words, of which k may differ, is dealt into k + 2 interleaved cells, and each
pair of cells is a mask: k differences leave two cells whole, so no window with up to k of them is
missed. Windows have ``SPAN`` words (six masks of five or six words); an item that is shorter is
one window with masks of its own length.

Words are maximal runs of a-z, 0-9 and code points beyond 127 after lower-casing; quotation marks
and dashes beyond 127 are part of words.

Defined cases
-------------
* Null and empty texts have no words. An item of one to four words is sought as a whole line or a
  whole text, since in running text it would be met everywhere.
* Items with the same words are one, named by their smallest id, and so are equal windows (with
  their flanks) of different items: a preamble that many items share counts for the smallest. With
  ``every_item`` it counts for each of them, and each of the items with the same words has its row.
* Repeated rows of a document are one. A null doc_id or item_id is kept as null.
* Further columns are ignored. Empty tables give no rows.

Documents pass once, narrowly; a bit filter over the benchmark's hashes lets through little but
true hits, which alone are shuffled. A fuller filter costs time, never results.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, shared_table
from .hashing import blocks, byte_table, words_of

#: Words of a window, and beside it.
SPAN = 11
FLANK = 4
#: Hundredths of the compared words that must agree.
LIKE = 80
#: Items with fewer words are sought as lines.
LEAST_WORDS = 5
#: Bits of the filter per hash, and the most that it has in all (as a power of two: 16 MB).
BITS_PER_HASH, MOST_BITS = 16, 27
PROBES = 3
#: Benchmark hashes up to which they are broadcast.
BROADCAST_SEEDS = 200_000

SEEDS = "item_id long, n_item long, seed long, at int, around array<long>"
HITS = "doc_id long, text_hash long, seed long, at int, around array<long>"

_BETWEEN = ~byte_table((48, 57), (97, 122), (128, 255))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_AROUND = np.arange(-FLANK, SPAN + FLANK)


def masks_of(n: int) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """The pairs of cells of a window of n words."""
    cells = n * (100 - LIKE) // 100 + 2
    return list(combinations([tuple(range(c, n, cells)) for c in range(cells)], 2))


def _seeds(words: np.ndarray, n: int, at: np.ndarray, line: bool = False) -> np.ndarray:
    """(masks, places) hashes of the windows of n words at the places ``at``; of a word's neighbours in ``words`` the caller knows that they are the text's."""
    masks = masks_of(n)
    cells: dict[tuple, np.ndarray] = {}
    for cell in dict.fromkeys(c for mask in masks for c in mask):
        h = np.full(len(at), 0x27D4EB2F165667C5, np.uint64)
        for j, o in enumerate(cell):
            h ^= words[at + o]
            h *= _MIX[j & 3]
            h ^= h >> np.uint64(29)
        cells[cell] = h
    out = np.empty((len(masks), len(at)), np.uint64)
    for kind, (a, b) in enumerate(masks):
        h = cells[a] * _MIX[1] + (cells[b] ^ np.uint64((n * 256 + kind) * 2 + line)) * _MIX[2]
        out[kind] = (h ^ (h >> np.uint64(31))) * _MIX[0]
    return out


def _around(words: np.ndarray, at: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The words of each window of ``SPAN`` with flanks, 0 beyond the text's [first, end)."""
    places = at[:, None] + _AROUND
    inside = (places >= first[:, None]) & (places < end[:, None])
    return np.where(inside, words[np.clip(places, 0, len(words) - 1)], np.uint64(0))


def _windows(texts: pa.Array, sizes: list[int], as_lines: bool):
    """(hashes, places, texts' numbers, words, first words of the texts) of all windows of a block of texts, in parts."""
    w = words_of(pc.utf8_lower(texts), _BETWEEN)
    words, bounds = w.hashes(), w.bounds(len(texts))
    parts = []
    for n in sizes:
        at = np.arange(len(words) - n + 1)
        parts.append((n, at[w.text[: len(at)] == w.text[n - 1 :]] if len(at) else at, False))
    if as_lines and len(words):
        first = np.flatnonzero(w.fresh)
        size = np.diff(np.append(first, len(words)))
        whole = np.diff(bounds)
        # A text of few words over several lines is sought as a whole, too.
        some = np.flatnonzero((whole > 0) & (whole < LEAST_WORDS))
        some = some[size[np.searchsorted(first, bounds[some])] < whole[some]]
        for n in range(1, LEAST_WORDS):
            parts.append((n, np.concatenate([first[size == n], bounds[some][whole[some] == n]]), True))
    hashes, places = [], []
    for n, at, line in parts:
        if len(at):
            h = _seeds(words, n, at, line)
            hashes.append(h.ravel())
            places.append(np.tile(at, len(h)))
    empty = np.empty(0, np.int64)
    return (np.concatenate(hashes) if hashes else empty.astype(np.uint64)), (np.concatenate(places) if places else empty), w.text, words, bounds


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, text): the items, each as its words; null texts aren't any."""
    words = F.regexp_replace(F.lower("text"), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.trim(words).alias("text")).where("text is not null")


def item_windows(items: DataFrame) -> DataFrame:
    """Hashes of the items' windows; equal items as one."""
    schema = _schema(SEEDS)

    def run(batches):
        for batch in batches:
            for lo, texts in blocks(batch.column("text")):
                w = words_of(pc.utf8_lower(texts), _BETWEEN)
                words, bounds = w.hashes(), w.bounds(len(texts))
                rows = []
                for i, item in enumerate(batch.column("item_id").slice(lo, len(texts)).to_pylist()):
                    own = words[bounds[i] : bounds[i + 1]]
                    n = len(own)
                    if n:
                        at = np.arange(n - min(n, SPAN) + 1)
                        near = _around(own, at, np.zeros_like(at), np.full_like(at, n)).view(np.int64)
                        for hashes in _seeds(own, min(n, SPAN), at, n < LEAST_WORDS).view(np.int64):
                            rows += [{"item_id": item, "n_item": n, "seed": h, "at": k, "around": near[k]} for k, h in enumerate(hashes.tolist())]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return items.groupBy("text").agg(F.min("item_id").alias("item_id")).select("item_id", "text").mapInArrow(run, SEEDS)


def benchmark_seeds(windows: DataFrame) -> DataFrame:
    """Equal windows as one, that of the smallest id."""
    first = F.min(F.struct(F.col("item_id").isNull(), "item_id", "at", "n_item")).alias("f")
    return windows.groupBy("seed", "around").agg(first).select("f.item_id", "f.n_item", "seed", "f.at", "around")


def sharing_items(windows: DataFrame, seeds: DataFrame) -> DataFrame:
    """(item_id, item_at, other_id, n_other, other_at): the places of further items whose window is that of an item in ``seeds``."""
    of = seeds.select(F.col("item_id").alias("first_id"), F.col("at").alias("item_at"), "seed", "around")
    other = ~F.col("item_id").eqNullSafe(F.col("first_id"))
    met = windows.join(of, ["seed", "around"]).where(other)
    return met.select(F.col("first_id").alias("item_id"), "item_at", F.col("item_id").alias("other_id"), F.col("n_item").alias("n_other"), F.col("at").alias("other_at")).distinct()


def _probes(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(hashes * _MIX[p] >> np.uint64(64 - bits)).astype(np.int64) for p in range(PROBES)]


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """A bit filter, packed, of a power of two of bits; on the driver come at most as many rows as it has bytes."""
    bits = min(MOST_BITS, max(16, (BITS_PER_HASH * seeds.count()).bit_length()))

    def run(batches):
        for batch in batches:
            h = np.asarray(batch.column(0), np.int64).view(np.uint64)
            on = np.unique(np.concatenate(_probes(h, bits))) if len(h) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(on >> 3, pa.int32()), pa.array(1 << (on & 7), pa.int32())], names=["byte", "bit"])

    rows = seeds.select("seed").mapInArrow(run, "byte int, bit int").groupBy("byte").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (bits - 3), np.uint8)
    out[rows["byte"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.uint8)
    return out


def document_hits(docs: DataFrame, table: np.ndarray, lengths: tuple) -> DataFrame:
    """Windows of the documents whose hash passes the filter, with the words around them.

    ``lengths`` are those of the items that are shorter than ``SPAN``.
    """
    schema = _schema(HITS)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    as_lines = any(n < LEAST_WORDS for n in lengths)
    sizes = [SPAN, *(n for n in lengths if n >= LEAST_WORDS)]

    def run(batches):
        table = shared.value
        bits = (8 * len(table)).bit_length() - 1
        width = SPAN + 2 * FLANK
        for batch in batches:
            for lo, texts in blocks(batch.column("text")):
                hashes, places, text, words, bounds = _windows(texts, sizes, as_lines)
                for p in range(PROBES):
                    bit = (hashes * _MIX[p] >> np.uint64(64 - bits)).astype(np.int64)
                    passed = (table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 != 0
                    hashes, places = hashes[passed], places[passed]
                if not len(hashes):
                    continue
                own = text[places]
                near = _around(words, places, bounds[own], bounds[own + 1])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(hashes) + 1, dtype=np.int32) * width), pa.array(near.view(np.int64).ravel()))
                taken = pa.array(own + lo)
                at = (places - bounds[own]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(taken), batch.column("text_hash").take(taken), pa.array(hashes.view(np.int64)), pa.array(at), lists], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, HITS)


def _stretches(docs: DataFrame, items: DataFrame, every_item: bool = False) -> DataFrame:
    """One row per document, text, item and diagonal that overlap: ``n_matched``, ``doc_word``, ``item_word``."""
    windows = item_windows(items)
    if every_item:
        windows = shared_table(windows, "benchmark-windows")
    seeds = shared_table(benchmark_seeds(windows), "benchmark-seeds")
    lengths = tuple(sorted(r[0] for r in seeds.where(F.col("n_item") < SPAN).select("n_item").distinct().collect()))
    hits = document_hits(docs, seed_filter(seeds), lengths)
    known = broadcast_if_small(seeds, BROADCAST_SEEDS).select("item_id", "n_item", "seed", F.col("at").alias("item_at"), F.col("around").alias("item_around"))
    met = hits.join(known, "seed")
    # Word by word: whether both agree; null beyond an end of either, which doesn't count.
    met = met.withColumn("same", F.zip_with("around", "item_around", lambda a, b: F.when((a != 0) & (b != 0), a == b)))

    def alike(same):
        compared, agree = F.size(F.filter(same, lambda x: x.isNotNull())), F.size(F.filter(same, lambda x: x))
        return (compared > 0) & (agree * 100 >= compared * LIKE)

    met = met.where(alike("same") | alike(F.slice("same", FLANK + 1, SPAN)))
    places = F.filter(F.transform("same", lambda x, j: F.when(x, F.col("item_at") - FLANK + j)), lambda x: x.isNotNull())
    met = met.select("doc_id", "text_hash", "item_id", "n_item", "item_at", (F.col("at") - F.col("item_at")).alias("diagonal"), places.alias("places"))
    if every_item:
        others = broadcast_if_small(shared_table(sharing_items(windows, seeds), "sharing-items"), BROADCAST_SEEDS).withColumnsRenamed({"item_id": "first_id", "item_at": "first_at"})
        shift = F.col("other_at") - F.col("item_at")
        also = met.join(others, F.col("item_id").eqNullSafe(F.col("first_id")) & (F.col("item_at") == F.col("first_at"))).select(
            "doc_id", "text_hash", F.col("other_id").alias("item_id"), F.col("n_other").alias("n_item"), "item_at", (F.col("diagonal") - shift).alias("diagonal"), F.transform("places", lambda x: x + shift).alias("places")
        )
        met = met.unionByName(also)
    per_diagonal = met.groupBy("doc_id", "text_hash", "item_id", "n_item", "diagonal").agg(
        F.array_distinct(F.flatten(F.collect_set("places"))).alias("places")
    )
    return per_diagonal.select(
        "doc_id", "text_hash", "item_id", "n_item", F.size("places").cast("long").alias("n_matched"), (F.col("diagonal") + F.array_min("places")).cast("long").alias("doc_word"), F.array_min("places").cast("long").alias("item_word")
    )


def overlaps(docs: DataFrame, benchmark: DataFrame, every_item: bool = False) -> DataFrame:
    """One row per document and item that overlap: where, on how many words, and what part of the item.

    Without ``every_item`` a window that several items share, or a whole item, counts for the smallest id.
    """
    items = benchmark_items(benchmark)
    best = F.max_by(F.struct("n_matched", "doc_word", "item_word"), F.struct("n_matched", -F.col("doc_word")))
    out = (
        _stretches(docs, items, every_item)
        .groupBy("doc_id", "item_id", "n_item")
        .agg(best.alias("b"))
        .select("doc_id", "item_id", "n_item", "b.n_matched", "b.doc_word", "b.item_word", (F.col("b.n_matched") / F.col("n_item")).alias("overlap"))
    )
    if not every_item:
        return out
    named = items.groupBy("text").agg(F.min("item_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("text", "first_id")
    copies = items.join(named, "text").select("first_id", F.col("item_id").alias("copy_id")).where("not copy_id <=> first_id").distinct()
    again = out.join(copies, F.col("item_id").eqNullSafe(F.col("first_id"))).select("doc_id", F.col("copy_id").alias("item_id"), *out.columns[2:])
    return out.unionByName(again)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that overlap an item. A row is known by its id and text: of an id's texts only the leaked ones go, and null ids too."""
    found = _stretches(docs.select("doc_id", "text"), benchmark_items(benchmark)).select("doc_id", "text_hash").distinct()
    found = broadcast_if_small(shared_table(found, "contaminated"))
    rows = docs.select(F.struct("*").alias("row"))
    gone = F.col("row.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (F.xxhash64("row.text") == F.col("text_hash"))
    return rows.join(found, gone, "left_anti").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
