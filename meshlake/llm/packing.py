"""Best-fit packing by hierarchical residual rounds.

Documents become token ids with a closing id 0; only longer ones than a sequence are cut. Pieces
are dealt into groups of bounded size. Each group is packed best-fit, longest pieces first. Bins
that are nearly full are final; the emptiest of the others become items themselves: groups are
merged ``FAN_IN`` at a time up a tree, and each merge packs its items best-fit again.

After best-fit no two bins of one group fit together and at most one is half empty, so a merge
can save a bin per merged group at most; ``carry`` of the emptiest bins per group go up, far more
than that, and any other stays a sequence as it is. No piece is ever dropped.

Defined cases
-------------
* Null and empty texts are one piece of length 1 (the closing id).
* A null id is kept; repeated rows are pieces of their own.
* Further columns are ignored. An empty table gives no rows.

Texts are tokenized once, in a narrow pass, and never shuffled: what moves is 40 bytes a piece.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table

SEQUENCE = 2048
GROUP = 50_000
FAN_IN = 16
#: Bins with less room than this are nearly full.
SLACK = 16
CARRY = 2048

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, seq long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long, fill long, open boolean"
BINS = "origin long, bin long, off long, fill long, grp long, open boolean"


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and place of each item, and the bins' fills; an item goes where least room stays.

    Bins with r free places wait in ``waiting[r]``; bit r of ``room`` says that there are some.
    """
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    room, bins, places, fills = 0, [], [], []
    for size in sizes:
        fit = room >> size
        if fit:
            free = size + (fit & -fit).bit_length() - 1
            b = waiting[free].pop()
            if not waiting[free]:
                room &= ~(1 << free)
        else:
            free, b = capacity, len(fills)
            fills.append(0)
        bins.append(b)
        places.append(capacity - free)
        fills[b] += size
        left = free - size
        if left:
            waiting[left].append(b)
            room |= 1 << left
    return bins, places, fills


def still_open(fills: np.ndarray, capacity: int, slack: int, carry: int) -> np.ndarray:
    """Which bins go up the tree: those with room, the emptiest ``carry`` of them."""
    up = fills <= capacity - slack
    if up.sum() > carry:
        up[:] = False
        up[np.argsort(fills, kind="stable")[:carry]] = True
    return up


def pieces_of(docs: DataFrame, path: str, capacity: int = SEQUENCE) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32, seq); seq tells equal rows apart."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(PIECES))

    def run(batches):
        from .tokens import tokenizer

        encode, seq = tokenizer(path).ids, 0
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + b"\0\0\0\0"
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    for col, x in zip(cols, (doc_id, piece, start, len(part) // 4, zlib.crc32(part), seq), strict=True):
                        col.append(x)
                    seq += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def pack(pieces: DataFrame, capacity: int = SEQUENCE, group: int = GROUP, fan_in: int = FAN_IN, slack: int = SLACK, carry: int = CARRY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a written table of pieces."""
    groups = max(1, -(-pieces.count() // group))
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "seq"), F.lit(groups)))

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "seq"], ascending=[False, True, True, True], kind="stable")
        bins, places, fills = best_fit(pdf["length"].tolist(), capacity)
        bins, fills = np.asarray(bins, np.int64), np.asarray(fills, np.int64)
        up = still_open(fills, capacity, slack, carry)
        g = int(pdf["grp"].iloc[0])
        out = pdf[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
        out["doc_id"] = out["doc_id"].astype("Int64")
        out["bin"], out["at"] = bins + (g << 32), np.asarray(places, np.int64)
        out["fill"], out["open"] = fills[bins], up[bins]
        return out

    packed = dealt.groupBy("grp").applyInPandas(local, PACKED)
    if groups == 1:
        return packed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    packed = shared_table(packed, "packed-pieces")
    moved = merge_rounds(packed, groups, capacity, fan_in, slack, carry).select("origin", F.col("bin").alias("to"), "off")
    joined = packed.join(moved, (packed["open"]) & (packed["bin"] == moved["origin"]), "left")
    return joined.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("to", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("off", F.lit(0))).alias("offset"),
    )


def merge_rounds(packed: DataFrame, groups: int, capacity: int, fan_in: int, slack: int, carry: int) -> DataFrame:
    """Where each open bin ends: (origin, bin, off, ...), after log(groups) rounds up the tree."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        items = pdf.groupby("bin", sort=True)["fill"].first().reset_index().sort_values(["fill", "bin"], ascending=[False, True], kind="stable")
        bins, places, fills = best_fit(items["fill"].tolist(), capacity)
        fills = np.asarray(fills, np.int64)
        up = still_open(fills, capacity, slack, carry)
        items["slot"], items["place"] = bins, places
        names = items.groupby("slot", sort=True)["bin"].first().to_numpy()  # the first item's name is the bin's
        at = items.set_index("bin").loc[pdf["bin"]]
        slot = at["slot"].to_numpy()
        return pd.DataFrame(
            {"origin": pdf["origin"].to_numpy(), "bin": names[slot], "off": pdf["off"].to_numpy() + at["place"].to_numpy(), "fill": fills[slot], "grp": pdf["grp"].to_numpy(), "open": up[slot]}
        )

    bins = (
        packed.where("open")
        .groupBy("bin")
        .agg(F.first("fill").alias("fill"))
        .select(F.col("bin").alias("origin"), "bin", F.lit(0).cast("long").alias("off"), "fill", F.shiftright("bin", 32).alias("grp"), F.lit(True).alias("open"))
    )
    while groups > 1:
        groups = -(-groups // fan_in)
        bins = bins.withColumn("grp", F.floor(F.col("grp") / fan_in))
        bins = shared_table(bins.where("open").groupBy("grp").applyInPandas(merge, BINS).unionByName(bins.where("not open")), "packed-bins")
    return bins


def pack_documents(docs: DataFrame, path: str, capacity: int = SEQUENCE, **kw) -> DataFrame:
    """Tokenize and pack whole documents; one row per piece."""
    return pack(shared_table(pieces_of(docs, path, capacity), "token-pieces"), capacity, **kw)
