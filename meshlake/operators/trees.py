"""Trees of nodes: checks, paths, numbering into pages, and roll-ups from the leaves.

A tree is rows (node_id, parent_id, ordinal, depth). Work goes level by level, one join or
aggregate each; levels are staged so that plans don't grow with the depth.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import numbered, small_side, staged

PAGE = 64


def valid_children(links: DataFrame) -> DataFrame:
    """Links (node_id, child_id) without those to no child (-1 or null)."""
    return links.where("child_id is not null and child_id != -1")


def tree_issues(tree: DataFrame) -> DataFrame:
    """(code, node_id): several roots, a node with several parents, a parent that is missing."""
    roots = tree.where("parent_id is null").select(F.lit("root").alias("code"), "node_id")
    many_roots = roots.join(F.broadcast(roots.agg(F.count("*").alias("n")).where("n != 1").drop("n")))
    shared = tree.groupBy("node_id").agg(F.countDistinct("parent_id").alias("n")).where("n > 1").select(F.lit("shared child").alias("code"), "node_id")
    missing = tree.alias("t").join(tree.select(F.col("node_id").alias("p")), F.col("parent_id") == F.col("p"), "left_anti").where("parent_id is not null")
    return many_roots.unionByName(shared).unionByName(missing.select(F.lit("missing parent").alias("code"), "node_id"))


def empty_leaves(tree: DataFrame, with_geometry: DataFrame) -> DataFrame:
    """Leaves without geometry."""
    inner = tree.select(F.col("parent_id").alias("node_id")).where("node_id is not null")
    return tree.join(inner, "node_id", "left_anti").join(with_geometry.select("node_id"), "node_id", "left_anti").select("node_id")


def depth_of(tree: DataFrame) -> int:
    return tree.agg(F.max("depth")).first()[0] or 0


def with_paths(tree: DataFrame, deepest: int | None = None) -> DataFrame:
    """Adds ``path``, the ordinals from the root down; paths order a level as a queue would."""
    deepest = depth_of(tree) if deepest is None else deepest
    level = tree.where("depth = 0").withColumn("path", F.array("ordinal"))
    out = level
    for d in range(1, deepest + 1):
        above = level.select(F.col("node_id").alias("parent_id"), F.col("path").alias("above"))
        level = tree.where(F.col("depth") == d).join(above, "parent_id").withColumn("path", F.array_append("above", F.col("ordinal"))).drop("above")
        level = staged(level, "tree-level")
        out = out.unionByName(level)
    return out


def breadth_first_pages(tree: DataFrame, page: int = PAGE, deepest: int | None = None) -> DataFrame:
    """Adds ``idx``, ``page_id`` and ``slot``: nodes in breadth-first order, ``page`` to a page."""
    out = numbered(with_paths(tree, deepest), ["depth", "path"], "idx")
    return out.withColumns({"page_id": F.floor(F.col("idx") / page), "slot": F.col("idx") % page})


def remap_links(paged: DataFrame) -> DataFrame:
    """(idx, parent_idx, first_child, n_children) after numbering.

    In breadth-first order the children of a node follow one another, so two numbers name them all,
    however many there are.
    """
    parents = paged.select(F.col("node_id").alias("parent_id"), F.col("idx").alias("parent_idx"))
    linked = paged.select("idx", "parent_id").join(parents, "parent_id", "left")
    kids = linked.where("parent_idx is not null").groupBy(F.col("parent_idx").alias("idx")).agg(F.min("idx").alias("first_child"), F.count("*").alias("n_children"))
    return linked.select("idx", "parent_idx").join(kids, "idx", "left").fillna(0, ["n_children"])


def roll_up(tree: DataFrame, own: DataFrame, aggregates: dict[str, str], deepest: int | None = None) -> DataFrame:
    """Each node's aggregate over its whole subtree.

    ``own`` has (node_id, columns of ``aggregates``); values are min, max, sum or bit_or by column.
    Null own values don't count.
    """
    deepest = depth_of(tree) if deepest is None else deepest
    f = {"min": F.min, "max": F.max, "sum": F.sum, "bit_or": F.bit_or}
    nodes = tree.select("node_id", "parent_id", "depth").join(own, "node_id", "left")
    columns = list(aggregates)
    done = None
    below = None
    for d in range(deepest, -1, -1):
        rows = nodes.where(F.col("depth") == d)
        if below is not None:
            lifted = below.where("parent_id is not null").select(F.col("parent_id").alias("node_id"), *columns)
            both = rows.select("node_id", *columns).unionByName(lifted).groupBy("node_id").agg(*(f[a](c).alias(c) for c, a in aggregates.items()))
            rows = rows.select("node_id", "parent_id", "depth").join(both, "node_id")
        below = staged(rows, "rolled-level") if d else rows
        done = below if done is None else done.unionByName(below)
    return done.select("node_id", "parent_id", "depth", *columns)


def subtree_sizes(tree: DataFrame, deepest: int | None = None) -> DataFrame:
    one = tree.select("node_id", F.lit(1).cast("long").alias("subtree_size"))
    return roll_up(tree, one, {"subtree_size": "sum"}, deepest).select("node_id", "subtree_size")


def dive_statistics(paged: DataFrame) -> DataFrame:
    """Average depth of leaves and number of pages that a dive from the root to a leaf opens."""
    inner = paged.select(F.col("parent_id").alias("node_id")).where("node_id is not null").distinct()
    leaves = paged.join(inner, "node_id", "left_anti").select("node_id", "depth", "path")
    prefixes = leaves.select("node_id", "depth", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", 1, n))).alias("path"))
    pages = prefixes.join(paged.select("path", "page_id"), "path").groupBy("node_id", "depth").agg(F.countDistinct("page_id").alias("pages"))
    return pages.agg(F.avg("depth").alias("avg_leaf_depth"), F.avg("pages").alias("avg_pages"), F.count("*").alias("n_leaves"))


def tile_tree(tiles: DataFrame, levels: int) -> DataFrame:
    """(level, i, j, n_children, p_level, p_i, p_j): the quadtree over tiles (i, j) of the finest of ``levels`` levels.

    A coarser tile is there where one of its four children is; the coarse levels come from the fine ones.
    """
    level = tiles.select("i", "j", F.lit(0).cast("long").alias("n_children")).distinct()
    out = None
    for k in range(levels - 1, -1, -1):
        level = staged(level, "tiles")
        up = lambda c: F.floor(F.col(c) / 2)
        above = (F.lit(k - 1), up("i"), up("j")) if k else (F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(None).cast("long"))
        rows = level.select(F.lit(k).alias("level"), "i", "j", "n_children", *(c.alias(n) for c, n in zip(above, ("p_level", "p_i", "p_j"), strict=True)))
        out = rows if out is None else out.unionByName(rows)
        level = level.groupBy(up("i").alias("i"), up("j").alias("j")).agg(F.count("*").alias("n_children"))
    return out


#: Points of a cell that one task divides further by itself.
CELL_POINTS = 50_000


def _halves(pdf: pd.DataFrame, leaf: int, deepest: int) -> pd.DataFrame:
    """The cells below one cell: the same rule as ``median_cells``, over arrays."""
    fid, at = pdf["fid"].to_numpy(), pdf[["x", "y", "z"]].to_numpy(np.float64)
    names, sizes = np.empty(len(pdf), object), np.empty(len(pdf), np.int64)
    todo = [(str(pdf["cell"].iloc[0]), np.arange(len(pdf)))]
    while todo:
        cell, rows = todo.pop()
        if len(rows) <= leaf or len(cell) >= deepest:
            names[rows], sizes[rows] = cell, len(rows)
            continue
        here = at[rows]
        axis = int(np.argmax(here.max(axis=0) - here.min(axis=0)))
        rows = rows[np.lexsort((fid[rows], here[:, axis]))]
        todo += [(cell + "0", rows[: len(rows) // 2]), (cell + "1", rows[len(rows) // 2 :])]
    return pd.DataFrame({"fid": fid, "x": at[:, 0], "y": at[:, 1], "z": at[:, 2], "cell": names, "n": sizes})


def median_cells(points: DataFrame, leaf: int = 64, deepest: int = 40, block: int = CELL_POINTS) -> DataFrame:
    """(fid, x, y, z, cell, n): the top-down hierarchy over points, as the path of 0 and 1 to each point's leaf.

    A cell of more than ``leaf`` points is divided at the median along its widest axis (the first of
    equals), the smaller half of an odd number below. All cells of a level are divided at once, by
    one numbering of the points in the order of (cell, coordinate, id), until a cell has at most
    ``block`` points: what is below it is one task's work.
    """
    rows = staged(points.select("fid", *(F.col(c).cast("double").alias(c) for c in "xyz"), F.lit("").alias("cell")), "cells")
    local = "fid long, x double, y double, z double, cell string, n long"
    done = None
    for _ in range(deepest + 1):
        ends = rows.groupBy("cell").agg(F.count("*").alias("n"), *((F.max(c) - F.min(c)).alias(f"w{c}") for c in "xyz"))
        axis = F.when((F.col("wx") >= F.col("wy")) & (F.col("wx") >= F.col("wz")), "x").when(F.col("wy") >= F.col("wz"), "y").otherwise("z")
        met = rows.join(small_side(ends.select("cell", "n", axis.alias("axis"))), "cell")
        final = (F.col("n") <= max(block, leaf)) | (F.length("cell") >= deepest)
        whole = met.where(final & (F.length("cell") >= deepest)).select("fid", "x", "y", "z", "cell", "n")  # however many
        done = whole if done is None else done.unionByName(whole)
        small = met.where(final & (F.length("cell") < deepest)).select("fid", "x", "y", "z", "cell").groupBy("cell").applyInPandas(lambda pdf: _halves(pdf, leaf, deepest), local)
        done = done.unionByName(small)
        large = met.where(~final)
        if not large.limit(1).count():
            return done
        along = F.when(F.col("axis") == "x", F.col("x")).when(F.col("axis") == "y", F.col("y")).otherwise(F.col("z"))
        placed = numbered(large.withColumn("along", along), ["cell", "along", "fid"])
        first = placed.groupBy("cell").agg(F.min("number").alias("first"))
        side = F.when(F.col("number") - F.col("first") < F.floor(F.col("n") / 2), "0").otherwise("1")
        rows = staged(placed.join(small_side(first), "cell").select("fid", "x", "y", "z", F.concat("cell", side).alias("cell")), "cells")
    return done
