"""Bounding hierarchy over points or features: neighbours joined from the leaves up, then few levels kept.

1. Down: the points are halved at medians into cells of at most ``leaf`` (``trees.median_cells``).
2. Up: in each cell the two clusters whose common hull is smallest are joined, again and again, until
   ``keep`` are left. They go up to the cell above, where those of both halves are joined further; at the
   root one is left. A cell never holds more than 2 x ``keep`` or ``leaf`` clusters, so a cell is one
   bounded group, and all cells of a depth are worked on at once.
3. Down again: of this binary tree a node stays if its sphere is smaller than that of the nearest
   node above that stays, divided by ``scale``; leaves always stay. Others hand their children on. A
   cell's joints are settled together, and what they hand to joints of deeper cells is a row each.

What is below a cell of at most ``TASK_POINTS`` points is one task's work, up and down. The jobs are as many as the
depth of those cells, twice; a binary tree may be deeper than that.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hulls import DIRECTIONS, frames
from .staging import staged
from .trees import median_cells

LEAF = 64
KEEP = 32
#: Points of a cell that one task joins up and walks down.
TASK_POINTS = 20_000
#: Points of a cell that one task halves further.
HALVED_POINTS = 200_000
_SPHERE = "x double, y double, z double, radius double"
JOINTS = f"cell string, name string, first string, second string, lo array<double>, hi array<double>, {_SPHERE}, up boolean"
NODES = f"cell string, node string, parent string, of double, {_SPHERE}, handed boolean"


def _frame_indexes() -> list[list[tuple[int, float]]]:
    """Each frame's axes as (direction, sign)."""
    out = []
    for axes in frames():
        out.append([next((i, s) for i, d in enumerate(DIRECTIONS) for s in (1.0, -1.0) if all(math.isclose(s * a, b, abs_tol=1e-9) for a, b in zip(d, axis, strict=True))) for axis in axes])
    return out


_FRAMES = _frame_indexes()


def spheres(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(x, y, z, radius) around each hull's best box of fixed orientation: the one of least diagonal, the first of equals."""
    wide, mid = hi - lo, (hi + lo) / 2
    diagonal = np.stack([sum(wide[:, i] ** 2 for i, _ in frame) for frame in _FRAMES], axis=1)
    best = np.array([[round(v, 9) for v in row] for row in diagonal.tolist()]).reshape(diagonal.shape).argmin(axis=1)
    out = np.empty((len(lo), 4))
    for f, frame in enumerate(_FRAMES):
        at = best == f
        out[at, :3] = sum(mid[at, i][:, None] * np.asarray(DIRECTIONS[i]) for i, _ in frame)
        out[at, 3] = np.sqrt(diagonal[at, f]) / 2
    return out


def join_up(lo: np.ndarray, hi: np.ndarray, keep: int) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Pairs joined in turn, as positions (joined ones behind the others), and the hulls of all.

    The next pair is the one whose common hull has the least sum of squared widths, then the first
    by position.
    """
    n, joints = len(lo), []
    most = 2 * n - keep
    lo, hi = np.vstack([lo, np.zeros((max(0, most - n), lo.shape[1]))]), np.vstack([hi, np.zeros((max(0, most - n), hi.shape[1]))])
    apart = np.full((len(lo), len(lo)), np.inf)

    def meet(i: int, others: np.ndarray) -> None:
        size = ((np.maximum(hi[i], hi[others]) - np.minimum(lo[i], lo[others])) ** 2).sum(axis=1).round(9)
        first = np.minimum(i, others), np.maximum(i, others)
        apart[first] = size

    if n > 1:
        i, j = np.triu_indices(n, 1)
        apart[i, j] = ((np.maximum(hi[i], hi[j]) - np.minimum(lo[i], lo[j])) ** 2).sum(axis=1).round(9)
    alive = np.zeros(len(lo), bool)
    alive[:n] = True
    for new in range(n, most):
        i, j = divmod(int(np.argmin(apart)), len(lo))
        joints.append((i, j))
        lo[new], hi[new] = np.minimum(lo[i], lo[j]), np.maximum(hi[i], hi[j])
        for gone in (i, j):
            apart[gone], apart[:, gone], alive[gone] = np.inf, np.inf, False
        meet(new, np.flatnonzero(alive))
        alive[new] = True
    return joints, lo, hi


def _joined(cell: str, names: list[str], lo: np.ndarray, hi: np.ndarray, keep: int):
    """What is joined in a cell, (names, their two parts' names, lo, hi), and the clusters that go up, (names, lo, hi)."""
    order = sorted(range(len(names)), key=names.__getitem__)
    names = [names[i] for i in order]
    n = len(names)
    pairs, lo, hi = join_up(lo[order], hi[order], keep)
    names += [f"{cell}:{k}" for k in range(len(pairs))]
    gone = {i for pair in pairs for i in pair}
    left = [i for i in range(len(names)) if i not in gone]
    made = slice(n, n + len(pairs))
    return (names[made], [(names[i], names[j]) for i, j in pairs], lo[made], hi[made]), ([names[i] for i in left], lo[left], hi[left])


def _joints(made: list, cell: str, up: tuple) -> pd.DataFrame:
    """``JOINTS`` of what was joined, (cell, *what ``_joined`` has made) each, and of what goes up from ``cell``: that with hulls, joints with spheres."""
    names = [n for _, own, *_ in made for n in own]
    parts = [p for _, _, pairs, *_ in made for p in pairs]
    round_ = spheres(np.concatenate([lo for *_, lo, _ in made]), np.concatenate([hi for *_, hi in made])) if names else np.empty((0, 4))
    none = [None] * len(names)
    out = {"cell": [c for c, own, *_ in made for _ in own], "name": names, "first": [p[0] for p in parts], "second": [p[1] for p in parts], "lo": none, "hi": none}
    own = pd.DataFrame(out | {c: round_[:, k] for k, c in enumerate(("x", "y", "z", "radius"))} | {"up": False}, dtype=object)
    above, lo, hi = up
    none = [None] * len(above)
    rest = {"cell": cell, "name": above, "first": none, "second": none, "lo": list(lo), "hi": list(hi), "x": none, "y": none, "z": none, "radius": none, "up": True}
    return pd.concat([own, pd.DataFrame(rest, dtype=object)])


def _joined_cell(pdf: pd.DataFrame, keep: int) -> pd.DataFrame:
    """``JOINTS`` of one cell."""
    cell = str(pdf["cell"].iloc[0])
    made, up = _joined(cell, pdf["name"].tolist(), np.stack(pdf["lo"].tolist()), np.stack(pdf["hi"].tolist()), keep)
    return _joints([(cell, *made)], cell, up)


def _joined_to(keep: int):
    return lambda pdf: _joined_cell(pdf, keep)


def _joined_block(pdf: pd.DataFrame, keep: int) -> pd.DataFrame:
    """``JOINTS`` of all cells below one, from its points."""
    pdf = pdf.sort_values("cell", kind="stable")
    block, cells = str(pdf["block"].iloc[0]), pdf["cell"].to_numpy()
    x, y, z = (pdf[c].to_numpy(np.float64) for c in "xyz")
    along = np.stack([x * d[0] + y * d[1] + z * d[2] for d in DIRECTIONS], axis=1)
    names = [f"p{f}" for f in pdf["fid"].tolist()]
    ends = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
    levels: dict[int, dict[str, list]] = {}
    for s, e in zip(ends, ends[1:]):
        levels.setdefault(len(cells[s]), {})[cells[s]] = [(names[s:e], along[s:e], along[s:e])]
    made, d = [], max(levels)
    while True:
        for cell, given in levels.pop(d, {}).items():
            own, up = _joined(cell, sum((g[0] for g in given), []), *(np.concatenate([g[k] for g in given]) for k in (1, 2)), keep if d else 1)
            made.append((cell, *own))
            if cell == block:
                return _joints(made, block, up)
            levels.setdefault(d - 1, {}).setdefault(cell[:-1], []).append(up)
        d -= 1


def _settled(pdf: pd.DataFrame, scale: float) -> pd.DataFrame:
    """``NODES`` from the joints of one cell, or of all below one, and the parents handed to some of them.

    A row whose ``first`` is null is handed: ``name`` is the joint, ``second`` its parent so far and
    ``of`` that one's radius.
    """
    made, given = pdf[pdf["first"].notna()], pdf[pdf["first"].isna()]
    joints = dict(zip(made["name"], zip(*(made[c].tolist() for c in ("first", "second", "x", "y", "z", "radius")), strict=True), strict=True))
    todo = [(n, None if p is None or p != p else p, of) for n, p, of in zip(given["name"], given["second"], given["of"], strict=True)]
    rows = []
    while todo:
        name, parent, of = todo.pop()
        first, second, x, y, z, radius = joints[name]
        if parent is None or radius < of / scale:
            rows.append(("", name, parent, None, x, y, z, radius, False))
            parent, of = name, radius
        for child in (first, second):
            if child in joints:
                todo.append((child, parent, of))
            else:  # a joint of a deeper cell, or a leaf
                rows.append((child.split(":")[0] if ":" in child else "", child, parent, of, None, None, None, None, ":" in child))
    return pd.DataFrame(rows, columns=["cell", "node", "parent", "of", "x", "y", "z", "radius", "handed"])


def bounding_hierarchy(points: DataFrame, scale: float = 2.0, leaf: int = LEAF, keep: int = KEEP, deepest: int = 40, block: int = TASK_POINTS) -> DataFrame:
    """(node, parent, fid, x, y, z, radius): spheres; a leaf has its point's ``fid``, the root no parent."""
    cells = staged(median_cells(points, leaf, deepest, max(block, HALVED_POINTS)), "median-cells")
    last, n = cells.agg(F.max(F.length("cell")), F.count("*")).first()
    if last is None:
        return cells.limit(0).select(F.col("cell").alias("node"), F.col("cell").alias("parent"), "fid", "x", "y", "z", F.col("x").alias("radius"))
    # Cells of a depth are of one size, but for one point.
    top = min(last, math.ceil(math.log2(max(1.0, n / block))))
    head = lambda d: F.substring("cell", 1, d)
    spread = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = cells.select("fid", "x", "y", "z", "cell", head(top).alias("block")).repartition(max(spread, min(2**top, 4096)), "block")
    blocks = staged(blocks.groupBy("block").applyInPandas(lambda pdf: _joined_block(pdf, keep), JOINTS), "joints")
    joints, below = [], blocks
    for d in range(top - 1, -1, -1):
        # Those of cells of this depth that are leaves stay with the blocks.
        rows = blocks.where(f"up and length(cell) = {d + 1}") if d < top - 1 else blocks.limit(0)
        rows = rows.unionByName(below.where(f"up and length(cell) = {d + 1}")).select(head(d).alias("cell"), "name", "lo", "hi")
        below = staged(rows.groupBy("cell").applyInPandas(_joined_to(keep if d else 1), JOINTS), "joints")
        joints.append(below)
    joints.reverse()
    tops = below.where("up").select("cell", "name", F.lit(None).cast("string").alias("second"), F.lit(None).cast("double").alias("of"))
    # The root may be a joint of its own cell, of a deeper one, or a single leaf.
    home = F.when(F.col("name").contains(":"), F.split("name", ":")[0]).otherwise("")
    handed, found = tops.withColumn("cell", home), None
    leaf_rows = tops.where(~F.col("name").contains(":")).select(F.col("name").alias("node"), F.col("second").alias("parent"))
    ball = ["x", "y", "z", "radius"]
    for d in range(top + 1):
        own = blocks.where("not up").where(F.length("cell") >= d if d == top else F.length("cell") == d)
        own = own.unionByName(joints[d].where("not up")) if d < top else own
        own = own.select("cell", "name", "first", "second", *ball, F.lit(None).cast("double").alias("of"))
        here = handed.where((F.length("cell") >= d if d == top else F.length("cell") == d) & F.col("name").contains(":"))
        here = here.select("cell", "name", F.lit(None).cast("string").alias("first"), "second", *(F.lit(None).cast("double").alias(c) for c in ball), "of")
        both = own.unionByName(here).withColumn("cell", head(d))
        both = both.repartition(max(spread, min(2**top, 4096)), "cell") if d == top else both
        out = staged(both.groupBy("cell").applyInPandas(lambda pdf: _settled(pdf, scale), NODES), "nodes")
        handed = handed.unionByName(out.where("handed").select("cell", F.col("node").alias("name"), F.col("parent").alias("second"), "of"))
        found = out if found is None else found.unionByName(out)
    inner = found.where("not handed and radius is not null").select("node", "parent", F.lit(None).cast("long").alias("fid"), "x", "y", "z", "radius")
    leaf_rows = leaf_rows.unionByName(found.where("not handed and radius is null").select("node", "parent"))
    at = cells.select(F.concat(F.lit("p"), F.col("fid").cast("string")).alias("node"), "fid", "x", "y", "z")
    return inner.unionByName(leaf_rows.join(at, "node").select("node", "parent", "fid", "x", "y", "z", F.lit(0.0).alias("radius")))
