"""Pages of nodes: breadth first, or full pages that keep subtrees and siblings together.

Pages by locality are built in two steps, one tree per value of a column or all trees at once.

1. From the top, by waves. A start is a node, or up to ``siblings`` neighbouring children of one
   node, whose subtrees together fill a page. Its page takes the start, then always the last child
   that is left of the pending family whose parent has the largest priority (of equal ones the family
   that became pending last). The families that are left give the starts of the next wave.
2. What is in no page then lies in subtrees smaller than a page. These nodes fill pages in post-order,
   across subtrees, so that of each tree only the last page has free slots.

A page is at most ``page`` nodes and looks at ``page`` children of each of them: that is the bounded
group in which Python walks. Everything that grows with the tree is a join, an aggregate or a range
shuffle; a family of any size is cut into pages at once, not one page a wave.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import numbered, running_totals, small_side, staged
from .trees import PAGE, breadth_first_pages, subtree_sizes

#: A page's way through its tree: pages of one wave are in the order of these.
PATH = "array<struct<family:long,part:long,later:long>>"
KNOWN = "pid long, node_id long, parent long, place long, priority double, n_children long, asked boolean"
STEP = KNOWN + ", slot long, family long, taken long, fresh boolean, more boolean"


def post_order(tree: DataFrame, root_of: str) -> DataFrame:
    """(node_id, parent_id, root_of, size, behind, post) of a forest, one tree or more per ``root_of``.

    ``post`` numbers the nodes of each ``root_of`` so that each comes after its children, ``behind``
    counts the siblings after a node, and a parent that isn't in the table is null. A subtree is a
    stretch of ``size`` numbers, which begins where those of the earlier siblings end: sums over
    siblings, carried from the roots down, number all nodes without a walk. Siblings are in the order
    of (ordinal, node_id), and there may be any number of them.
    """
    there = tree.select(F.col("node_id").alias("parent_id"), F.lit(True).alias("there"))
    sizes = subtree_sizes(tree).withColumnRenamed("subtree_size", "size")
    nodes = tree.select("node_id", "parent_id", root_of, "ordinal", "depth").join(there, "parent_id", "left").join(sizes, "node_id")
    nodes = nodes.withColumns({"parent_id": F.when(F.col("there"), F.col("parent_id")), "one": F.lit(1).cast("long")}).drop("there")
    nodes = running_totals(nodes, [root_of, "parent_id", "ordinal", "node_id"], {"ahead": "size", "rank": "one"}).drop("one")
    family = nodes.groupBy(F.col(root_of).alias("_under"), F.col("parent_id").alias("_of")).agg(F.min("ahead").alias("_ahead"), F.max("rank").alias("_last"))
    met = nodes.join(family, F.col(root_of).eqNullSafe(F.col("_under")) & F.col("parent_id").eqNullSafe(F.col("_of")))
    own = staged(met.select("node_id", "parent_id", root_of, "depth", "size", (F.col("_last") - F.col("rank")).alias("behind"), (F.col("ahead") - F.col("_ahead")).alias("ahead")), "families")
    first, last = own.agg(F.min("depth"), F.max("depth")).first()
    out, above = own.limit(0).withColumn("begin", F.lit(0).cast("long")), None
    for d in range(first, last + 1) if first is not None else ():
        level = own.where(F.col("depth") == d)
        if above is None:
            level = level.withColumn("begin", F.col("ahead"))
        else:
            level = level.join(above, "parent_id", "left").withColumn("begin", F.col("ahead") + F.coalesce("top", F.lit(0))).drop("top")
        level = staged(level, "post-order")
        above = level.select(F.col("node_id").alias("parent_id"), F.col("begin").alias("top"))
        out = out.unionByName(level)
    return out.select("node_id", "parent_id", root_of, "size", "behind", (F.col("begin") + F.col("size") - 1).alias("post"))


def fill_page(known: pd.DataFrame, page: int) -> pd.DataFrame:
    """A page as far as the known children show it.

    Where a node on the page has children that aren't known yet, the walk goes on as if it had
    none, and all these nodes are marked ``asked``; ``more`` says that the page isn't final. On a
    final page each node has its slot, the number of its children on the page (``taken``) and, if it has
    more, the rank of its ``family`` among those that are left.
    """
    known = known.drop_duplicates("node_id")
    ids = known["node_id"].tolist()
    info = dict(zip(ids, zip(known["priority"], known["n_children"], known["asked"], strict=True), strict=True))
    kids: dict = {}
    parents = [None if pd.isna(x) else int(x) for x in known["parent"]]
    for _, parent, node in sorted(zip((-known["place"]).tolist(), parents, ids, strict=True), key=lambda x: x[0]):
        kids.setdefault(parent, []).append(node)  # the last of a list is the first to go
    heap = [(float("-inf"), 0, None, kids[None])]
    slot, taken, asks, pushed = {}, {}, set(), 0
    while heap and len(slot) < page:
        _, _, parent, left = heap[0]
        if not left:
            heapq.heappop(heap)
            continue
        node = left.pop()
        slot[node] = len(slot)
        taken[parent] = taken.get(parent, 0) + 1
        priority, n_children, asked = info[node]
        if n_children and asked:
            pushed += 1
            heapq.heappush(heap, (-priority, -pushed, node, kids.get(node, [])))
        elif n_children:
            asks.add(node)
    left = [f[2] for f in sorted(heap, key=lambda f: f[:2]) if f[2] is not None and taken.get(f[2], 0) < info[f[2]][1]]
    family = {node: i + 1 for i, node in enumerate(left)}
    out = known.copy()
    out["asked"] = out["asked"] | out["node_id"].isin(asks)
    out["slot"] = pd.array([None if asks else slot.get(n) for n in ids], "Int64")
    out["family"] = pd.array([None if asks else family.get(n) for n in ids], "Int64")
    out["taken"] = pd.array([taken.get(n, 0) for n in ids], "Int64")
    out["fresh"] = out["node_id"].isin(asks)
    out["more"] = bool(asks)
    return out


def _pages_of(starts: DataFrame, nodes: DataFrame, near: DataFrame, page: int) -> DataFrame:
    """(pid, node_id, slot, family, taken, n_children) of pages that begin with ``starts``, (pid, node_id, place)."""
    known = starts.join(nodes.select("node_id", "priority", "n_children"), "node_id")
    known = known.select("pid", "node_id", F.lit(None).cast("long").alias("parent"), "place", "priority", "n_children", F.lit(False).alias("asked"))
    done = None
    while True:
        out = staged(known.groupBy("pid").applyInPandas(lambda pdf: fill_page(pdf, page), STEP), "page-steps")
        final = out.where("not more and slot is not null").select("pid", "node_id", "slot", "family", "taken", "n_children")
        done = final if done is None else done.unionByName(final)
        asking = out.where("more")
        fresh = asking.where("fresh").select("pid", F.col("node_id").alias("parent"))
        if not fresh.limit(1).count():
            return done
        below = small_side(fresh).join(near, "parent").select("pid", "node_id", "parent", "place", "priority", "n_children", F.lit(False).alias("asked"))
        known = asking.select(*below.columns).unionByName(below)


def _dealt(left: DataFrame, siblings: int | None, page: int) -> DataFrame:
    """Adds ``part``, ``later`` and ``place`` to the children that are ``left`` of families.

    A family is cut into parts of ``siblings`` from its last child on. A part gives its first
    children to its first page, its last ones to the next wave's page, and so on by turns, always from
    the end inwards, until less than a page is left.
    """
    i = F.col("behind") - F.col("taken")
    part = F.lit(0).cast("long") if siblings is None else F.floor(i / siblings)
    n = F.col("left") if siblings is None else F.least(F.lit(siblings), F.col("left") - part * siblings)
    left = left.withColumns({"part": part, "_n": n}).withColumn("_up", F.col("_n") - 1 - (i if siblings is None else i % siblings))
    down, pages = F.col("_n") - 1 - F.col("_up"), F.floor(F.col("_n") / page)
    low, high = F.floor((pages + 1) / 2), F.floor(pages / 2)
    from_low, from_high = F.floor(F.col("_up") / page) < low, F.floor(down / page) < high
    later = F.when(from_low, 2 * F.floor(F.col("_up") / page)).when(from_high, 2 * F.floor(down / page) + 1).otherwise(pages)
    place = F.when(from_low, F.col("_up") % page).when(from_high, down % page).when(pages % 2 == 0, F.col("_up") - low * page).otherwise(down - high * page)
    return left.withColumns({"later": later, "place": place}).drop("_n", "_up")


def local_subtree_pages(tree: DataFrame, root_of: str, priority: str, page: int = PAGE, siblings: int | None = 1) -> DataFrame:
    """(node_id, root_of, page_id, slot): full pages numbered within each ``root_of``; see the module.

    ``siblings`` is how many children of one node may start a page together; None: all that are left.
    """
    order = post_order(tree, root_of)
    n_children = order.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n_children"))
    rank = tree.select("node_id", F.col(priority).cast("double").alias("priority"))
    nodes = staged(order.join(rank, "node_id").join(n_children, "node_id", "left").fillna(0, ["n_children"]), "page-tree")
    near = nodes.where((F.col("parent_id").isNotNull()) & (F.col("behind") < page)).select(F.col("parent_id").alias("parent"), "node_id", F.col("behind").alias("place"), "priority", "n_children")
    counts = nodes.groupBy(root_of).agg(F.count("*").alias("n"))

    roots = nodes.where("parent_id is null").join(counts, root_of).where(F.col("size") >= F.least(F.col("n"), F.lit(page)))
    step = F.struct(F.lit(0).cast("long").alias("family"), F.col("post").alias("part"), F.lit(0).cast("long").alias("later"))
    starts = roots.select(root_of, F.lit(0).cast("long").alias("wave"), F.array(step).cast(PATH).alias("path"), "node_id", F.lit(0).cast("long").alias("place"), F.monotonically_increasing_id().alias("pid"))
    pages, placed = None, None
    while True:
        starts = staged(starts, "page-starts")
        if not starts.limit(1).count():
            break
        heads = starts.groupBy("pid").agg(F.first(root_of).alias(root_of), F.first("wave").alias("wave"), F.first("path").alias("path"))
        pages = heads if pages is None else pages.unionByName(heads)
        own = staged(_pages_of(starts.select("pid", "node_id", "place"), nodes, near, page), "page-slots")
        placed = own if placed is None else placed.unionByName(own)
        # Children that their page has no room for, in parts of a page's size, as starts of the next waves.
        able = nodes.where(F.col("size") >= page) if siblings == 1 else nodes
        left = own.where("family is not null").select(F.col("node_id").alias("parent_id"), F.col("pid").alias("from"), "family", "taken", (F.col("n_children") - F.col("taken")).alias("left"))
        left = _dealt(left.join(able.drop("n_children"), "parent_id").where(F.col("behind") >= F.col("taken")), siblings, page)
        key = ["from", "family", "part", "later"]
        full = left.groupBy(*key).agg(F.sum("size").alias("total")).where(F.col("total") >= page)
        full = full.join(heads.select(F.col("pid").alias("from"), root_of, "wave", "path"), "from")
        step = F.struct("family", "part", (-F.col("later")).alias("later"))
        full = staged(full.select(*key, root_of, (F.col("wave") + 1 + F.col("later")).alias("wave"), F.array_append("path", step).cast(PATH).alias("path"), F.monotonically_increasing_id().alias("low")), "page-parts")
        base = pages.agg(F.max("pid")).first()[0] + 1
        starts = left.select(*key, "node_id", "place").join(full, key).select(root_of, "wave", "path", "node_id", "place", (F.col("low") + base).alias("pid"))

    if pages is None:
        ids = nodes.limit(0).select(root_of, F.lit(0).cast("long").alias("pid"), F.lit(0).cast("long").alias("page_id"))
        placed = nodes.limit(0).select("node_id", F.lit(0).cast("long").alias("pid"), F.lit(0).cast("long").alias("slot"))
    else:
        ids = staged(_from_zero(numbered(pages, [root_of, "wave", "path"]), root_of).select(root_of, "pid", F.col("number").alias("page_id")), "page-numbers")
    top = placed.join(ids, "pid").select("node_id", root_of, "page_id", "slot")
    rest = nodes.join(placed.select("node_id"), "node_id", "left_anti").select("node_id", root_of, "post")
    rest = _from_zero(numbered(rest, [root_of, "post"]), root_of).join(ids.groupBy(root_of).agg(F.count("*").alias("before")), root_of, "left")
    rest = rest.select("node_id", root_of, (F.coalesce("before", F.lit(0)) + F.floor(F.col("number") / page)).alias("page_id"), (F.col("number") % page).alias("slot"))
    return top.unionByName(rest)


def _from_zero(rows: DataFrame, by: str) -> DataFrame:
    """``number`` from 0 in each group of neighbours ``by``."""
    first = rows.groupBy(by).agg(F.min("number").alias("_first"))
    return rows.join(first, by).withColumn("number", F.col("number") - F.col("_first")).drop("_first")


def _local(siblings: int | None):
    return lambda tree, page: local_subtree_pages(tree.withColumn("_tree", F.lit(0)), "_tree", "priority", page, siblings).drop("_tree")


#: Ways to deal nodes into pages: a function of (tree, page) that gives (node_id, page_id, slot).
PAGE_BUILDERS = {
    "breadth_first": lambda tree, page: breadth_first_pages(tree, page).select("node_id", F.col("page_id").cast("long").alias("page_id"), F.col("slot").cast("long").alias("slot")),
    "local_subtree": _local(1),
    "local_subtree_all_siblings": _local(None),
}


def build_pages(tree: DataFrame, strategy: str, page: int = PAGE, progress=None) -> DataFrame:
    """Pages by one of ``PAGE_BUILDERS``, or by a builder of the caller's with the same signature.

    ``progress`` is called with the strategy before and with the number of pages after.
    """
    builder = PAGE_BUILDERS[strategy] if isinstance(strategy, str) else strategy
    if progress is None:
        return builder(tree, page)
    progress("start", strategy)
    out = staged(builder(tree, page), "pages")
    progress("pages", out.agg(F.max("page_id")).first()[0])
    return out
