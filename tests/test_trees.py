"""Pages that keep subtrees together, and post-order numbers, against plain walks over random trees."""

from __future__ import annotations

import random
from collections import deque

import pytest

from meshlake.operators import pages, trees

TREE = "node_id long, parent_id long, ordinal long, depth int, tree int, priority double"


def random_trees(rng, n, trees_=3, roots=1, chain=0.0, kinds=12):
    rows = []
    for tree in range(trees_):
        ids, depth = [], {}
        for k in range(n):
            node = tree * 100_000 + k
            parent = None if k < roots else ids[-1] if rng.random() < chain else rng.choice(ids[: 1 + int(len(ids) * rng.random() ** 2)])
            depth[node] = 0 if parent is None else depth[parent] + 1
            rows.append((node, parent, rng.randrange(5), depth[node], tree, float(rng.randrange(kinds))))
            ids.append(node)
    return rows


def families(rows):
    kids = {}
    for node, parent, ordinal, *_ in rows:
        kids.setdefault(parent, []).append((ordinal, node))
    return {p: [n for _, n in sorted(k)] for p, k in kids.items()}


def walk(kids, node):
    for k in kids.get(node, ()):
        yield from walk(kids, k)
    yield node


def plain_pages(rows, page, siblings):
    """node -> (page, slot), one page after another."""
    out = {}
    for tree in {r[4] for r in rows}:
        own = [r for r in rows if r[4] == tree]
        kids, priority = families(own), {r[0]: r[5] for r in own}
        size = {r[0]: sum(1 for _ in walk(kids, r[0])) for r in own}
        full = min(page, len(own))
        starts, number = deque([root] for root in kids.get(None, [])), 0
        while starts:
            start = starts.popleft()
            if sum(size[n] for n in start) < full:
                continue
            open_ = [(float("inf"), 0, start)]  # each family's last member is the next
            for slot in range(full):
                open_ = sorted((f for f in open_ if f[2]), key=lambda f: f[:2])
                if not open_:
                    break
                node = open_[-1][2].pop()
                out[node] = (number, slot)
                if kids.get(node):
                    open_.append((priority[node], slot + 1, list(kids[node])))
            number += 1
            for *_, left in sorted(open_, key=lambda f: f[:2], reverse=True):
                while left:
                    k = min(siblings or len(left), len(left))
                    starts.append(left[: -k - 1 : -1])
                    left = left[:-k]
        rest = [n for root in kids.get(None, []) for n in walk(kids, root) if n not in out]
        out |= {n: (number + i // page, i % page) for i, n in enumerate(rest)}
    return out


@pytest.mark.parametrize("page,siblings,roots,chain", [(4, 1, 1, 0.1), (8, None, 3, 0.0), (4, 9, 1, 0.0), (200, 1, 1, 0.0)])
def test_local_subtree_pages(spark, page, siblings, roots, chain):
    rng = random.Random(page * 31 + (siblings or 0))
    rows = random_trees(rng, 80, roots=roots, chain=chain)
    # One family much larger than a page, of leaves and of small subtrees.
    rows += [(900_000 + i, 0, 7, 1, 0, 1.0) for i in range(70)] + [(950_000 + i, 900_000 + i // 3, i % 3, 2, 0, 2.0) for i in range(60)]
    df = spark.createDataFrame(rows, TREE).repartition(5)
    got = {r.node_id: (r.page_id, r.slot) for r in pages.local_subtree_pages(df, "tree", "priority", page, siblings).collect()}
    assert got == plain_pages(rows, page, siblings)
    if roots == 1:  # all pages but the last of each tree are full
        for tree in range(3):
            sizes = {}
            for n, (p, _) in got.items():
                if {r[0]: r[4] for r in rows}[n] == tree:
                    sizes[p] = sizes.get(p, 0) + 1
            assert all(sizes[p] == page for p in range(max(sizes)))


def test_post_order(spark):
    rows = random_trees(random.Random(5), 200, roots=3)
    kids = families(rows)
    got = {r.node_id: r for r in pages.post_order(spark.createDataFrame(rows, TREE), "tree").collect()}
    for tree in range(3):
        want = [n for root in kids[None] if root // 100_000 == tree for n in walk(kids, root)]
        assert [got[n].post for n in want] == list(range(200))
    assert all(got[n].size == sum(1 for _ in walk(kids, n)) for n in got)
    assert all(got[n].behind == len(k) - 1 - i for p, k in kids.items() if p is not None for i, n in enumerate(k))


def test_pages_of_nothing(spark):
    df = spark.createDataFrame([], TREE)
    assert pages.local_subtree_pages(df, "tree", "priority").count() == 0
    assert pages.post_order(df, "tree").count() == 0


def test_page_builders(spark):
    rows = [(0, None, 0, 0, 1.0)] + [(i, (i - 1) // 3, i, 0, float(i % 5)) for i in range(1, 40)]
    depth = {0: 0}
    for n, parent, *_ in rows[1:]:
        depth[n] = depth[parent] + 1
    df = spark.createDataFrame([(n, p, o, depth[n], w) for n, p, o, _, w in rows], "node_id long, parent_id long, ordinal long, depth int, priority double")
    said = []
    for strategy in (*pages.PAGE_BUILDERS, lambda t, page: t.select("node_id", (t.node_id / page).cast("long").alias("page_id"), (t.node_id % page).alias("slot"))):
        got = pages.build_pages(df, strategy, 8, lambda *what: said.append(what)).collect()
        assert {r.node_id for r in got} == set(range(40)) and len({(r.page_id, r.slot) for r in got}) == 40 and max(r.slot for r in got) < 8
    assert [s[0] for s in said] == ["start", "pages"] * 4
    assert trees.depth_of(df) == 3
