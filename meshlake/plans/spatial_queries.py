"""Queries of envelopes and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import envelopes as env
from ..operators import hierarchy, pages, trees
from .inputs import BOXES, PTS, TREE, boxes, points, table, tree
from .registry import query


@query("with " + PTS + 'select grp, min(lon) as "left", max(lon) as "right", min(lat) as bottom, max(lat) as top, min(h) as front, max(h) as back from pts group by grp')
def planar_envelope(spark, sf):
    return env.planar_envelope(points(spark, sf), ["grp"])


#: Clusters at several places of the globe: around the meridians 0 and 180, and spread.
_CLUSTERED = """, c as (select fid % 6 as grp, lat, h, case fid % 6 when 0 then lon / 10 when 1 then case when lon < 0 then -180 - lon / 20 else 180 - lon / 20 end when 2 then lon
   when 3 then lon / 4 + 60 when 4 then (fid * 31 % 3) * 100 - 130 + lon / 40 else -180.0::double end as lon from pts)"""


def _clustered(spark, sf):
    k, lon = F.col("fid") % 6, F.col("lon")
    x = F.when(k == 0, lon / 10).when(k == 1, F.when(lon < 0, -180 - lon / 20).otherwise(180 - lon / 20)).when(k == 2, lon).when(k == 3, lon / 4 + 60)
    x = x.when(k == 4, (F.col("fid") * 31 % 3) * 100 - 130 + lon / 40).otherwise(-180.0)
    return points(spark, sf).select(k.alias("grp"), x.alias("lon"), "lat", "h")


@query("with " + PTS + _CLUSTERED + """, a as (select grp, min(lon) lo, max(lon) hi, coalesce(min(lon) filter (where lon >= 0), 180) pos, coalesce(max(lon) filter (where lon < 0), -180) neg,
   bool_or(lon <> 0 and lon <> -180) inn, min(lat) bottom, max(lat) top, min(h) front, max(h) back from c group by grp),
d as (select distinct grp, lon from c union select grp, 180 from a where lo = -180 and hi <> 180),
g as (select grp, lon as w, lag(lon) over (partition by grp order by lon) as e from d),
m as (select grp, max(w - e) as d from g group by grp), b as (select g.grp, min(g.w) as w, any_value(m.d) as d from g join m on g.grp = m.grp and g.w - g.e = m.d group by g.grp),
b2 as (select b.grp, b.w, g.e, b.d from b join g on b.grp = g.grp and b.w = g.w),
r as (select a.*, case when hi <= lo + 180 then case when lo = -180 and hi = 0 and not inn then 0 when hi = -180 then 180 else lo end
   when pos >= neg + 180 then case when neg <> -180 and pos = 180 then -180 else pos end
   else case when lo - (case when lo = -180 and hi <> 180 then 180 else hi end) + 360 >= d then lo else case when w = 180 then -180 else w end end end as "left",
  case when hi <= lo + 180 then case when lo = -180 and hi = 0 and not inn then 180 when hi = -180 then 180 else hi end
   when pos >= neg + 180 then case when neg = -180 then 180 else neg end
   else case when lo - (case when lo = -180 and hi <> 180 then 180 else hi end) + 360 >= d then (case when lo = -180 and hi <> 180 then 180 else hi end) else case when e = -180 then 180 else e end end end as "right" from a left join b2 using (grp))
select grp, round("left"::double, 9) as "left", round("right"::double, 9) as "right", bottom, top, front, back from r""")
def geo_envelope_points(spark, sf):
    out = env.geographic_envelope(_clustered(spark, sf), "grp")
    return out.withColumns({c: F.round(c, 9) for c in ("left", "right")})


@query("with " + PTS + _CLUSTERED + """, r as (select grp, lon as w, lon + 0.5 as e from c), x as (select *, max(e) over (partition by grp) - 360 as wrapped,
   max(e) over (partition by grp order by w, e desc rows between unbounded preceding and 1 preceding) as before from r),
g as (select grp, w, greatest(wrapped, coalesce(before, -1e9)) as cover from x), m as (select grp, max(w - cover) as d from g group by grp),
b as (select g.grp, min(w) as w, any_value(d) as d from g join m on g.grp = m.grp and w - cover = d group by g.grp), b2 as (select distinct b.grp, b.w, g.cover as e, d from b join g on b.grp = g.grp and b.w = g.w and g.w - g.cover = d)
select grp, round(case when d <= 0 then -180 when w = 180 then -180 else w end::double, 6) as w, round(case when d <= 0 then 180 when e > 180 then e - 360 when e <= -180 then case when e = -180 then 180 else e + 360 end else e end::double, 6) as e from b2""")
def geo_envelope_merge(spark, sf):
    """Half-degree ranges at the points; those that cross the 180th meridian wrap."""
    e = F.col("lon") + 0.5
    ranges = _clustered(spark, sf).select("grp", F.col("lon").alias("left"), F.when(e > 180, e - 360).otherwise(e).alias("right"))
    return env.merge_longitudes(ranges, "grp").select("grp", F.round("w", 6).alias("w"), F.round("e", 6).alias("e"))


@query("with " + BOXES + 'select id % 7 as grp, min("left") as "left", max("right") as "right", min(bottom) as bottom, max(top) as top, min(front) as front, max(back) as back from boxes group by 1')
def planar_envelope_merge(spark, sf):
    return env.merge_envelopes(boxes(spark, sf).withColumn("grp", F.col("id") % 7), "grp", geographic=False)


@query("with " + PTS + """, t as (select fid, lon as a, case when lon + h > 180 then lon + h - 360 else lon + h end as b, case when lon - h / 2 < -180 then lon - h / 2 + 360 else lon - h / 2 end as c from (select fid, lon, h / 10 as h from pts)),
s as (select fid, list_sort([a, b, c]) as l from t), g as (select fid, l, l[1] - l[3] + 360 as wrap, l[2] - l[1] as g1, l[3] - l[2] as g2 from s)
select fid, round(case when wrap >= g1 and wrap >= g2 then l[1] when g1 >= g2 then l[2] else l[3] end, 6) + 0.0 as "left", round(case when wrap >= g1 and wrap >= g2 then l[3] when g1 >= g2 then l[1] else l[2] end, 6) + 0.0 as "right" from g""")
def triangle_longitudes(spark, sf):
    p = points(spark, sf).withColumn("h", F.col("h") / 10)
    b, c = F.col("lon") + F.col("h"), F.col("lon") - F.col("h") / 2
    p = p.select("fid", F.col("lon").alias("a"), F.when(b > 180, b - 360).otherwise(b).alias("b"), F.when(c < -180, c + 360).otherwise(c).alias("c"))
    out = env.triangle_longitudes(p, "a", "b", "c")
    return out.select("fid", (F.round("left", 6) + 0.0).alias("left"), (F.round("right", 6) + 0.0).alias("right"))


@query("with " + BOXES + """select id, round(case when "left" - ("right" - "left") * 0.5 <= -180 then "left" - ("right" - "left") * 0.5 + 360 else "left" - ("right" - "left") * 0.5 end, 6) + 0.0 as "left",
  round(case when "left" - ("right" - "left") * 0.5 > -180 and "right" + ("right" - "left") * 0.5 > 180 then "right" + ("right" - "left") * 0.5 - 360 else "right" + ("right" - "left") * 0.5 end, 6) + 0.0 as "right",
  greatest(bottom - (top - bottom) * 0.5, -90.0::double) as bottom, least(top + (top - bottom) * 0.5, 90.0::double) as top from boxes""")
def inflate_boxes(spark, sf):
    out = env.inflate(boxes(spark, sf), 0.5)
    return out.select("id", (F.round("left", 6) + 0.0).alias("left"), (F.round("right", 6) + 0.0).alias("right"), "bottom", "top")


# ---------------------------------------------------------------- trees
_PATHS = TREE + """, w as (select t.node_id, t.depth, case t.depth when 0 then [0] when 1 then [0, t.ordinal] when 2 then [0, p.ordinal, t.ordinal] else [0, q.ordinal, p.ordinal, t.ordinal] end as path, t.parent_id
  from tree t left join tree p on t.parent_id = p.node_id left join tree q on p.parent_id = q.node_id), n as (select node_id, parent_id, depth, path, row_number() over (order by depth, path) - 1 as idx from w)"""


@query("with " + _PATHS + "select node_id, idx, cast(idx // 64 as bigint) as page_id, idx % 64 as slot from n")
def tree_bfs_pages(spark, sf):
    return trees.breadth_first_pages(tree(spark, sf), 64, 3).select("node_id", "idx", "page_id", "slot")


@query("with " + _PATHS + ", k as (select parent_id, count(*) as n_children, min(idx) as first_child from n group by 1) select n.idx, p.idx as parent_idx, first_child, coalesce(n_children, 0) as n_children from n left join n p on n.parent_id = p.node_id left join k on k.parent_id = n.node_id")
def tree_remap_links(spark, sf):
    return trees.remap_links(trees.breadth_first_pages(tree(spark, sf), 64, 3))


@query("with recursive " + TREE + ", up as (select node_id as leaf, node_id, parent_id from tree union all select u.leaf, t.node_id, t.parent_id from up u join tree t on u.parent_id = t.node_id) select node_id, count(*) as subtree_size from up group by 1")
def subtree_size(spark, sf):
    return trees.subtree_sizes(tree(spark, sf), 3)


@query("with recursive " + TREE + """, up as (select node_id as leaf, node_id, parent_id, depth from tree union all select u.leaf, t.node_id, t.parent_id, t.depth from up u join tree t on u.parent_id = t.node_id),
o as (select c_custkey + 1000001 as leaf, c_acctbal as bal, c_custkey % 360 - 180 as x from customer) select node_id, depth, min(bal) as low, max(bal) as high, cast(min(x) as bigint) as x_min, cast(max(x) as bigint) as x_max from up left join o using (leaf) group by 1, 2""")
def tree_rollup_box(spark, sf):
    x = F.col("c_custkey") % 360 - 180
    own = table(spark, sf, "customer").select((F.col("c_custkey") + 1_000_001).alias("node_id"), F.col("c_acctbal").alias("low"), F.col("c_acctbal").alias("high"), x.alias("x_min"), x.alias("x_max"))
    return trees.roll_up(tree(spark, sf), own, {"low": "min", "high": "max", "x_min": "min", "x_max": "max"}, 3).drop("parent_id")


@query("select 'missing parent' as code, c_custkey + 1000001 as node_id from customer where c_nationkey = 3")
def tree_checks(spark, sf):
    """One nation is taken out: its customers have lost their parent, and nothing else is wrong."""
    t = tree(spark, sf).where("node_id != 1004")
    return trees.tree_issues(t)


@query("select n_nationkey + 1001 as node_id from nation where n_nationkey not in (select c_nationkey from customer) union all select c_custkey + 1000001 from customer where c_custkey % 10 = 0")
def tree_empty_leaves(spark, sf):
    t = tree(spark, sf)
    return trees.empty_leaves(t, t.where("node_id % 10 != 1"))


@query("with " + _PATHS + """, leaf as (select * from n where node_id not in (select parent_id from n where parent_id is not null)), a as (select l.node_id, l.depth, p.idx // 64 as page from leaf l join n p on list_slice(l.path, 1, len(p.path)) = p.path),
c as (select node_id, depth, count(distinct page) as pages from a group by 1, 2) select round(avg(depth), 6) as avg_leaf_depth, round(avg(pages), 6) as avg_pages, count(*) as n_leaves from c""")
def tree_dive_statistics(spark, sf):
    out = trees.dive_statistics(trees.breadth_first_pages(tree(spark, sf), 64, 3))
    return out.select(F.round("avg_leaf_depth", 6).alias("avg_leaf_depth"), F.round("avg_pages", 6).alias("avg_pages"), "n_leaves")


# Regions come before nations and nations before customers if no node's priority exceeds its parent's: then the
# first page is the first 64 in the order of (depth, priority of the parent, last child first).
_PAGED = "with " + TREE + """, q as (select *, node_id * 7919 % 1009 + 2000 * (3 - depth) as priority from tree),
o as (select q.*, p.priority as above, p.ordinal as p_ordinal, g.ordinal as g_ordinal, row_number() over (order by q.depth, p.priority desc, q.ordinal desc) - 1 as first_slot from q left join q p on q.parent_id = p.node_id left join q g on p.parent_id = g.node_id),
top as (select node_id, 0 as page_id, first_slot as slot from o where first_slot < 64),
"""
_REMAINDER = """rest as (select o.node_id, row_number() over (order by g_ordinal, p_ordinal, ordinal) - 1 as i from o where node_id not in (select node_id from top) {and_not})
select node_id, 0::int as tree, page_id::bigint as page_id, slot::bigint as slot from top union all {more} select node_id, 0::int, ({pages} + i // 64)::bigint, (i % 64)::bigint from rest"""


def _prioritised(spark, sf):
    """The whole tree with a priority that falls from level to level, as radii do."""
    return tree(spark, sf).withColumns({"priority": (F.col("node_id") * 7919 % 1009 + 2000 * (3 - F.col("depth"))).cast("double"), "tree": F.lit(0)})


@query(_PAGED + _REMAINDER.format(and_not="", more="", pages=1))
def tree_local_pages(spark, sf):
    """Page and slot of every node: the root's page, then customers in post-order, all pages full but the last."""
    return pages.local_subtree_pages(_prioritised(spark, sf), "tree", "priority", 64)


@query(_PAGED + """kid as (select o.node_id, o.parent_id, above, row_number() over (partition by o.parent_id order by ordinal) - 1 as up, count(*) over (partition by o.parent_id) as n from o where depth = 3 and node_id not in (select node_id from top)),
cut as (select *, n - 1 - up as down, n // 64 as whole from kid),
dealt as (select *, case when up // 64 < (whole + 1) // 2 then 2 * (up // 64) when down // 64 < whole // 2 then 2 * (down // 64) + 1 end as wave, case when up // 64 < (whole + 1) // 2 then up % 64 else down % 64 end as slot from cut),
start as (select wave, parent_id, row_number() over (order by wave, any_value(above) desc) as page_id from dealt where wave is not null group by wave, parent_id),
""" + _REMAINDER.format(and_not="and node_id not in (select node_id from dealt where wave is not null)", more="select node_id, 0::int, page_id::bigint, slot::bigint from dealt join start using (wave, parent_id) union all", pages="(select 1 + count(*) from start)"))
def tree_sibling_pages(spark, sf):
    """Page and slot of every node where all customers that are left of a nation start pages together."""
    return pages.local_subtree_pages(_prioritised(spark, sf), "tree", "priority", 64, None)


@query("with recursive " + TREE + """, w as (select node_id, parent_id, depth, ordinal, [ordinal] as path from tree where depth = 0 union all select t.node_id, t.parent_id, t.depth, t.ordinal, list_append(w.path, t.ordinal) from w join tree t on t.parent_id = w.node_id),
up as (select node_id as leaf, node_id, parent_id from tree union all select u.leaf, t.node_id, t.parent_id from up u join tree t on u.parent_id = t.node_id),
size as (select node_id, count(*) as size from up group by 1),
leaves as (select node_id, row_number() over (order by path) - 1 as pre from w)
select w.node_id, size, (count(*) over (partition by w.parent_id) - row_number() over (partition by w.parent_id order by ordinal))::bigint as behind, (pre + size - 1 - depth)::bigint as post from w join size using (node_id) join leaves using (node_id)""")
def tree_post_order(spark, sf):
    """A node's place in pre-order, the size of its subtree and its depth give its place in post-order."""
    return pages.post_order(_prioritised(spark, sf), "tree").select("node_id", "size", "behind", "post")


@query("with " + TREE + ", l as (select parent_id as node_id, case when node_id % 3 = 0 then -1 else node_id end as child_id from tree where parent_id is not null) select node_id, child_id from l where child_id <> -1")
def tree_valid_children(spark, sf):
    child = F.when(F.col("node_id") % 3 == 0, F.lit(-1).cast("long")).otherwise(F.col("node_id"))
    return trees.valid_children(tree(spark, sf).where("parent_id is not null").select(F.col("parent_id").alias("node_id"), child.alias("child_id")))


@query("with " + TREE + """, t as (select * from tree union all select 5000000, null, 1, 0 union all select c_custkey + 1000001, 1001, c_custkey, 3 from customer where c_custkey % 50 = 7)
select 'root' as code, node_id from t where parent_id is null union all select 'shared child', node_id from t group by node_id having count(distinct parent_id) > 1
union all select 'missing parent', node_id from t where parent_id is not null and parent_id not in (select node_id from t)""")
def tree_checks_all(spark, sf):
    """A second root, and customers that a second nation claims."""
    t = tree(spark, sf)
    root = t.where("depth = 0").select(F.lit(5_000_000).cast("long").alias("node_id"), "parent_id", F.lit(1).cast("long").alias("ordinal"), "depth")
    again = t.where("depth = 3 and (node_id - 1000001) % 50 = 7").withColumn("parent_id", F.lit(1001).cast("long"))
    return trees.tree_issues(t.unionByName(root).unionByName(again))


@query("with " + PTS + """, l3 as (select distinct floor((lon + 180) / 45.1)::bigint as i, floor((lat + 90) / 22.6)::bigint as j from pts), l2 as (select i // 2 as i, j // 2 as j, count(*) as n from l3 group by 1, 2),
l1 as (select i // 2 as i, j // 2 as j, count(*) as n from l2 group by 1, 2), l0 as (select i // 2 as i, j // 2 as j, count(*) as n from l1 group by 1, 2)
select 3 as level, i, j, 0::bigint as n_children, 2 as p_level, i // 2 as p_i, j // 2 as p_j from l3 union all select 2, i, j, n, 1, i // 2, j // 2 from l2 union all select 1, i, j, n, 0, i // 2, j // 2 from l1 union all select 0, i, j, n, null, null, null from l0""")
def tile_tree(spark, sf):
    """Tiles that hold a point, and the coarser ones above them."""
    p = points(spark, sf)
    tiles = p.select(F.floor((F.col("lon") + 180) / 45.1).alias("i"), F.floor((F.col("lat") + 90) / 22.6).alias("j"))
    return trees.tile_tree(tiles, 4)


def _median_sql(levels: int) -> str:
    """Cells of ``levels`` levels of splits at the median of the widest axis."""
    out = "c0 as (select fid, lon as x, lat as y, h as z, '' as cell from pts)"
    for k in range(levels):
        out += f""", w{k} as (select cell, count(*) as n, max(x) - min(x) as wx, max(y) - min(y) as wy, max(z) - min(z) as wz from c{k} group by 1),
a{k} as (select c.*, n, case when wx >= wy and wx >= wz then x when wy >= wz then y else z end as along from c{k} c join w{k} using (cell)),
r{k} as (select *, row_number() over (partition by cell order by along, fid) as k from a{k}),
c{k + 1} as (select fid, x, y, z, case when n <= 64 then cell || '.' when k <= n // 2 then cell || '0' else cell || '1' end as cell from r{k} where not contains(cell, '.') union all select fid, x, y, z, cell from r{k} where contains(cell, '.'))"""
    return out


@query("with " + PTS + ", " + _median_sql(4) + ", f as (select fid, replace(cell, '.', '') as cell from c4) select fid, cell, count(*) over (partition by cell) as n from f")
def median_cells(spark, sf):
    """Four levels of the hierarchy over all points."""
    p = points(spark, sf).select("fid", F.col("lon").alias("x"), F.col("lat").alias("y"), F.col("h").alias("z"))
    return trees.median_cells(p, 64, 4).select("fid", "cell", "n")


@query()
def bounding_hierarchy(spark, sf):
    """Spheres over all points, joined from the leaves up; a plain recursion is its test."""
    p = points(spark, sf).select("fid", F.col("lon").alias("x"), F.col("lat").alias("y"), F.col("h").alias("z"))
    return hierarchy.bounding_hierarchy(p)
