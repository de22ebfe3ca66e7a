"""Queries of documents, the archive's index, splits, and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as doc
from ..operators import envelopes, hulls, trees
from ..operators.staging import shared_folder
from ..sources.tables import table_stream
from ..streaming import windows
from .inputs import PTS, points, table, tree
from .registry import query
from .spatial_queries import _PATHS


@query("""select l_orderkey, l_linenumber, coalesce(nullif(l_linenumber, 1), -2147483648)::integer as i32, coalesce(nullif(l_suppkey, 7), (-9223372036854775808)::bigint) as i64,
  coalesce(nullif(l_linenumber, 2), 255)::smallint as u8, l_quantity = 1 as f64_unset, nullif(l_returnflag, 'R') as s from lineitem""")
def attribute_null_sentinel(spark, sf):
    f64 = doc.with_sentinel(F.nullif(F.col("l_quantity"), F.lit(1.0)), "float64")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", doc.with_sentinel(F.nullif(F.col("l_linenumber"), F.lit(1)), "int32").alias("i32"), doc.with_sentinel(F.nullif(F.col("l_suppkey"), F.lit(7)), "int64").alias("i64"),
        doc.with_sentinel(F.nullif(F.col("l_linenumber"), F.lit(2)), "uint8").alias("u8"), F.isnan(f64).alias("f64_unset"), doc.with_sentinel(F.nullif(F.col("l_returnflag"), F.lit("R")), "string").alias("s"))


@query("select event_id, 'k' as key, json_extract_string(props, '$.k')::integer as value from events")
def key_value_map(spark, sf):
    return table(spark, sf, "events").select("event_id", F.explode(F.from_json("props", "map<string,int>")).alias("key", "value"))


@query("""select event_id, case when event_id % 10 > 1 then json_extract_string(props, '$.k')::integer end as k,
  case event_id % 10 when 0 then 'malformed' when 1 then 'missing' end as issue from events""")
def document_issues(spark, sf):
    """Every tenth text is cut off, and another tenth lacks the field."""
    i = F.col("event_id") % 10
    texts = table(spark, sf, "events").select("event_id", F.when(i == 0, F.substring("props", 1, 3)).when(i == 1, F.lit("{}")).otherwise(F.col("props")).alias("text"))
    return doc.read_documents(texts, "text", {"k": "int"}).drop("text")


@query("with f as (select event_id, event_id * 1234567891011 as fid from events) select event_id, fid & 4294967295 as low, fid >> 32 as high, fid as back from f")
def fid_parts(spark, sf):
    low, high = doc.fid_parts(F.col("event_id") * 1234567891011)
    parts = table(spark, sf, "events").select("event_id", low.alias("low"), high.alias("high"))
    return parts.withColumn("back", doc.fid_of_parts(F.col("low"), F.col("high")))


_RESOURCES = "r as (select page_id, regexp_replace(replace(url, '\\', '/'), '^/', '') as path, octet_length(encode(html)) as size from pages)"


@query("with " + _RESOURCES + "select page_id, path, md5(path) as key, coalesce(sum(size) over (order by path, page_id rows between unbounded preceding and 1 preceding), 0)::bigint as start, size from r")
def archive_index(spark, sf):
    from ..functions import text

    resources = table(spark, sf, "pages").select("page_id", text.archive_path(F.col("url")).alias("path"), F.octet_length("html").cast("long").alias("size"))
    return doc.archive_index(resources, ["path", "page_id"])


@query("with " + _RESOURCES + """, i as (select md5(path) as key, coalesce(sum(size) over (order by path, page_id rows between unbounded preceding and 1 preceding), 0)::bigint as start, size from r)
select row_number() over (order by key, start) - 1 as place, key, start, size from i""")
def archive_index_by_key(spark, sf):
    """The index as it is stored: in the order of the keys."""
    return doc.index_by_key(archive_index(spark, sf))


@query("with " + _RESOURCES + """, i as (select md5(path) as key, coalesce(sum(size) over (order by path, page_id rows between unbounded preceding and 1 preceding), 0)::bigint as start, size from r),
f as (select key, min(start) as start, arg_min(size, start) as size from i group by key), a as (select page_id, case when page_id % 3 = 0 then path || '.gz' else '/' || path end as path from r)
select page_id, path, start, size from a left join f on f.key = md5(regexp_replace(path, '^/', ''))""")
def archive_lookup(spark, sf):
    """Paths with a leading slash are found, and those with another ending are not."""
    from ..functions import text

    path = text.archive_path(F.col("url"))
    asked = table(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(path, F.lit(".gz"))).otherwise(F.concat(F.lit("/"), path)).alias("path"))
    return doc.archive_lookup(archive_index(spark, sf), asked, "path")


@query("""with e as (select user_id, min(event_id) filter (where event_type = 'purchase') as stop from events group by 1)
select event_id, user_id, event_type from events join e using (user_id) where stop is null or event_id <= stop""")
def scan_until(spark, sf):
    """Each user's events up to the first purchase."""
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return doc.scan_until(rows, ["user_id"], "event_id", F.col("event_type") == "purchase")


_MATERIALS = """m as (select p_partkey as id, case p_size % 3 when 0 then 'opaque' when 1 then 'mask' else 'blend' end as mode, p_size % 2 = 0 as two, case when p_size % 4 = 3 then 'back' else 'none' end as cull, case when p_size % 5 = 0 then p_size % 7 end as t from part),
d as (select id, '{' || list_aggregate(list_filter([case when mode <> 'opaque' then '"alphaMode":"' || mode || '"' end, case when mode = 'mask' then '"alphaCutoff":0.5' end, case when two then '"doubleSided":true' end,
  case when cull <> 'none' then '"cullFace":"back"' end, case when t is not null then '"pbrMetallicRoughness":{"baseColorTexture":{"textureSetDefinitionId":' || t || '}}' end], lambda x: x is not null), 'string_agg', ',') || '}' as document from m),
e as (select id, coalesce(document, '{}') as document from d), f as (select document, row_number() over (order by min(id)) - 1 as definition from e group by document)"""


def _materials(spark, sf):
    k = F.col("p_size")
    rows = table(spark, sf, "part").select(
        "p_partkey", F.when(k % 3 == 0, "opaque").when(k % 3 == 1, "mask").otherwise("blend").alias("alpha_mode"), F.lit(0.5).alias("alpha_cutoff"), (k % 2 == 0).alias("double_sided"),
        F.when(k % 4 == 3, "back").otherwise("none").alias("culling"), F.lit(None).cast("array<double>").alias("base_color"), F.when(k % 5 == 0, k % 7).alias("texture_set"))
    return doc.material_definitions(rows, "p_partkey")


@query("with " + _MATERIALS + " select definition, document from f")
def material_definitions(spark, sf):
    return _materials(spark, sf)[0]


@query("with " + _MATERIALS + " select id as p_partkey, definition from e join f using (document)")
def material_nodes(spark, sf):
    return _materials(spark, sf)[1]


# ---------------------------------------------------------------- rules of a layer
@query("""with k as (select event_id, event_id % 11 as k, event_id % 3 as t from events), i as (select event_id, t, case
  when t = 0 then case k when 0 then ['error topology'] when 1 then ['error legacyTopology'] when 2 then ['error headers'] when 3 then ['error vertexAttributes.position.valueType'] when 4 then ['warning vertexAttributes.normal']
    when 5 then ['error vertexAttributes.color.valuesPerElement'] when 6 then ['error featureAttributes.id.valueType'] when 7 then ['error vertexAttributes.region.valueType'] else [] end
  when t = 1 then case when k = 0 then [] else ['error topology'] end
  else case k when 0 then ['error vertexAttributes.position.valueType'] when 1 then ['error topology', 'error legacyTopology', 'error vertexAttributes.position.valueType'] when 3 then ['error topology']
    when 6 then ['error topology', 'error featureAttributes.id.valueType', 'error vertexAttributes.position.valueType'] else ['error topology', 'error vertexAttributes.position.valueType'] end end as found from k), r as (select event_id, unnest(found) as x from i)
select event_id, split_part(x, ' ', 1) as severity, split_part(x, ' ', 2) as path from r""")
def geometry_schema_issues(spark, sf):
    """Meshes, points and point clouds, each with one thing changed in eleven ways."""
    from ..operators import layer_rules as rules

    k, t = F.col("event_id") % 11, F.col("event_id") % 3
    names = lambda *v: F.array(*map(F.lit, v))
    df = table(spark, sf, "events").select(
        "event_id", F.when(t == 0, "3DObject").when(t == 1, "Point").otherwise("PointCloud").alias("layer_type"), F.when(k == 0, "points").otherwise("triangles").alias("geometry_type"),
        F.when(k == 1, "other").otherwise("PerAttributeArray").alias("topology"), F.when(k == 2, names("vertexCount")).otherwise(names("vertexCount", "featureCount")).alias("headers"),
        F.when(k == 3, "Int32").otherwise("Float32").alias("position_type"), F.lit(3).alias("position_n"), F.lit("Float32").alias("normal_type"), F.when(k == 4, 0).otherwise(3).alias("normal_n"), F.lit("Float32").alias("uv0_type"), F.lit(2).alias("uv0_n"),
        F.lit("UInt8").alias("color_type"), F.when(k == 5, 3).otherwise(4).alias("color_n"), F.when(k == 7, "UInt8").otherwise("UInt16").alias("region_type"), F.when(k == 8, 0).otherwise(4).alias("region_n"),
        F.when(k == 6, "Int32").otherwise("UInt64").alias("id_type"), F.lit(1).alias("id_n"), F.lit("UInt32").alias("faceRange_type"), F.lit(2).alias("faceRange_n"))
    return rules.geometry_schema_issues(df, ["event_id"])


@query("""with k as (select event_id, event_id % 9 as k, event_id % 2 = 0 as text from events), i as (select event_id, case when text then case k when 0 then ['error header', 'error header[1].property', 'error header[1].valueType'] when 1 then ['error header[0].property']
  when 2 then ['error header[0].valueType'] when 3 then ['error ordering'] when 4 then ['error attributeByteCounts.valueType'] when 5 then ['error attributeValues.valuesPerElement'] when 6 then ['warning attributeValues.encoding'] else [] end
  else case k when 0 then [] when 1 then ['error header[0].property'] when 2 then ['error header[0].valueType'] when 3 then ['error ordering'] when 5 then ['error attributeValues.valuesPerElement'] when 7 then ['error objectIds.valueType'] else [] end end as found from k), r as (select event_id, unnest(found) as x from i)
select event_id, split_part(x, ' ', 1) as severity, split_part(x, ' ', 2) as path from r""")
def storage_rule_issues(spark, sf):
    """Texts and numbers, each with one thing changed in nine ways."""
    from ..operators import layer_rules as rules

    k, text = F.col("event_id") % 9, F.col("event_id") % 2 == 0
    names = lambda *v: F.array(*map(F.lit, v))
    first = F.when(k == 1, "other").otherwise("count")
    kind = F.when(k == 2, "Float32").otherwise("UInt32")
    df = table(spark, sf, "events").select(
        "event_id", F.when(text, "String").otherwise("Float64").alias("value_type"), F.when(k == 5, 2).otherwise(1).alias("values_n"), F.when(k == 6, "UTF-16").otherwise("UTF-8").alias("encoding"),
        F.when(text & (k != 0), F.array(first, F.lit("attributeValuesByteCount"))).otherwise(F.array(first)).alias("header"), F.when(text & (k != 0), F.array(kind, F.lit("UInt32"))).otherwise(F.array(kind)).alias("header_types"),
        F.when(k == 3, names("other")).when(text, names("attributeByteCounts", "attributeValues")).when(k == 7, names("ObjectIds")).otherwise(names("attributeValues")).alias("ordering"),
        F.when(k == 4, "Int64").otherwise("Int32").alias("counts_type"), F.lit(1).alias("counts_n"), F.lit("Float32").alias("object_ids_type"), F.lit(1).alias("object_ids_n"))
    return rules.storage_issues(df, ["event_id"])


# ---------------------------------------------------------------- typed reading
_TYPED = """t as (select event_id, event_id % 12 as k, '{"a": {"b": ' || case event_id % 12 when 0 then 'null' when 1 then '"x"' when 2 then '[1, 2]' else event_id::varchar end ||
  '}, "u": ' || case event_id % 6 when 0 then '"Meters"' when 1 then '"foot_us"' when 2 then '"furlong"' when 3 then '7' when 4 then 'null' else '"us-foot"' end ||
  ', "x": ' || case event_id % 5 when 0 then '"+inf"' when 1 then '"-inf"' when 2 then '"other"' when 3 then '1.5' else '[0]' end ||
  ', "l": ' || case event_id % 4 when 0 then '[1, 2, 3]' when 1 then '[1, 2]' when 2 then '[]' else '"no"' end ||
  case when event_id % 7 = 0 then '' else ', "o": ' || case event_id % 7 when 1 then 'true' when 2 then '12' when 3 then '0.5' when 4 then '"s"' when 5 then '[1]' else '{"z": 1}' end end || '}' as whole from events),
d as (select event_id, k, case when k = 11 then substr(whole, 1, 9) else whole end as text from t)"""


def _typed(spark, sf):
    """Texts that hold every kind of value in each of five fields, right ones and wrong ones."""
    from ..operators import typed_documents as typed

    e = F.col("event_id")
    pick = lambda n, *values: F.get(F.array(*(v if not isinstance(v, str) else F.lit(v) for v in values)), (e % n).cast("int"))
    b = F.when(e % 12 == 0, "null").when(e % 12 == 1, '"x"').when(e % 12 == 2, "[1, 2]").otherwise(e.cast("string"))
    o = F.when(e % 7 == 0, "").otherwise(F.concat(F.lit(', "o": '), pick(7, "", "true", "12", "0.5", '"s"', "[1]", '{"z": 1}')))
    whole = F.concat(
        F.lit('{"a": {"b": '), b, F.lit('}, "u": '), pick(6, '"Meters"', '"foot_us"', '"furlong"', "7", "null", '"us-foot"'),
        F.lit(', "x": '), pick(5, '"+inf"', '"-inf"', '"other"', "1.5", "[0]"), F.lit(', "l": '), pick(4, "[1, 2, 3]", "[1, 2]", "[]", '"no"'), o, F.lit("}"))
    texts = table(spark, sf, "events").select("event_id", F.when(e % 12 == 11, F.substring(whole, 1, 9)).otherwise(whole).alias("text"))
    fields = [typed.Field("a.b", "bigint"), typed.Field("u", "enum:height_unit", required=False, default="meter"), typed.Field("x", "number"), typed.Field("l", "array<int>", most=2), typed.Field("o", "dynamic", required=False)]
    return typed.read_typed(texts, "text", fields)


@query("with " + _TYPED + """select event_id, case when k > 2 and k < 11 then event_id end as a_b, case when k < 11 then case event_id % 6 when 0 then 'meter' when 1 then 'us-foot' when 4 then 'meter' when 5 then 'us-foot' end end as u,
  case when k < 11 then case event_id % 5 when 0 then 'Infinity' when 1 then '-Infinity' when 2 then 'NaN' when 3 then '1.5' end end as x, case when k < 11 and event_id % 4 in (1, 2) then case event_id % 4 when 1 then '1,2' else '' end end as l,
  case when k < 11 then case event_id % 7 when 1 then 'bool' when 2 then 'int' when 3 then 'double' when 4 then 'string' end end as o_kind, case when k < 11 then case event_id % 7 when 1 then 'true' when 2 then '12' when 3 then '0.5' when 4 then 's' end end as o_value from d""")
def typed_values(spark, sf):
    out = _typed(spark, sf)
    return out.select("event_id", "a_b", "u", F.col("x").cast("string").alias("x"), F.array_join(F.transform("l", lambda v: v.cast("string")), ",").alias("l"), F.col("o.kind").alias("o_kind"), F.col("o.value").alias("o_value"))


@query("with " + _TYPED + """, i as (select event_id, case when k = 11 then [{'path': '', 'code': 'malformed'}] else list_filter([
  case k when 0 then {'path': 'a.b', 'code': 'missing'} when 1 then {'path': 'a.b', 'code': 'not convertible'} when 2 then {'path': 'a.b', 'code': 'not convertible'} end,
  case event_id % 6 when 2 then {'path': 'u', 'code': 'unknown name'} when 3 then {'path': 'u', 'code': 'not convertible'} end,
  case event_id % 5 when 4 then {'path': 'x', 'code': 'not convertible'} end,
  case event_id % 4 when 0 then {'path': 'l', 'code': 'too many values'} when 3 then {'path': 'l', 'code': 'not convertible'} end,
  case event_id % 7 when 5 then {'path': 'o', 'code': 'unexpected array'} when 6 then {'path': 'o', 'code': 'unexpected object'} end], lambda x: x is not null) end as found from d), r as (select event_id, unnest(found) as x from i)
select event_id, x.path as path, x.code as code from r""")
def typed_issues(spark, sf):
    # Outer, so that no filter on the array's size is pushed below the reading and computes it again.
    return _typed(spark, sf).select("event_id", F.explode_outer("issues").alias("i")).where("i is not null").select("event_id", "i.path", "i.code")


@query("select event_id, case event_id % 4 when 0 then '\"nan\"' when 1 then '\"+inf\"' when 2 then '\"-inf\"' else (event_id % 100 + 0.5)::double::varchar end as written from events")
def non_finite_numbers(spark, sf):
    """Numbers as they are written."""
    from ..operators.typed_documents import number_text

    k = F.col("event_id") % 4
    x = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).otherwise(F.col("event_id") % 100 + 0.5)
    return table(spark, sf, "events").select("event_id", number_text(x).alias("written"))


def _enum_sql() -> str:
    from ..functions import enums

    rows = [(e, s, c, enums.NAMES[e].index(c)) for e in enums.NAMES for s, c in enums.spellings(e).items()]
    return "(values " + ", ".join(f"('{e}', '{s}', '{c}', {i})" for e, s, c, i in rows) + ") e(enumeration, spelled, name, number)"


@query("select event_id, enumeration, case when event_id % 2 = 0 then name end as name, case when event_id % 2 = 0 then number end as number from (select *, row_number() over (order by enumeration, spelled) - 1 as r from " + _enum_sql() + ") e join (select event_id, event_id % (select count(*) from " + _enum_sql() + ") as r from events) using (r)")
def enum_names(spark, sf):
    """Every spelling of every enumeration, and for odd ids the same text with a mark, which is none."""
    from ..functions import enums

    pairs = sorted((e, s) for e in enums.NAMES for s in enums.spellings(e))
    at = (F.col("event_id") % len(pairs)).cast("int")
    given = F.get(F.array(*(F.struct(F.lit(e).alias("e"), F.lit(s).alias("s")) for e, s in pairs)), at)
    rows = table(spark, sf, "events").select("event_id", given.alias("g"))
    text = F.when(F.col("event_id") % 2 == 0, F.col("g.s")).otherwise(F.concat("g.s", F.lit("?")))
    name, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    for e in enums.NAMES:
        name = F.when(F.col("g.e") == e, enums.canonical(text, e)).otherwise(name)
        number = F.when(F.col("g.e") == e, enums.number_of(text, e)).otherwise(number)
    return rows.select("event_id", F.col("g.e").alias("enumeration"), name.alias("name"), number.alias("number"))


@query("select md5('nodes/' || o_custkey) as key, count(*) as n from orders group by 1 having count(*) > 1")
def archive_duplicates(spark, sf):
    from ..functions import text

    return doc.archive_duplicates(table(spark, sf, "orders").select(text.node_path(F.col("o_custkey")).alias("path")))


@query("""select i as definition, to_json({'attributes': list_filter(['position', case when i & 1 = 0 then 'normal' end, 'uv0', case when i & 2 = 0 then 'color' end, case when i & 4 = 0 then 'region' end], lambda x: x is not null),
  'bytesPerVertex': 20 + case when i & 1 = 0 then 12 else 0 end + case when i & 2 = 0 then 4 else 0 end + case when i & 4 = 0 then 8 else 0 end})::varchar as document from range(8) t(i)""")
def geometry_definitions(spark, sf):
    return doc.geometry_definitions(spark)


@query("""with f as (select n_nationkey as idx, n_name as name, case n_nationkey % 4 when 0 then 'string' when 1 then 'date' when 2 then 'int32' else 'float64' end as type from nation)
select idx, to_json({'key': 'f_' || idx, 'name': name, 'header': case when idx % 4 < 2 then ['count', 'attributeValuesByteCount'] else ['count'] end,
  'ordering': case when idx % 4 < 2 then ['attributeByteCounts', 'attributeValues'] else ['attributeValues'] end, 'valueType': case when idx % 4 < 2 then 'string' else type end})::varchar as document from f""")
def storage_documents(spark, sf):
    k = F.col("n_nationkey") % 4
    kind = F.when(k == 0, "string").when(k == 1, "date").when(k == 2, "int32").otherwise("float64")
    return doc.storage_documents(table(spark, sf, "nation").select(F.col("n_nationkey").alias("idx"), F.col("n_name").alias("name"), kind.alias("type")))


@query("""with d as (select distinct o_orderstatus as s, o_orderpriority as p from orders), c as (select s, p, (row_number() over (partition by s order by p) - 1)::integer as code from d)
select s as o_orderstatus, to_json({'name': s, 'codedValues': list({'name': p, 'code': code} order by code)})::varchar as document from c group by s""")
def domain_documents(spark, sf):
    return doc.domain_documents(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@query("with " + _PATHS + """, k as (select p.idx, list(n.idx order by n.idx) as children from n join n p on n.parent_id = p.node_id group by p.idx),
d as (select n.idx, p.idx as parent_idx, coalesce(k.children, []) as children from n left join n p on n.parent_id = p.node_id left join k on k.idx = n.idx)
select idx // 64 as page_id, to_json({'nodes': list({'index': idx, 'parentIndex': parent_idx, 'children': children} order by idx)})::varchar as document from d group by 1""")
def node_page_documents(spark, sf):
    return doc.node_page_documents(trees.breadth_first_pages(tree(spark, sf), 64, 3))


@query("with " + _PATHS + ", " + PTS + """, c as (select count(*) as nodes, count(distinct idx // 64) as pages, max(depth) as depth from n),
e as (select [floor(min(lon))::bigint, floor(min(lat))::bigint, ceil(max(lon))::bigint, ceil(max(lat))::bigint] as extent from pts)
select to_json({'nodeCount': nodes, 'pageCount': pages, 'depth': depth, 'extent': extent})::varchar as document from c, e""")
def layer_document(spark, sf):
    paged = trees.breadth_first_pages(tree(spark, sf), 64, 3)
    return doc.layer_document(paged, envelopes.planar_envelope(points(spark, sf), []))


@query("with " + _PATHS + """, m as (select node_id, node_id::varchar as name from n union all select node_id, 'root' from n where parent_id is null)
select node_id, 'nodes/' || name || '/' || kind as path from m, (values ('geometries/0'), ('shared'), ('textures/0')) t(kind)""")
def node_resources(spark, sf):
    return doc.node_resources(tree(spark, sf), ("geometries/0", "shared", "textures/0"))


_FEATURES = PTS + ", f as (select fid, grp, round(lon * 1000)::bigint as x, round(lat * 1000)::bigint as y from pts)"


def _features(spark, sf):
    return points(spark, sf).select("fid", "grp", F.round(F.col("lon") * 1000).cast("long").alias("x"), F.round(F.col("lat") * 1000).cast("long").alias("y"))


@query("with " + _FEATURES + "select grp, fid // 1000 as part, to_json(list({'id': fid, 'x': x, 'y': y} order by fid))::varchar as document from f group by 1, 2")
def feature_documents(spark, sf):
    return doc.feature_documents(_features(spark, sf), "grp")


@query("with " + _FEATURES + "select grp, fid, x, y from f")
def feature_documents_read(spark, sf):
    """Written as JSON and read again."""
    return doc.features_of_documents(doc.feature_documents(_features(spark, sf), "grp"), "grp")


@query("""select l_linenumber % 4 as definition, count(*) as n, round(sum(l_discount) / sum(l_quantity), 9) as ratio from lineitem group by 1""")
def layer_counters(spark, sf):
    """Nodes per definition, and the ratio of two sizes over all of them."""
    return table(spark, sf, "lineitem").groupBy((F.col("l_linenumber") % 4).alias("definition")).agg(F.count("*").alias("n"), F.round(F.sum("l_discount") / F.sum("l_quantity"), 9).alias("ratio"))


@query("""select event_type, value, event_id, (case when row_number() over (partition by event_type order by value, event_id) <= count(*) over (partition by event_type) // 2 then 0 else 1 end)::integer as side from events""")
def median_split(spark, sf):
    return doc.median_split(table(spark, sf, "events"), "event_type", "value", "event_id")


@query("""with v as (select event_id, (event_id % 3)::integer as kind, case event_id % 3 when 0 then event_type else '' end as txt, case event_id % 3 when 0 then 0.0::double when 1 then (event_id % 17)::double else value end as num from events)
select event_id, row_number() over (order by kind, txt, num, event_id) - 1 as place from v""")
def variant_order(spark, sf):
    k = F.col("event_id") % 3
    values = table(spark, sf, "events").select(
        "event_id", k.cast("int").alias("kind"), F.when(k == 0, F.col("event_type")).otherwise("").alias("txt"), F.when(k == 0, 0.0).when(k == 1, (F.col("event_id") % 17).cast("double")).otherwise(F.col("value")).alias("num"))
    return doc.variant_order(values, "kind", "txt", "num", "event_id").select("event_id", "place")


@query("with " + PTS + """, a as (select min(lon) l, max(lon) r, min(lat) b, max(lat) t, min(h) f, max(h) k, bool_or(h > 480) whole from pts)
select case when whole then -180.0::double else l end as "left", case when whole then 180.0::double else r end as "right", case when whole then -90.0::double else b end as bottom, case when whole then 90.0::double else t end as top, f as front, k as back from a""")
def layer_extent(spark, sf):
    return hulls.layer_extent(points(spark, sf), F.col("h") > 480)


# ---------------------------------------------------------------- streams
def _stream(spark, sf):
    return table_stream(spark, sf, "events", "ts")


@query("""with w as (select date_trunc('day', ts) as d, event_type, value from events), m as (select max(ts) - interval 1 hour as mark from events)
select strftime(d, '%Y-%m-%d') as day, event_type, min(value) as low, max(value) as high, count(*) as n, round(sum(value), 4) as total from w, m where d + interval 1 day <= mark group by 1, 2""")
def stream_window_stats(spark, sf):
    """Days that the watermark has passed."""
    out = windows.drained(windows.window_stats(_stream(spark, sf), "ts", "value", "event_type"), shared_folder(spark), "window-stats")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "low", "high", "n", F.round("total", 4).alias("total"))


@query("select distinct user_id, event_type from events")
def stream_first_seen(spark, sf):
    """The delay spans the whole table: what is left is distinct."""
    seen = windows.first_seen(_stream(spark, sf).select("ts", "user_id", "event_type"), "ts", ["user_id", "event_type"], "3650 days")
    return windows.drained(seen, shared_folder(spark), "first-seen").select("user_id", "event_type")
