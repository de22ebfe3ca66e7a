"""Documents of a layer: attribute buffers' nulls, definitions, node pages, features and the archive's index.

A document is a JSON text made by ``to_json``. Whatever gathers rows into one document gathers a
page of bounded size; offsets and splits that need a global order come from ``numbered``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import path_key
from .joins import dictionary_encode
from .staging import numbered, range_offsets, ranged

# What stands for null in a buffer, by type. Texts keep null (it isn't the empty text).
NULL_SENTINELS = {
    "int8": -(1 << 7), "uint8": (1 << 8) - 1, "int16": -(1 << 15), "uint16": (1 << 16) - 1, "int32": -(1 << 31),
    "uint32": (1 << 32) - 1, "int64": -(1 << 63), "uint64": (1 << 64) - 1, "float32": float("nan"), "float64": float("nan"),
}
#: The narrowest Spark type that holds each buffer type.
SPARK_TYPES = {
    "int8": "byte", "uint8": "short", "int16": "short", "uint16": "int", "int32": "int", "uint32": "long",
    "int64": "long", "uint64": "decimal(20,0)", "float32": "float", "float64": "double", "string": "string",
}

# Vertex attributes in their order, with the bytes of one vertex.
VERTEX_ATTRIBUTES = (("position", 12), ("normal", 12), ("uv0", 8), ("color", 4), ("region", 8))
#: Attributes that a definition may leave out, by bit.
DROPPABLE = ("normal", "color", "region")

FEATURES = "array<struct<id:bigint,x:bigint,y:bigint>>"
KEEP_NULLS = {"ignoreNullFields": "false"}

def with_sentinel(value: Column, kind: str) -> Column:
    """``value`` as it goes into a buffer of type ``kind``."""
    out = value.cast(SPARK_TYPES[kind])
    if kind == "string":
        return out
    sentinel = NULL_SENTINELS[kind]
    return F.coalesce(out, F.lit(str(sentinel) if kind == "uint64" else sentinel).cast(SPARK_TYPES[kind]))


def fid_parts(fid: Column) -> tuple[Column, Column]:
    """Low and high 32 bits of a feature id, each as a non-negative number."""
    return fid.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(fid, 32)


def fid_of_parts(low: Column, high: Column) -> Column:
    return F.shiftleft(high, 32).bitwiseOR(low)


def geometry_definitions(spark: SparkSession) -> DataFrame:
    """(definition, document): one for each choice of left-out attributes."""
    i = F.col("definition")
    left_out = {name: i.bitwiseAND(1 << bit) != 0 for bit, name in enumerate(DROPPABLE)}
    there = {name: ~left_out[name] if name in left_out else F.lit(True) for name, _ in VERTEX_ATTRIBUTES}
    names = F.filter(F.array(*(F.when(there[n], F.lit(n)) for n, _ in VERTEX_ATTRIBUTES)), lambda x: x.isNotNull())
    size = F.aggregate(F.array(*(F.when(there[n], b).otherwise(0) for n, b in VERTEX_ATTRIBUTES)), F.lit(0), lambda a, b: a + b)
    return spark.range(1 << len(DROPPABLE)).withColumnRenamed("id", "definition").select("definition", F.to_json(F.struct(names.alias("attributes"), size.alias("bytesPerVertex"))).alias("document"))


def storage_documents(fields: DataFrame) -> DataFrame:
    """(idx, document) of fields (idx, name, type): how a buffer of the field is laid out."""
    text = F.col("type").isin("string", "date")
    strings = lambda *s: F.array(*map(F.lit, s))
    document = F.struct(
        F.concat(F.lit("f_"), F.col("idx").cast("string")).alias("key"),
        F.col("name"),
        F.when(text, strings("count", "attributeValuesByteCount")).otherwise(strings("count")).alias("header"),
        F.when(text, strings("attributeByteCounts", "attributeValues")).otherwise(strings("attributeValues")).alias("ordering"),
        F.when(text, F.lit("string")).otherwise(F.col("type")).alias("valueType"),
    )
    return fields.select("idx", F.to_json(document, KEEP_NULLS).alias("document"))


def domain_documents(values: DataFrame, field: str, name: str) -> DataFrame:
    """(field, document): the distinct names of each field with codes from 0, for fields whose names are a short list."""
    distinct = values.select(field, name).where(F.col(name).isNotNull()).distinct()
    coded = distinct.withColumn("code", F.row_number().over(Window.partitionBy(field).orderBy(name)) - 1)
    listed = F.sort_array(F.collect_list(F.struct("code", F.col(name).alias("name"))))
    as_written = F.transform(listed, lambda x: F.struct(x["name"].alias("name"), x["code"].alias("code")))
    return coded.groupBy(field).agg(as_written.alias("codedValues")).select(field, F.to_json(F.struct(F.col(field).alias("name"), "codedValues")).alias("document"))


def node_page_documents(paged: DataFrame) -> DataFrame:
    """(page_id, document) of nodes numbered breadth first.

    Children of a node have consecutive numbers there, so two aggregates name them all.
    """
    up = paged.select(F.col("node_id").alias("parent_id"), F.col("idx").alias("parent_idx"))
    linked = paged.select("idx", "page_id", "parent_id").join(up, "parent_id", "left").select("idx", "page_id", "parent_idx")
    kids = linked.where("parent_idx is not null").groupBy(F.col("parent_idx").alias("idx")).agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    children = F.when(F.col("first").isNotNull(), F.sequence("first", "last")).otherwise(F.array().cast("array<bigint>"))
    node = F.struct("idx", F.struct(F.col("idx").alias("index"), F.col("parent_idx").alias("parentIndex"), children.alias("children")).alias("doc"))
    pages = linked.join(kids, "idx", "left").groupBy("page_id").agg(F.sort_array(F.collect_list(node)).alias("nodes"))
    return pages.select("page_id", F.to_json(F.struct(F.col("nodes.doc").alias("nodes")), KEEP_NULLS).alias("document"))


def layer_document(paged: DataFrame, extent: DataFrame) -> DataFrame:
    """One row: number of nodes and pages, depth, and the extent (one row) rounded outwards to whole units."""
    counted = paged.agg(F.count("*").alias("nodeCount"), F.countDistinct("page_id").alias("pageCount"), F.max("depth").alias("depth"))
    ends = extent.select(F.array(*(f(c).cast("bigint") for f, c in ((F.floor, "left"), (F.floor, "bottom"), (F.ceil, "right"), (F.ceil, "top")))).alias("extent"))
    return counted.join(F.broadcast(ends)).select(F.to_json(F.struct("nodeCount", "pageCount", "depth", "extent")).alias("document"))


def node_resources(nodes: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(node_id, path): a resource of each kind per node; the root's stand under ``root`` too."""
    names = F.when(F.col("parent_id").isNull(), F.array(F.col("node_id").cast("string"), F.lit("root"))).otherwise(F.array(F.col("node_id").cast("string")))
    each = nodes.select("node_id", F.explode(names).alias("name"))
    return each.select("node_id", F.explode(F.transform(F.array(*map(F.lit, kinds)), lambda k: F.concat(F.lit("nodes/"), F.col("name"), F.lit("/"), k))).alias("path"))


def feature_documents(points: DataFrame, by: str, page: int = 1000) -> DataFrame:
    """(by, part, document): features (fid, x, y) as JSON lists; a part holds the ids of one range, ``page`` at most."""
    parts = points.groupBy(by, F.floor(F.col("fid") / page).alias("part"))
    listed = F.sort_array(F.collect_list(F.struct(F.col("fid").alias("id"), "x", "y")))
    return parts.agg(F.to_json(listed).alias("document"))


def features_of_documents(documents: DataFrame, by: str) -> DataFrame:
    """The features that ``feature_documents`` wrote."""
    return documents.select(by, F.explode(F.from_json("document", FEATURES)).alias("f")).select(by, F.col("f.id").alias("fid"), "f.x", "f.y")


def read_documents(df: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """Adds ``fields`` of JSON texts and ``issue``: ``malformed``, ``missing`` (a field isn't there) or null."""
    schema = ", ".join(f"{n} {t}" for n, t in fields.items()) + ", _malformed string"
    read = df.withColumn("_read", F.from_json(column, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"}))
    missing = F.lit(False)
    for n in fields:
        missing = missing | F.col(f"_read.{n}").isNull()
    issue = F.when(F.col("_read._malformed").isNotNull(), "malformed").when(missing, "missing")
    return read.select(*df.columns, *(F.col(f"_read.{n}").alias(n) for n in fields), issue.alias("issue"))


def scan_until(df: DataFrame, by: list[str], order: str, stop: Column) -> DataFrame:
    """The rows of each group in order up to and with the first for which ``stop`` holds; all where none does.

    Where the scan ends is one aggregate per group, so nothing is read in order.
    """
    marked = df.withColumn("_stop", F.coalesce(stop, F.lit(False)))
    ends = marked.groupBy(*by).agg(F.min(F.when(F.col("_stop"), F.col(order))).alias("_end"))
    met = marked.join(ends.select(*(F.col(c).alias(f"_{c}") for c in by), "_end"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    return met.where(F.col("_end").isNull() | (F.col(order) <= F.col("_end"))).select(*df.columns)


def material_definitions(materials: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(definitions, nodes): the distinct materials as documents numbered as they first appear, and each row's number.

    ``materials`` has ``order``, alpha_mode, alpha_cutoff, double_sided, culling, base_color and
    texture_set; a value that is the default is left out of the document.
    """
    default = {"alpha_mode": "opaque", "alpha_cutoff": 0.25, "double_sided": False, "culling": "none"}
    unless = lambda c: F.when(F.col(c) != default[c], F.col(c)) if c in default else F.col(c)
    textured = F.when(F.col("texture_set").isNotNull(), F.struct(F.col("texture_set").alias("textureSetDefinitionId")))
    pbr = F.when(F.col("base_color").isNotNull() | textured.isNotNull(), F.struct(F.col("base_color").alias("baseColorFactor"), textured.alias("baseColorTexture")))
    document = F.struct(
        unless("alpha_mode").alias("alphaMode"), F.when(F.col("alpha_mode") == "mask", unless("alpha_cutoff")).alias("alphaCutoff"),
        unless("double_sided").alias("doubleSided"), unless("culling").alias("cullFace"), pbr.alias("pbrMetallicRoughness"),
    )
    rows = materials.select(order, F.to_json(document).alias("document"))
    dictionary, encoded = dictionary_encode(rows, "document", order)
    return dictionary.select(F.col("code").alias("definition"), "document"), encoded.select(order, F.col("code").alias("definition"))


def archive_index(resources: DataFrame, order: list[str]) -> DataFrame:
    """(key, start, size and the columns of ``order``) of resources (path, size, ...) laid one after the other.

    Sizes are summed within the ranges that number the rows, then over the ranges' totals, one row a range.
    """
    rows = ranged(resources, order)
    within = Window.partitionBy("_range").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    totals = range_offsets(rows, F.sum("size"))
    placed = rows.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0))).join(F.broadcast(totals), "_range")
    return placed.select(*order, F.md5("path").alias("key"), (F.col("_offset") + F.col("_within")).alias("start"), "size")


def index_by_key(index: DataFrame) -> DataFrame:
    """(place, key, start, size) of an archive's index in the order of the 128-bit keys, as it is stored for searching.

    A key that several resources share is an error of the archive; ``archive_duplicates`` finds it.
    """
    return numbered(index.select("key", "start", "size"), ["key", "start"], "place")


def archive_lookup(index: DataFrame, asked: DataFrame, path: str) -> DataFrame:
    """``asked`` with ``start`` and ``size`` of the resource at ``path``; null where the archive has none."""
    found = index.groupBy("key").agg(F.min(F.struct("start", "size")).alias("at"))
    return asked.withColumn("key", path_key(F.col(path))).join(found, "key", "left").select(*asked.columns, "at.start", "at.size")


def archive_duplicates(resources: DataFrame) -> DataFrame:
    """(key, n): paths that occur more than once."""
    return resources.groupBy(F.md5("path").alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def median_split(df: DataFrame, by: str, value: str, tie: str) -> DataFrame:
    """Adds ``side``: 0 for the lower half of each group (the smaller one if its size is odd), else 1.

    Rows are numbered over all groups at once, so a group of any size is spread over tasks.
    """
    rows = numbered(df.select(by, value, tie), [by, value, tie])
    sizes = rows.groupBy(by).agg(F.min("number").alias("first"), F.count("*").alias("n"))
    return rows.join(sizes, by).select(by, value, tie, F.when(F.col("number") - F.col("first") < F.floor(F.col("n") / 2), 0).otherwise(1).alias("side"))


def variant_order(df: DataFrame, kind: str, text: str, number: str, tie: str) -> DataFrame:
    """Adds ``number``: place of a value of any type, by type, then as text or as number."""
    return numbered(df, [kind, text, number, tie], "place")
