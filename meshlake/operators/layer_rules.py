"""Checks of a layer's descriptions by tables of rules: the geometry schema and the attributes' storage.

A rule is a path, whether it applies, and whether what is there is right. Every broken rule is a row
(severity, path), for each description on its own; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Vertex attributes of the geometry schema, with their type and values per vertex, and whether a missing one is a warning.
VERTEX_RULES = (("position", "Float32", 3, None), ("normal", "Float32", 3, True), ("uv0", "Float32", 2, True), ("color", "UInt8", 4, True), ("region", "UInt16", 4, False))
FEATURE_RULES = (("id", "UInt64", 1), ("faceRange", "UInt32", 2))
COUNT_TYPES = ("UInt32", "Int32")
INTEGERS = ("Int8", "UInt8", "Int16", "UInt16", "Int32", "UInt32", "Oid32", "Int64", "UInt64", "Oid64")


def _broken(df: DataFrame, keys: list[str], rules: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """Rules (severity, path, applies, right) that don't hold; a rule that can't be decided doesn't."""
    each = [
        F.when(applies & ~F.coalesce(right, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(path).alias("path")))
        for severity, path, applies, right in rules
    ]
    found = F.filter(F.array(*each), lambda x: x.isNotNull())
    return df.select(*keys, F.explode_outer(found).alias("i")).where("i is not null").select(*keys, "i.severity", "i.path")


def geometry_schema_issues(schemas: DataFrame, keys: list[str]) -> DataFrame:
    """``schemas``: layer_type, geometry_type, topology, headers (array), and <attribute>_type, <attribute>_n of the attributes of the rules (n 0 or null: not there)."""
    kind = F.col("layer_type")
    points, cloud = kind.isin("Point", "PointCloud"), kind == "PointCloud"
    has = lambda name: F.coalesce(F.col(f"{name}_n"), F.lit(0)) > 0
    solid = kind != "Point"
    mesh = solid & ~cloud
    rules = [
        ("error", "topology", points, F.col("geometry_type") != "triangles"),
        ("error", "topology", ~points, F.col("geometry_type") != "points"),
        ("error", "legacyTopology", solid, F.col("topology") == "PerAttributeArray"),
        ("error", "headers", mesh, F.col("headers") == F.array(F.lit("vertexCount"), F.lit("featureCount"))),
    ]
    for name, type_, n in FEATURE_RULES:
        rules += [("error", f"featureAttributes.{name}.valueType", solid & has("id"), F.col(f"{name}_type") == type_), ("error", f"featureAttributes.{name}.valuesPerElement", solid & has("id"), F.col(f"{name}_n") == n)]
    for name, type_, n, wanted in VERTEX_RULES:
        there = F.lit(True) if wanted is None else has(name)
        rules += [("error", f"vertexAttributes.{name}.valueType", mesh & there, F.col(f"{name}_type") == type_), ("error", f"vertexAttributes.{name}.valuesPerElement", mesh & there, F.col(f"{name}_n") == n)]
        if wanted:
            rules.append(("warning", f"vertexAttributes.{name}", mesh, has(name)))
    rules += [("error", "vertexAttributes.position.valueType", cloud, F.col("position_type") == "Int32"), ("error", "vertexAttributes.position.valuesPerElement", cloud, F.col("position_n") == 3)]
    return _broken(schemas, keys, rules)


def storage_issues(storage: DataFrame, keys: list[str]) -> DataFrame:
    """``storage``: value_type, values_n, encoding, header and header_types (arrays), ordering (array), counts_type, counts_n, object_ids_type, object_ids_n."""
    text = F.col("value_type") == "String"
    header, types, ordering = F.col("header"), F.col("header_types"), F.col("ordering")
    some = F.size(header) > 0
    ids = ~text & some & (F.get(ordering, F.lit(0)) == "ObjectIds")
    plain = ~text & some & (F.get(ordering, F.lit(0)) != "ObjectIds")
    rules = [
        ("error", "header", some, F.size(header) == F.when(text, 2).otherwise(1)),
        ("error", "header[0].property", some, F.get(header, F.lit(0)) == "count"),
        ("error", "header[0].valueType", some, F.get(types, F.lit(0)).isin(*COUNT_TYPES)),
        ("error", "header[1].property", text, F.get(header, F.lit(1)) == "attributeValuesByteCount"),
        ("error", "header[1].valueType", text, F.get(types, F.lit(1)).isin(*COUNT_TYPES)),
        ("error", "ordering", text, ordering == F.array(F.lit("attributeByteCounts"), F.lit("attributeValues"))),
        ("error", "attributeByteCounts.valuesPerElement", text, F.col("counts_n") == 1),
        ("error", "attributeByteCounts.valueType", text, F.col("counts_type").isin(*COUNT_TYPES)),
        ("error", "attributeValues.valuesPerElement", text | plain, F.col("values_n") == 1),
        ("warning", "attributeValues.encoding", text, F.col("encoding") == "UTF-8"),
        ("error", "ordering", ~text & some, (F.size(ordering) == 1) & F.get(ordering, F.lit(0)).isin("attributeValues", "ObjectIds")),
        ("error", "objectIds.valuesPerElement", ids, F.col("object_ids_n") == 1),
        ("error", "objectIds.valueType", ids, F.col("object_ids_type").isin(*INTEGERS)),
    ]
    return _broken(storage, keys, rules)
