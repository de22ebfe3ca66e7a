"""Typed reading of JSON texts: values by a list of fields, and what is wrong with each text.

A text is parsed once, into a variant; each field is then taken by its dotted path. A field that is
required must be there and not null; an optional one has a default. Numbers may be the texts
``+inf``, ``-inf`` and ``nan``; enumerated texts are read in all their spellings and written in the
canonical one; lists may have a largest length. Issues name the dotted path of the field.

Defined cases: a null or malformed text has the one issue ``malformed`` at the path ``""`` and all
values null, defaults too; a value of another type than asked is ``not convertible`` and null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import enums

#: Types of a dynamic value; lists and objects are none of them.
DYNAMIC = "struct<kind:string,value:string>"


@dataclass(frozen=True)
class Field:
    """``kind`` is a Spark type, ``number`` (non-finite texts allowed), ``dynamic``, or ``enum:<name>``.

    ``most`` is the largest length of a list.
    """

    path: str
    kind: str = "string"
    required: bool = True
    default: object = None
    most: int | None = None

    @property
    def name(self) -> str:
        return self.path.replace(".", "_")


def kind_of_schema(s: Column) -> Column:
    """``bool``, ``int``, ``double``, ``string``, ``array``, ``object`` or ``null``, by the schema of a variant; null schema: ``null``."""
    return (
        F.when(s.isNull() | (s == "VOID"), "null")
        .when(s == "BOOLEAN", "bool")
        .when((s == "BIGINT") | (s.startswith("DECIMAL") & s.endswith(",0)")), "int")
        .when((s == "DOUBLE") | s.startswith("DECIMAL"), "double")
        .when(s == "STRING", "string")
        .when(s.startswith("ARRAY"), "array")
        .otherwise("object")
    )


def kind_of(value: Column) -> Column:
    """The kind of a variant; ``null`` for nothing."""
    return kind_of_schema(F.schema_of_variant(value))


def non_finite(value: Column, kind: Column | None = None) -> Column:
    """A number, or one of the texts for what is not finite; any other text is not a number."""
    text = F.try_variant_get(value, "$", "string")
    special = F.when(text == "+inf", float("inf")).when(text == "-inf", float("-inf")).otherwise(float("nan"))
    return F.when((kind_of(value) if kind is None else kind) == "string", special).otherwise(F.try_variant_get(value, "$", "double"))


def number_text(x: Column) -> Column:
    """A number as it is written: what is not finite as a text."""
    return F.when(F.isnan(x), '"nan"').when(x == float("inf"), '"+inf"').when(x == float("-inf"), '"-inf"').otherwise(F.to_json(F.struct(x.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(x.alias("x")))) - 6))


def _value(field: Field, v: Column, kind: Column) -> Column:
    """The field's value from its variant, which is not null; null where it can't be had."""
    if field.kind == "number":
        return F.when(kind.isin("int", "double", "string"), non_finite(v, kind))
    if field.kind == "dynamic":
        simple = kind.isin("bool", "int", "double", "string")
        return F.when(simple, F.struct(kind.alias("kind"), F.try_variant_get(v, "$", "string").alias("value")))
    if field.kind.startswith("enum:"):
        return enums.canonical(F.when(kind == "string", F.try_variant_get(v, "$", "string")), field.kind[5:])
    return F.try_variant_get(v, "$", field.kind)


def _wrong(field: Field, kind: Column, value: Column) -> Column:
    """What is wrong with a value that is there, or null."""
    if field.kind == "dynamic":
        return F.when(kind == "array", "unexpected array").when(kind == "object", "unexpected object")
    if field.kind.startswith("enum:"):
        return F.when(kind != "string", "not convertible").when(value.isNull(), "unknown name")
    code = F.when(value.isNull(), "not convertible")
    return code.when(F.size(value) > field.most, "too many values") if field.most is not None else code


def read_typed(df: DataFrame, column: str, fields: list[Field]) -> DataFrame:
    """``df`` with a column per field (its path with underscores) and ``issues``, an array of (path, code) in the fields' order."""
    # Each step is a projection of its own, so that nothing is computed twice.
    names = [f.name for f in fields]
    whole = F.col("_document").isNotNull()
    rows = df.select(F.struct("*").alias("_row"), F.try_parse_json(column).alias("_document"))
    # A JSON null is a variant of its own; its kind is null like that of a missing field.
    rows = rows.withColumns({f"_v_{f.name}": F.try_variant_get("_document", f"$.{f.path}", "variant") for f in fields})
    rows = rows.withColumns({f"_s_{n}": F.schema_of_variant(f"_v_{n}") for n in names})
    rows = rows.withColumns({f"_k_{n}": kind_of_schema(F.col(f"_s_{n}")) for n in names})
    rows = rows.withColumns({f"_x_{f.name}": F.when(F.col(f"_k_{f.name}") != "null", _value(f, F.col(f"_v_{f.name}"), F.col(f"_k_{f.name}"))) for f in fields})
    rows = rows.withColumns({f"_c_{f.name}": F.when(F.col(f"_k_{f.name}") != "null", _wrong(f, F.col(f"_k_{f.name}"), F.col(f"_x_{f.name}"))) for f in fields})
    values, issues = [], []
    for f in fields:
        kind = {"number": "double", "dynamic": DYNAMIC}.get(f.kind, "string" if f.kind.startswith("enum:") else f.kind)
        there, code = F.col(f"_k_{f.name}") != "null", F.col(f"_c_{f.name}")
        kept = F.when(~F.coalesce(code == "too many values", F.lit(False)), F.col(f"_x_{f.name}"))
        values.append(F.when(there, kept).otherwise(F.when(whole, F.lit(f.default).cast(kind))).cast(kind).alias(f.name))
        lost = F.when(whole, F.lit("missing")) if f.required else F.lit(None).cast("string")
        code = F.when(there, code).otherwise(lost)
        issues.append(F.when(code.isNotNull(), F.struct(F.lit(f.path).alias("path"), code.alias("code"))))
    malformed = F.array(F.struct(F.lit("").alias("path"), F.lit("malformed").alias("code")))
    listed = F.when(~whole, malformed).otherwise(F.filter(F.array(*issues), lambda i: i.isNotNull()))
    return rows.select(*(F.col(f"_row.`{c}`").alias(c) for c in df.columns), *values, listed.alias("issues"))
