"""Strings, resource paths, versions and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File endings by kind and by encoding.
MIME_EXTENSIONS = {
    "json": "json", "binary": "bin", "jpeg": "jpg", "png": "png", "dds": "dds", "dds_legacy": "bin.dds",
    "ktx": "bin.ktx", "basis": "basis", "ktx2": "ktx2",
}
ENCODING_EXTENSIONS = {"gzip": "gz", "xyz": "pccxyz", "rgb": "pccrgb", "intensity": "pccint"}

# Image formats in the order of their bits, from bit 0.
IMAGE_FORMATS = ("jpg", "png", "dds", "ktx", "basis", "ktx2")
#: Kinds that are compressed already.
NEVER_GZIPPED = ("jpeg", "png", "basis", "ktx2")

# Other spellings of height units.
HEIGHT_UNIT_ALIASES = {
    "Meter": "meter", "Meters": "meter", "foot_us": "us-foot", "foot_clarke": "clarke-foot", "yard_clarke": "clarke-yard",
    "link_clarke": "clarke-link", "yard_sears": "sears-yard", "foot_sears": "sears-foot", "chain_sears": "sears-chain",
    "chain_benoit_1895_b": "benoit-1895-b-chain", "yard_indian": "indian-yard", "yard_indian_1937": "indian-1937-yard",
    "foot_gold_coast": "gold-coast-foot", "chain_sears_1922_trunctuated": "sears-1922-trunctuated-chain", "inch_us": "us-inch",
    "inch": "us-inch", "mile_us": "us-mile", "yard_us": "us-yard",
}
HEIGHT_UNITS = (
    "meter", "us-foot", "foot", "clarke-foot", "clarke-yard", "clarke-link", "sears-yard", "sears-foot", "sears-chain",
    "benoit-1895-b-chain", "indian-yard", "indian-1937-yard", "gold-coast-foot", "sears-1922-trunctuated-chain", "us-inch",
    "us-mile", "us-yard", "millimeter", "decimeter", "centimeter", "kilometer",
)


def base64_of(raw: Column) -> Column:
    """Base64 on one line: what Spark encodes is cut into lines of 76 characters by default."""
    return F.translate(F.base64(raw), "\r\n", "")


def lookup(value: Column, table: dict[str, str]) -> Column:
    """The table's entry, or null."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), value)


def trimmed(s: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(s, r"^\s+", ""), r"\s+$", "")


def unquoted(s: Column) -> Column:
    """Without one leading quote and all trailing quotes and NULs."""
    return F.regexp_replace(F.regexp_replace(s, '^"', ""), r'["\x00]+$', "")


def replaced(s: Column, old: str, new: str) -> Column:
    return F.replace(s, F.lit(old), F.lit(new)) if old else s


def json_escaped(s: Column) -> Column:
    for raw, out in (("\\", "\\\\"), ('"', '\\"'), ("\b", "\\b"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        s = F.replace(s, F.lit(raw), F.lit(out))
    return s


def archive_path(s: Column) -> Column:
    """Forward slashes, without one leading slash; the case stays."""
    return F.regexp_replace(F.replace(s, F.lit("\\"), F.lit("/")), "^/", "")


def path_key(s: Column) -> Column:
    """MD5 of the archive path: the key of the archive's index."""
    return F.md5(archive_path(s))


def same_resource(a: Column, b: Column) -> Column:
    return F.lower(archive_path(a)) == F.lower(archive_path(b))


def with_extensions(path: Column, mime: Column, encoding: Column) -> Column:
    kind, pack = lookup(mime, MIME_EXTENSIONS), lookup(encoding, ENCODING_EXTENSIONS)
    return F.concat(path, F.coalesce(F.concat(F.lit("."), kind), F.lit("")), F.coalesce(F.concat(F.lit("."), pack), F.lit("")))


def mime_of_extension(extension: Column) -> Column:
    return lookup(extension, {v: k for k, v in MIME_EXTENSIONS.items()})


def node_path(node: Column, *parts) -> Column:
    return F.concat_ws("/", F.lit("nodes"), node.cast("string"), *(p if isinstance(p, Column) else F.lit(p) for p in parts))


def attribute_path(node: Column, field: Column) -> Column:
    return node_path(node, "attributes", F.concat(F.lit("f_"), field.cast("string")), "0")


def epsg_url(wkid: Column, latest: Column) -> Column:
    """URL of a spatial reference, the latest id first; -1 is unset."""
    return F.concat(F.lit("http://www.opengis.net/def/crs/EPSG/0/"), F.coalesce(F.nullif(latest, F.lit(-1)), F.nullif(wkid, F.lit(-1))).cast("string"))


def is_geographic(wkid: Column, latest: Column) -> Column:
    """Exactly one of the two well-known geographic systems is named, by either id."""
    named = lambda k: F.coalesce(wkid == k, F.lit(False)) | F.coalesce(latest == k, F.lit(False))
    return named(4326) != named(4490)


def version_number(s: Column) -> Column:
    """``major.minor`` as one number; null where a part is missing or above 255."""
    major = F.regexp_extract(s, r"^(\d{1,3})\.(\d{1,3})$", 1).try_cast("int")
    minor = F.regexp_extract(s, r"^(\d{1,3})\.(\d{1,3})$", 2).try_cast("int")
    return F.when((major <= 255) & (minor <= 255), major * 256 + minor)


def version_text(n: Column) -> Column:
    return F.concat_ws(".", F.shiftright(n, 8).cast("string"), n.bitwiseAND(255).cast("string"))


def height_unit(s: Column) -> Column:
    """Canonical name of a height unit; null if it is none. Case counts."""
    return lookup(s, HEIGHT_UNIT_ALIASES | {u: u for u in HEIGHT_UNITS})


def formats_of_mask(mask: Column) -> Column:
    """Names of the image formats whose bits are set, in the order of the bits."""
    each = F.array(*(F.when(mask.bitwiseAND(1 << i) != 0, F.lit(f)) for i, f in enumerate(IMAGE_FORMATS)))
    return F.filter(each, lambda x: x.isNotNull())


def texture_name(fmt: Column, semantic: Column) -> Column:
    """Resource name of a texture by format and meaning."""
    group = F.when(fmt.isin("jpg", "png"), 2).when(fmt == "dds", 8).when(fmt == "ktx2", 5)
    offset = F.when(semantic == "normal", 0).when(semantic.isin("occlusion", "metallic_roughness"), 1).when(semantic == "emissive", 2)
    base = F.when(fmt == "dds", "0_0_1").when(fmt == "ktx", "0_0_2").when(fmt == "basis", "2").when(fmt == "ktx2", "1").otherwise("0")
    return F.coalesce((group + offset).cast("string"), base)


def gzip_wanted(mime: Column) -> Column:
    return ~mime.isin(*NEVER_GZIPPED)


def variant_text(v: Column) -> Column:
    """A simple value as text; ``<Null>`` for nothing."""
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("<Null>"))


def variant_number(v: Column) -> Column:
    """A simple value as a number; 0 for nothing and for a text that is none."""
    return F.coalesce(F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "boolean").cast("double"), F.lit(0.0))
