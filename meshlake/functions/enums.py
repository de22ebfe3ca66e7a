"""Names of enumerated values: canonical texts and the other spellings that are read as them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import HEIGHT_UNIT_ALIASES, HEIGHT_UNITS

# The texts of each enumeration, in the order of their numbers.
NAMES = {
    "alpha_mode": ("opaque", "mask", "blend"),
    "face_culling_mode": ("none", "front", "back"),
    "type": (
        "Int8", "UInt8", "Int16", "UInt16", "Int32", "UInt32", "Oid32", "Int64", "UInt64", "Oid64", "Float32", "Float64",
        "String", "Date", "GlobalID", "GUID",
    ),
    "domain_type": ("codedValue", "range"),
    "key_value_encoding_type": ("SeparatedKeyValues",),
    "legacy_topology": ("PerAttributeArray",),
    "vertex_attrib_ordering": ("position", "normal", "uv0", "color", "region"),
    "feature_attrib_ordering": ("id", "faceRange"),
    "geometry_header_property": ("vertexCount", "featureCount"),
    "mesh_topology": ("triangles", "lines", "points"),
    "encoding": ("none", "string-utf8"),
    "lod_metric_type": (
        "maxScreenThresholdSQ", "maxScreenThreshold", "distanceRangeFromDefaultCamera", "density-threshold", "screenSpaceRelative",
    ),
    "layer_type": ("3DObject", "IntegratedMesh", "Point", "PointCloud", "Building", "Voxel", "group"),
    "vb_binding": ("per-vertex", "per-uv-region", "per-feature"),
    "texture_filtering_mode": (
        "nearest", "linear", "nearest-mipmap-nearest", "linear-mipmap-nearest", "nearest-mipmap-linear", "linear-mipmap-linear",
    ),
    "texture_wrap_mode": ("clamp", "repeat"),
    "normal_reference_frame": ("east-north-up", "earth-centered", "vertex-reference-frame"),
    "compressed_mesh_attribute": ("position", "normal", "uv0", "color", "uv-region", "feature-index", "flag"),
    "attrib_header_property": ("count", "attributeValuesByteCount"),
    "attrib_ordering": ("attributeValues", "attributeByteCounts", "ObjectIds"),
    "compressed_geometry_format": ("Not_set", "draco", "lepcc"),
    "legacy_image_channel": ("rgba", "rgb"),
    "legacy_wrap_mode": ("none", "repeat", "mirror"),
    "mime_image_format": ("image/jpeg", "image/png", "image/vnd-ms.dds", "image/ktx", "image/basis", "image/ktx2"),
    "legacy_uv_set": ("uv0",),
    "value_encoding": ("UTF-8",),
    "time_encoding": ("ECMA_ISO8601",),
    "attribute_storage_info_encoding": ("embedded-elevation", "lepcc-xyz", "lepcc-rgb", "lepcc-intensity"),
    "bsl_filter_mode": ("solid", "wireFrame"),
    "height_model": ("gravity_related_height", "ellipsoidal", "orthometric"),
    "height_unit": HEIGHT_UNITS,
    "continuity": ("continuous", "discrete"),
    "base_quantity": ("horizontal-coordinate", "vertical-coordinate", "time", "none"),
    "pcsl_attribute_buffer_type": (
        "ELEVATION", "INTENSITY", "RGB", "CLASS_CODE", "FLAGS", "RETURNS", "POINTID", "USER_DATA", "POINT_SRC_ID", "GPS_TIME",
        "SCAN_ANGLE", "NEAR_INFRARED",
    ),
    "bounding_volume_type": ("obb", "mbs"),
    "vxl_variable_semantic": (
        "stc-hot-spot-results", "stc-cluster-outlier-results", "stc-estimated-bin", "generic-nearest-interpolated",
    ),
    "vertical_exag_mode": ("scale-position", "scale-height"),
    "rendering_quality": ("low", "medium", "high", "custom"),
    "interpolation": ("linear", "nearest"),
    "vxl_render_mode": ("volume", "surfaces"),
    "vxl_rw_stats_status": ("partial", "final"),
    "priority": ("High", "Low"),
    "semantic": ("None", "Labels"),
    "capability": ("View", "Query", "Edit", "Extract"),
}

# Other spellings that are read.
ALIASES = {
    "geometry_header_property": {"faceCount": "featureCount"},
    "mesh_topology": {"triangle": "triangles"},
    "attrib_ordering": {"objectIds": "ObjectIds"},
    "legacy_image_channel": {"": "rgb"},
    "mime_image_format": {
        "data:image/jpeg": "image/jpeg", "data:image/png": "image/png", "data:image/vnd-ms.dds": "image/vnd-ms.dds", "data:image/ktx": "image/ktx",
    },
    "height_unit": HEIGHT_UNIT_ALIASES,
}


def spellings(enumeration: str) -> dict[str, str]:
    """Every text that is read, with its canonical one."""
    return {n: n for n in NAMES[enumeration]} | ALIASES.get(enumeration, {})


def canonical(text: Column, enumeration: str) -> Column:
    """The canonical text of a value; null if the enumeration has none. Case counts."""
    pairs = [F.lit(x) for pair in spellings(enumeration).items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), text)


def number_of(text: Column, enumeration: str) -> Column:
    """The value's number, from 0; null for an unknown text."""
    order = {n: i for i, n in enumerate(NAMES[enumeration])}
    pairs = [F.lit(x) for spelled, name in spellings(enumeration).items() for x in (spelled, order[name])]
    return F.try_element_at(F.create_map(*pairs), text)


def name_of(number: Column, enumeration: str) -> Column:
    """The canonical text of a number; null outside the enumeration."""
    return F.get(F.array(*map(F.lit, NAMES[enumeration])), number.cast("int"))
