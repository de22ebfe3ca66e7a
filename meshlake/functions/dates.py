"""Dates by a format mask: checked, and turned into epoch milliseconds and ISO 8601 text.

A mask has YYYY, MM, DD, hh, mm, ss, sss and at the end Z. One character stands between numbers.
Hours run to 24 and days to 31 in any month; what overflows goes on into the next day or month.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mask element: (name, smallest, largest)
_ELEMENTS = {"YYYY": ("year", 0, 9999), "MM": ("month", 1, 12), "DD": ("day", 1, 31), "hh": ("hour", 0, 24), "mm": ("minute", 0, 59), "ss": ("second", 0, 59), "sss": ("ms", 0, 999)}
_MASK = re.compile(r"YYYY|MM|DD|hh|mm|sss|ss|Z")


def parse_mask(mask: str) -> list[str]:
    """Elements in order; raises where the mask has none or Z is not last."""
    found = _MASK.findall(mask)
    if not found or "Z" in found[:-1] or re.sub(r"YYYY|MM|DD|hh|mm|sss|ss|Z|[-/:. T]", "", mask):
        raise ValueError(f"not a date mask: {mask!r}")
    return found


def _pattern(elements: list[str]) -> str:
    numbers = [e for e in elements if e != "Z"]
    out = r"[^0-9]".join(r"([0-9]+)" for _ in numbers)
    return "^" + out + (r"(Z|[+-][0-9]{1,2}:[0-9]{2})$" if "Z" in elements else r"([^0-9].*)?$")


def epoch_millis(s: Column, mask: str, offset_minutes: int = 0) -> Column:
    """Milliseconds since 1970 in UTC; null where the text doesn't fit the mask or a part is out of range.

    ``offset_minutes`` is the layer's own offset; an offset in the text takes its place.
    """
    elements = parse_mask(mask)
    pattern = _pattern(elements)
    numbers = [e for e in elements if e != "Z"]
    if len(elements) > len(numbers):
        tail = F.regexp_extract(s, pattern, len(numbers) + 1)
        found = F.struct(F.split(s, "[^0-9]", len(numbers) + 1).alias("parts"), tail.alias("tail"))
    else:
        found = F.struct(F.split(s, "[^0-9]", len(numbers) + 1).alias("parts"), F.lit("").alias("tail"))
    # The text is matched and split once; its parts are then named as often as it takes.
    return F.get(F.transform(F.array(F.when(F.regexp_like(s, F.lit(pattern)), found)), lambda x: _millis(x, elements, numbers, offset_minutes)), F.lit(0))


def _millis(x: Column, elements: list[str], numbers: list[str], offset_minutes: int) -> Column:
    part: dict[str, Column] = {}
    ok = x.isNotNull()
    for i, e in enumerate(numbers):
        name, lo, hi = _ELEMENTS[e]
        part[name] = F.get(x["parts"], F.lit(i)).try_cast("int")
        ok = ok & part[name].between(lo, hi)
    get = lambda name, default: part.get(name, F.lit(default))
    first = F.make_date(get("year", 1970), get("month", 1), F.lit(1))
    days = F.unix_date(first) + get("day", 1) - 1
    seconds = get("hour", 0) * 3600 + get("minute", 0) * 60 + get("second", 0)
    minutes = F.lit(offset_minutes)
    if len(elements) > len(numbers):
        tail = x["tail"]
        hours = F.regexp_extract(tail, r"^[+-]([0-9]{1,2}):", 1).try_cast("int")
        mins = F.regexp_extract(tail, r":([0-9]{2})$", 1).try_cast("int")
        ok = ok & ((tail == "Z") | (hours.between(0, 14) & mins.between(0, 59)))
        minutes = F.when(tail == "Z", 0).otherwise(F.when(tail.startswith("-"), -1).otherwise(1) * (hours * 60 + mins))
    millis = days.cast("long") * 86_400_000 + seconds.cast("long") * 1000 + get("ms", 0).cast("long") - minutes.cast("long") * 60_000
    return F.when(ok, millis)


def iso8601(millis: Column, offset_minutes: int = 0) -> Column:
    """ISO 8601 with milliseconds and Z or the offset."""
    sign, minutes = ("-" if offset_minutes < 0 else "+"), abs(offset_minutes)
    suffix = f"{sign}{minutes // 60:02d}:{minutes % 60:02d}" if offset_minutes else "Z"
    local = F.timestamp_millis(millis + offset_minutes * 60_000)
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit(suffix))


def to_iso8601(s: Column, mask: str, offset_minutes: int = 0) -> Column:
    """Null and empty stay; what doesn't parse becomes null."""
    return F.when(s == "", "").otherwise(iso8601(epoch_millis(s, mask, offset_minutes), offset_minutes))


def is_leap_year(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def leap_days_between(first: Column, last: Column) -> Column:
    """Leap days of the years from ``first`` up to, not with, ``last``."""
    before = lambda y: F.floor((y - 1) / 4) - F.floor((y - 1) / 100) + F.floor((y - 1) / 400)
    return (before(last) - before(first)).cast("int")


def layer_timestamp(millis: Column) -> Column:
    """A layer's time, or now where it isn't set (null, or not above 0)."""
    return F.coalesce(F.when(millis > 0, millis), F.unix_millis(F.current_timestamp()))
