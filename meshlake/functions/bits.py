"""Bits, powers of two and screen sizes as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def bits_set(mask: Column, width: int = 32) -> Column:
    """Numbers of the set bits, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda b: F.getbit(mask, b) == 1)


def is_power_of_two(n: Column) -> Column:
    return n.bitwiseAND(n - 1) == 0


def first_bit_set(n: Column) -> Column:
    """One more than the number of the highest set bit; 0 for 0."""
    return F.length(F.regexp_replace(F.bin(n), "^0+", ""))


def nth_bit_set(mask: Column, n: Column) -> Column:
    """Number of the n-th set bit from below, -1 where there are fewer."""
    return F.coalesce(F.try_element_at(bits_set(mask), n), F.lit(-1))


def bits_below(mask: Column, bit: Column) -> Column:
    """How many bits are set below ``bit``."""
    return F.size(F.filter(bits_set(mask), lambda b: b < bit))


def round_up_power(n: Column) -> Column:
    return F.when(n <= 1, n).otherwise(F.pow(F.lit(2.0), F.length(F.bin(n - 1))).cast("long"))


def round_down_power(n: Column) -> Column:
    return F.when(n < 1, n).otherwise(F.pow(F.lit(2.0), F.length(F.bin(n)) - 1).cast("long"))


def nearest_power(n: Column) -> Column:
    hi = round_up_power(n)
    lo = F.floor(hi / 2)
    return F.when(n - lo < hi - n, lo).otherwise(hi)


def texture_side(side: Column, most: int, power: bool) -> Column:
    """Side of a texture under a limit; to a power of two if asked, shrunk where rounding up exceeds the limit."""
    if not power:
        return F.least(side, F.lit(most))
    up = round_up_power(side)
    return F.when(side > most, F.lit(1 << (most.bit_length() - 1))).when(is_power_of_two(side), side).otherwise(F.when(up > most, F.floor(up / 2)).otherwise(up))


def screen_area(size: Column) -> Column:
    """Area of a disc of this diameter."""
    return size * size * (math.pi / 4)


def screen_size(area: Column) -> Column:
    return 2 * F.sqrt(area / math.pi)


def bytes_reversed(n: Column, width: int) -> Column:
    """The lowest ``width`` bytes of a number in the other order, as a number."""
    out = F.lit(0).cast("long")
    for i in range(width):
        byte = F.shiftrightunsigned(n.cast("long"), 8 * i).bitwiseAND(255)
        out = out.bitwiseOR(F.shiftleft(byte, 8 * (width - 1 - i)))
    return out
