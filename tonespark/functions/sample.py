"""Sample conversion and integer arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def float_to_int(v: Column, depth: int) -> Column:
    """Signed integer sample of ``depth`` bits: rounded half away from zero, clamped, NaN as 0."""
    scale = float(1 << (depth - 1))
    whole = F.least(F.greatest(F.round(v * scale), F.lit(-scale)), F.lit(scale - 1))
    return F.when(F.isnan(v), F.lit(0)).otherwise(whole).cast("long")


def int_to_float(q: Column, depth: int) -> Column:
    """Sample of full scale 1: a power of two is divided out."""
    return q.cast("double") / F.lit(float(1 << (min(max(depth, 1), 32) - 1)))


def zigzag(v: Column) -> Column:
    """0, -1, 1, -2 ... as 0, 1, 2, 3 ..."""
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(u: Column) -> Column:
    return F.shiftright(u, 1).bitwiseXOR(-u.bitwiseAND(F.lit(1).cast("long")))


def magnitude_bits(v: Column) -> Column:
    """Bits that a signed value takes, sign included."""
    folded = F.when(v < 0, -v - 1).otherwise(v)
    return F.when(folded == 0, F.lit(1)).otherwise(F.length(F.bin(folded)) + 1).cast("int")


def to_log(v: Column, steps: int = 128) -> Column:
    """Logarithm to base 2 in ``steps`` whole steps an octave; of what is below 1, that of 1."""
    return F.round(F.log2(F.greatest(v, F.lit(1)).cast("double")) * steps).cast("long")


def from_log(y: Column, steps: int = 128) -> Column:
    return F.pow(F.lit(2.0), y / F.lit(float(steps)))


def power_compand(v: Column, exponent: float = 0.75) -> Column:
    """Whole numbers whose steps grow with the value: the magnitude's power, rounded, with the sign."""
    return (F.signum(v) * F.round(F.pow(F.abs(v).cast("double"), F.lit(exponent)))).cast("long")


def power_expand(y: Column, exponent: float = 0.75) -> Column:
    return F.signum(y) * F.pow(F.abs(y).cast("double"), F.lit(1 / exponent))


def decibels(power_ratio: Column) -> Column:
    return F.lit(10.0) * F.log10(power_ratio)


def little_endian_hex(q: Column, octets: int) -> Column:
    """Two's complement bytes of an integer, least significant first, as hex."""
    low = q.bitwiseAND(F.lit((1 << (8 * octets)) - 1))
    big = F.lpad(F.hex(low), 2 * octets, "0")
    return F.concat(*[F.substring(big, 2 * k + 1, 2) for k in reversed(range(octets))])


def big_endian_hex(q: Column, octets: int) -> Column:
    return F.lpad(F.hex(q.bitwiseAND(F.lit((1 << (8 * octets)) - 1))), 2 * octets, "0")


def hex_to_signed(text: Column, octets: int) -> Column:
    """Signed value of big-endian two's complement hex."""
    v = F.conv(text, 16, 10).cast("long")
    return F.when(v >= 1 << (8 * octets - 1), v - F.lit(1 << (8 * octets))).otherwise(v)
