"""Codes as bytes: two 4-bit integers or one E4M3 value a byte, packed and unpacked by expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = "0123456789ABCDEF"
# No 4-bit code is -8, so it fills the last byte of an odd number of codes.
_FILL = "8"
_NAN = 0x7F


def pack_int4(codes: Column) -> Column:
    """An array of integers from -7 to 7 as binary, two to a byte; null gives null."""
    digits = F.transform(codes, lambda c: F.substring(F.lit(_DIGITS), F.pmod(c.cast("int"), F.lit(16)) + 1, F.lit(1)))
    text = F.array_join(digits, "")
    return F.unhex(F.when(F.size(codes) % 2 == 1, F.concat(text, F.lit(_FILL))).otherwise(text))


def unpack_int4(packed: Column) -> Column:
    """The array of codes that ``pack_int4`` was given."""
    digits = F.filter(F.split(F.hex(packed), ""), lambda d: (d != "") & (d != _FILL))
    value = lambda d: F.instr(F.lit(_DIGITS), d) - 1
    return F.transform(digits, lambda d: F.when(value(d) > 7, value(d) - 16).otherwise(value(d)).cast("tinyint"))


def _e4m3_byte(value: Column) -> Column:
    """The byte of an E4M3 value: sign, four bits of exponent, three of mantissa."""
    size = F.abs(value)
    exponent = F.floor(F.log2(F.when(size > 0, size).otherwise(F.lit(1.0))))
    # the logarithm may miss a power of two by its last digit
    exponent = exponent + F.when(size >= F.pow(F.lit(2.0), exponent + 1), 1).otherwise(0)
    normal = (exponent + 7) * 8 + (size / F.pow(F.lit(2.0), exponent) - 1) * 8
    magnitude = F.when(size < 2.0**-6, size * 2.0**9).otherwise(normal).cast("int")
    negative = (value < 0) | ((value == 0) & value.cast("string").startswith("-"))
    return F.when(F.isnan(value), F.lit(_NAN)).otherwise(magnitude + F.when(negative, 128).otherwise(0))


def _e4m3_value(byte: Column) -> Column:
    magnitude = F.pmod(byte, F.lit(128))
    exponent, mantissa = F.floor(magnitude / 8), F.pmod(magnitude, F.lit(8)).cast("double")
    normal = (mantissa / 8 + 1) * F.pow(F.lit(2.0), exponent - 7)
    value = F.when(exponent == 0, mantissa * 2.0**-9).otherwise(normal)
    signed = F.when(byte >= 128, -value).otherwise(value)
    return F.when(magnitude == _NAN, F.lit(float("nan"))).otherwise(signed)


def pack_e4m3(codes: Column) -> Column:
    """An array of E4M3 values (``fp8_codes``) as binary, one byte each; null gives null."""
    return F.unhex(F.array_join(F.transform(codes, lambda v: F.lpad(F.hex(_e4m3_byte(v)), 2, "0")), ""))


def unpack_e4m3(packed: Column) -> Column:
    """The array of values that ``pack_e4m3`` was given."""
    places = F.when(F.length(packed) > 0, F.sequence(F.lit(1), F.length(packed))).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.hex(F.substring(packed, i, F.lit(1))), 16, 10).cast("int")
    return F.when(packed.isNotNull(), F.transform(places, lambda i: _e4m3_value(byte(i))))


PACKINGS = {"int4": (pack_int4, unpack_int4), "e4m3": (pack_e4m3, unpack_e4m3)}
