"""Column functions: tapers, scalar maths, binary decoding. Catalyst expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxelwave.functions.dsp import TAPER_WEIGHTS

__all__ = ["TAPER_WEIGHTS"]


def taper(name: str, k: Column, n: int) -> Column:
    """Value k (from 0) of a taper of length n."""
    if n == 1:
        return F.lit(1.0)
    if name == "bohmanwin":
        x = F.abs(2 * k / F.lit(n - 1.0) - 1)
        return F.when((k == 0) | (k == n - 1), 0.0).otherwise((1 - x) * F.cos(F.pi() * x) + F.sin(F.pi() * x) / F.pi())
    out = F.lit(0.0)
    for j, w in enumerate(TAPER_WEIGHTS[name]):
        out = out + F.lit((-1) ** j * w) * F.cos(2 * j * F.pi() * k / F.lit(n - 1.0))
    return out


def taper_array(name: str, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: taper(name, k, n))


def sinc(x: Column) -> Column:
    return F.when(x == 0, 1.0).otherwise(F.sin(F.pi() * x) / F.nullif(F.pi() * x, F.lit(0.0)))


def clamp(x: Column, low: float | None = None, high: float | None = None) -> Column:
    out = x if high is None else F.least(x, F.lit(high))
    return out if low is None else F.greatest(out, F.lit(low))


def polyval(coefficients, x: Column) -> Column:
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + float(c)
    return out


def hertz_to_erb_scale(f: Column) -> Column:
    return 21.4 * F.log10(1 + 0.00437 * f)


def erb_scale_to_hertz(e: Column) -> Column:
    return (F.pow(F.lit(10.0), e / 21.4) - 1) / 0.00437


def hertz_to_erb(f: Column) -> Column:
    return 24.7 * (0.00437 * f + 1)


def nextpow2(x: Column) -> Column:
    return F.ceil(F.log2(x))


def wavelet_cycles(f: Column, frequency_range=(2.0, 200.0), cycle_range=(3.0, 20.0)) -> Column:
    (f0, f1), (c0, c1) = frequency_range, cycle_range
    share = (F.log(f) - F.log(F.lit(float(f0)))) / (F.log(F.lit(float(f1))) - F.log(F.lit(float(f0))))
    return F.exp(F.log(F.lit(float(c0))) + share * (F.log(F.lit(float(c1))) - F.log(F.lit(float(c0)))))


# complex numbers as struct<re,im>


def cadd(a: Column, b: Column) -> Column:
    return F.struct((a["re"] + b["re"]).alias("re"), (a["im"] + b["im"]).alias("im"))


def cmul(a: Column, b: Column) -> Column:
    return F.struct((a["re"] * b["re"] - a["im"] * b["im"]).alias("re"), (a["re"] * b["im"] + a["im"] * b["re"]).alias("im"))


def cabs2(a: Column) -> Column:
    return a["re"] * a["re"] + a["im"] * a["im"]


# binary decoding, little-endian


def _word(raw: Column, width: int, i: Column) -> Column:
    """Unsigned value of the i-th word (from 0); widths up to 4 bytes."""
    out = F.lit(0).cast("bigint")
    for k in range(width - 1, -1, -1):
        byte = F.conv(F.hex(F.substring(raw, i * width + (k + 1), F.lit(1))), 16, 10).cast("bigint")
        out = out * 256 + byte
    return out


def _words(raw: Column, width: int, made) -> Column:
    n = F.octet_length(raw)
    bad = n % width != 0
    whole = F.when(bad, F.raise_error(F.lit(f"length must be a multiple of {width}")).cast("int")).otherwise((n / width).cast("int"))
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), whole - 1), lambda i: made(_word(raw, width, i))))


def _signed(width: int):
    half, full = 1 << (8 * width - 1), 1 << (8 * width)
    return lambda u: F.when(u >= half, u - full).otherwise(u)


def raw_to_uint8(raw: Column) -> Column:
    return _words(raw, 1, lambda u: u).cast("array<int>")


def raw_to_int8(raw: Column) -> Column:
    return _words(raw, 1, _signed(1)).cast("array<int>")


def raw_to_uint16(raw: Column) -> Column:
    return _words(raw, 2, lambda u: u).cast("array<int>")


def raw_to_int16(raw: Column) -> Column:
    return _words(raw, 2, _signed(2)).cast("array<int>")


def raw_to_uint32(raw: Column) -> Column:
    return _words(raw, 4, lambda u: u)


def raw_to_int32(raw: Column) -> Column:
    return _words(raw, 4, _signed(4)).cast("array<int>")


def raw_to_int64(raw: Column) -> Column:
    """Two 4-byte halves; the upper one carries the sign."""
    n = F.octet_length(raw)
    whole = F.when(n % 8 != 0, F.raise_error(F.lit("length must be a multiple of 8")).cast("int")).otherwise((n / 8).cast("int"))
    word = lambda i: F.shiftleft(_word(raw, 4, i * 2 + 1), 32).bitwiseOR(_word(raw, 4, i * 2))
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), whole - 1), word))


def raw_to_float(raw: Column) -> Column:
    """IEEE-754 single precision, from sign, exponent and fraction."""

    def make(u: Column) -> Column:
        sign = F.when(u >= 1 << 31, -1.0).otherwise(1.0)
        e = F.shiftright(u, 23).bitwiseAND(F.lit(255).cast("bigint"))
        f = u.bitwiseAND(F.lit((1 << 23) - 1).cast("bigint")).cast("double") / float(1 << 23)
        special = F.when(f == 0, sign * F.lit(float("inf"))).otherwise(F.lit(float("nan")))
        return F.when(e == 255, special).when(e == 0, sign * f * 2.0**-126).otherwise(sign * (1 + f) * F.pow(F.lit(2.0), (e - 127).cast("double")))

    n = F.octet_length(raw)
    whole = F.when(n % 4 != 0, F.raise_error(F.lit("length must be a multiple of 4")).cast("int")).otherwise((n / 4).cast("int"))
    return F.when(n == 0, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), whole - 1), lambda i: make(_word(raw, 4, i))))


def raw_to_string(raw: Column) -> Column:
    """Text up to the first NUL."""
    return F.substring_index(F.decode(raw, "UTF-8"), "\0", 1)
