"""Column expressions for colours and texts made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def byte(v: Column) -> Column:
    """Truncated to a whole number from 0 to 255."""
    return F.greatest(F.least(v, F.lit(255.0)), F.lit(0.0)).cast("int")


def luminance(r="r", g="g", b="b") -> Column:
    """Rec. 709 luma, 0 to 1."""
    return (_c(r) * F.lit(0.2126) + _c(g) * F.lit(0.7152) + _c(b) * F.lit(0.0722)) / F.lit(255.0)


def srgb_to_linear(v: Column | str) -> Column:
    s = _c(v) / F.lit(255.0)
    lin = F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))
    return byte(F.floor(lin * 255.0 + 0.5))


def linear_to_srgb(v: Column | str) -> Column:
    x = _c(v) / F.lit(255.0)
    s = F.when(x <= 0.0031308, x * 12.92).otherwise(F.pow(x, F.lit(1 / 2.4)) * 1.055 - 0.055)
    return byte(F.floor(s * 255.0 + 0.5))


def over(v: Column | str, alpha: Column | str, back: Column | int) -> Column:
    """A channel laid over a background, truncated."""
    a = _c(alpha) / F.lit(255.0)
    return byte(_c(v) * a + (F.lit(back) if isinstance(back, int) else back) * (F.lit(1.0) - a))


def checkerboard(x="x", y="y", cell: int = 8, dark: int = 200, light: int = 240) -> Column:
    """Grey of the board that shows through transparent pixels."""
    return F.when((F.floor(_c(x) / cell) + F.floor(_c(y) / cell)) % 2 == 0, F.lit(light)).otherwise(F.lit(dark))


def hex_color(r="r", g="g", b="b") -> Column:
    return F.format_string("#%02x%02x%02x", _c(r), _c(g), _c(b))


def parse_hex(c: Column | str) -> list[Column]:
    """r, g, b of #rrggbb or rrggbb; null for anything else."""
    digits = F.regexp_extract(F.lower(_c(c)), "^#?([0-9a-f]{6})$", 1)
    part = lambda at: F.when(F.length(digits) == 6, F.conv(F.substring(digits, at, 2), 16, 10).cast("int"))
    return [part(1), part(3), part(5)]


def one_decimal(v: Column) -> Column:
    """One digit behind the point, rounded from the exact binary value, exact halves to even. The fraction is taken as a
    whole number of 2 ** -58 and compared in whole numbers."""
    v = v.cast("double")
    size = F.abs(v)
    whole, unit = F.floor(size), 1 << 58
    scaled = (size - whole) * F.lit(float(unit))
    n = F.floor(scaled) * 10
    digit, rest = F.shiftright(n, 58), n.bitwiseAND(F.lit(unit - 1))
    rest = rest * 2 + F.when(scaled > F.floor(scaled), 1).otherwise(0)
    up = (rest > unit) | ((rest == unit) & (digit % 2 == 1))
    tenths = whole * 10 + digit + F.when(up, 1).otherwise(0)
    return F.concat(F.when(v < 0, "-").otherwise(""), F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def duration(ms: Column | str) -> Column:
    ms = _c(ms)
    return (
        F.when(ms < 1000, F.format_string("%dms", ms))
        .when(ms < 60_000, F.concat(one_decimal(ms / 1000), F.lit("s")))
        .otherwise(F.format_string("%dm %ds", F.floor(ms / 60_000), F.floor(ms % 60_000 / 1000)))
    )
