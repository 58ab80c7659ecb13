"""Numbers as the engine writes and reads them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 2) -> Column:
    """floor(x * 10^digits + 0.5) / 10^digits on doubles; halves go up, also below zero. NaN says nothing: null."""
    scale = F.lit(float(10**digits))
    return F.when(~F.isnan(x), F.floor(x * scale + F.lit(0.5)).cast("double") / scale)


def parse_float(c: Column) -> Column:
    """The number at the start of a text, else null."""
    return F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def answer(c: Column) -> Column:
    """A likelihood in [0, 1]; null for unknown, ? and whatever is no such number."""
    v = parse_float(c)
    return F.when(~F.lower(F.trim(c)).isin("unknown", "?") & (v >= 0) & (v <= 1), v)


def aspect_label(width: Column, height: Column) -> Column:
    ok = (width > 0) & (height > 0)
    return F.when(ok, F.concat(F.lit("aspect_"), F.format_string("%.2f", width.cast("double") / height))).otherwise(F.lit(""))


def fit_scale(width: Column, height: Column, longest: int) -> Column:
    """Factor that fits the longer side, never above 1."""
    return F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))


def damage_percent(bad_pixels: Column, width: Column, height: Column) -> Column:
    return bad_pixels / F.greatest(F.lit(1).cast("long"), width.cast("long") * height) * 100.0


def clamp_range(low: Column, high: Column) -> tuple[Column, Column, Column]:
    """(low, high, their difference): low not below 0, high not below low."""
    low = F.greatest(F.lit(0.0), low)
    high = F.greatest(low, high)
    return low, high, high - low


def fixed(x: Column, digits: int = 2, before: str = "", after: str = "") -> Column:
    """A number with so many decimals, in a frame of text. Null and NaN stay null."""
    shown = F.format_string(f"%.{digits}f", F.when(~F.isnan(x.cast("double")), x.cast("double")))
    return F.when(x.isNotNull() & ~F.isnan(x.cast("double")), F.concat(F.lit(before), shown, F.lit(after)))


def kilobytes(size: Column) -> Column:
    return fixed(size / F.lit(1024.0), 1, after=" KB")


def grouped(x: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(x, 0)
