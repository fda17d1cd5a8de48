"""Deterministic pseudo-random order from row keys.

A draw depends on the seed and the row key only, so a sample is the same under any
partitioning, after a task retry, and in any engine that has md5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: hex digits turned into the numeric draw (60 bits fit a signed long)
DRAW_DIGITS = 15
DRAW_RANGE = 16**DRAW_DIGITS


def _as_column(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def row_digest(seed, *keys) -> Column:
    """md5 hex text of ``seed:key1:key2…``; keys must identify a row."""
    parts = [_as_column(seed).cast("string"), *(_as_column(k).cast("string") for k in keys)]
    return F.md5(F.concat_ws(":", *parts))


def hex_to_long(digest: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def draw_number(digest: Column) -> Column:
    """Leading 60 bits of a digest; sorts like the digest itself."""
    return hex_to_long(digest, 1, DRAW_DIGITS)


def unit_draw(digest: Column) -> Column:
    """Uniform double in [0, 1) from the leading 52 bits."""
    return hex_to_long(digest, 1, 13) / F.lit(float(16**13))
