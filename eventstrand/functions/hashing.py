"""Seeded pseudo-random columns that depend on row values only, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def md5_hex(*parts) -> Column:
    """md5 over the ``:``-joined parts (columns, or Python values taken as literals)."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in columns]))


def md5_int(*parts) -> Column:
    """First 32 bits of the md5 as a bigint."""
    return F.conv(F.substring(md5_hex(*parts), 1, 8), 16, 10).cast("bigint")


def md5_uniform(*parts) -> Column:
    """Uniform double in [0, 1)."""
    return md5_int(*parts) / F.lit(float(2**32))


def bits_below(probability: float, bits: Column) -> Column:
    """Are eight hex digits, read as a number in [0, 1), below ``probability``?  Compared as text, nothing is parsed."""
    limit = -int(-probability * 2**32 // 1)  # ceiling
    if limit >= 2**32:
        return F.lit(True)
    if limit <= 0:
        return F.lit(False)
    return bits < F.lit(f"{limit:08x}")


def md5_below(probability: float, *parts) -> Column:
    """``md5_uniform(*parts) < probability``."""
    return bits_below(probability, F.substring(md5_hex(*parts), 1, 8))
