"""Uniforms from hashes: the same for a key on any partitioning, and in other SQL engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 281474976710656.0  # 2**48


def uniform(*parts: Column | str | int | float) -> Column:
    """A number in (0, 1) from the first 48 bits of the md5 of the parts, joined by colons."""
    text = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return uniform_of(F.concat_ws(":", *text))


def uniform_of(key: Column) -> Column:
    bits = F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(SPAN)


def standard_normal(*parts: Column | str | int | float) -> Column:
    """Box-Muller of two such uniforms."""
    return F.sqrt(-2.0 * F.ln(uniform(*parts, "r"))) * F.cos(2.0 * F.pi() * uniform(*parts, "a"))
