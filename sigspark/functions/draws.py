"""Random numbers as functions of a key: the same on every engine, in every partitioning and on every rerun."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*key: Column | str | int) -> Column:
    """A number in [0, 1) from the key's parts: the first 32 bits of their MD5."""
    parts = [k if isinstance(k, Column) else F.lit(str(k)) for k in key]
    text = F.concat_ws("|", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(*key: Column | str | int) -> Column:
    """A standard normal number, by Box and Muller."""
    u = F.greatest(uniform(*key, "r"), F.lit(1e-12))
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * pi * uniform(*key, "a"))


def exponential(*key: Column | str | int) -> Column:
    return -F.ln(F.greatest(uniform(*key), F.lit(1e-12)))
