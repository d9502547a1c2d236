"""Random draws that only depend on their key: the same on any partitioning, in Spark, DuckDB and Python."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*key) -> Column:
    return F.md5(F.concat_ws("-", *[k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key]))


def number(*key) -> Column:
    """A long from 0 to 2**32 - 1."""
    return F.conv(F.substring(digest(*key), 1, 8), 16, 10).cast("long")


def draw(low: int, high: int, *key) -> Column:
    """A long from ``low`` to ``high``, both included."""
    if high < low:
        raise ValueError(f"no number from {low} to {high}")
    return number(*key) % (high - low + 1) + low


def unit(*key) -> Column:
    """A double from 0 up to 1."""
    return number(*key) / F.lit(2.0**32)


def draw_of(low: int, high: int, *key) -> int:
    """``draw`` in Python."""
    return int(hashlib.md5("-".join(map(str, key)).encode()).hexdigest()[:8], 16) % (high - low + 1) + low


class Sampler:
    """A sequence of uniform integers; each sampler of a source has a seed of its own."""

    def __init__(self, seed: int, low: int, high: int):
        if high < low:
            raise ValueError(f"no number from {low} to {high}")
        self.seed, self.low, self.high, self.drawn = seed, low, high, 0

    def next(self) -> int:
        self.drawn += 1
        return draw_of(self.low, self.high, self.seed, self.drawn)


class RandomSource:
    """Hands out samplers with consecutive seeds."""

    def __init__(self, seed: int):
        self.seed = seed

    def sampler(self, low: int, high: int) -> Sampler:
        self.seed += 1
        return Sampler(self.seed - 1, low, high)
