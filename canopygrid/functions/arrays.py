"""Array expressions: histograms, votes, planes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at_most_one(x: Column) -> Column:
    """``x`` clamped to 0 to 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def added(a: Column, b: Column) -> Column:
    """Element-wise sum; arrays of unlike size fail."""
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: x + y)).otherwise(F.raise_error("arrays of unlike shape").cast("array<double>"))


def normalized(histogram: Column, prior: Column, bias: float = 0.0, use_prior: bool = True) -> Column:
    """A leaf's distribution: counts less ``bias`` of their sum and not below 0, as shares, times the share of the class in ``prior``.

    All zero if nothing is left; with priors the result doesn't sum to 1.
    """
    double = lambda a: F.transform(a, lambda x: x.cast("double"))
    with_sum = F.transform(F.array(F.struct(double(histogram).alias("h"), total(double(histogram)).alias("n"), double(prior).alias("p"), total(double(prior)).alias("q"))), lambda s: F.struct(F.transform(s["h"], lambda x: F.greatest(F.lit(0.0), x - bias * s["n"])).alias("h"), s["p"].alias("p"), s["q"].alias("q")))
    shares = F.transform(with_sum, lambda s: F.struct(s["h"].alias("h"), total(s["h"]).alias("n"), s["p"].alias("p"), s["q"].alias("q")))
    weigh = (lambda s: F.zip_with(s["h"], s["p"], lambda x, p: F.when(s["n"] > 0, x / s["n"] * (p / s["q"])).otherwise(0.0))) if use_prior else (lambda s: F.transform(s["h"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(0.0)))
    return F.element_at(F.transform(shares, weigh), 1)


def dominant(histogram: Column) -> Column:
    """The first class with the highest count, from 0."""
    return (F.array_position(histogram, F.array_max(histogram)) - 1).cast("int")


def is_pure(histogram: Column) -> Column:
    return F.size(F.filter(histogram, lambda x: x > 0)) == 1


def voted(votes: Column) -> Column:
    """Summed votes as shares; all zero without any."""
    return F.element_at(F.transform(F.array(F.struct(votes.alias("v"), total(votes).alias("n"))), lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(0.0))), 1)
