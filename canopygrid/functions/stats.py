"""When to stop a search: a one-sided two-sample t-test on losses."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHA = 0.005
LEAST_RUNS = 3


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def t_tail(t: float, dof: float) -> float:
    """P(T > t) of Student's t for t >= 0."""
    x, a, b = dof / (dof + t * t), dof / 2, 0.5
    if x >= 1:
        return 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    low = front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b
    return low / 2


def continue_searching(best: list[float], run: list[float]) -> bool:
    """Whether a run of losses may still turn out as good as the best ones; variances are those of the population."""
    if not best or len(run) < LEAST_RUNS or min(run) <= max(best):
        return True
    n, m = len(best), len(run)
    mean = [sum(x) / len(x) for x in (best, run)]
    var = [sum((v - c) ** 2 for v in x) / len(x) for x, c in zip((best, run), mean)]
    dof = n + m - 2
    pooled = math.sqrt(((n - 1) * var[0] + (m - 1) * var[1]) / dof)
    if pooled == 0:
        return False
    return t_tail(abs((mean[0] - mean[1]) / (pooled * math.sqrt(1 / n + 1 / m))), dof) > ALPHA


def t_statistic(a: str, b: str) -> tuple[Column, Column]:
    """t and degrees of freedom of two groups in one aggregate over ``loss``; ``a`` and ``b`` are conditions."""
    of = lambda f, c: f(F.when(F.expr(c), F.col("loss")))
    n, m = of(F.count, a), of(F.count, b)
    dof = n + m - 2
    pooled = F.sqrt(F.try_divide((n - 1) * of(F.var_pop, a) + (m - 1) * of(F.var_pop, b), dof))
    return F.try_divide(of(F.mean, a) - of(F.mean, b), pooled * F.sqrt(F.try_divide(F.lit(1.0), n) + F.try_divide(F.lit(1.0), m))), dof


def keep_going(losses: DataFrame, group: str, best: str) -> DataFrame:
    """``group``, ``keep_going`` for each group of ``losses`` against the group named ``best``."""

    @F.arrow_udf("double")
    def tail(t: pa.Array, dof: pa.Array) -> pa.Array:
        return pa.array([None if a is None or n is None or n < 1 else t_tail(abs(a), n) for a, n in zip(t.to_pylist(), dof.to_pylist())], pa.float64())

    stats = losses.groupBy(group).agg(F.count("loss").alias("n"), F.mean("loss").alias("m"), F.var_pop("loss").alias("v"), F.min("loss").alias("low"), F.max("loss").alias("high"))
    base = stats.where(F.col(group) == best).select(F.col("n").alias("bn"), F.col("m").alias("bm"), F.col("v").alias("bv"), F.col("high").alias("worst"))
    # One row on one side.
    joined = stats.join(F.broadcast(base), F.lit(True), "left")
    dof = F.col("n") + F.col("bn") - 2
    pooled = F.sqrt(F.try_divide((F.col("bn") - 1) * F.col("bv") + (F.col("n") - 1) * F.col("v"), dof))
    t = F.try_divide(F.col("bm") - F.col("m"), pooled * F.sqrt(1 / F.col("bn") + 1 / F.col("n")))
    going = F.col("bn").isNull() | (F.col("n") < LEAST_RUNS) | (F.col("low") <= F.col("worst")) | F.coalesce(tail(t, dof) > ALPHA, F.lit(False))
    return joined.select(group, F.round(t, 9).alias("t"), dof.alias("dof"), going.alias("keep_going"))
