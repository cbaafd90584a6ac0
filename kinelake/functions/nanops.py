"""Missing values: numpy's NaN rules in Spark, where NaN compares above everything and sums propagate it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def gt(c: Column | str, x) -> Column:
    """NaN is greater than nothing."""
    c = col(c)
    return ~F.isnan(c) & (c > x)


def lt(c: Column | str, x) -> Column:
    c = col(c)
    return ~F.isnan(c) & (c < x)


def known(c: Column | str) -> Column:
    """NaN as null, for aggregates that should skip it."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def in_order(order: Column | str, value: Column | str) -> Column:
    """Aggregate: the values in the given order without nulls, for sums whose last bits may decide and must not depend on how rows were moved."""
    pairs = F.array_sort(F.collect_list(F.when(col(value).isNotNull(), F.struct(col(order).alias("at"), col(value).cast("double").alias("x")))))
    return F.transform(pairs, lambda p: p["x"])


def mean_of(values: Column) -> Column:
    """The mean of an array, summed from its first value on; null if it is empty."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def std_pop_of(values: Column) -> Column:
    """The population deviation of an array by Welford's recurrence from its first value on; null if it is empty."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s"))

    def step(a, x):
        m = a["m"] + (x - a["m"]) / (a["n"] + 1.0)
        return F.struct((a["n"] + 1.0).alias("n"), m.alias("m"), (a["s"] + (x - m) * (x - a["m"])).alias("s"))

    return F.when(F.size(values) > 0, F.aggregate(values, start, step, lambda a: F.sqrt(a["s"] / a["n"])))


def divide(a: Column, b: Column) -> Column:
    """Null where b is 0."""
    return F.try_divide(a, b)


def clip(c: Column | str, low, high) -> Column:
    return F.least(F.greatest(col(c), F.lit(low)), F.lit(high))


def moment_corr(x: Column | str, y: Column | str) -> Column:
    """Correlation as one aggregate from sums; null where either side is constant."""
    x, y = col(x), col(y)
    n = F.count(F.lit(1))
    cov = F.avg(x * y) - F.avg(x) * F.avg(y)
    vx, vy = F.avg(x * x) - F.avg(x) * F.avg(x), F.avg(y * y) - F.avg(y) * F.avg(y)
    return F.when((n > 1) & (vx > 1e-12) & (vy > 1e-12), cov / F.sqrt(vx * vy))


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Null for what isn't finite, else rounded."""
    c = col(c)
    return F.when(finite(c), F.round(c, digits))
