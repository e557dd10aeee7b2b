"""Histograms and box statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.operators.predicates import with_keys
from tillwise.operators.ranking import exact_quantiles
from tillwise.session import store


def histogram(
    df: DataFrame, value: str, bins: int, by: Sequence[str] = (), count: str = "customers"
) -> DataFrame:
    """Rows per equal-width bin between the smallest and largest value, optionally per group.

    All groups share the bins; bins without rows do not appear.  Values are counted and stored once; limits and
    bins both come from the counts.
    """
    x = F.col(value).cast("double")
    counts = with_keys(df, *by).select(*by, x.alias("_x")).where("_x IS NOT NULL")
    counts = store(counts.groupBy(*by, "_x").agg(F.count("*").alias("_n")))
    limits = counts.agg(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi"))).scalar()
    df = counts.withColumn("_limits", limits)
    low, high, x = F.col("_limits.lo"), F.col("_limits.hi"), F.col("_x")
    place = F.coalesce(F.floor(F.try_divide((x - low) * bins, high - low)), F.lit(0))
    df = df.withColumns(
        {
            "bin": F.least(place, F.lit(bins - 1)).cast("int"),
            "_width": (high - low) / bins,
            "_low": low,
        }
    )
    start = F.col("_low") + F.col("bin") * F.col("_width")
    return (
        df.groupBy(*by, "bin", "_low", "_width")
        .agg(F.sum("_n").alias(count))
        .select(*by, "bin", start.alias("bin_start"), (start + F.col("_width")).alias("bin_end"), count)
    )


def readable_step(width: Column) -> Column:
    """The least of 1, 2, 5 and 10 times a power of ten that is not below ``width``; null unless ``width`` is above 0."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(width)))
    step = F.lit(10.0)
    for m in (5.0, 2.0, 1.0):
        step = F.when(width <= power * m, m).otherwise(step)
    return F.when(width > 0, power * step)


def auto_histogram(df: DataFrame, value: str, by: Sequence[str] = (), count: str = "customers", most: int = 200) -> DataFrame:
    """Rows per bin where no number of bins is given: bins start at multiples of a readable width.

    The width is twice the interquartile range divided by the cube root of the number of values, and at least a
    ``most``-th of the whole range, rounded up by ``readable_step``.  If half of all values are equal, the range decides alone;
    if all are, there is one bin of width 1.  All groups share the bins; bins without rows do not appear.
    """
    x = F.col(value).cast("double")
    counts = with_keys(df, *by).select(*by, x.alias("_x")).where("_x IS NOT NULL")
    counts = store(counts.groupBy(*by, "_x").agg(F.count("*").alias("_n")))
    edges = exact_quantiles(counts, "_x", 4, weight="_n")
    spread = 2 * (F.col("edge_3") - F.col("edge_1")) / F.pow(F.col("n").cast("double"), F.lit(1 / 3))
    width = F.greatest(spread, (F.col("edge_4") - F.col("edge_0")) / most)
    step = store(edges.select(F.coalesce(readable_step(width), F.lit(1.0)).alias("_step"))).agg(F.max("_step")).scalar()
    start = F.floor(F.col("_x") / F.col("_step"))
    return (
        counts.withColumn("_step", step)
        .groupBy(*by, start.alias("_at"), "_step")
        .agg(F.sum("_n").alias(count))
        .select(
            *by,
            (F.col("_at") * F.col("_step")).alias("bin_start"),
            ((F.col("_at") + 1) * F.col("_step")).alias("bin_end"),
            count,
        )
    )


def box_stats(df: DataFrame, value: str, by: str) -> DataFrame:
    """Quartiles, whiskers (the outermost values within 1.5 interquartile ranges) and outlier count.

    Rows are counted per group and value first; whiskers and outliers come from these counts, so a group
    of any size has a row per distinct value at most.
    """
    counts = store(with_keys(df, by, value).groupBy(by, value).agg(F.count("*").alias("_n")))
    names = ("minimum", "q1", "median", "q3", "maximum")
    quartiles = store(
        exact_quantiles(counts, value, 4, [by], weight="_n").select(
            by,
            F.col("n").alias("customers"),
            *[F.col(f"edge_{k}").alias(name) for k, name in enumerate(names)],
        )
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    x = F.col(value).cast("double")
    inside = (x >= F.col("q1") - reach) & (x <= F.col("q3") + reach)
    whiskers = (
        counts.join(quartiles.select(by, "q1", "q3"), by)
        .groupBy(by)
        .agg(
            F.min(F.when(inside, x)).alias("lower_whisker"),
            F.max(F.when(inside, x)).alias("upper_whisker"),
            F.sum(F.when(inside, 0).otherwise(F.col("_n"))).alias("outliers"),
        )
    )
    return quartiles.join(whiskers, by)
