"""Safe ratios, the four kinds of percentile, cost and rate arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_ratio(part: Column, whole: Column) -> Column:
    """0 where the whole is 0 or null."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return F.round(100 * safe_ratio(part, whole), 2)


def interpolated(c: Column, p: float) -> Column:
    """Percentile with linear interpolation; null for no values."""
    return F.percentile(c, F.lit(p))


def nearest_rank(c: str, p: float) -> Column:
    """The value of rank ceil(p n), at least the first."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c})")


def upper_median(df: DataFrame, group: list[str], value: str, out: str = "upper_median") -> DataFrame:
    """(group, out): of n sorted values that at place n div 2 from 0. Ranks are made without gathering a group."""
    from siltstone.plans.ranks import average_ranks

    ranks = average_ranks(df, group, value, False, "_r")
    sizes = df.where(F.col(value).isNotNull()).groupBy(*group).agg(F.floor(F.count(value) / 2 + 1).alias("_k"))
    half = (F.col("_r_ties") - 1) / 2.0
    return ranks.join(sizes, group).where((F.col("_k") >= F.col("_r") - half) & (F.col("_k") <= F.col("_r") + half)).select(*group, F.col(value).alias(out))


def cost(prompt: Column, completion: Column, per_million_in: float = 0.40, per_million_out: float = 1.60) -> Column:
    """Price of a model call; null if either count is."""
    return prompt / 1e6 * per_million_in + completion / 1e6 * per_million_out


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
