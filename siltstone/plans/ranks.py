"""Ranks and running totals that never put one whole group into one task.

A window over a hot key sorts that key's rows in a single task. Here a group is first cut into
value buckets by a mergeable quantile sketch, each bucket is handled by its own window, and the
bucket totals (at most ``MAX_BUCKETS`` rows per group) give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_BUCKETS = 256


def average_ranks(df: DataFrame, group: list[str], value: str, best_high: bool, out: str, bucket_rows: int = 100_000) -> DataFrame:
    """Per distinct (group, value): competition rank with averaged ties, 1 for the best.

    Returns ``group + [value, out, out_ties]``. Nulls and NaN in ``value`` get no row. Equal
    values are counted before anything is shuffled, so one value holding most rows is one row.
    """
    v = F.col(value)
    counts = df.where(v.isNotNull() & ~F.isnan(v.cast("double"))).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    parts = F.least(F.lit(MAX_BUCKETS), F.ceil(F.count(F.lit(1)) / F.lit(bucket_rows))).cast("int")
    # Sketch of each group, split points only for groups larger than one bucket.
    marks = [i / MAX_BUCKETS for i in range(1, MAX_BUCKETS)]
    splits = counts.groupBy(*group).agg(parts.alias("_parts"), F.percentile_approx(value, marks, 2000).alias("_marks"))
    splits = splits.where("_parts > 1").select(*[F.col(c).alias(f"_g_{c}") for c in group], F.array_distinct("_marks").alias("_marks"))
    joined = counts.join(splits, [counts[c].eqNullSafe(splits[f"_g_{c}"]) for c in group], "left")
    below = F.coalesce(F.size(F.filter("_marks", lambda m: m < F.col(value))), F.lit(0))
    joined = joined.select(*[counts[c] for c in group], value, "_n", F.when(F.col("_marks").isNull(), 0).otherwise(below).alias("_b"))
    order = F.col(value).desc() if best_high else F.col(value).asc()
    inner = Window.partitionBy(*group, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = joined.withColumn("_before", F.coalesce(F.sum("_n").over(inner), F.lit(0)))
    totals = joined.groupBy(*group, "_b").agg(F.sum("_n").alias("_t"))
    outer = Window.partitionBy(*group).orderBy(F.col("_b").desc() if best_high else F.col("_b").asc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(c).alias(f"_o_{c}") for c in group], F.col("_b").alias("_ob"), F.coalesce(F.sum("_t").over(outer), F.lit(0)).alias("_off"))
    on = [local[c].eqNullSafe(offsets[f"_o_{c}"]) for c in group] + [local["_b"] == offsets["_ob"]]
    rank = F.col("_off") + F.col("_before") + (F.col("_n") + 1) / F.lit(2.0)
    return local.join(offsets, on).select(*[local[c] for c in group], value, rank.alias(out), F.col("_n").alias(f"{out}_ties"))


def running_total(df: DataFrame, key: str, order: str, tie: str, amount: Column, out: str, bucket: int = 4096) -> DataFrame:
    """``df`` with the sum of ``amount`` over the rows of ``key`` before the row, by (``order``, ``tie``).

    ``order`` is an integer column; buckets of ``bucket`` consecutive values are summed apart, so a
    key with a third of all rows is spread over many tasks. A null ``order`` counts as 0.
    """
    b = F.floor(F.coalesce(F.col(order), F.lit(0)) / F.lit(bucket))
    base = df.withColumn("_amount", amount).withColumn("_b", b)
    inner = Window.partitionBy(key, "_b").orderBy(F.coalesce(F.col(order), F.lit(0)), tie).rowsBetween(Window.unboundedPreceding, -1)
    local = base.withColumn("_in", F.coalesce(F.sum("_amount").over(inner), F.lit(0)))
    totals = base.groupBy(F.col(key).alias("_k"), F.col("_b").alias("_ob")).agg(F.sum("_amount").alias("_t"))
    outer = Window.partitionBy("_k").orderBy("_ob").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_k", "_ob", F.coalesce(F.sum("_t").over(outer), F.lit(0)).alias("_off"))
    joined = local.join(offsets, local[key].eqNullSafe(offsets["_k"]) & (local["_b"] == offsets["_ob"]))
    return joined.select(*[local[c] for c in df.columns], (F.col("_off") + F.col("_in")).alias(out))


def row_numbers(df: DataFrame, group: list[str], value: str, tie: str, out: str, best_high: bool = False, bucket_rows: int = 100_000) -> DataFrame:
    """``df`` with the place of each row in its group by ``value``, ties by ``tie``, from 1.

    Only rows of one group with equal values are sorted together. Rows with a null value or group are left out.
    """
    places = average_ranks(df, group, value, best_high, "_place", bucket_rows)
    places = places.select(*group, value, (F.col("_place") - (F.col("_place_ties") - 1) / 2.0).cast("bigint").alias("_first"))
    own = F.row_number().over(Window.partitionBy(*group, value).orderBy(tie))
    return df.join(places, [*group, value]).withColumn(out, F.col("_first") + own - 1).drop("_first")


def running(df: DataFrame, key: str, order: str, columns: dict[str, tuple[str, Column, bool]], bucket: int = 4096) -> DataFrame:
    """``df`` with running ``min``, ``max`` or ``sum`` per key by the integer column ``order``.

    ``columns``: output name -> (function, value, whether the row itself counts). Summed over buckets
    of consecutive orders and then within each, so a hot key is many tasks.
    """
    functions = {"min": F.min, "max": F.max, "sum": F.sum}
    join = {"min": F.least, "max": F.greatest, "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}
    base = df.withColumn("_b", F.floor(F.col(order) / F.lit(bucket)))
    for name, (_, value, _) in columns.items():
        base = base.withColumn(f"_v_{name}", value)
    inner, outer = Window.partitionBy(key, "_b").orderBy(order), Window.partitionBy("_k").orderBy("_ob").rowsBetween(Window.unboundedPreceding, -1)
    frame = lambda own: inner.rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    local = base.select("*", *[functions[f](f"_v_{n}").over(frame(own)).alias(f"_i_{n}") for n, (f, _, own) in columns.items()])
    totals = base.groupBy(F.col(key).alias("_k"), F.col("_b").alias("_ob")).agg(*[functions[f](f"_v_{n}").alias(f"_t_{n}") for n, (f, _, _) in columns.items()])
    before = totals.select("_k", "_ob", *[functions[f](f"_t_{n}").over(outer).alias(f"_o_{n}") for n, (f, _, _) in columns.items()])
    joined = local.join(before, local[key].eqNullSafe(before["_k"]) & (local["_b"] == before["_ob"]))
    return joined.select(*[local[c] for c in df.columns], *[join[f](F.col(f"_i_{n}"), F.col(f"_o_{n}")).alias(n) for n, (f, _, _) in columns.items()])
