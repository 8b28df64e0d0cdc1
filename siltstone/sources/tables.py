"""Parquet tables of a directory, as DataFrames with only the columns asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch sent to a Python worker: rows alone would not bound batches of long texts.
BATCH_BYTES = 32 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """Lowers the session's Arrow batch size in bytes to ``limit`` if it is higher."""
    if int(spark.conf.get(_SETTING).rstrip("bB")) > limit:
        spark.conf.set(_SETTING, str(limit))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """``name`` of ``sf_dir``; ``columns`` prunes the scan. All rows, no filter."""
    bound_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def delivered_once(df: DataFrame, key: str = "id", time: str = "created_at") -> DataFrame:
    """One row per ``key``: the earliest delivery.

    A record delivered again has equal values but a later ``time``. Rows with a null key are
    kept apart from each other by nothing and count as one record. Ties on ``time`` are equal
    rows. Partial aggregation keeps one row per key before the shuffle.
    """
    others = [c for c in df.columns if c not in (key, time)]
    out = df.groupBy(key).agg(F.min_by(F.struct(*others), F.col(time)).alias("_rest"), F.min(time).alias(time))
    # min_by skips null times; a record whose every delivery has no time keeps any of its equal rows.
    return out.select(key, *[F.col(f"_rest.{c}").alias(c) for c in others], time)
