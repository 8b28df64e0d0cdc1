"""Cutting lineage with written tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and all executors are threads of this process (tests, a single machine)
    a temporary folder is made and set; it is deleted when the process ends.
    """
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set {SETTING} to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the application's own part of the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str = "cut") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, safe if executors are lost."""
    spark = df.sparkSession
    path = scratch(spark, label)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def cleared(spark: SparkSession) -> None:
    """Deletes every table that this application has written: call it when its results are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
