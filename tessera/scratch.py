"""Tables written on the way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def path(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir. Where that is missing, a temporary folder on one machine; a cluster is refused,
    as its executors don't share one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tessera/{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to a scratch table and read back, which cuts its lineage and survives lost executors."""
    to = path(df.sparkSession, name)
    df.write.parquet(to)
    out = df.sparkSession.read.schema(df.schema).parquet(to)
    out._scratch = to
    return out


def dropped(df: DataFrame) -> None:
    """Delete what stored() wrote, once no later step reads it."""
    if to := getattr(df, "_scratch", None):
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(to)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p.getParent(), True)
