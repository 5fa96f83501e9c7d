"""The table of queries over the engine's operators, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: Query -> ids of the operators it runs.
COVERS: dict[str, list[str]] = {}
_WIDER = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double"}


def query(name: str, covers: str, sql: str | None = None):
    """Register f(t) -> DataFrame, t(table name) giving a table; integers come out as bigint, floats as double."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Tables(spark, sf_dir))
            return out.select(*(F.col(f"`{c}`").cast(_WIDER[k]).alias(c) if k in _WIDER else F.col(f"`{c}`") for c, k in out.dtypes))

        if name in QUERIES:
            raise ValueError(name)
        run.__doc__, run.__name__ = f.__doc__, name
        QUERIES[name] = run
        COVERS[name] = covers.split()
        if sql:
            ORACLE[name] = sql
        return f

    return put


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table for work that is heavy per row: dealt out evenly if it has fewer splits than twice the cores, as a small
        file of one row group has; a table of many splits is read as it lies, without a shuffle."""
        df, cores = self(name), self.spark.sparkContext.defaultParallelism
        return df.repartition(4 * cores) if df.rdd.getNumPartitions() < 2 * cores else df


def r6(*names: str):
    """Columns rounded to six places, under their names."""
    return [F.round(F.col(n), 6).alias(n) for n in names]
