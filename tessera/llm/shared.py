"""Scratch tables in the cluster's shared folder, and small helpers the operators have in common."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, for Java's and Python's patterns alike: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir, which driver and executors share.

    Where that setting is missing, a temporary folder is made and set on one machine (as in tests); a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tessera/{uuid.uuid4().hex}/{name}"
    _MADE.append(path)
    return path


#: Paths that scratch() gave and nothing has deleted.
_MADE: list[str] = []


@contextmanager
def swept(spark: SparkSession):
    """Deletes, at its end, what was made in scratch folders meanwhile, but for the tables put into the list that it gives."""
    before, keep = set(_MADE), []
    yield keep
    kept = {getattr(df, "_tessera_path", None) for df in keep}
    for path in [p for p in _MADE if p not in before and p not in kept]:
        _delete(spark, path)


#: Makes Spark delete a query's shuffle files when it ends, rather than when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to scratch and read it back: cuts lineage, survives lost executors, frees its shuffle files."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete what stored() wrote, once no later step reads it."""
    if path := getattr(df, "_tessera_path", None):
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p.getParent(), True)
    if path in _MADE:
        _MADE.remove(path)


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """docs as one column `row` and the columns named, so that no other column's name can clash with those an operator adds."""
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), *columns)


def row_keys(docs: DataFrame, name: str) -> tuple[DataFrame, list[str]]:
    """(docs, two expressions that tell its rows apart): the file and the place in it that a row is read from. Rows that
    don't come straight from files are written first."""
    try:
        at = docs.metadataColumn("_metadata")
        docs.select(at["row_index"])
    except AnalysisException:
        docs = stored(docs, name)
        at = docs.metadataColumn("_metadata")
    return docs, [F.xxhash64(at["file_path"]), at["row_index"]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shards(spark: SparkSession, rows_or_bytes: int, per_shard: int) -> int:
    """Partitions so that each holds about per_shard; never fewer than the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(rows_or_bytes) // per_shard))


def hex64(c) :
    """A bigint's 64 bits as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(c)), 16, "0")


#: What a Python worker keeps from one task to the next, by name.
HELD: dict[str, object] = {}


def held(name: str, make):
    """What make() gives, made once in a worker and kept until something else is held or a tidy() task runs."""
    if name not in HELD:
        HELD.clear()
        HELD[name] = make()
    return HELD[name]


def tidy(op):
    """op for mapInArrow; workers serve one stage after the other, so before it what earlier stages held goes, and after it the memory
    that it took is given back to the machine."""

    @wraps(op)
    def run(batches):
        HELD.clear()
        _trim()
        yield from op(batches)
        _trim()

    return run


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; elsewhere nothing is done
    if trim:
        trim(0)
