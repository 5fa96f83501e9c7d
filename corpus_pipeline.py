"""A corpus pipeline: quality classifier, near-duplicates, secrets, source mix, byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, classifier, mixing, secrets, simhash
from tessera.llm.shared import dropped, stored, swept

#: Each takes (spark, docs, sf_dir); its result is written and read again as the next one's docs.
STAGES = [
    ("quality classifier", classifier.stage),
    ("near-duplicates", simhash.stage),
    ("secrets", secrets.stage),
    ("source mix", mixing.stage),
    ("byte-level BPE", bpe.stage),
]

#: The hashes, trees and merges of the stages are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's table is written to the shared folder; once it is there, the one before and what the stage made on its way are deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = docs
        with swept(spark) as keep:
            docs = stored(stage(spark, before, sf_dir), name.replace(" ", "-"))
            keep.append(docs)
        dropped(before)
    return docs
