"""Queries that have or once had no SQL beside them: each processes every row of its table."""

import pytest
from pyspark.sql import functions as F

from tessera.catalogue import QUERIES
from tessera.functions import packed as P

SF_DIR = "/root/testdata/sf0.01"
IDS = {"tensor_gelu_erf": "vec_id", "quant_ternary": "vec_id", "embedding_output": "vec_id", "sample_dry": "ctx", "sample_draw": "ctx", "log_mel": "clip_id", "mel_clamped": "clip_id"}


@pytest.mark.parametrize("name", IDS)
def test_every_embedding(spark, name):
    want = {r.vec_id for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id").collect()}
    assert {r[0] for r in QUERIES[name](spark, SF_DIR).select(IDS[name]).distinct().collect()} == want


def test_every_step(spark):
    want = {(r.vec_id % 10, r.vec_id // 10) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id").collect()}
    assert {tuple(r) for r in QUERIES["sample_mirostat"](spark, SF_DIR).select("stream", "step").collect()} == want


@pytest.mark.parametrize("kind", P.LAYOUTS)
def test_every_part(spark, kind):
    want = spark.read.parquet(f"{SF_DIR}/part.parquet").count()
    got = QUERIES[f"decode_{kind}"](spark, SF_DIR).select("p_partkey", F.size("values").alias("n")).collect()
    assert len({r.p_partkey for r in got}) == len(got) == want and len({r.n for r in got}) == 1


def test_whole_texts(spark):
    """What stands behind a prefix counts: the results of a text follow its end."""
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    letters = {r.doc_id: r.letters for r in QUERIES["pretoken_counts"](spark, SF_DIR).select("doc_id", "letters").collect()}
    assert {d: len(x) for d, x in letters.items()} == {d: len(t.encode()) for d, t in text.items()}
    roman = {r.doc_id: r.roman for r in QUERIES["romanise"](spark, SF_DIR).select("doc_id", "roman").collect()}
    assert all(len(roman[d]) > 0.5 * len(t) for d, t in text.items())
