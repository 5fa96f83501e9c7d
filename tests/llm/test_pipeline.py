import hashlib

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, classifier, mixing, secrets
from tests.llm.test_mixing import plain_targets
from tests.llm.test_secrets import plain
from tests.llm.test_simhash import plain_similar


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    good = {r.doc_id for r in classifier.scores(docs, classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).where("score >= 0.3").collect()}
    comp = plain_similar({d: text[d] for d in good})
    kept = {d for d in good if comp[d] == d}
    clean = {d: secrets.redacted(text[d], secrets.all_spans(text[d])) for d in kept}
    assert all(not plain(t) for t in clean.values())
    size = {d: len(t.encode().split()) for d, t in clean.items()}
    by = {}
    for d in kept:
        by[source[d]] = by.get(source[d], 0) + size[d]
    goal = plain_targets(sorted(by.items()))
    items = []
    for s in by:
        cum = 0
        for h, d in sorted((hashlib.md5(f"{d}:mix".encode()).hexdigest(), d) for d in kept if source[d] == s):
            cum += size[d]
            items += [((cum + k * by[s]) / goal[s], h, d, k) for k in (0, 1) if size[d]]
    left, passes = 1.5 * sum(by.values()), []
    for _, _, d, _ in sorted(items):
        if (left := left - size[d]) < 0:
            break
        passes.append(d)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load(), special_tokens={})
    want = sorted((d, lib.encode_ordinary(clean[d])) for d in passes)
    got = sorted((r.doc_id, r.ids) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert [d for d, _ in got] == [d for d, _ in want]
    assert got == want


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert mixing.REPEATS == 2


def test_stages_keep_columns_of_any_name(spark, sf_dir, tmp_path):
    """Columns named as the operators name their own, rows that repeat, ids that repeat with other texts, and null ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = docs.where("doc_id in (3, 4)").unionByName(docs.where("doc_id = 5").withColumn("text", F.concat("text", F.lit("another text altogether")))).unionByName(docs.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long")))
    docs = docs.unionByName(more)
    names = ["score", "held_out", "predicted", "_text", "row", "findings", "n_hex", "clean_text", "kept_id", "mix_id", "mix_pass", "size", "h", "passes", "row_file", "row_at", "digest", "component_id", "_metadata_", "pass", "text_"]
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs.write.mode("overwrite").parquet(f"{tmp_path}/{stage.__module__}")
        before = spark.read.parquet(f"{tmp_path}/{stage.__module__}")
        docs = stage(spark, before, sf_dir)
        assert docs.dtypes == before.dtypes
        assert docs.where(" or ".join(f"`{c}` <> concat('{c}', cast(doc_id as string))" for c in names)).count() == 0
        assert stage(spark, before.limit(0), sf_dir).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == docs.count()


def test_scratch_is_deleted(spark, sf_dir):
    import os

    from tessera.llm import shared

    before = set(shared._MADE)
    out = corpus_pipeline.run(spark, sf_dir)
    assert set(shared._MADE) - before == {out._tessera_path}
    assert os.path.isdir(out._tessera_path.removeprefix("file:").replace("//", "/", 1)) and out.count()
