import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import rules
from tests.llm.helpers import documents


def plain(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_measures_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: plain(r.text) for r in docs.collect()}
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rules.measures(docs).collect()}
    assert got == want


def test_against_sql(spark):
    for sf_dir in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        con = duckdb.connect()
        for t in ("documents", "labels"):
            con.execute(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
        want = sorted(con.execute(rules.OP2_SQL).fetchall())
        got = sorted(tuple(r) for r in rules.op2_quality_rules(spark, sf_dir).collect())
        assert got == want


def test_risk_is_controlled_and_junk_goes(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = rules.op2_quality_rules(spark, sf_dir).toPandas()
    both = got.merge(spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas(), on="doc_id")
    good = both[(both.quality == 1) & ~both.base_failed]
    assert 1 - good.kept.mean() <= rules.RISK
    passing = both[(both.quality == 0) & ~both.base_failed]
    assert passing.kept.mean() < 0.5


def test_native_plan(spark, sf_dir):
    plan = rules.op2_quality_rules(spark, sf_dir)._jdf.queryExecution().toString() + rules.measures(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize(("k", "n"), [(0, 1), (0, 500), (3, 1000), (0, 0), (40, 10_000), (5, 100), (400, 100_000), (4_500, 1_000_000)])
def test_binomial_tail(spark, k, n):
    p = 0.005
    got = spark.range(1).select(rules.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
    if k >= n * p:
        assert got == 1.0
    else:
        want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1))
        assert got == pytest.approx(want, rel=1e-7, abs=1e-300)


def test_edge_cases(spark):
    texts = [None, "", " \t\n\x0b", "a " * 20, "one\ntwo\none\n\n \n one\r\none", "x" * 100_000, "w " * 100_000, " ".join(f"u{i}" for i in range(30)), "é#ü " * 25]
    docs = documents(spark, [(i, t, None if i % 2 else "en", "s", 0) for i, t in enumerate(texts)] + [(None, "a b", "en", "s", 0), (7, texts[7], "en", "s", 0)])
    labels = spark.createDataFrame([(7, 1, 0), (7, 1, 0), (None, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int").withColumn("lang", F.lit("clash"))
    got = rules.judged(docs.withColumn("n_words", F.lit("clash")).withColumn("stratum", F.lit(1)), labels).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(texts[r.doc_id])
            assert r.kept == (not r.base_failed)
    assert rules.judged(docs.limit(0), labels).count() == 0
    assert rules.judged(docs, labels.limit(0)).count() == len(texts) + 2


def test_documents_of_both_labels_are_no_holdout(spark):
    words = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    docs = documents(spark, [(i, words(i)) for i in range(40)])
    scored = rules.shares(rules.measures(docs)).withColumn("stratum", F.lit("en"))
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(i, 0) for i in range(20, 40)], "doc_id long, quality int")
    one = rules.thresholds(scored, labels, risk=0.9, delta=0.5).collect()
    assert one == rules.thresholds(scored, labels.where("doc_id < 20"), risk=0.9, delta=0.5).collect()
    assert one != rules.thresholds(scored, labels.where("quality = 1 and doc_id < 2"), risk=0.9, delta=0.5).collect()
