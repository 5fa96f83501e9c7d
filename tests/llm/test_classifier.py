import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import classifier as C
from tests.llm.helpers import documents, rows


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = C.op3_quality_classifier(spark, sf_dir).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all()
    both = got.merge(spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas(), on="doc_id")
    held = both[both.held_out]
    assert auc(held.quality.to_numpy(), held.score.to_numpy()) > 0.95
    assert held[held.quality == 1].predicted.mean() > 0.97
    again = C.op3_quality_classifier(spark, sf_dir).toPandas().set_index("doc_id").score
    assert (again.sort_index().to_numpy() == got.set_index("doc_id").score.sort_index().to_numpy()).all()


def test_flat_traversal_equals_walking():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(600, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = C.fit(x, y, trees=30)

    def walk(row):
        total = forest.start
        for f, c, v in zip(forest.feature, forest.cut, forest.value):
            at = 0
            while at < len(f):
                at = 2 * at + (1 if row[f[at]] <= c[at] else 2)
            total += v[at - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.score(x), [walk(r) for r in x])
    assert ((forest.score(x) > 0.5) == y).mean() > 0.95


def test_edge_cases(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = documents(spark, [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n\t"), (None, "x"), (10**6 + 3, "a " * 100_000), (10**6 + 3, "a")])
    both = docs.unionByName(odd).withColumn("score", F.lit("clash")).withColumn("quality", F.lit("clash"))
    mixed = labels.unionByName(spark.createDataFrame([(None, 1, 0), (10**6, None, None)], labels.schema)).withColumn("text", F.lit("clash"))
    forest = C.train(both, mixed)
    got = [r for r in C.scores(both, forest).collect() if r.doc_id is None or r.doc_id >= 10**6]
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    by = rows(C.scores(both.where("doc_id in (1000000, 1000001)"), forest))
    assert by[10**6].score == by[10**6 + 1].score
    assert C.scores(both.limit(0), forest).count() == 0
    empty = C.train(docs, labels.limit(0))
    assert {r.score for r in C.scores(docs, empty).select("score").distinct().collect()} == {0.5}


def test_stage_rejects_and_keeps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = C.stage(spark, docs, sf_dir)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert 0 < len(kept) < docs.count()
    assert np.mean([d in kept for d, q in good.items() if q]) > 0.97
    assert np.mean([d in kept for d, q in good.items() if not q]) < 0.3


def plain_tree(x, y, depth, raw):
    """One Newton tree by trying every cut between quantiles, node by node; the leaf value of each row."""
    p = 1 / (1 + np.exp(-raw))
    g, h = y - p, np.maximum(p * (1 - p), 1e-6)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, C.BINS + 1)[1:-1])) for j in range(x.shape[1])]
    gain = lambda a, b: a * a / (b + C.L2)

    def grow(rows, d):
        if d:
            best = (1e-6, None)
            for j, cuts in enumerate(edges):
                for c in cuts:
                    left = x[rows, j] <= c
                    if C.LEAF <= left.sum() <= len(rows) - C.LEAF:
                        a, b = rows[left], rows[~left]
                        top = gain(g[a].sum(), h[a].sum()) + gain(g[b].sum(), h[b].sum()) - gain(g[rows].sum(), h[rows].sum())
                        if top > best[0] + 1e-12:
                            best = (top, left)
            if best[1] is not None:
                return {**grow(rows[best[1]], d - 1), **grow(rows[~best[1]], d - 1)}
        return dict.fromkeys(rows.tolist(), C.RATE * g[rows].sum() / (h[rows].sum() + C.L2))

    got = grow(np.arange(len(x)), depth)
    return np.array([got[i] for i in range(len(x))])


def test_fit_against_brute_force():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(400, 5)), 1)
    x[:, 4] = 1.0
    y = (x[:, 0] * x[:, 1] + rng.normal(size=400) * 0.3 > 0).astype(float)
    forest = C.fit(x, y, trees=6, depth=3)
    raw = np.full(400, np.log((y.sum() + 1) / (402 - y.sum() - 1)))
    for _ in range(6):
        raw = raw + plain_tree(x, y, 3, raw)
    assert np.allclose(forest.score(x), 1 / (1 + np.exp(-raw)), atol=1e-9)


def test_train_takes_one_row_per_id(spark):
    text = lambda i: f"{'good words here ' if i % 2 else '%% $$ ## '}" * (i % 7 + 3)
    one = documents(spark, [(i, text(i)) for i in range(200)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    many = one.unionByName(one.where("doc_id < 50")).unionByName(one.where("doc_id = 7").withColumn("text", F.lit("zzz")))
    a, b = C.train(one, labels), C.train(many.repartition(9), labels)
    assert all(np.array_equal(getattr(a, f), getattr(b, f)) for f in ("feature", "cut", "value"))
