"""Products of all vectors with a set of them, against the same by hand on odd arrays."""

import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.functions import vector as V
from tests import oracle

INF, NAN = float("inf"), float("nan")
ODD = [None, [], [None, None], [0.0, 0.0, 0.0], [0.0], [1.0, None, 3.0], [None, 2.0, -1.0], [INF, 1.0, 0.0], [0.0, -INF, 2.0], [NAN, 1.0, 1.0], [2.0, 3.0], [1.0, 2.0, 3.0, 4.0], [INF], [-0.5, None]]


def table(spark, names, seed, ids):
    draw = random.Random(seed)
    arrays = ODD + [[draw.uniform(-1, 1) for _ in range(3)] for _ in range(20)]
    rows = [(draw.choice(ids) if ids else k, a) for k, a in enumerate(arrays)]
    return rows, spark.createDataFrame(rows, f"{names[0]} long, {names[1]} array<double>").repartition(3)


def alike(x, y):
    return x is y if x is None or y is None else math.isnan(x) and math.isnan(y) or x == pytest.approx(y, abs=1e-12)


def same(got, want):
    assert len(got) == len(want)
    order = lambda r: (repr(r[:2]), repr(r[2] if r[2] is None else round(r[2], 9) + 0.0))
    bad = [(g, w) for g, w in zip(sorted(got, key=order), sorted(want, key=order), strict=True) if g[:2] != w[:2] or not alike(g[2], w[2])]
    assert not bad, bad[:5]


@pytest.mark.parametrize("ids", [None, [1, 2, 3, 50, None]], ids=["own", "shared"])
@pytest.mark.parametrize("limit", [5, 1000])
def test_matmul(spark, limit, ids):
    (left, a), (right, b) = table(spark, "ix", 1, ids), table(spark, "jy", 2, ids)
    want = {}
    for i, x in left:
        for j, y in right:
            for u, v in zip(x or [], y or [], strict=False):
                want.setdefault((i, j), []).append(None if u is None or v is None else u * v)
    want = [(*ij, sum(w) if (w := [v for v in vs if v is not None]) else None) for ij, vs in want.items()]
    same([tuple(r) for r in V.matmul(a, b, limit).collect()], want)


def test_long_queries_are_sent_in_parts(spark, monkeypatch):
    a, b = table(spark, "ix", 1, None)[1], table(spark, "jy", 2, None)[1]
    want = [tuple(r) for r in V.matmul(a, b).collect()]
    monkeypatch.setattr(V, "_HELD", 30)
    df = V.matmul(a, b)
    assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") > 2
    same([tuple(r) for r in df.collect()], want)


def test_matmul_of_nothing(spark):
    a, b = table(spark, "ix", 1, None)[1], table(spark, "jy", 2, None)[1]
    assert V.matmul(a, b.limit(0)).count() == 0 == V.matmul(a.limit(0), b).count()


def test_matmul_makes_each_pair_once(spark, sf_dir):
    """Pairs are neither shuffled nor joined place by place."""
    df = entry.queries()["matmul"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Join" not in plan
    assert oracle.compare(df, oracle.connection(sf_dir), entry.oracle_sql()["matmul"]) is None


def test_places(spark):
    at = [0.0, -0.0, 0.5e-6, -2.5e-6, 1.0000005, -3.4999995, 0.1234565, 2.5, 1e15, -1e305, INF, -INF, NAN, None, 0.49999999999999994e-6]
    got = [r.v for r in spark.createDataFrame([(x,) for x in at], "x double").select(V.places("x", 6).alias("v")).collect()]
    want = [oracle.duckdb.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0] for x in at]
    assert all(alike(g, w) and (g is None or repr(g + 0.0) == repr(w + 0.0)) for g, w in zip(got, want, strict=True)), list(zip(got, want))


# --- similarities


@pytest.mark.parametrize("limit", [5, 1000])
def test_similarities(spark, limit):
    """Any number of queries, as cosine() has it for each pair."""
    q, c = table(spark, ["i", "embedding"], 3, [1, 2, None])[1], table(spark, ["j", "embedding"], 4, None)[1]
    want = q.select("i", F.col("embedding").alias("q")).crossJoin(c).select("i", "j", V.cosine(F.col("q"), F.col("embedding"))).collect()
    same([tuple(r) for r in V.similarities(q, c, limit).collect()], [tuple(r) for r in want])


def test_similarity_matrix_is_no_nested_loop(spark, sf_dir):
    df = entry.queries()["similarity_matrix"](spark, sf_dir)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    assert oracle.compare(df, oracle.connection(sf_dir), entry.oracle_sql()["similarity_matrix"]) is None
