"""Operators that SQL can't express, held against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import batching as B
from tessera.operators import ngram as N
from tessera.operators import sampling as M
from tessera.operators import stats as S
from tessera.sources import readers


def test_principal_direction(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    x = np.array([r.embedding for r in e.select("embedding").collect()], float)
    _, vectors = np.linalg.eigh(x.T @ x)
    want = vectors[:, -1] * np.sign(vectors[np.abs(vectors[:, -1]).argmax(), -1])
    got = np.asarray(S.principal_direction(e.repartition(5), "embedding", 64), float)
    assert np.linalg.norm(got) == pytest.approx(1, abs=1e-9) and got[np.abs(got).argmax()] > 0
    assert np.allclose(got, want, atol=1e-4)


def test_split_sequences(spark):
    sets = {"a": {1}, "b": {2}, "ab": {1, 2}}
    # Key, sets of its tokens in order, micro-batch size, micro-batches.
    cases = [(1, "ab a b ab", 8, [0, 0, 1, 2]), (2, "a a a", 2, [0, 0, 1]), (3, "a b a b", 8, [0, 1, 0, 1]), (4, "ab b a ab", 8, [0, 0, 1, 2])]
    for key, words, n, want in cases:
        rows = [(key, i, sorted(sets[w])) for i, w in enumerate(words.split())]
        random.Random(key).shuffle(rows)
        out = B.split_sequences(spark.createDataFrame(rows, "batch long, pos long, seqs array<long>"), n).orderBy("pos").collect()
        got = [r.ubatch for r in out]
        assert got == want
        for u in set(got):  # at most n, each set within the one before, numbers without gaps
            own = [set(r.seqs) for r in out if r.ubatch == u]
            assert len(own) <= n and all(b <= a for a, b in zip(own, own[1:]))
        assert sorted(set(got)) == list(range(max(got) + 1))


def test_modulo_table(spark):
    rnd = random.Random(3)
    rows = [(s, p, rnd.choice("abcdefgh")) for s in range(9) for p in range(60)]
    tokens = spark.createDataFrame(rows, "seq_id long, pos long, token string")
    grams = N.ngrams(tokens, 2).select("seq_id", "pos", "next", F.pmod(F.xxhash64("ngram"), F.lit(16)).alias("slot")).collect()
    want = {}
    for r in sorted(grams, key=lambda r: (r.seq_id, r.pos)):
        want[r.slot] = r.next
    assert {r.slot: r.next for r in N.modulo_table(tokens.repartition(4), 2, 16).collect()} == want and len(want) == 16


def test_synthetic_prompts(spark):
    got = readers.synthetic_prompts(spark, 300, 5, 20, 3).collect()
    assert [r.id for r in got] == list(range(300)) and {r.n_tokens for r in got} == set(range(5, 21))
    assert all(len(r.tokens) == r.n_tokens and all(0 <= t < 32_000 for t in r.tokens) for r in got)
    assert readers.synthetic_prompts(spark, 300, 5, 20, 3).collect() == got != readers.synthetic_prompts(spark, 300, 5, 20, 4).collect()


@pytest.mark.parametrize("tau", [1.0, 3.0])
def test_mirostat(spark, tau):
    """Every drawn token stood within the limit, the limit moves by the error of its surprise, and surprise nears tau."""
    rnd = random.Random(8)
    logits = {(s, t): [rnd.gauss(0, 2) for _ in range(40)] for s in range(2) for t in range(150)}
    rows = [(s, t, i, x) for (s, t), xs in logits.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "stream long, step long, id long, logit double")
    got = sorted(M.mirostat(df, 2, tau, 0.1, seed=5).collect(), key=lambda r: (r.stream, r.step))
    assert [(r.stream, r.step) for r in got] == sorted(logits)
    mu, seen = {0: 2 * tau, 1: 2 * tau}, []
    for r in got:
        e = [math.exp(x) for x in logits[r.stream, r.step]]
        p = [x / sum(e) for x in e]
        kept = [i for i, x in enumerate(p) if -math.log2(x) <= mu[r.stream] or x == max(p)]
        assert r.id in kept
        surprise = -math.log2(p[r.id] / sum(p[i] for i in kept))
        mu[r.stream] -= 0.1 * (surprise - tau)
        assert r.mu == pytest.approx(mu[r.stream], abs=1e-9)
        seen.append(surprise)
    assert sum(seen) / len(seen) == pytest.approx(tau, abs=0.3)
    assert sorted(M.mirostat(df.repartition(7), 2, tau, 0.1, seed=5).collect()) == sorted(got)
