import itertools
import math

import pytest

from tessera.operators import sampling as M


def cand(spark, p):
    return spark.createDataFrame([(1, i, math.log(x) if x else float("-inf")) for i, x in enumerate(p)], "ctx long, id long, logit double")


def final(df):
    rows = M.probabilities(df.select("ctx", "id", "logit")).collect()
    return sorted((r.p for r in rows), reverse=True)


FOUR = (0.1, 0.2, 0.3, 0.4)
# Operator, its argument, probabilities after renormalising. Fixed values.
GOLDEN = [
    (M.top_k, 1, [1.0]), (M.top_k, 3, [0.44444, 0.33333, 0.22222]), (M.top_k, 4, [0.4, 0.3, 0.2, 0.1]), (M.top_k, 0, [0.4, 0.3, 0.2, 0.1]),
    (M.top_p, 0.0, [1.0]), (M.top_p, 0.7, [0.571429, 0.428571]), (M.top_p, 0.8, [0.44444, 0.33333, 0.22222]), (M.top_p, 1.0, [0.4, 0.3, 0.2, 0.1]),
    (M.min_p, 0.0, [0.4, 0.3, 0.2, 0.1]), (M.min_p, 0.26, [0.4 / 0.9, 0.3 / 0.9, 0.2 / 0.9]), (M.min_p, 0.49, [0.4 / 0.9, 0.3 / 0.9, 0.2 / 0.9]), (M.min_p, 0.51, [0.4 / 0.7, 0.3 / 0.7]), (M.min_p, 0.76, [1.0]), (M.min_p, 1.05, [1.0]),
    (M.temperature, 0.0, [1.0]), (M.temperature, 1.0, [0.4, 0.3, 0.2, 0.1]), (M.top_n_sigma, 0.0, [0.4, 0.3, 0.2, 0.1]), (M.top_n_sigma, 1.0, [0.571429, 0.428571, 0.0, 0.0]),
]


@pytest.mark.parametrize(("step", "argument", "expected"), GOLDEN)
def test_golden(spark, step, argument, expected):
    assert final(step(cand(spark, FOUR), argument)) == pytest.approx(expected, abs=1e-5)


def test_xtc_keeps_probabilities(spark):
    got = lambda t, p=1.0: sorted((r.p for r in M.xtc(cand(spark, (0.4, 0.3, 0.2, 0.1)), p, t).collect()), reverse=True)
    assert got(0.19) == pytest.approx([0.2, 0.1]) and got(0.09) == pytest.approx([0.1]) and got(0.29) == pytest.approx([0.3, 0.2, 0.1]) and got(0.39) == pytest.approx([0.4, 0.3, 0.2, 0.1])
    assert len(got(0.09, 0.0)) == 4


def test_penalties(spark):
    history = spark.createDataFrame([(1, 0, 0)], "ctx long, pos long, id long")
    assert final(M.penalties(cand(spark, (0.2,) * 5), history, 64, 1.0, 5.0, 5.0)) == pytest.approx([0.249997] * 4 + [0.000011], abs=1e-5)
    twice = spark.createDataFrame([(1, i, x) for i, x in enumerate((0, 1, 2, 0, 0))], "ctx long, pos long, id long")
    assert final(M.penalties(cand(spark, (0.2,) * 5), twice, 64, 1.0, 5.0, 5.0)) == pytest.approx([0.499977, 0.499977, 0.000023, 0.000023, 0.0], abs=1e-5)


def test_dry(spark):
    history = spark.createDataFrame([(1, i, x) for i, x in enumerate((0, 1, 2, 0, 1))], "ctx long, pos long, id long")
    got = {r.id: r.p for r in M.probabilities(M.dry(cand(spark, (0.25,) * 4), history, 1.0, 1.1, 2).select("ctx", "id", "logit")).collect()}
    assert [got[i] for i in range(4)] == pytest.approx([0.296923, 0.296923, 0.109232, 0.296923], abs=1e-5)


def test_orders_of_a_chain(spark):
    """With logits ln(id), each filter keeps the top of the list; so its size, in any order, is that of plain arithmetic."""
    n = 500
    base = spark.createDataFrame([(1, i, math.log(i)) for i in range(1, n + 1)], "ctx long, id long, logit double").cache()
    for order in itertools.permutations("kpm"):
        ids, df = list(range(n, 0, -1)), base
        for s in order:
            df = {"k": lambda d: M.top_k(d, 100), "p": lambda d: M.top_p(d, 0.8), "m": lambda d: M.min_p(d, 0.7)}[s](df).select("ctx", "id", "logit")
            if s == "k":
                ids = ids[:100]
            elif s == "m":
                ids = [i for i in ids if i >= 0.7 * ids[0] - 1e-9]
            else:
                total, cum, kept = sum(ids), 0, []
                for i in ids:
                    if kept and cum / total >= 0.8 - 1e-9:
                        break
                    kept.append(i)
                    cum += i
                ids = kept
        assert sorted((r.id for r in df.collect()), reverse=True) == ids
    with pytest.raises(ValueError):
        M.chain(base, [("q", {})])


def test_draw_follows_p(spark):
    rows = [(c, i, math.log(x)) for c in range(4000) for i, x in enumerate((0.7, 0.2, 0.1))]
    got = M.draw(spark.createDataFrame(rows, "ctx long, id long, logit double"), 5).groupBy("id").count().collect()
    share = {r.id: r["count"] / 4000 for r in got}
    assert share[0] == pytest.approx(0.7, abs=0.03) and share[1] == pytest.approx(0.2, abs=0.03)
