import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import phrases as P
from tests.llm.helpers import documents

M = 2**64 - 1


def mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def toss(x, before):
    k = ((x ^ before) & -(x ^ before)).bit_length() - 1
    return 2 * k + (x >> k & 1)


def plain_rounds(text):
    """Round by round, the phrase names of one text, one name at a time."""
    x = [ord(c) for c in text]
    out = []
    while x:
        runs = []
        for name in x:
            if runs and runs[-1][0] == name:
                runs[-1][1] += 1
            else:
                runs.append([name, 1])
        y = [n if k == 1 else mix((n + mix(k)) & M) for n, k in runs]
        y = [n ^ 1 if i and y[i - 1] == n else n for i, n in enumerate(y)]
        label = [toss(n, y[i - 1] if i else int(n == 0)) for i, n in enumerate(y)]
        for _ in range(3):
            label = [toss(n, label[i - 1] if i else int(n == 0)) for i, n in enumerate(label)]
        assert all(a != b for a, b in zip(label, label[1:])) and max(label) < 8
        cuts = [i for i in range(len(y)) if i == 0 or (i + 1 < len(y) and label[i - 1] < label[i] > label[i + 1])]
        x = [mix(sum(mix((n + (i + 1) * 0x9E3779B97F4A7C15) & M) for i, n in enumerate(y[a:b])) & M ^ (b - a)) for a, b in zip(cuts, [*cuts[1:], len(y)])]
        out.append(x)
        if len(x) == 1:
            return out
    return out


def plain_fingerprint(text):
    rounds = plain_rounds(text)
    counted = [(k, n) for k, r in enumerate(rounds, 1) if k >= P.FIRST for n in r] or [(1, n) for r in rounds for n in r]
    bins = [M] * P.BINS
    for k, n in counted:
        h = mix((n + k * 0xD1342543DE82EF95) & M)
        bins[h % P.BINS] = min(bins[h % P.BINS], h | P.BINS - 1)
    return [P.EMPTY if b == M else (b >> 16) % P.EMPTY for b in bins]


def plain_likeness(a, b):
    either = sum(x != P.EMPTY or y != P.EMPTY for x, y in zip(a, b))
    return sum(x == y != P.EMPTY for x, y in zip(a, b)) / either if either else 1.0


def plain(rows):
    """rows in their order; each followed by the next, the last by the first."""
    out = []
    for i, (d, t) in enumerate(rows):
        n = rows[(i + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        f, g, h = map(plain_fingerprint, (t, e, n))
        hexed = lambda x: "".join(f"{v:04x}" for v in x)
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), hexed(f), hexed(g), plain_likeness(f, g), plain_likeness(f, h)))
    return out


def result(df):
    return [(r.doc_id, r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest(), r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in df.collect()]


def test_against_brute_force(spark, sf_dir):
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), reverse=True)
    assert sorted(tuple(r) for r in P.op10_phrase_fingerprint(spark, sf_dir).collect()) == sorted(plain(docs))


def test_ranges_make_no_difference(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = sorted(result(P.fingerprint_pairs(docs, parts=1)))
    monkeypatch.setattr(P, "TOGETHER", 5000)
    for parts in (7, 300):
        assert sorted(result(P.fingerprint_pairs(docs.repartition(3), parts=parts))) == want


def test_equal_substrings_share_phrases():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9)))
    body = " ".join(word() for _ in range(300))
    whole = plain_rounds(body)
    moved = plain_rounds("another start, " + " ".join(word() for _ in range(7)) + body + " tail")
    for k in range(5):  # all but a margin at both ends
        inside = whole[k][6:-6]
        assert inside and set(inside) <= set(moved[k])
    own, shifted, other = P.fingerprints([body, "xyz " + body, " ".join(word() for _ in range(300))])
    assert P.likeness(own[None], shifted[None])[0] > 0.85 and P.likeness(own[None], other[None])[0] < 0.1


def test_likeness_separates(spark):
    got = P.op10_phrase_fingerprint(spark, "/root/testdata/sf0.01").toPandas()
    long = got[got.n_chars >= 200]
    assert long.near_edited.between(0, 1).all() and (long.near_edited > long.near_next).mean() > 0.99
    assert 0.4 < long.near_edited.mean() < 0.7 and long.near_next.median() < 0.1


def test_edge_cases(spark):
    long = "ab" * 60_000 + "a" * 50_000
    texts = [(9, None), (8, ""), (7, "x"), (6, "aaaaaaa"), (5, "same text here"), (5, "same text here"), (4, "same text here"), (3, long), (2, "é漢字🎉" * 9), (1, "\0\1\0"), (None, "last")]
    docs = documents(spark, texts)
    got = result(P.fingerprint_pairs(docs.withColumn("part", F.lit("clash")).withColumn("extra", F.lit(1))))
    assert sorted(got, key=str) == sorted(plain([(d, t or "") for d, t in texts]), key=str)
    same = {r[3] for r in got if r[0] in (4, 5)}
    assert len(same) == 1
    assert P.fingerprint_pairs(docs.limit(0)).count() == 0
    assert [r[5:] for r in result(P.fingerprint_pairs(docs.where("doc_id = 7")))] == [(1.0, 1.0)]
    assert len(result(P.fingerprint_pairs(docs.where("doc_id is null")))) == 1
    assert np.array_equal(P.fingerprints([""])[0], np.full(P.BINS, P.EMPTY))


def test_hot_ids_and_copies(spark):
    """A third of the rows without an id, a third under one id, and of these half equal: every row has the next one in the order."""
    rnd = random.Random(10)
    texts = ["".join(rnd.choice("abcdef ") for _ in range(rnd.randrange(0, 40))) for _ in range(120)]
    rows = [(None, t) for t in texts[:40]] + [(None, "the same text")] * 60 + [(50, t) for t in texts[40:70]] + [(50, "copied copied")] * 70 + [(i, t) for i, t in enumerate(texts[70:])]
    docs = documents(spark, rows)
    h = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) AS h").collect()}
    for some in (rows, rows[:100], rows[100:], rows[130:200]):
        want = sorted(plain(sorted(some, key=lambda r: (r[0] is None, -(r[0] or 0), h[r[1]]))), key=str)
        df = documents(spark, some)
        for parts in (1, 4, 25, 90):
            assert sorted(result(P.fingerprint_pairs(df, parts=parts)), key=str) == want
    own = docs.selectExpr("doc_id", "text", "xxhash64(text) AS h")
    ranged, n, _ = P._ranges(own, 25)
    sizes = [r["count"] for r in ranged.groupBy("part").count().collect()]
    assert max(sizes) <= 4 * len(rows) / 25 and len(sizes) <= n
