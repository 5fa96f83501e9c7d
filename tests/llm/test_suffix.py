import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import suffix
from tests.llm.helpers import documents, rows


def plain(docs, length=50):
    """{(doc_id, text): (removed flags)} by a table of all strings."""
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(d, first.get(w, d))
    out = {}
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d, t] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_against_brute_force(spark):
    for sf_dir in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
        assert result(suffix.op4_suffix_dedup(spark, sf_dir)) == {d: x for (d, _), x in plain(docs).items()}


def test_small_blocks_and_batches(spark, monkeypatch):
    """Many blocks, shards, batches and levels give the same as one."""
    rnd = random.Random(8)
    passages = ["".join(rnd.choice("abcdefgh é") for _ in range(rnd.randrange(30, 300))) for _ in range(12)]
    docs = []
    for d in rnd.sample(range(1000), 150):
        parts = [rnd.choice(passages) if rnd.random() < 0.6 else "".join(rnd.choice("abcdefgh é") for _ in range(rnd.randrange(120))) for _ in range(rnd.randrange(1, 6))]
        docs.append((d, "".join(p[rnd.randrange(5) :] for p in parts)))
    docs += [(2000, "a" * 3000), (2001, "a" * 49), (2002, "a" * 50 + "b"), (2003, "ab" * 500), (1999, "a" * 51)]
    want = {d: x for (d, _), x in plain(docs).items()}
    frame = documents(spark, docs).repartition(7)

    def run():
        return {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in suffix.remove_repeats(frame).collect()}

    assert run() == want
    for name, value in (("BLOCK", 700), ("SHARD_BYTES", 5000)):
        monkeypatch.setattr(suffix, name, value)
    monkeypatch.setattr(suffix, "_STEP", 97)
    assert run() == want


@pytest.mark.parametrize("batch", [1, 40, 1000, 10**6])
def test_index_levels(batch):
    rnd = random.Random(batch)
    keys = [f"{rnd.randrange(300):050d}".encode() for _ in range(2000)]
    at = 50 * np.arange(2000)
    docs = np.sort(np.array([rnd.randrange(500) for _ in range(2000)]))
    index, got = suffix.SuffixIndex(np.frombuffer(b"".join(keys), np.uint8)), []
    for lo in range(0, 2000, batch):
        got.append(index.add(at[lo : lo + batch], docs[lo : lo + batch]))
        sizes = [len(x) for x in index.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
    first = {}
    for k, d in zip(keys, docs):
        first.setdefault(k, d)
    assert np.concatenate(got).tolist() == [first[k] for k in keys]


@pytest.mark.parametrize("length", [24, 31, 32, 50, 255])
def test_suffix_order(length, monkeypatch):
    rnd = random.Random(length)
    text = b"".join(rnd.choice([b"ab", b"\xff\0", b"the same passage again ", b"x" * 60]) for _ in range(400))
    data = np.frombuffer(text, np.uint8)
    at = np.array(rnd.sample(range(len(text) - length + 1), 1500))
    order, same = suffix.suffix_order(data, at, length)
    keys = [text[i : i + length] for i in at[order]]
    assert keys == sorted(keys) and same.tolist() == [a == b for a, b in zip(keys, keys[1:])]
    # Two sorted runs, as a merge scan has them, in stretches.
    monkeypatch.setattr(suffix, "STRETCH", 64)
    half = [h[suffix.suffix_order(data, h, length)[0]] for h in (at[:900], at[900:])]
    for a, b in (half, half[::-1], (half[0], half[1][:0]), (half[0][:0], half[1])):
        order, same = suffix.merge_order(data, a, b, suffix._word(data, a), suffix._word(data, b), length)
        got = [text[i : i + length] for i in np.concatenate([a, b])[order]]
        assert got == sorted(text[i : i + length] for i in np.concatenate([a, b]))
        ends = np.diff(np.r_[True, ~same, True].nonzero()[0]) if len(got) else []
        assert same.tolist() == [x == y for x, y in zip(got, got[1:])] and sum(ends) == len(got)


def test_batches_against_a_stored_index(spark, tmp_path):
    """Batches in ascending order against what is stored give what one run over all gives; levels merge by size; the index can be opened again."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(documents(spark, [(9000 + i, "a passage that comes back again and again in many of the documents. " * 2 + str(i)) for i in range(60)]).select("doc_id", "text"))
    want = {r.doc_id: (r.n_bytes, r.spans, r.kept) for r in suffix.remove_repeats(docs).collect()}
    path, got, sizes = f"{tmp_path}/index", {}, []
    for lo, hi in ((0, 60), (60, 100), (100, 101), (101, 9010), (9010, 9030), (9500, 9600), (9030, 9500)):
        index = suffix.RepeatIndex(spark, path, 6)
        out = index.add(docs.where(f"doc_id >= {lo} and doc_id < {hi}"))
        got |= {r.doc_id: (r.n_bytes, r.spans, r.kept) for r in out.collect()}
        sizes.append([n for _, n in index.levels])
        assert all(a >= 2 * b for a, b in zip(sizes[-1], sizes[-1][1:]))
    assert got == want
    assert len(sizes[0]) == 1 and max(map(len, sizes)) > 1
    with pytest.raises(ValueError):
        suffix.RepeatIndex(spark, path, 7)
    assert len([f for f in os.listdir(path) if f.startswith("level-")]) == len(sizes[-1])


def test_many_texts_under_one_id(spark):
    rows_ = [(5, f"text number {i} " * 6) for i in range(40_000)] + [(4, "text number 77 " * 6), (5, "text number 3 " * 6)] * 3
    got = suffix.remove_repeats(documents(spark, rows_).repartition(4)).where("size(spans) > 0").collect()
    assert len(got) == 1 and got[0].kept == b"" and got[0].doc_id == 5


def test_hot_records_travel_once_a_task(monkeypatch):
    passage = b"A licence line that very many documents have in common, word for word. " * 2
    texts = [passage + str(i).encode() * 30 for i in range(60)]
    known, sent, places = {}, 0, 0
    for lo in range(0, 60, 10):
        for _, kind, payload in suffix._block(texts[lo : lo + 10], np.arange(lo, lo + 10) + 100, np.zeros(10, np.int64), 4, 50, known):
            doc = suffix._unpack(payload)[0]
            sent += 0 if kind else len(doc)
            places += len(doc) if kind else 0
    assert places > 59 * 2 and sent < 60 * 12
    early = list(suffix._block([passage, passage], np.array([3, 4]), np.zeros(2, np.int64), 1, 50, known))  # smaller documents: sent again
    assert any(kind == 0 and (suffix._unpack(p)[0] == 3).any() for _, kind, p in early)


def test_edge_cases(spark):
    long = "".join(random.Random(1).choice("abcdefghij ") for _ in range(150_000))
    rows_ = [(1, None), (2, ""), (3, "x" * 49), (5, "y" * 60), (5, "y" * 60), (5, "z" * 70), (6, "z" * 50), (None, "y" * 60), (7, "y" * 55), (8, long), (9, long[1000:120_000]), (10, "\0" * 60), (11, "\0" * 50)]
    docs = documents(spark, rows_)
    got = sorted(((r.doc_id or -1), r.n_bytes, len(r.kept), len(r.spans)) for r in suffix.remove_repeats(docs.withColumn("variant", F.lit("clash")).withColumn("places", F.lit(1))).collect())
    assert got == sorted([(1, 0, 0, 0), (2, 0, 0, 0), (3, 49, 49, 0), (5, 60, 60, 0), (5, 60, 60, 0), (5, 70, 70, 0), (6, 50, 0, 1), (-1, 60, 60, 0), (7, 55, 0, 1), (8, 150_000, 150_000, 0), (9, 119_000, 0, 1), (10, 60, 60, 0), (11, 50, 0, 1)])
    assert suffix.remove_repeats(docs.limit(0)).count() == 0
    assert rows(suffix.remove_repeats(docs.where("doc_id = 1")))[1].kept == b""
