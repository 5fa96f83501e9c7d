import hashlib
import random
import time
from itertools import islice, product

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import bpe
from tests.llm.helpers import documents, rows

RANKS = bpe.load()
OURS = bpe.Bpe(RANKS, public_tokenizers.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_against_the_library(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = rows(bpe.op7_byte_bpe(spark, sf_dir))
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = THEIRS.encode_ordinary(r.text or "")
        g = got[r.doc_id]
        assert g.n_tokens == len(ids) and g.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aabbe \t\n\r\x1c\x1f\x85  'st <|endoftext|>"))))
def test_random_texts(text):
    assert OURS.encode(text) == THEIRS.encode_ordinary(text)
    assert OURS.decode(OURS.encode(text)) == text.encode()


def test_long_pre_tokens():
    rnd = random.Random(4)
    for piece in ("a" * 30_001, "".join(rnd.choice("etaoinsh") for _ in range(30_000)), "ab" * 9_999, "=-" * 7_000):
        assert OURS.merge(piece.encode()) == THEIRS.encode_ordinary(piece)
    took = []
    for n in (50_000, 200_000):
        text = "".join(rnd.choice("etaoinsh") for _ in range(n)).encode()
        start = time.perf_counter()
        OURS.merge(text)
        took.append(time.perf_counter() - start)
    assert took[1] < 12 * took[0]


def plain(piece, ranks):
    """The least rank of any pair, the leftmost of equals, again and again."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[x] for x in parts]


@pytest.mark.parametrize("size", [300, 65_537, 200_000])
def test_any_vocabulary(size):
    """Vocabularies on both sides of what words of 256 bits hold, against the library and by brute force."""
    rnd = random.Random(size)
    longer = (bytes(x) for n in range(2, 8) for x in product(b"abcdefgh", repeat=n))
    tokens = [*(bytes([i]) for i in range(256)), *islice(longer, size - 256)]
    order = list(range(size))
    rnd.shuffle(order)  # so that early and late ranks both meet
    ranks = dict(zip(tokens, order))
    ours = bpe.Bpe(ranks, r"[a-h]+| +|[^a-h ]+")
    theirs = tiktoken.Encoding("own", pat_str=r"[a-h]+| +|[^a-h ]+", mergeable_ranks=ranks, special_tokens={})
    for n in (1, 2, 3, 10, 100, 3000):
        piece = bytes(rnd.choice(b"abcdefgh") for _ in range(n))
        want = theirs.encode_ordinary(piece.decode())
        assert ours.merge(piece) == want and ours.decode(want) == piece
        if n <= 100:
            assert plain(piece, ranks) == want or piece in ranks
        assert not any(ours.words) and not any(ours.buckets)  # the queue is empty again


def test_edge_cases(spark):
    docs = documents(spark, [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "é" * 10), (4, "x" * 200_000)])
    got = bpe.encoded(docs.withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit("clash"))).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == 6
    for r in got:
        text = {1: "", 2: "", 3: "one two", None: "é" * 10, 4: "x" * 200_000}[r.doc_id]
        assert r.ids == THEIRS.encode_ordinary(text) and r.n_tokens == len(r.ids)
        assert (r.ids_sha256 == empty) == (not text)
    assert bpe.encoded(docs.limit(0)).count() == 0
    assert bpe.stage(spark, docs, "").count() == 6
