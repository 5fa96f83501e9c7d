"""Byte-level BPE, with a hierarchical-bitmap rank queue.

Merging takes, again and again, the leftmost pair of least rank. A queue keeps a bucket of positions
per rank; a bitmap marks the buckets that hold something, and a bitmap over its words the words that aren't zero, so the next rank
is a find-first-set per level. There are two levels, and words have as many bits as the square root of the number of
ranks asks for, so any vocabulary fits. Positions are nodes of a linked list of symbols. A merge leaves stale entries in buckets behind; they are skipped when popped. So
a pre-token of n bytes takes about n steps times a small constant, however long it is.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from heapq import heappop, heappush
from itertools import chain, pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import held, table

RANKS = "byte_bpe_50k.tiktoken"
#: Pre-tokens up to this many characters are remembered, in two generations of CACHED at most in each worker.
CACHE_CHARS, CACHED = 48, 250_000


class Bpe(dict):
    """Maps a pre-token to its ids; as a dict it remembers short ones.

    A full generation becomes the old one, from which what is asked for again comes back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.old: dict[str, tuple[int, ...]] = {}
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.token = [b""] * self.size
        for piece, rank in ranks.items():
            self.token[rank] = piece
        self.digits = [b"%d" % i for i in range(self.size)]
        # White space as the Unicode property has it; Python's own \s has four control characters more.
        self.find = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        # The queue, empty again after each merge: positions by rank, a bit for each rank that has some, in words of 2 ** shift bits.
        self.shift = max(8, ((self.size - 1).bit_length() + 1) // 2)
        self.buckets: list[list[int]] = [[] for _ in range(self.size)]
        self.words = [0] * ((self.size >> self.shift) + 1)
        self.bit = [1 << i for i in range(max(1 << self.shift, len(self.words)))]
        self.pairs = [[ranks.get(bytes((a, b)), -1) for b in range(256)] for a in range(256)]

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece) or tuple(self.merge(piece.encode()))
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHED:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        after = list(range(1, n + 1))  # where a node's symbol ends: the next node
        before = list(range(-1, n - 1))
        pairs, get = self.pairs, ranks.get
        pair = [pairs[a][b] for a, b in pairwise(piece)]  # the rank of a node's symbol with the next one, -1 if none
        pair.append(-1)
        # The queue's push and pop, written out: as calls they take half of the time of a short pre-token.
        words, buckets, bit, shift, top = self.words, self.buckets, self.bit, self.shift, 0
        low_bits = (1 << shift) - 1
        for i, rank in enumerate(pair):
            if rank >= 0:
                bucket = buckets[rank]
                if not bucket:
                    words[rank >> shift] |= bit[rank & low_bits]
                    top |= bit[rank >> shift]
                bucket.append(i)  # ascending, so a heap
        while top:
            word = (top & -top).bit_length() - 1
            bits = words[word]
            low = bits & -bits
            rank = word << shift | low.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket.pop()
                words[word] = bits = bits ^ low
                if not bits:
                    top ^= bit[word]
            if pair[i] != rank:
                continue  # stale: merged away, or its neighbour has changed
            gone = after[i]
            after[i] = end = after[gone]
            pair[gone] = -1
            if end < n:
                before[end] = i
                pair[i] = new = get(piece[i : after[end]], -1)
                if new >= 0:
                    bucket = buckets[new]
                    if bucket:
                        heappush(bucket, i)
                    else:
                        bucket.append(i)
                        words[new >> shift] |= bit[new & low_bits]
                        top |= bit[new >> shift]
            else:
                pair[i] = -1
            left = before[i]
            if left >= 0 and (new := get(piece[left:end], -1)) != pair[left]:
                pair[left] = new
                if new >= 0:
                    bucket = buckets[new]
                    if bucket:
                        heappush(bucket, left)
                    else:
                        bucket.append(left)
                        words[new >> shift] |= bit[new & low_bits]
                        top |= bit[new >> shift]
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.find(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def load(path: str | None = None) -> dict[bytes, int]:
    """The ranks in a .tiktoken file; by default the public 50k vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(RANKS)
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encoded(docs: DataFrame, columns: list[str] | None = None, ranks: dict[bytes, int] | None = None, pattern: str | None = None, ids: bool = True) -> DataFrame:
    """docs(doc_id, text, ...) with n_tokens, ids_sha256, decoded_sha256 and, if asked, ids.

    The digests are of the decimal ids joined by a space, and of the bytes that decoding those ids gives.
    Null texts count as empty, with no ids. The vocabulary, of fixed size, is sent to the executors by
    the driver. Repeated rows are encoded each, texts of any length whole; extra columns are left aside; an empty table gives an
    empty result."""
    keep = columns or ["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast((ranks or load(), pattern or default_pattern()))
    key = uuid.uuid4().hex
    schema = docs.select(*keep).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def op(batches):
        bpe = held(key, lambda: Bpe(*sent.value))  # it outlives a task
        for b in batches:
            n, sha, back, own = [], [], [], []
            for text in b.column(b.num_columns - 1).to_pylist():
                got = bpe.encode(text or "")
                n.append(len(got))
                sha.append(hashlib.sha256(b" ".join(map(bpe.digits.__getitem__, got))).hexdigest())
                back.append(hashlib.sha256(bpe.decode(got)).hexdigest())
                if ids:
                    own.append(pa.array(got, pa.int32()))
            cols = [*b.columns[:-1], pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            if ids:
                flat = pa.concat_arrays(own) if own else pa.array([], pa.int32())
                cols.append(pa.ListArray.from_arrays(pa.array([0, *_cumulative(n)], pa.int32()), flat))
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return docs.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(op, schema)


def _cumulative(n):
    total = 0
    for x in n:
        total += x
        yield total


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), ids=False)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: each document's ids, with its id, language and source; other columns, whatever their names, are left aside. Repeated
    rows are encoded each; an empty table stays empty."""
    return encoded(docs, ["doc_id", "lang", "source"])
