"""Micro-batches of tokens and greedy packing. Greedy rules depend on order, so each runs in Python over one group's narrow rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _with(df: DataFrame, name: str) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])


def split_simple(tokens: DataFrame, n: int, order: list[str], key: str) -> DataFrame:
    """Consecutive blocks of n tokens per key."""
    return tokens.withColumn("ubatch", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1) / n))


def split_equal(tokens: DataFrame, n: int, key: str = "batch") -> DataFrame:
    """tokens(batch, seq, pos): again and again, as many tokens of each sequence that is left (as many sequences as fit),
    until one runs out or one more of each would pass n. Adds ubatch."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seq", "pos"]).reset_index(drop=True)
        left = {s: list(g.index) for s, g in pdf.groupby("seq")}
        number, out = 0, [0] * len(pdf)
        while left:
            own = sorted(left)[:n]
            k = max(1, min(min(len(left[s]) for s in own), n // len(own)))
            for s in own:
                for i in left[s][:k]:
                    out[i] = number
                left[s] = left[s][k:]
                if not left[s]:
                    del left[s]
            number += 1
        return pdf.assign(ubatch=out)

    return tokens.groupBy(key).applyInPandas(one, _with(tokens, "ubatch"))


def split_sequences(tokens: DataFrame, n: int, key: str = "batch") -> DataFrame:
    """tokens(batch, pos, seqs array): a micro-batch starts with the first unused token's set of sequences and goes on with
    tokens whose set is part of the set before, up to n."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        sets = [frozenset(s) for s in pdf["seqs"]]
        out, number, used = [0] * len(pdf), 0, [False] * len(pdf)
        while not all(used):
            now, size = None, 0
            for i, s in enumerate(sets):
                if used[i] or size >= n or (now is not None and not s <= now):
                    continue
                now, used[i], out[i] = s, True, number
                size += 1
            number += 1
        return pdf.assign(ubatch=out)

    return tokens.groupBy(key).applyInPandas(one, _with(tokens, "ubatch"))


def _folded(df: DataFrame, key: str, order: str, name: str, start, step) -> DataFrame:
    """df with `name`: step(state, row's values by column) gives (state, number) for a key's rows in order, from start().

    A greedy rule is a fold, so a key's rows pass through one task, but as a sorted stream: the task holds a batch and the state."""

    def op(batches):
        now, state = _NONE, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                k = getattr(r, key)
                if k != now and not (pd.isna(k) and now is not _NONE and pd.isna(now)):
                    now, state = k, start()
                state, number = step(state, r)
                out.append(number)
            yield pdf.assign(**{name: out})

    return df.repartition(key).sortWithinPartitions(key, order).mapInPandas(op, _with(df, name))


_NONE = object()


def pack(prompts: DataFrame, size: str, n_batch: int, n_seq: int, key: str, order: str) -> DataFrame:
    """Prompts in order into batches of at most n_batch tokens and n_seq prompts; an oversized prompt has a batch to itself."""

    def step(state, row):
        batch, tokens, seqs = state
        v = getattr(row, size)
        if seqs and (tokens + v > n_batch or seqs >= n_seq):
            batch, tokens, seqs = batch + 1, 0, 0
        return (batch, tokens + v, seqs + 1), batch

    return _folded(prompts, key, order, "batch", lambda: (0, 0, 0), step)


def shards_by_count(tensors: DataFrame, n: int, order: list[str], key: str) -> DataFrame:
    """W17."""
    return split_simple(tensors, n, order, key).withColumnRenamed("ubatch", "shard")


def shards_by_bytes(tensors: DataFrame, size: str, most: int, order: str, key: str, align: int = 32) -> DataFrame:
    """Tensors in order, each padded to the alignment; a shard ends before it would pass `most` bytes."""

    def step(state, row):
        shard, held = state
        v = -(-int(getattr(row, size)) // align) * align
        if held and held + v > most:
            shard, held = shard + 1, 0
        return (shard, held + v), shard

    return _folded(tensors, key, order, "shard", lambda: (0, 0), step)
