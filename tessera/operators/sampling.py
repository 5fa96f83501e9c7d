"""The sampling chain as window operators on a candidate relation: cand(ctx, id, logit).

Each operator returns cand with fewer rows or other logits; probabilities() gives p at the end. Ties go to the smaller id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLACK = 1e-9


def _all():
    return Window.partitionBy("ctx")


def _best():
    return _all().orderBy(F.col("logit").desc(), "id")


def _upto():
    return _best().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def probabilities(cand: DataFrame) -> DataFrame:
    """M1: p by softmax, shifted by the largest logit."""
    top = F.max("logit").over(_all())
    shifted = cand.withColumn("_e", F.exp(F.col("logit") - top))
    return shifted.withColumn("p", F.col("_e") / F.sum("_e").over(_all())).drop("_e")


def log_probabilities(cand: DataFrame) -> DataFrame:
    """M1."""
    top = F.max("logit").over(_all())
    shifted = cand.withColumn("_m", top).withColumn("_s", F.sum(F.exp(F.col("logit") - F.col("_m"))).over(_all()))
    return shifted.withColumn("logp", F.col("logit") - F.col("_m") - F.ln("_s")).drop("_m", "_s")


def greedy(cand: DataFrame) -> DataFrame:
    """M2: one row per ctx."""
    return cand.groupBy("ctx").agg(F.min_by("id", F.struct(-F.col("logit"), F.col("id"))).alias("id"), F.max("logit").alias("logit"))


def temperature(cand: DataFrame, t: float = 0.8) -> DataFrame:
    """M3: t <= 0 keeps the best candidate only."""
    return cand.withColumn("logit", F.col("logit") / t) if t > 0 else top_k(cand, 1)


def dynamic_temperature(cand: DataFrame, t: float, spread: float, exponent: float = 1.0) -> DataFrame:
    """M4: the temperature goes from t - spread to t + spread with the normalised entropy of p."""
    p = probabilities(cand)
    h = -F.sum(F.when(F.col("p") > 0, F.col("p") * F.ln("p")).otherwise(0.0)).over(_all())
    n = F.count(F.lit(1)).over(_all())
    share = F.when(n > 1, h / F.ln(n.cast("double"))).otherwise(0.0)
    low = max(0.0, t - spread)
    return p.withColumn("_t", low + (t + spread - low) * F.pow(share, F.lit(exponent))).withColumn("logit", F.when(F.col("_t") > 0, F.col("logit") / F.col("_t")).otherwise(F.col("logit"))).drop("_t", "p")


def top_k(cand: DataFrame, k: int = 40) -> DataFrame:
    """M5: k <= 0 keeps all."""
    return cand if k <= 0 else cand.withColumn("_r", F.row_number().over(_best())).where(F.col("_r") <= k).drop("_r")


def top_p(cand: DataFrame, p: float = 0.95) -> DataFrame:
    """M6: candidates up to and with the one at which the sum of p reaches it; 1 keeps all, the best always stays."""
    if p >= 1:
        return cand
    rows = probabilities(cand).withColumn("_r", F.row_number().over(_best())).withColumn("_before", F.sum("p").over(_upto()) - F.col("p"))
    return rows.where((F.col("_r") == 1) | (F.col("_before") < p - SLACK)).drop("p", "_r", "_before")


def min_p(cand: DataFrame, m: float = 0.05) -> DataFrame:
    """M7: p at least m times the best p; the best always stays."""
    rows = probabilities(cand).withColumn("_r", F.row_number().over(_best())).withColumn("_top", F.max("p").over(_all()))
    return rows.where((F.col("_r") == 1) | (F.col("p") >= m * F.col("_top") - SLACK)).drop("p", "_r", "_top")


def typical(cand: DataFrame, mass: float = 1.0) -> DataFrame:
    """M8: candidates by how near their surprise is to the entropy, until the sum of p passes mass; p stays as it was."""
    rows = probabilities(cand)
    if mass >= 1:
        return rows
    h = -F.sum(F.col("p") * F.ln("p")).over(_all())
    rows = rows.withColumn("_d", F.round(F.abs(-F.ln("p") - h), 9))
    near = _all().orderBy("_d", F.col("logit").desc(), "id")
    rows = rows.withColumn("_before", F.sum("p").over(near.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("p"))
    return rows.where(F.col("_before") <= mass + SLACK).drop("_d", "_before")


def top_n_sigma(cand: DataFrame, n: float) -> DataFrame:
    """M9: logits under the best less n standard deviations (population) get p 0; n <= 0 changes nothing."""
    if n <= 0:
        return cand
    cut = F.max("logit").over(_all()) - n * F.stddev_pop("logit").over(_all())
    return cand.withColumn("_cut", cut).withColumn("logit", F.when(F.col("logit") >= F.col("_cut"), F.col("logit")).otherwise(F.lit(float("-inf")))).drop("_cut")


def coin(seed: int) -> Column:
    """A number from 0 to 1 that depends on ctx and seed only."""
    return F.pmod(F.xxhash64(F.col("ctx"), F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)


def xtc(cand: DataFrame, probability: float = 0.0, threshold: float = 0.1, seed: int = 0) -> DataFrame:
    """With a probability, all candidates at or above threshold go but the least likely of them; p stays as it was."""
    rows = probabilities(cand).withColumn("_r", F.row_number().over(_best())).withColumn("_above", F.sum(F.when(F.col("p") >= threshold - SLACK, 1).otherwise(0)).over(_all()))
    keep = (F.col("_above") < 2) | (F.col("_r") >= F.col("_above"))
    return rows.where(keep | (coin(seed) >= probability)).drop("_r", "_above")


def penalties(cand: DataFrame, history: DataFrame, last: int = 64, repeat: float = 1.0, frequency: float = 0.0, presence: float = 0.0) -> DataFrame:
    """history(ctx, pos, id); what its last tokens hold is divided (or multiplied, below 0) by repeat, less frequency times its count and presence."""
    recent = history.withColumn("_r", F.row_number().over(Window.partitionBy("ctx").orderBy(F.col("pos").desc()))).where(F.col("_r") <= last)
    counts = recent.groupBy("ctx", "id").agg(F.count(F.lit(1)).alias("_n"))
    logit = F.when(F.col("logit") <= 0, F.col("logit") * repeat).otherwise(F.col("logit") / repeat) - F.col("_n") * frequency - presence
    return cand.join(counts, ["ctx", "id"], "left").withColumn("logit", F.when(F.col("_n").isNull(), F.col("logit")).otherwise(logit)).drop("_n")


def dry(cand: DataFrame, history: DataFrame, multiplier: float = 1.0, base: float = 1.75, allowed: int = 2, last: int = 64) -> DataFrame:
    """A candidate that would go on a repetition loses multiplier * base ** (length - allowed), length being that
    of the longest end of the history that stood before the candidate earlier on.

    Ends of a history and what followed them are compared by arrays within a ctx: the history is bounded by `last`."""
    recent = history.withColumn("_r", F.row_number().over(Window.partitionBy("ctx").orderBy(F.col("pos").desc()))).where(F.col("_r") <= last)
    h = recent.groupBy("ctx").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("h")).withColumn("n", F.size("h"))
    # For each place i before the end: how many tokens before it match the end of the history.
    at = h.where("n > 1").select("ctx", "h", "n", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("i"))
    same = F.transform(F.sequence(F.lit(1), F.col("i")), lambda k: F.get("h", F.col("i") - k) == F.get("h", F.col("n") - k))
    length = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.col("i").cast("bigint"))
    longest = at.select("ctx", F.get("h", F.col("i")).alias("id"), length.alias("length")).groupBy("ctx", "id").agg(F.max("length").alias("_len"))
    loss = F.lit(multiplier) * F.pow(F.lit(base), F.col("_len") - allowed)
    return cand.join(longest, ["ctx", "id"], "left").withColumn("logit", F.when(F.col("_len") >= allowed, F.col("logit") - loss).otherwise(F.col("logit"))).drop("_len")


def bias(cand: DataFrame, biases: DataFrame) -> DataFrame:
    """biases(id, bias)."""
    return cand.join(biases, "id", "left").withColumn("logit", F.col("logit") + F.coalesce("bias", F.lit(0.0))).drop("bias")


def draw(cand: DataFrame, seed: int) -> DataFrame:
    """One id per ctx, at random by p: the first whose running sum of p passes the ctx's number."""
    rows = probabilities(cand).withColumn("_c", F.sum("p").over(_upto())).withColumn("_u", coin(seed))
    hit = rows.withColumn("_ok", F.col("_c") > F.col("_u"))
    return hit.groupBy("ctx").agg(F.coalesce(F.min_by("id", F.when(F.col("_ok"), F.col("_c"))), F.max_by("id", "_c")).alias("id"))


def listing(cand: DataFrame, n: int) -> DataFrame:
    """The n best of each ctx with their p, as an array."""
    rows = probabilities(cand).withColumn("_r", F.row_number().over(_best())).where(F.col("_r") <= n)
    return rows.groupBy("ctx").agg(F.array_sort(F.collect_list(F.struct(F.col("_r").alias("rank"), "id", "p"))).alias("top"))


def accepted(pairs: DataFrame) -> DataFrame:
    """pairs(ctx, pos, draft, sampled), draft null at the end: sampled tokens up to and with the first that disagrees."""
    first = F.min(F.when(~F.col("draft").eqNullSafe(F.col("sampled")), F.col("pos"))).over(_all())
    return pairs.withColumn("_first", first).where(F.col("_first").isNull() | (F.col("pos") <= F.col("_first"))).drop("_first")


def within_budget(tokens: DataFrame, start: str, end: str, budget: int) -> DataFrame:
    """tokens(ctx, pos, piece) with in_block and spent, and forced where a block between the tags passes the budget."""
    order = _all().orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = tokens.withColumn("_tag", F.when(F.col("piece") == start, 1).when(F.col("piece") == end, 0)).withColumn("in_block", F.coalesce(F.last("_tag", ignorenulls=True).over(order) == 1, F.lit(False)) & (F.col("piece") != start))
    rows = rows.withColumn("_block", F.sum(F.when(F.col("piece") == start, 1).otherwise(0)).over(order))
    own = Window.partitionBy("ctx", "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("spent", F.sum(F.when(F.col("in_block"), 1).otherwise(0)).over(own))
    return rows.withColumn("forced", F.col("in_block") & (F.col("spent") > budget)).drop("_tag", "_block")


def mirostat(steps: DataFrame, version: int = 2, tau: float = 5.0, eta: float = 0.1, m: int = 100, seed: int = 0) -> DataFrame:
    """steps(stream, step, id, logit): one id per step, drawn so that the mean surprise nears tau bits.

    A limit mu starts at 2 tau and moves by eta times the error after each draw. Version 2 keeps what surprises no more than
    mu; version 1 keeps the k best, k from mu and the slope of the m best probabilities. Steps of a stream depend on
    one another, so a stream is worked through in Python, one step in memory after another."""
    import numpy as np
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        mu, out, rnd = 2 * tau, [], np.random.default_rng([seed, int(pdf["stream"].iloc[0]) & 0xFFFFFFFF])
        for step, rows in pdf.groupby("step", sort=True):
            rows = rows.sort_values(["logit", "id"], ascending=[False, True])
            p = np.exp(rows["logit"].to_numpy() - rows["logit"].max())
            p /= p.sum()
            if version == 1:
                top = p[:m]
                t = np.log((np.arange(len(top) - 1) + 2) / (np.arange(len(top) - 1) + 1))
                slope = (t * np.log(top[:-1] / top[1:])).sum() / (t * t).sum() if len(top) > 1 else 1.0
                e = slope - 1
                k = len(p) if abs(e) < 1e-9 or slope <= 0 else ((e * 2**mu) / (1 - len(p) ** (-e))) ** (1 / slope)
                keep = np.arange(len(p)) < max(1, int(min(k, len(p))))
            else:
                keep = -np.log2(p) <= mu
                keep[0] = True
            q = np.where(keep, p, 0) / p[keep].sum()
            at = min(int(np.searchsorted(np.cumsum(q), rnd.random())), int(np.flatnonzero(keep)[-1]))
            mu -= eta * (-np.log2(q[at]) - tau)
            out.append((pdf["stream"].iloc[0], step, rows["id"].iloc[at], mu))
        return pd.DataFrame(out, columns=["stream", "step", "id", "mu"])

    return steps.groupBy("stream").applyInPandas(one, "stream long, step long, id long, mu double")


#: One letter per operator, as a chain is written.
LETTERS = {"k": top_k, "p": top_p, "m": min_p, "t": temperature, "y": typical, "s": top_n_sigma, "x": xtc}


def chain(cand: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    """Operators by letter, one after another, then p."""
    for letter, options in steps:
        if letter not in LETTERS:
            raise ValueError(f"no sampler {letter!r}; there are {', '.join(LETTERS)}")
        cand = LETTERS[letter](cand, **options)
    return probabilities(cand.select("ctx", "id", "logit"))
