"""Document fingerprints by locally consistent parsing.

A text is a sequence of names, at first its code points. A round replaces runs of equal names by one,
then tosses coins deterministically: each name gets a label from the lowest bit in which it differs from the name
before it, which bit and what value; repeated, this brings labels below 8 while neighbours stay different.
A phrase begins at each local maximum of labels. Its name in the next round is a hash of its
names. A boundary depends on a few names around it only, so equal substrings are parsed alike, but for a
margin at their ends, wherever they start; rounds go on until a text is one phrase.

The fingerprint is a one-permutation minhash over the set of phrase names of all rounds from FIRST
on, each with its round. Likeness estimates the resemblance of two such sets.
"""

from __future__ import annotations

import json
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import shards, table

#: Bins of the minhash, and the first round whose phrases count (round 1: about 3 to 4 code points).
BINS, FIRST = 64, 2
EMPTY = 0xFFFF
#: Bytes of text in one range, code points parsed together. A range is sorted (Spark spills) and streamed, so beyond
#: MOST_RANGES ranges just grow: bounds and first rows are constants in the plan, a few numbers per range.
TASK_BYTES, TOGETHER, MOST_RANGES = 32 << 20, 1 << 20, 20_000
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finish."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _small_toss() -> np.ndarray:
    """The toss for labels below 128, by table: [label, the one before]; equal ones don't meet."""
    a, b = np.meshgrid(np.arange(128), np.arange(128), indexing="ij")
    d = a ^ b
    bit = np.bitwise_count(((d & -d) - 1).astype(np.uint64) & _U(127)).astype(np.int64)
    return (2 * bit + (a >> bit & 1)).astype(np.uint8).ravel()


_TOSS = _small_toss()


def _labels(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Labels below 8 of names, neighbours in one text being different; start marks where texts begin.

    Where a text begins, the name before is taken to be 0 (or 1 for a name of 0)."""
    prev = np.empty_like(x)
    prev[1:] = x[:-1]
    prev[start] = x[start] == 0
    d = x ^ prev
    low = d & (~d + x.dtype.type(1))
    bit = np.bitwise_count(low - x.dtype.type(1))
    label = (2 * bit + ((x & low) != 0)).astype(np.uint8)  # below 128
    for _ in range(3):  # below 14, 8, 6
        before = np.empty_like(label)
        before[1:] = label[:-1]
        before[start] = label[start] == 0
        label = _TOSS[label.astype(np.int16) * 128 + before]
    return label


def _round(x: np.ndarray, text: np.ndarray):
    """One round over names x, text: each one's text number, ascending. Gives the same for the phrases."""
    new = np.empty(len(x), bool)
    new[0] = True
    np.not_equal(text[1:], text[:-1], out=new[1:])
    head = new.copy()
    head[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(head)
    run = np.diff(np.r_[at, len(x)])
    x, text, start = x[at].astype(np.uint64), text[at], new[at]
    long = run > 1
    with np.errstate(over="ignore"):
        x[long] = _mix(x[long] + _mix(run[long].astype(np.uint64)))  # a run of equal names is one name
    same = np.flatnonzero(~start[1:] & (x[1:] == x[:-1])) + 1
    x[same] ^= _U(1)  # a run's name that equals its neighbour's by chance
    label = _labels(x, start)
    last = np.r_[start[1:], True]
    up = np.r_[True, label[1:] > label[:-1]]
    down = np.r_[label[:-1] > label[1:], True]
    cut = start | (up & down & ~last)
    begin = np.flatnonzero(cut)
    size = np.diff(np.r_[begin, len(x)])
    place = np.arange(len(x)) - np.repeat(begin, size)
    with np.errstate(over="ignore"):
        names = np.add.reduceat(_mix(x + (place.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15)), begin)
    return _mix(names ^ size.astype(np.uint64)), text[begin]


def parse(texts: list[str]):
    """For each round, (names, text numbers) of all texts' phrases; a text drops out once it is one phrase.

    A text of one code point is one phrase at once. Empty texts have none."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    x = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    while len(x):
        x, text = _round(x, text)
        yield x, text
        more = np.zeros(len(texts), bool)
        again = text[1:][text[1:] == text[:-1]]
        more[again] = True
        on = more[text]
        x, text = x[on], text[on]


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of BINS 16-bit values for each text; EMPTY where a bin has no phrase. Short texts count all rounds."""
    out = np.full((len(texts), BINS), np.iinfo(np.uint64).max, np.uint64)
    flat = out.ravel()
    counted = np.zeros(len(texts), bool)
    first = None
    for k, (x, text) in enumerate(parse(texts), 1):
        if k < FIRST:
            first = x, text
            continue
        _least(flat, x, text, k)
        counted[text] = True
    if first is not None and FIRST > 1:  # texts that are one phrase before the first round that counts
        on = ~counted[first[1]]
        _least(flat, first[0][on], first[1][on], 1)
    kept = ((out >> _U(16)) % _U(EMPTY)).astype(np.uint16)
    kept[out == np.iinfo(np.uint64).max] = EMPTY
    return kept


def _least(flat: np.ndarray, x: np.ndarray, text: np.ndarray, k: int) -> None:
    with np.errstate(over="ignore"):
        h = _mix(x + _U(k) * _U(0xD1342543DE82EF95))
    slot = text.astype(np.int64) * BINS + (h & _U(BINS - 1)).astype(np.int64)
    np.minimum.at(flat, slot, h | _U(BINS - 1))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, the share of the bins filled in either that agree; two empty texts are alike."""
    either = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    agree = ((a == b) & (a != EMPTY)).sum(axis=1)
    return np.where(either == 0, 1.0, agree / np.maximum(either, 1))


def to_text(fps: np.ndarray) -> list[str]:
    """Four hex digits a bin."""
    return [row.tobytes().hex() for row in fps.astype(">u2")]


def edited(text: str, following: str) -> str:
    """The last third of a text's code points replaced by the first as many of another's."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def _cuts(own: DataFrame, parts: int) -> tuple[list[int], dict]:
    """(cut points of doc_id, cut points of h and their salts per hot id) for about `parts` equal ranges.

    An id (or null) that fills two ranges or more gets ranges of its own, cut evenly by the hash of the text; a text that fills two
    or more under such an id is dealt to that many by salt. At most parts numbers of each kind come to the driver."""
    if parts < 2:
        return [], {}
    got = own.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], max(10_000, 20 * parts)).alias("q"), F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("ids")).first()
    times = Counter(got["q"] or [])
    each = max(got["n"] / parts, 1.0)
    hot: dict = {v: k + 1 for v, k in times.items() if k > 1 and k * each >= 2}
    if got["n"] - got["ids"] >= 2 * each:
        hot[None] = int((got["n"] - got["ids"]) / each)
    cuts = sorted(set(times) | {v - 1 for v in hot if v is not None and v > -(1 << 63)})
    if not hot:
        return cuts, {}
    among = F.col("doc_id").isin([v for v in hot if v is not None]) | (F.col("doc_id").isNull() if None in hot else F.lit(False))
    copies = own.where(among).groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2 * each).collect()
    pieces = {}
    for v, k in hot.items():
        heavy = {r["h"]: max(2, int(r["n"] / each)) for r in copies if r["doc_id"] == v}
        at = {-(1 << 63) + (i << 64) // k for i in range(1, k)} | set(heavy) | {h - 1 for h in heavy if h > -(1 << 63)}
        pieces[v] = [(h, heavy.get(h, 1)) for h in sorted(at | {(1 << 63) - 1})]
    return cuts, pieces


def _numbers(values: list) -> Column:
    """Numbers as one constant of the plan, whatever their count."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _below(cuts: Column, start: Column, size: Column, most: int, value: Column) -> Column:
    """How many of cuts[start : start + size], ascending and at most `most`, are below value: a binary search."""
    steps = F.array(*(F.lit(1 << k).cast("bigint") for k in reversed(range(most.bit_length()))))
    step_to = lambda at, step: F.when((at + step <= size) & (F.get(cuts, (start + at + step - 1).cast("int")) < value), at + step).otherwise(at)
    return F.aggregate(steps, F.lit(0).cast("bigint"), step_to)


def _ranges(own: DataFrame, parts: int) -> tuple[DataFrame, int, list]:
    """own with `part`, its range in order; their number; and for each whether it holds one id only."""
    cuts, pieces = _cuts(own, parts)
    # Ranges by descending id, each up to its cut (that of the largest ids has none); null ids last, with the smallest ids unless
    # either fill ranges of their own.
    held = [[], *(pieces.get(c, []) for c in reversed(cuts)), pieces.get(None, [])]
    of, starts, flat, salts, single = [], [], [], [], []
    for k, some in enumerate(held):
        joins = k == len(held) - 1 and not some and not held[-2]
        of.append(of[-1] if joins else len(single))
        starts.append(len(flat))
        for h, width in some:
            flat.append(h)
            salts.append((len(single), width))
            single += [True] * width
        if not some and not joins:
            single.append(False)
    sizes, n = [len(some) for some in held], len(cuts) + 1
    whole = _below(_numbers(cuts), F.lit(0), F.lit(len(cuts)), len(cuts), F.col("doc_id")) if cuts else F.lit(0).cast("bigint")
    ranged = own.withColumn("at", F.when(F.col("doc_id").isNull(), F.lit(n)).otherwise(n - 1 - whole).cast("int"))
    part = F.get(_numbers(of), F.col("at"))
    if flat:
        start, size = F.get(_numbers(starts), F.col("at")), F.get(_numbers(sizes), F.col("at"))
        ranged = ranged.withColumn("piece", F.when(size > 0, start + _below(_numbers(flat), start, size, max(sizes), F.col("h"))).cast("int"))
        width = F.get(_numbers([w for _, w in salts]), F.col("piece"))
        part = F.when(F.col("piece").isNull(), part).otherwise(F.get(_numbers([p for p, _ in salts]), F.col("piece")) + F.pmod(F.monotonically_increasing_id(), width))
    return ranged.select(part.cast("int").alias("part"), "doc_id", "h", "text"), len(single), single


def fingerprint_pairs(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """docs(doc_id, text) with each row's own fingerprint, its edited text's, and the next row's likeness.

    Rows stand by descending doc_id (null ids last; rows of one id by the XXH64 of their texts); after the last comes the first.
    Null texts count as empty. Rows are dealt to ranges of that order, rows of an id that fills several to several; each range also
    gets the row that follows its last, so every text moves once, and no task sees more than its range.
    Gives doc_id, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited and near_next. Other columns are dropped,
    whatever their names. An empty table gives an empty result; one row follows itself."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    total = own.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    ranged, parts, single = _ranges(own, parts or min(MOST_RANGES, shards(spark, total, TASK_BYTES)))
    # The first row of each range that has any: an id and, where all have that id, a hash come to the driver.
    least = ranged.groupBy("part").agg(F.max("doc_id").alias("top"), *[F.min("h").alias("low")] * any(single)).collect()
    heads = {r["part"]: r for r in least}
    there = sorted(heads)
    before = {p: there[k - 1] for k, p in enumerate(there)}
    at, places = F.col("part"), range(parts)
    to = F.get(_numbers([before.get(p) for p in places]), at)
    first = ranged.where(F.col("doc_id").eqNullSafe(F.get(_numbers([heads[p]["top"] if p in heads else None for p in places]), at)))
    if any(single):
        low = F.get(_numbers([heads[p]["low"] if p in heads and single[p] else None for p in places]), at)
        first = first.where(low.isNull() | (F.col("h") == low))
    first = first.groupBy("part").agg(F.min(F.struct("h", "text")).alias("row"), F.max("doc_id").alias("doc_id"))
    follow = first.select(to.cast("int").alias("part"), F.lit(1).alias("extra"), "doc_id", "row.h", "row.text")
    dealt = ranged.select("part", F.lit(0).alias("extra"), "doc_id", "h", "text").unionByName(follow).repartitionById(parts, at)
    ordered = dealt.sortWithinPartitions("part", "extra", F.col("doc_id").desc_nulls_last(), "h", "text").select("part", "extra", "doc_id", "text")
    return ordered.mapInArrow(_pairs, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _pairs(batches):
    """Rows of one range in order, then the row that follows the last (extra = 1)."""
    held: list[tuple] = []
    size = 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            held.append(row)
            size += len(row[3])
            if size >= TOGETHER and len(held) > 1:
                yield _paired(held)
                held, size = held[-1:], len(held[-1][3])
    if held:
        yield _paired(held)


def _paired(held: list[tuple]):
    rows = [r for r in held[:-1] if not r[1]]
    following = [held[i + 1][3] for i, r in enumerate(held[:-1]) if not r[1]]
    texts = [r[3] for r in held]
    at = [i for i, r in enumerate(held[:-1]) if not r[1]]
    changed = [edited(r[3], f) for r, f in zip(rows, following, strict=True)]
    fps = fingerprints(texts + changed)
    own, nxt, new = fps[at], fps[[i + 1 for i in at]], fps[len(texts) :]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[2] for r in rows], pa.int64()), pa.array([len(r[3]) for r in rows], pa.int64()), pa.array(changed, pa.string()), pa.array(to_text(own), pa.string()), pa.array(to_text(new), pa.string()), pa.array(likeness(own, new), pa.float64()), pa.array(likeness(own, nxt), pa.float64())],
        ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def op10_phrase_fingerprint(spark, sf_dir: str) -> DataFrame:
    out = fingerprint_pairs(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
