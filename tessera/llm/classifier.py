"""A quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled documents and flattened into arrays of equal
length, so that scoring is a few numpy gathers per tree level over a whole batch of documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import packed, table, tidy

#: At most so many labelled documents are fitted on: those with the smallest hash of their id.
SAMPLE = 20_000
FOLDS = 5
CUT = 0.3
TREES, DEPTH, BINS, RATE, L2, LEAF = 120, 4, 64, 0.15, 1.0, 8

_CLASSES = {
    "lower": range(97, 123),
    "upper": range(65, 91),
    "digit": range(48, 58),
    "space": [9, 11, 12, 13, 32],
    "newline": [10],
    "high": range(128, 256),
    "stop": b".,;:",
    "shout": b"!?",
    "symbol": b"#*$%&|<>",
    "bracket": b"()[]{}",
    "quote": b"'\"`",
    "web": b"/@_=+~^\\",
    "dash": b"-",
    "control": [*range(0, 9), *range(14, 32), 127],
}
STATS = (
    *(f"{c}_share" for c in _CLASSES), "log_bytes", "log_words", "mean_word", "sd_word", "long_words", "short_words", "unique_words", "top_word", "unique_pairs", "unique_windows",
    "log_lines", "unique_lines", "mean_line", "sd_line", "empty_lines", "ended_lines", "letter_entropy", "upper_words", "title_words", "symbol_words", "bar_words", "byte_kinds",
)
_WEIGHTS = np.zeros((256, len(_CLASSES)))
for _k, _c in enumerate(_CLASSES.values()):
    _WEIGHTS[list(_c), _k] = 1


def _word_stats(text: bytes) -> tuple:
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * 13
    size = np.fromiter(map(len, words), np.int64, n)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    upper = sum(c for w, c in counts.items() if w.isupper() and len(w) > 1)
    title = sum(c for w, c in counts.items() if w.istitle())
    marked = sum(c for w, c in counts.items() if w[-1] in b"#*$%&|<>!")
    return (
        np.log1p(n), size.mean(), size.std(), (size > 12).mean(), (size < 4).mean(), len(counts) / n, max(counts.values()) / n,
        len(set(zip(words, words[1:], strict=False))) / n, len(set(zip(words, words[2:], words[4:], words[6:], strict=False))) / n,
        upper / n, title / n, marked / n, counts.get(b"|", 0) / n,
    )


def _line_stats(text: bytes) -> tuple:
    lines = text.split(b"\n")
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    full = [x for x in lines if x.strip()]
    m = max(1, len(full))
    return np.log1p(len(lines)), len(set(full)) / m, size.mean(), size.std(), 1 - len(full) / len(lines), sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in full) / m


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """One row of STATS for each text; null counts as empty. Labels, ids and sources play no part."""
    out = np.zeros((len(texts), len(STATS)))
    hist = np.zeros((len(texts), 256))
    for i, t in enumerate(texts):
        t = t or b""
        hist[i] = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
        w = _word_stats(t)
        out[i, len(_CLASSES) + 1 :] = (*w[:9], *_line_stats(t), 0.0, *w[9:], 0.0)
    n = np.maximum(1, hist.sum(axis=1))
    share = hist / n[:, None]
    at = len(_CLASSES)
    out[:, :at] = share @ _WEIGHTS
    out[:, at] = np.log1p(hist.sum(axis=1))
    out[:, STATS.index("letter_entropy")] = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    out[:, STATS.index("byte_kinds")] = (hist > 0).sum(axis=1) / np.sqrt(n)
    return out


@dataclass
class Forest:
    """Trees as arrays [tree, node]: the children of node i are 2i + 1 and 2i + 2; leaves repeat down to the last level."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            total += v[at - inner]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Newton boosting of the logistic loss; splits come from histograms of at most BINS quantile bins."""
    n, k = x.shape
    inner = 2**depth - 1
    prior = (y.sum() + 1) / (n + 2)
    out = Forest(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), float(np.log(prior / (1 - prior))))
    if not n or y.min() == y.max():
        return out
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)  # bin b: up to edge b
    raw = np.full(n, out.start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            own = at - first
            best = np.full(wide, 1e-6)
            pick_f, pick_b = np.zeros(wide, np.int64), np.full(wide, -1)
            for j in range(k):
                if not len(edges[j]):
                    continue
                key = own * BINS + binned[:, j]
                gs, hs, cs = (np.bincount(key, w, minlength=wide * BINS).reshape(wide, BINS).cumsum(axis=1) for w in (g, h, None))
                gl, hl, cl = gs[:, :-1], hs[:, :-1], cs[:, :-1]
                gt, ht, ct = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                gain[(cl < LEAF) | (ct - cl < LEAF)] = 0
                gain[:, len(edges[j]) :] = 0
                b = gain.argmax(axis=1)
                better = (top := gain[np.arange(wide), b]) > best
                best[better], pick_f[better], pick_b[better] = top[better], j, b[better]
            for node in range(wide):
                if pick_b[node] >= 0:
                    out.feature[t, first + node] = pick_f[node]
                    out.cut[t, first + node] = edges[pick_f[node]][pick_b[node]]
            at = 2 * at + 1 + (x[np.arange(n), out.feature[t, at]] > out.cut[t, at])
        leaf = at - inner
        step = RATE * np.bincount(leaf, g, minlength=inner + 1) / (np.bincount(leaf, h, minlength=inner + 1) + L2)
        out.value[t] = step
        raw += step[leaf]
    return out


def held_out(doc_id="doc_id"):
    """Rows never fitted on: crc32 of the id as text is 0 modulo FOLDS. A null id: false."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Fit on at most `sample` labelled documents outside the held-out fold.

    Of an id with conflicting labels the smallest counts, of one with several texts the smallest text, so the driver gets one row for
    each of the sampled ids and reruns agree. Without labelled rows, or with labels of one kind only, the forest gives one score
    to all."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")  # bounded by `sample`
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))

    @tidy
    def op(batches):
        for b in batches:
            x = statistics(b.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2).cast(pa.float64()), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    got = rows.select("doc_id", "text", F.col("quality").cast("int")).mapInArrow(op, "doc_id long, quality double, x array<double>").toPandas()
    got = got.sort_values("doc_id")
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(STATS))
    return fit(x, (got["quality"].to_numpy(float) > 0).astype(float))


def scores(docs: DataFrame, forest: Forest, columns: list[str] | None = None) -> DataFrame:
    """docs(doc_id, text, ...) with held_out, score and predicted; columns: which of docs stay (doc_id).

    Null and empty texts get the score that the trees give to statistics of zero. Rows that repeat are scored each, texts of
    any length whole; an empty table gives an empty result."""
    keep = columns or ["doc_id"]
    broadcast = docs.sparkSession.sparkContext.broadcast(forest)
    kept = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = docs.select(*keep).schema.add("score", "double")

    @tidy
    def op(batches):
        for b in batches:
            s = broadcast.value.score(statistics(b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s)], [*b.schema.names[:-1], "score"])

    out = kept.mapInArrow(op, schema)
    return out.select(*keep, held_out().alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scores(docs, train(docs, table(spark, sf_dir, "labels")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts 0 go. All columns of docs are kept, whatever their names; repeated rows are judged
    each; an empty table stays empty."""
    forest = train(docs, table(spark, sf_dir, "labels"))
    return scores(packed(docs, "doc_id", "text"), forest, ["row", "doc_id"]).where("predicted = 1").select("row.*")
