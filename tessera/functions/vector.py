"""Functions on arrays as vectors: norms, likeness, elementwise operations, reductions, layout."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

_ZERO = 0.0
#: Queries that are sent to the tasks together, numbers that those hold at most, and pairs that are worked out at once.
_SENT, _HELD, _PAIRS = 10_000, 1 << 22, 1 << 16


def doubles(a) -> Column:
    return F.col(a).cast("array<double>") if isinstance(a, str) else a.cast("array<double>")


def total(a) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a, b) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def places(x, n: int) -> Column:
    """x rounded to n places, halves away from zero, in binary as DuckDB does it; for very many rows, as F.round goes by decimal strings."""
    y = F.col(x) * 10.0**n
    r = F.rint(y)
    r = F.when(F.abs(y - r) == 0.5, y + 0.5 * F.signum(y)).otherwise(r)
    return F.when(F.abs(y) < float("inf"), r / 10.0**n).otherwise(F.col(x))


def normalised(a, mode: int = 2) -> Column:
    """V1: -1 none, 0 largest value to 32760, 1 taxicab, 2 Euclid, p for the p-norm; zero vectors stay zero."""
    if mode < 0:
        return a
    if mode == 0:
        size = F.array_max(F.transform(a, F.abs)) / 32760.0
    elif mode == 1:
        size = total(F.transform(a, F.abs))
    elif mode == 2:
        size = F.sqrt(dot(a, a))
    else:
        size = F.pow(total(F.transform(a, lambda x: F.pow(F.abs(x), F.lit(float(mode))))), F.lit(1.0 / mode))
    # One value per row, worked out once: the array is wrapped so that the lambda below sees it as a variable.
    return F.element_at(F.transform(F.array(size), lambda s: F.transform(a, lambda x: F.when(s > 0, x / s).otherwise(_ZERO))), 1)


def cosine(a, b) -> Column:
    """V2: two zero vectors are alike (1), a zero one is unlike any other (0)."""
    na, nb = dot(a, a), dot(b, b)
    return F.when((na == 0) & (nb == 0), 1.0).when((na == 0) | (nb == 0), 0.0).otherwise(dot(a, b) / (F.sqrt(na) * F.sqrt(nb)))


def _dense(arrays):
    """Arrays as a matrix, with zeros where they hold no number; the places where they do; their lengths, -1 for null."""
    lengths = pc.fill_null(pc.list_value_length(arrays), -1).to_numpy(zero_copy_only=False)
    holds = np.arange(max(0, lengths.max(initial=0))) < lengths[:, None]
    values, x = arrays.flatten(), np.zeros(holds.shape)
    x[holds] = pc.fill_null(values, 0).to_numpy(zero_copy_only=False)
    if values.null_count:
        holds[holds] = values.is_valid().to_numpy(zero_copy_only=False)
    return x, holds, lengths


def _dots(a, b):
    """Products of all arrays of a with all of b, summed over the places where both hold a number; where there is no such place."""
    (x, p, _), (y, q, _) = a, b
    k = min(x.shape[1], y.shape[1])
    x, p, y, q = x[:, :k], p[:, :k], y[:, :k], q[:, :k]
    v = x @ y.T
    if p.all() and q.all():
        return v, None if k else np.ones(v.shape, bool)
    # A place that holds none counts as zero above, which times infinity is no number.
    for r in np.flatnonzero(~np.isfinite(x).all(axis=1)):
        v[r] = np.where(p[r] & q, x[r] * y, 0).sum(axis=1)
    for c in np.flatnonzero(~np.isfinite(y).all(axis=1)):
        v[:, c] = np.where(p & q[c], x * y[c], 0).sum(axis=1)
    return v, p.astype(float) @ q.T.astype(float) == 0


def _cosines(a, b):
    """cosine() of all arrays of a with all of b; where it is null."""
    (x, p, n), (y, q, m) = a, b
    k = min(x.shape[1], y.shape[1])
    s, t = (x * x).sum(axis=1), (y * y).sum(axis=1)
    known, told = p.sum(axis=1) == n, q.sum(axis=1) == m
    zero, nought = (known & (s == 0))[:, None], told & (t == 0)
    v = x[:, :k] @ y[:, :k].T / (np.sqrt(s)[:, None] * np.sqrt(t))
    if zero.any() or nought.any():
        v = np.where(zero & nought, 1.0, np.where(zero | nought, 0.0, v))
    unknown = ~(known[:, None] & told & (n[:, None] == m))
    return v, unknown & ~(zero | nought) if unknown.any() else None


def _products(rows: DataFrame, queries: DataFrame, of, limit: int) -> DataFrame:
    """rows(key, array) by queries(key, array): a row (key, key, v) for each pair, v by `of` two matrices.

    Rows stream by; about `limit` queries go to the tasks at a time, fewer of long arrays, dealt by their keys: any number is served."""
    (row, _), (key, array) = rows.schema, queries.schema
    schema = StructType([row, key, StructField("v", DoubleType())])
    count, held = queries.agg(F.count(F.lit(1)), F.sum(F.size(array.name))).first()
    parts = max(1, -(-count // limit), -(-(held or 0) // _HELD))

    def one(k):
        some = queries.where(F.pmod(F.xxhash64(key.name), F.lit(parts)) == k) if parts > 1 else queries
        sent = rows.sparkSession.sparkContext.broadcast(some.toArrow().combine_chunks())

        def op(batches):
            keys, arrays = (c.combine_chunks() for c in sent.value.columns)
            right, m = _dense(arrays), len(keys)
            step = max(1, _PAIRS // max(1, m))
            for batch in batches:
                for at in range(0, batch.num_rows if m else 0, step):
                    left = batch.slice(at, step)
                    with np.errstate(all="ignore"):
                        v, null = of(_dense(left.column(1)), right)
                    n = left.num_rows
                    ids = left.column(0).take(pa.array(np.repeat(np.arange(n), m))), keys.take(pa.array(np.tile(np.arange(m), n)))
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(v.ravel(), mask=None if null is None else null.ravel())], [row.name, key.name, "v"])

        return rows.mapInArrow(op, schema)

    return reduce(DataFrame.unionAll, map(one, range(parts)))


def similarities(queries: DataFrame, chunks: DataFrame, limit: int = _SENT) -> DataFrame:
    """The rows of the similarity matrix that belong to queries(i, embedding), a stated set, against all chunks(j, embedding).

    The queries are sent to the tasks, `limit` at a time; matrix products of them and the chunks give what cosine() gives."""
    q, c = queries.select("i", doubles("embedding").alias("_q")), chunks.select("j", doubles("embedding").alias("_c"))
    return _products(c, q, _cosines, limit).select("i", "j", F.col("v").alias("score"))


def top_k(queries: DataFrame, chunks: DataFrame, key: str, k: int = 40, limit: int = 100_000) -> DataFrame:
    """For each query, its k nearest chunks by cosine: (query_id, rank, key, score).

    queries(query_id, embedding) are a stated set; beyond `limit` of them this raises rather than broadcast them. Both sides are
    normalised once. Partial results of k per query and partition meet in the final ranking, as a window with a row
    limit does it."""
    from pyspark.sql import Window

    if queries.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} queries: split them")
    q = queries.select("query_id", normalised(doubles("embedding")).alias("_q"))
    c = chunks.select(key, normalised(doubles("embedding")).alias("_c"))
    scored = c.join(F.broadcast(q)).select("query_id", key, dot(F.col("_q"), F.col("_c")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def pooled(tokens: DataFrame, how: str) -> DataFrame:
    """V4: tokens(seq_id, pos, embedding) to one vector per sequence: mean, cls (first) or last."""
    if how == "cls":
        return tokens.groupBy("seq_id").agg(F.min_by("embedding", "pos").alias("embedding"))
    if how == "last":
        return tokens.groupBy("seq_id").agg(F.max_by("embedding", "pos").alias("embedding"))
    per = tokens.select("seq_id", F.posexplode("embedding").alias("j", "v")).groupBy("seq_id", "j").agg(F.avg("v").alias("v"))
    return per.groupBy("seq_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x["v"]).alias("embedding"))


def _sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-x))


def _gelu(x) -> Column:
    return 0.5 * x * (1 + F.tanh(math.sqrt(2 / math.pi) * x * (1 + 0.044715 * x * x)))


def erf(x) -> Column:
    """To 1e-13, there being no built-in: below 3 by the series of positive terms, beyond by the continued fraction of erfc."""
    near, far = F.least(F.abs(x), F.lit(3.0)), F.greatest(F.abs(x), F.lit(3.0))
    series, fraction = F.lit(1.0), far
    for n in range(50, 0, -1):
        series = series * (near * near * (2 / (2 * n + 1))) + 1
    for n in range(30, 0, -1):
        fraction = F.lit(n / 2) / fraction + far
    inside = 2 / math.sqrt(math.pi) * near * F.exp(-near * near) * series
    return F.signum(x) * F.when(F.abs(x) < 3, inside).otherwise(1 - F.exp(-far * far) / (math.sqrt(math.pi) * fraction))


#: Elementwise functions of one value, by name.
UNARY = {
    "abs": F.abs, "ceil": lambda x: F.ceil(x).cast("double"), "cos": F.cos, "elu": lambda x: F.when(x > 0, x).otherwise(F.expm1(x)), "exp": F.exp, "expm1": F.expm1, "floor": lambda x: F.floor(x).cast("double"), "gelu": _gelu,
    "gelu_erf": lambda x: 0.5 * x * (1 + erf(x / math.sqrt(2))), "gelu_quick": lambda x: x * _sigmoid(1.702 * x), "hardsigmoid": lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x + 3) / 6)), "hardswish": lambda x: x * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x + 3) / 6)),
    "leaky_relu": lambda x: F.when(x > 0, x).otherwise(0.01 * x), "log": F.ln, "neg": lambda x: -x, "relu": lambda x: F.greatest(x, F.lit(0.0)), "round": lambda x: F.round(x, 0), "sgn": F.signum, "sigmoid": _sigmoid, "silu": lambda x: x * _sigmoid(x), "sin": F.sin,
    "softplus": lambda x: F.when(x > 20, x).otherwise(F.log1p(F.exp(x))), "sqr": lambda x: x * x, "sqrt": F.sqrt, "step": lambda x: F.when(x > 0, 1.0).otherwise(0.0), "tanh": F.tanh, "trunc": lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double"),
    "xielu": lambda x: F.when(x > 0, 0.8 * x * x + 0.5 * x).otherwise((F.expm1(F.least(x, F.lit(-1e-6))) - x) * 0.8 + 0.5 * x),
}
BINARY = {"add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y, "div": lambda x, y: x / y}
#: Of a row whose halves are gate and value.
GATED = {"reglu": UNARY["relu"], "geglu": _gelu, "geglu_erf": UNARY["gelu_erf"], "geglu_quick": UNARY["gelu_quick"], "swiglu": UNARY["silu"]}


def map_unary(name: str, a) -> Column:
    return F.transform(a, UNARY[name])


def map_binary(name: str, a, b) -> Column:
    return F.zip_with(a, b, BINARY[name])


def gated(name: str, a) -> Column:
    half = (F.size(a) / 2).cast("int")
    return F.zip_with(F.slice(a, F.lit(1), half), F.slice(a, half + 1, half), lambda g, v: GATED[name](g) * v)


def swiglu_oai(a, alpha: float = 1.702, limit: float = 7.0) -> Column:
    half = (F.size(a) / 2).cast("int")
    return F.zip_with(F.slice(a, F.lit(1), half), F.slice(a, half + 1, half), lambda g, v: F.least(g, F.lit(limit)) * _sigmoid(alpha * F.least(g, F.lit(limit))) * (F.greatest(F.lit(-limit), F.least(v, F.lit(limit))) + 1))


def scaled(a, by: float, plus: float = 0.0) -> Column:
    return F.transform(a, lambda x: x * by + plus)


def clamped(a, lo: float, hi: float) -> Column:
    return F.transform(a, lambda x: F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def filled(a, value: float) -> Column:
    return F.transform(a, lambda _: F.lit(value))


def accumulated(a, b, offset: int) -> Column:
    """ACC: b added onto a from an offset on."""
    return F.transform(a, lambda x, i: x + F.coalesce(F.get(b, i - offset), F.lit(0.0)))


def set_at(a, b, offset: int) -> Column:
    """SET: b written into a from an offset on."""
    return F.transform(a, lambda x, i: F.when(i >= offset, F.coalesce(F.get(b, i - offset), x)).otherwise(x))


def mean(a) -> Column:
    return total(a) / F.size(a)


def argmax(a) -> Column:
    """From 0; of equal values the first."""
    return F.array_position(a, F.array_max(a)) - 1


def cumsum(a) -> Column:
    return F.element_at(F.transform(F.array(F.struct(F.lit(0.0).alias("s"))), lambda _: F.transform(a, lambda x, i: total(F.slice(a, F.lit(1), i + 1)))), 1)


def _once(value, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def norm(a, eps: float = 1e-5) -> Column:
    return _once(mean(a), lambda m: _once(total(F.transform(a, lambda x: (x - m) * (x - m))) / F.size(a), lambda v: F.transform(a, lambda x: (x - m) / F.sqrt(v + eps))))


def rms_norm(a, eps: float = 1e-5) -> Column:
    return _once(dot(a, a) / F.size(a), lambda v: F.transform(a, lambda x: x / F.sqrt(v + eps)))


def l2_norm(a, eps: float = 1e-12) -> Column:
    return _once(F.greatest(F.sqrt(dot(a, a)), F.lit(eps)), lambda s: F.transform(a, lambda x: x / s))


def group_norm(a, groups: int, size: int, eps: float = 1e-6) -> Column:
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: norm(F.slice(a, g * size + 1, F.lit(size)), eps)))


def softmax(a) -> Column:
    return _once(F.array_max(a), lambda m: _once(total(F.transform(a, lambda x: F.exp(x - m))), lambda s: F.transform(a, lambda x: F.exp(x - m) / s)))


def log_softmax(a) -> Column:
    return _once(F.array_max(a), lambda m: _once(F.ln(total(F.transform(a, lambda x: F.exp(x - m)))), lambda s: F.transform(a, lambda x: x - m - s)))


def cross_entropy(logits, target) -> Column:
    return -dot(target, log_softmax(logits))


def argsort(a, descending: bool = False) -> Column:
    """Places from 0 in the order of their values; equal values keep theirs."""
    pairs = F.transform(a, lambda x, i: F.struct((-x if descending else x).alias("x"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"].cast("bigint"))


def top_places(a, k: int) -> Column:
    return F.slice(argsort(a, descending=True), F.lit(1), F.lit(k))


def rolled(a, by: int) -> Column:
    """ROLL: to the right by `by`."""
    n = F.size(a)
    s = F.pmod(F.lit(by), n)
    return F.concat(F.slice(a, n - s + 1, s), F.slice(a, F.lit(1), n - s))


def padded(a, left: int, right: int) -> Column:
    return F.concat(F.array_repeat(F.lit(0.0), left), a, F.array_repeat(F.lit(0.0), right))


def pad_reflect(a, left: int, right: int) -> Column:
    """PAD_REFLECT_1D: the ends mirrored, the outermost value not doubled."""
    return F.concat(F.reverse(F.slice(a, F.lit(2), F.lit(left))), a, F.reverse(F.slice(a, F.size(a) - right, F.lit(right))))


def repeated(a, n: int) -> Column:
    return F.flatten(F.array_repeat(a, n))


def arange(start: float, stop: float, step: float) -> Column:
    n = max(0, math.ceil((stop - start) / step))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(start) + i * step) if n else F.array().cast("array<double>")


def pool_1d(a, width: int, stride: int, how: str = "avg") -> Column:
    n = ((F.size(a) - width) / stride).cast("int")
    window = lambda i: F.slice(a, i * stride + 1, F.lit(width))
    return F.transform(F.sequence(F.lit(0), n), lambda i: mean(window(i)) if how == "avg" else F.array_max(window(i)))


def framed(a, width: int, hop: int) -> Column:
    """Windows of a width, one every hop; the last one that fits ends it. No window fits a shorter array."""
    n = F.size(a)
    starts = F.when(n >= width, F.sequence(F.lit(0), n - width, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(a, i + 1, F.lit(width)))


def rope(a, pos, base: float = 10000.0) -> Column:
    """ROPE on neighbouring pairs."""
    n = F.size(a)
    angle = lambda k: pos * F.pow(F.lit(base), -2.0 * k / n)
    half = lambda i: F.floor(i / 2)
    return F.transform(a, lambda x, i: F.when(i % 2 == 0, x * F.cos(angle(half(i))) - F.get(a, i + 1) * F.sin(angle(half(i)))).otherwise(F.get(a, i - 1) * F.sin(angle(half(i))) + x * F.cos(angle(half(i)))))


def timestep_embedding(t, dim: int, period: float = 10000.0) -> Column:
    half = dim // 2
    at = F.sequence(F.lit(0), F.lit(half - 1))
    angle = lambda i: t * F.exp(-math.log(period) * i / half)
    return F.concat(F.transform(at, lambda i: F.cos(angle(i))), F.transform(at, lambda i: F.sin(angle(i))))


def _by_repeats(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows that have an id to themselves; those that share one, if there are any."""
    ids = df.groupBy(key).count().where("count > 1").select(F.col(key).alias("_id"))
    if ids.isEmpty():
        return df, None
    same = F.col(key).eqNullSafe(F.col("_id"))
    return df.join(ids, same, "left_anti"), df.join(ids, same, "left_semi")


def matmul(a: DataFrame, b: DataFrame, limit: int = _SENT) -> DataFrame:
    """MUL_MAT: a(i, x) and b(j, y), arrays that are the rows of two matrices, to (i, j, v), summed over the places of both.

    b is sent to the tasks, `limit` rows at a time, and each pair made once, so nothing is shuffled. Nulls count for nothing; arrays of one
    id are added up, by partial sums that meet per (i, j); an empty or null array has no pairs."""
    (one, more), (other, others) = (_by_repeats(df.select(key, doubles(x).alias(x)).where(F.size(x) > 0), key) for df, key, x in ((a, "i", "x"), (b, "j", "y")))
    out = _products(one, other, _dots, limit)
    if rest := [_products(p, q, _dots, limit) for p, q in ((one, others), (more, other), (more, others)) if p is not None and q is not None]:
        out = out.unionAll(reduce(DataFrame.unionAll, rest).groupBy("i", "j").agg(F.sum("v").alias("v")))
    return out


def outer(a, b) -> Column:
    """OUT_PROD of two vectors, row by row."""
    return F.transform(a, lambda x: F.transform(b, lambda y: x * y))


def masked_inf(df: DataFrame, past: int = 0) -> DataFrame:
    """DIAG_MASK_INF on (i, j, v): what lies more than `past` right of the diagonal becomes -infinity."""
    return df.withColumn("v", F.when(F.col("j") > F.col("i") + past, F.lit(float("-inf"))).otherwise(F.col("v")))


def lower_triangle(df: DataFrame) -> DataFrame:
    """TRI: zero above the diagonal."""
    return df.withColumn("v", F.when(F.col("j") > F.col("i"), 0.0).otherwise(F.col("v")))


def matmul_by_id(a: DataFrame, b: DataFrame) -> DataFrame:
    """MUL_MAT_ID: a(i, k, v, id) with the matrix that each row names, b(id, j, k, v), to (i, id, j, v)."""
    both = a.select("i", "id", "k", F.col("v").alias("x")).join(b.select("id", "j", "k", F.col("v").alias("y")), ["id", "k"])
    return both.groupBy("i", "id", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def add_by_id(a: DataFrame, b: DataFrame) -> DataFrame:
    """ADD_ID: a(i, j, v, id) plus the row of b(id, j, w) that it names."""
    return a.join(b, ["id", "j"], "left").withColumn("v", F.col("v") + F.coalesce("w", F.lit(0.0))).drop("w")


def pool_2d(m: DataFrame, width: int, stride: int, how: str = "avg") -> DataFrame:
    """POOL_2D on (m, i, j, v): windows of width by width every stride, those that lie inside."""
    top = m.groupBy("m").agg(F.max("i").alias("_h"), F.max("j").alias("_w"))
    spans = lambda c: F.sequence(F.greatest(F.ceil((F.col(c) - width + 1) / stride), F.lit(0)).cast("int"), F.floor(F.col(c) / stride).cast("int"))
    rows = m.join(top, "m")
    rows = rows.where(F.floor(F.col("i") / stride) >= F.ceil((F.col("i") - width + 1) / stride)).withColumn("oi", F.explode(spans("i"))).withColumn("oj", F.explode(spans("j")))
    rows = rows.where((F.col("oi") * stride + width - 1 <= F.col("_h")) & (F.col("oj") * stride + width - 1 <= F.col("_w")))
    agg = F.avg("v") if how == "avg" else F.max("v")
    return rows.groupBy("m", F.col("oi").alias("i"), F.col("oj").alias("j")).agg(agg.alias("v"))


def im2col(m: DataFrame, width: int, stride: int = 1) -> DataFrame:
    """IM2COL on (m, i, j, v): (m, oi, oj, k, v), the k-th value of each window that lies inside."""
    top = m.groupBy("m").agg(F.max("i").alias("_h"), F.max("j").alias("_w"))
    at = F.transform(F.sequence(F.lit(0), F.lit(width * width - 1)), lambda k: F.struct(k.alias("k"), F.floor(k / width).alias("di"), (k % width).alias("dj")))
    rows = m.join(top, "m").select("m", "i", "j", "v", "_h", "_w", F.inline(at))
    rows = rows.withColumn("oi", F.col("i") - F.col("di")).withColumn("oj", F.col("j") - F.col("dj"))
    inside = (F.col("oi") >= 0) & (F.col("oj") >= 0) & (F.col("oi") + width - 1 <= F.col("_h")) & (F.col("oj") + width - 1 <= F.col("_w")) & (F.col("oi") % stride == 0) & (F.col("oj") % stride == 0)
    return rows.where(inside).select("m", (F.col("oi") / stride).cast("bigint").alias("oi"), (F.col("oj") / stride).cast("bigint").alias("oj"), "k", "v")


def upscaled(m: DataFrame, by: int) -> DataFrame:
    """UPSCALE on (m, i, j, v): each value by times by times, nearest."""
    each = F.sequence(F.lit(0), F.lit(by - 1))
    rows = m.withColumn("di", F.explode(each)).withColumn("dj", F.explode(each))
    return rows.select("m", (F.col("i") * by + F.col("di")).alias("i"), (F.col("j") * by + F.col("dj")).alias("j"), "v")


def solve_lower(a, b) -> Column:
    """SOLVE_TRI: x of a x = b for a lower triangular matrix (array of rows) and a vector, by a fold over the rows."""
    start = F.array().cast("array<double>")
    pairs = F.arrays_zip(a.alias("row"), b.alias("rhs"))

    def step(x, p):
        known = F.aggregate(F.zip_with(F.slice(p["row"], F.lit(1), F.size(x)), x, lambda u, v: u * v), F.lit(0.0), lambda s, t: s + t)
        return F.array_append(x, (p["rhs"] - known) / F.get(p["row"], F.size(x)))

    return F.aggregate(pairs, start, step)
