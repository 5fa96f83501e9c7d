"""Queries over vectors, tensors and the sampling chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import vector as V
from tessera.operators import sampling as M
from tessera.registry import query


def _rounded(a):
    return F.transform(a, lambda x: F.round(x, 6) + 0.0)


_E = "(SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
_R = "list_transform({x}, lambda v: round(v, 6) + 0.0)"


def _arrays(name, covers, spark_expr, sql_expr):
    """A query of one array per row of embeddings, against an expression over e."""

    @query(name, covers, f"SELECT vec_id, {_R.format(x=sql_expr)} AS out FROM {_E}")
    def _(t):
        return t("embeddings").select("vec_id", V.doubles("embedding").alias("e")).select("vec_id", _rounded(spark_expr(F.col("e"))).alias("out"))


_SUM = "list_sum(list_transform(e, lambda v: {f}))"
for _mode, _size in ((0, "list_max(list_transform(e, lambda v: abs(v))) / 32760.0::DOUBLE"), (1, _SUM.format(f="abs(v)")), (2, "sqrt(" + _SUM.format(f="v * v") + ")"), (3, "pow(" + _SUM.format(f="pow(abs(v), 3.0)") + ", 1.0::DOUBLE / 3)")):
    _arrays(f"embed_normalise_{_mode}", "V1", lambda e, m=_mode: V.normalised(e, m), f"list_transform(e, lambda x: x / ({_size.replace('lambda v', 'lambda w').replace('(v', '(w').replace('v * v', 'w * w')}))")

_UNARY_SQL = {
    "abs": "abs(x)", "ceil": "ceil(x * 10)", "cos": "cos(x)", "elu": "CASE WHEN x > 0 THEN x ELSE exp(x) - 1 END", "exp": "exp(x)", "expm1": "exp(x) - 1", "floor": "floor(x * 10)", "gelu": "0.5 * x * (1 + tanh(sqrt(2 / pi()) * x * (1 + 0.044715 * x * x)))",
    "gelu_quick": "x / (1 + exp(-1.702 * x))", "hardsigmoid": "least(1, greatest(0, (x + 3) / 6))", "hardswish": "x * least(1, greatest(0, (x + 3) / 6))", "leaky_relu": "CASE WHEN x > 0 THEN x ELSE 0.01 * x END", "neg": "-x", "relu": "greatest(x, 0)", "round": "round(x * 10)",
    "sgn": "sign(x)", "sigmoid": "1 / (1 + exp(-x))", "silu": "x / (1 + exp(-x))", "sin": "sin(x)", "softplus": "ln(1 + exp(x))", "sqr": "x * x", "step": "CASE WHEN x > 0 THEN 1 ELSE 0 END", "tanh": "tanh(x)", "trunc": "trunc(x * 10)", "xielu": "CASE WHEN x > 0 THEN 0.8 * x * x + 0.5 * x ELSE (exp(least(x, -1e-6)) - 1 - x) * 0.8 + 0.5 * x END",
}
for _name, _sql in _UNARY_SQL.items():
    _times = 10.0 if "x * 10" in _sql else 1.0
    _arrays(f"tensor_{_name}", f"tensor.{_name}", lambda e, n=_name, k=_times: V.map_unary(n, F.transform(e, lambda x: x * k)), f"list_transform(e, lambda x: ({_sql})::DOUBLE)")
_arrays("tensor_log_sqrt", "tensor.log tensor.sqrt", lambda e: V.map_unary("log", V.map_unary("sqrt", F.transform(e, lambda x: x * x + 0.1))), "list_transform(e, lambda x: ln(sqrt(x * x + 0.1)))")


# The error function by its series of positive terms, which sums to full precision within 60 terms for |x| < 4.
_GELU_ERF = "list_transform({0}, lambda x: 0.5 * x * (1 + CASE WHEN x = 0 THEN 0 ELSE sign(x) * 2 / sqrt(pi()) * exp(-x * x / 2) * list_sum(list_transform(range(0, 60), lambda n: exp((2 * n + 1) * ln(abs(x) / sqrt(2)) + 2 * n * ln(2) + lgamma(n + 1) - lgamma(2 * n + 2)))) END))"


@query("tensor_gelu_erf", "tensor.gelu_erf tensor.geglu_erf", f"WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), g AS (SELECT vec_id, e, {_GELU_ERF.format('e')} AS g FROM a) SELECT vec_id, list_transform(g, lambda v: round(v, 6) + 0.0) AS out, list_transform(range(1, len(e) // 2 + 1), lambda i: round(g[i] * e[len(e) // 2 + i], 6) + 0.0) AS gated FROM g")
def _(t):
    e = t("embeddings").select("vec_id", V.doubles("embedding").alias("e"))
    return e.select("vec_id", _rounded(V.map_unary("gelu_erf", F.col("e"))).alias("out"), _rounded(V.gated("geglu_erf", F.col("e"))).alias("gated"))


for _name, _op in (("add", "+"), ("sub", "-"), ("mul", "*"), ("div", "/")):
    _arrays(f"tensor_{_name}", f"tensor.{_name}", lambda e, n=_name: V.map_binary(n, e, F.transform(F.reverse(e), lambda x: x * x + 1.0)), f"list_transform(range(1, len(e) + 1), lambda i: e[i] {_op} (e[len(e) + 1 - i] * e[len(e) + 1 - i] + 1))")
_GATE_SQL = {"reglu": "greatest(x, 0)", "geglu": _UNARY_SQL["gelu"], "geglu_quick": _UNARY_SQL["gelu_quick"], "swiglu": _UNARY_SQL["silu"]}
for _name, _sql in _GATE_SQL.items():
    _arrays(f"tensor_{_name}", f"tensor.{_name}", lambda e, n=_name: V.gated(n, e), "list_transform(range(1, 33), lambda i: (" + _sql.replace("x", "e[i]").replace("eeei]p", "exp").replace("ee[i]p", "exp") + ") * e[i + 32])")
_arrays("tensor_swiglu_oai", "tensor.swiglu_oai", lambda e: V.swiglu_oai(F.transform(e, lambda x: x * 40)), "list_transform(range(1, 33), lambda i: least(e[i] * 40, 7) / (1 + exp(-1.702 * least(e[i] * 40, 7))) * (greatest(-7, least(e[i + 32] * 40, 7)) + 1))")
_arrays("tensor_scale_clamp", "tensor.scale tensor.clamp tensor.add1 tensor.fill", lambda e: F.concat(V.scaled(e, 2.0, 1.0), V.clamped(e, -0.1, 0.1), V.filled(F.slice(e, 1, 2), 3.0)), "list_concat(list_concat(list_transform(e, lambda x: x * 2 + 1), list_transform(e, lambda x: greatest(-0.1, least(0.1, x)))), [3.0, 3.0]::DOUBLE[])")
_arrays("tensor_acc_set", "tensor.acc tensor.set", lambda e: F.concat(V.accumulated(e, F.slice(e, 1, 4), 2), V.set_at(e, F.slice(e, 1, 4), 60)), "list_concat(list_transform(range(1, 65), lambda i: e[i] + CASE WHEN i BETWEEN 3 AND 6 THEN e[i - 2] ELSE 0 END), list_transform(range(1, 65), lambda i: CASE WHEN i > 60 THEN e[i - 60] ELSE e[i] END))")
_arrays("tensor_norm", "tensor.norm", V.norm, "list_transform(e, lambda x: (x - list_avg(e)) / sqrt(list_avg(list_transform(e, lambda y: y * y)) - list_avg(e) * list_avg(e) + 1e-5))")
_arrays("tensor_rms_norm", "tensor.rms_norm", V.rms_norm, "list_transform(e, lambda x: x / sqrt(list_avg(list_transform(e, lambda y: y * y)) + 1e-5))")
_arrays("tensor_l2_norm", "tensor.l2_norm", V.l2_norm, "list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y))))")
_arrays("tensor_group_norm", "tensor.group_norm", lambda e: V.group_norm(e, 2, 32, 1e-5), "list_concat(list_transform(e[1:32], lambda x: (x - list_avg(e[1:32])) / sqrt(list_var_pop(e[1:32]) + 1e-5)), list_transform(e[33:64], lambda x: (x - list_avg(e[33:64])) / sqrt(list_var_pop(e[33:64]) + 1e-5)))")
_arrays("tensor_softmax", "tensor.soft_max M1", V.softmax, "list_transform(e, lambda x: exp(x) / list_sum(list_transform(e, lambda y: exp(y))))")
_arrays("tensor_layout", "tensor.concat tensor.roll tensor.pad tensor.repeat tensor.cont tensor.dup tensor.cpy U5", lambda e: F.concat(V.rolled(e, 3), V.padded(F.slice(e, 1, 2), 1, 2), V.repeated(F.slice(e, 1, 2), 2)), "list_concat(list_concat(list_concat(e[62:64], e[1:61]), list_concat(list_concat([0.0]::DOUBLE[], e[1:2]), [0.0, 0.0]::DOUBLE[])), list_concat(e[1:2], e[1:2]))")
_arrays("tensor_pad_reflect", "tensor.pad_reflect_1d", lambda e: V.pad_reflect(F.slice(e, 1, 8), 2, 3), "list_concat(list_concat([e[3], e[2]], e[1:8]), [e[7], e[6], e[5]])")
_arrays("tensor_arange", "tensor.arange S20", lambda e: V.arange(0.5, 3.0, 0.75), "[0.5, 1.25, 2.0, 2.75]::DOUBLE[]")
_arrays("tensor_pool_1d", "tensor.pool_1d", lambda e: F.concat(V.pool_1d(e, 4, 4), V.pool_1d(e, 5, 3, "max")), "list_concat(list_transform(range(0, 16), lambda i: list_avg(e[i * 4 + 1:i * 4 + 4])), list_transform(range(0, 20), lambda i: list_max(e[i * 3 + 1:i * 3 + 5])))")
_arrays("tensor_rope", "tensor.rope", lambda e: V.rope(e, F.lit(7.0)), "list_transform(range(0, 64), lambda i: CASE WHEN i % 2 = 0 THEN e[i + 1] * cos(7.0 * pow(10000.0, -2.0 * (i // 2) / 64)) - e[i + 2] * sin(7.0 * pow(10000.0, -2.0 * (i // 2) / 64)) ELSE e[i] * sin(7.0 * pow(10000.0, -2.0 * (i // 2) / 64)) + e[i + 1] * cos(7.0 * pow(10000.0, -2.0 * (i // 2) / 64)) END)")
_arrays("tensor_cumsum", "tensor.cumsum W2", V.cumsum, "list_transform(range(1, 65), lambda i: list_sum(e[1:i]))")


@query("timestep_embedding", "tensor.timestep_embedding", "SELECT p_partkey, list_transform(list_concat(list_transform(range(0, 4), lambda i: cos(p_size * exp(-ln(10000.0::DOUBLE) * i / 4))), list_transform(range(0, 4), lambda i: sin(p_size * exp(-ln(10000.0::DOUBLE) * i / 4)))), lambda v: round(v, 6) + 0.0) AS out FROM part")
def _(t):
    return t("part").select("p_partkey", _rounded(V.timestep_embedding(F.col("p_size"), 8)).alias("out"))


@query("tensor_reductions", "tensor.sum tensor.sum_rows tensor.mean tensor.argmax tensor.count_equal A34", f"SELECT vec_id, round(list_sum(e), 6) AS total, round(list_avg(e), 6) AS mean, list_position(e, list_max(e))::BIGINT - 1 AS argmax, len(list_filter(e, lambda x: x > 0))::BIGINT AS n_equal FROM {_E}")
def _(t):
    e = t("embeddings").select("vec_id", V.doubles("embedding").alias("e"))
    x = F.col("e")
    return e.select("vec_id", F.round(V.total(x), 6).alias("total"), F.round(V.mean(x), 6).alias("mean"), V.argmax(x).alias("argmax"), F.size(F.filter(F.zip_with(V.map_unary("step", x), V.filled(x, 1.0), lambda a, b: a == b), lambda s: s)).alias("n_equal"))


@query("cross_entropy", "tensor.cross_entropy_loss A35", f"SELECT vec_id, round(-(e[label + 1] - ln(list_sum(list_transform(e, lambda y: exp(y))))), 6) AS loss FROM {_E}")
def _(t):
    target = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i == F.col("label"), 1.0).otherwise(0.0))
    return t("embeddings").select("vec_id", F.round(V.cross_entropy(V.doubles("embedding"), target), 6).alias("loss"))


@query("argsort", "W7 tensor.argsort tensor.top_k", f"SELECT vec_id, list_transform(list_sort(list_transform(range(0, 64), lambda i: {{'x': e[i + 1], 'i': i}})), lambda p: p.i)::BIGINT[] AS ascending, list_transform(list_sort(list_transform(range(0, 64), lambda i: {{'x': -e[i + 1], 'i': i}})), lambda p: p.i)[1:5]::BIGINT[] AS top FROM {_E}")
def _(t):
    e = t("embeddings").select("vec_id", V.doubles("embedding").alias("e"))
    return e.select("vec_id", V.argsort(F.col("e")).alias("ascending"), V.top_places(F.col("e"), 5).alias("top"))


_LONG = "(SELECT vec_id AS i, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings)"


@query("matmul", "tensor.mul_mat tensor.mul_mat_id", f"SELECT a.i, b.i AS j, round(sum(a.v * b.v), 6) AS v FROM {_LONG} a JOIN {_LONG} b ON a.k = b.k WHERE b.i % 50 = 0 GROUP BY 1, 2")
def _(t):
    """All vectors, as one matrix, by the transpose of a stated set of them."""
    a = t.spread("embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").alias("x"))
    b = t("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("j"), F.col("embedding").alias("y"))
    return V.matmul(a, b).select("i", "j", V.places("v", 6).alias("v"))


@query("outer_product", "tensor.out_prod tensor.diag_mask_inf tensor.tri tensor.diag", "SELECT vec_id, i::BIGINT AS i, j::BIGINT AS j, round(embedding[i + 1]::DOUBLE * embedding[j + 1]::DOUBLE, 6) AS v, CASE WHEN j > i THEN 0 ELSE round(embedding[i + 1]::DOUBLE * embedding[j + 1]::DOUBLE, 6) END AS lower, j <= i AS seen, i = j AS on_diagonal FROM embeddings, range(0, 4) r(i), range(0, 4) s(j)")
def _(t):
    e = t("embeddings").select("vec_id", F.slice(V.doubles("embedding"), 1, 4).alias("e"))
    rows = e.select("vec_id", F.posexplode(V.outer(F.col("e"), F.col("e"))).alias("i", "row")).select("vec_id", "i", F.posexplode("row").alias("j", "v")).withColumn("v", F.round("v", 6))
    return rows.withColumn("raw", F.col("v")).transform(V.lower_triangle).withColumnRenamed("v", "lower").withColumn("v", F.col("raw")).transform(V.masked_inf).select("vec_id", "i", "j", F.col("raw").alias("v"), "lower", (F.col("v") != F.lit(float("-inf"))).alias("seen"), (F.col("i") == F.col("j")).alias("on_diagonal"))


@query("retrieval_top_k", "J8 O4 V2 V3", "SELECT * FROM (SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) DESC, c.vec_id) AS rank FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0) WHERE rank <= 10")
def _(t):
    e = t("embeddings")
    out = V.top_k(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e, "vec_id", 10)
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("similarity_matrix", "J7 V2 K12", "SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0")
def _(t):
    """The rows of a stated set of vectors in the matrix that the embedding report prints."""
    q = t("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("i"), "embedding")
    out = V.similarities(q, t.spread("embeddings").select(F.col("vec_id").alias("j"), "embedding"))
    return out.select("i", "j", V.places("score", 6).alias("score"))


@query("pooling", "V4", "SELECT label::BIGINT AS seq_id, list_transform(range(1, 65), lambda i: round(list_avg(list_transform(es, lambda e: e[i])), 6) + 0.0) AS mean, list_transform(es[1], lambda v: round(v, 6) + 0.0) AS cls, list_transform(es[-1], lambda v: round(v, 6) + 0.0) AS last FROM (SELECT label, list(embedding::DOUBLE[] ORDER BY vec_id) AS es FROM embeddings GROUP BY label)")
def _(t):
    k = t("embeddings").select(F.col("label").cast("bigint").alias("seq_id"), F.col("vec_id").alias("pos"), V.doubles("embedding").alias("embedding"))
    out = V.pooled(k, "mean").select("seq_id", _rounded(F.col("embedding")).alias("mean"))
    for how in ("cls", "last"):
        out = out.join(V.pooled(k, how).select("seq_id", _rounded(F.col("embedding")).alias(how)), "seq_id")
    return out


_CAND = "cand AS (SELECT vec_id AS ctx, generate_subscripts(embedding, 1) - 1 AS id, 10 * unnest(embedding)::DOUBLE AS logit FROM embeddings), sm AS (SELECT *, exp(logit) / sum(exp(logit)) OVER (PARTITION BY ctx) AS p FROM cand), rk AS (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY logit DESC, id) AS r, sum(p) OVER (PARTITION BY ctx ORDER BY logit DESC, id ROWS UNBOUNDED PRECEDING) AS c, max(p) OVER (PARTITION BY ctx) AS top FROM sm)"


def _cand(t):
    return t("embeddings").select(F.col("vec_id").alias("ctx"), F.posexplode(V.doubles("embedding")).alias("id", "x")).select("ctx", F.col("id").cast("bigint").alias("id"), (F.col("x") * 10).alias("logit"))


def _final(df):
    return M.probabilities(df.select("ctx", "id", "logit")).select("ctx", "id", F.round("p", 6).alias("p"))


def _sampler(name, covers, step, kept, logit="logit"):
    @query(name, covers, f"WITH {_CAND}, kept AS (SELECT ctx, id, {logit} AS logit FROM ({kept})) SELECT ctx, id, round(exp(logit) / sum(exp(logit)) OVER (PARTITION BY ctx), 6) AS p FROM kept")
    def _(t):
        return _final(step(_cand(t), t))


_sampler("sample_softmax", "M1", lambda c, t: c, "SELECT * FROM rk")
_sampler("sample_temperature", "M3", lambda c, t: M.temperature(c, 0.8), "SELECT * FROM rk", "logit / 0.8")
_sampler("sample_top_k", "M5", lambda c, t: M.top_k(c, 7), "SELECT * FROM rk WHERE r <= 7")
_sampler("sample_top_p", "M6", lambda c, t: M.top_p(c, 0.7), "SELECT * FROM rk WHERE r = 1 OR c - p < 0.7")
_sampler("sample_min_p", "M7", lambda c, t: M.min_p(c, 0.2), "SELECT * FROM rk WHERE r = 1 OR p >= 0.2 * top")
_sampler("sample_bias", "M13", lambda c, t: M.bias(c, t.spark.createDataFrame([(3, -5.0), (9, 2.0)], "id long, bias double")), "SELECT ctx, id, logit + CASE id WHEN 3 THEN -5 WHEN 9 THEN 2 ELSE 0 END AS logit FROM cand")
_sampler("sample_chain", "M21 M5 M6 M3", lambda c, t: M.chain(c, [("k", {"k": 20}), ("t", {"t": 0.5})]), "SELECT * FROM rk WHERE r <= 20", "logit / 0.5")


@query("sample_greedy", "M2", f"WITH {_CAND} SELECT ctx, id, round(logit, 6) AS logit FROM rk WHERE r = 1")
def _(t):
    return M.greedy(_cand(t)).select("ctx", "id", F.round("logit", 6).alias("logit"))


@query("sample_log_softmax", "M1", f"WITH {_CAND} SELECT ctx, id, round(ln(p), 6) AS logp FROM sm")
def _(t):
    return M.log_probabilities(_cand(t)).select("ctx", "id", F.round("logp", 6).alias("logp"))


@query("sample_dynamic_temperature", "M4", f"WITH {_CAND}, h AS (SELECT ctx, 0.5 + 1.0 * (-sum(p * ln(p)) / ln(64.0::DOUBLE)) AS t FROM sm GROUP BY ctx), k AS (SELECT ctx, id, logit / t AS logit FROM cand JOIN h USING (ctx)) SELECT ctx, id, round(exp(logit) / sum(exp(logit)) OVER (PARTITION BY ctx), 6) AS p FROM k")
def _(t):
    return _final(M.dynamic_temperature(_cand(t), 1.0, 0.5))


@query("sample_typical", "M8", f"WITH {_CAND}, d AS (SELECT ctx, id, logit, p, round(abs(-ln(p) - (-sum(p * ln(p)) OVER (PARTITION BY ctx))), 9) AS d FROM sm), k AS (SELECT *, sum(p) OVER (PARTITION BY ctx ORDER BY d, logit DESC, id ROWS UNBOUNDED PRECEDING) - p AS before FROM d) SELECT ctx, id, round(p, 6) AS p FROM k WHERE before <= 0.5")
def _(t):
    return M.typical(_cand(t), 0.5).select("ctx", "id", F.round("p", 6).alias("p"))


@query("sample_n_sigma", "M9", f"WITH {_CAND}, k AS (SELECT *, max(logit) OVER (PARTITION BY ctx) - stddev_pop(logit) OVER (PARTITION BY ctx) AS cut FROM cand), e AS (SELECT ctx, id, CASE WHEN logit >= cut THEN exp(logit) ELSE 0 END AS e FROM k) SELECT ctx, id, round(e / sum(e) OVER (PARTITION BY ctx), 6) AS p FROM e")
def _(t):
    return _final(M.top_n_sigma(_cand(t), 1.0))


@query("sample_xtc", "M10", f"WITH {_CAND}, k AS (SELECT *, count(*) FILTER (WHERE p >= 0.05) OVER (PARTITION BY ctx) AS above FROM rk) SELECT ctx, id, round(p, 6) AS p FROM k WHERE above < 2 OR r >= above")
def _(t):
    return M.xtc(_cand(t), 1.0, 0.05).select("ctx", "id", F.round("p", 6).alias("p"))


_HIST = "hist AS (SELECT vec_id AS ctx, i AS pos, (vec_id * 7 + i * i) % 64 AS id FROM embeddings, range(0, 100) r(i))"


def _history(t):
    return t("embeddings").select(F.col("vec_id").alias("ctx"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("pos")).withColumn("id", ((F.col("ctx") * 7 + F.col("pos") * F.col("pos")) % 64).cast("bigint"))


@query("sample_penalties", "M11 W8", f"WITH {_CAND}, {_HIST}, n AS (SELECT ctx, id, count(*) AS n FROM hist WHERE pos >= 36 GROUP BY 1, 2), k AS (SELECT ctx, id, CASE WHEN n IS NULL THEN logit ELSE CASE WHEN logit <= 0 THEN logit * 1.2 ELSE logit / 1.2 END - n * 0.3 - 0.5 END AS logit FROM cand LEFT JOIN n USING (ctx, id)) SELECT ctx, id, round(exp(logit) / sum(exp(logit)) OVER (PARTITION BY ctx), 6) AS p FROM k")
def _(t):
    return _final(M.penalties(_cand(t), _history(t), 64, 1.2, 0.3, 0.5))


@query("sample_dry", "M12", f"WITH {_CAND}, {_HIST}, h AS (SELECT ctx, list(id ORDER BY pos) AS h FROM hist WHERE pos >= 36 GROUP BY ctx), m AS (SELECT ctx, h[i + 1] AS id, max(n) AS n FROM h, range(1, 64) a(i), range(0, 64) b(n) WHERE n <= i AND h[i - n + 1:i] = h[64 - n + 1:64] GROUP BY 1, 2), k AS (SELECT ctx, id, CASE WHEN n >= 2 THEN logit - pow(1.75, n - 2) ELSE logit END AS logit FROM cand LEFT JOIN m USING (ctx, id)), t AS (SELECT *, max(logit) OVER (PARTITION BY ctx) AS top FROM k) SELECT ctx, id, round(exp(logit - top) / sum(exp(logit - top)) OVER (PARTITION BY ctx), 6) AS p FROM t")
def _(t):
    return _final(M.dry(_cand(t), _history(t)))


@query("sample_draw", "M16")
def _(t):
    return M.draw(_cand(t), 11)


@query("sample_listing", "M18", f"WITH {_CAND} SELECT ctx, to_json(list({{'rank': r, 'id': id, 'p': round(p, 6)}} ORDER BY r))::VARCHAR AS top FROM rk WHERE r <= 3 GROUP BY ctx")
def _(t):
    out = M.listing(_cand(t), 3)
    return out.select("ctx", F.to_json(F.transform("top", lambda x: F.struct(x["rank"].alias("rank"), x["id"].alias("id"), F.round(x["p"], 6).alias("p")))).alias("top"))


@query("draft_verify", "M19 A27", "WITH p AS (SELECT conv_id AS ctx, i AS pos, CASE WHEN i < 5 THEN (conv_id + i) % 3 END AS draft, (conv_id + i * CASE WHEN i > conv_id % 5 THEN 2 ELSE 1 END) % 3 AS sampled FROM (SELECT DISTINCT conv_id FROM conversations), range(0, 6) r(i)), f AS (SELECT *, min(CASE WHEN draft IS DISTINCT FROM sampled THEN pos END) OVER (PARTITION BY ctx) AS first FROM p) SELECT ctx, pos::BIGINT AS pos, sampled::BIGINT AS sampled FROM f WHERE first IS NULL OR pos <= first")
def _(t):
    rows = t("conversations").select(F.col("conv_id").alias("ctx")).distinct().withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(5))))
    rows = rows.withColumn("draft", F.when(F.col("pos") < 5, (F.col("ctx") + F.col("pos")) % 3)).withColumn("sampled", (F.col("ctx") + F.col("pos") * F.when(F.col("pos") > F.col("ctx") % 5, 2).otherwise(1)) % 3)
    return M.accepted(rows).select("ctx", "pos", "sampled")


@query("reasoning_budget", "M20", "WITH k AS (SELECT conv_id AS ctx, turn * 100000000 + i AS pos, CASE WHEN i = 2 THEN '<think>' WHEN i = 9 THEN '</think>' ELSE w END AS piece FROM (SELECT conv_id, turn, generate_subscripts(string_split(text, ' '), 1) AS i, unnest(string_split(text, ' ')) AS w FROM conversations)), b AS (SELECT *, sum(CASE WHEN piece = '<think>' THEN 1 ELSE 0 END) OVER w AS block, last_value(CASE piece WHEN '<think>' THEN 1 WHEN '</think>' THEN 0 END IGNORE NULLS) OVER w AS open FROM k WINDOW w AS (PARTITION BY ctx ORDER BY pos ROWS UNBOUNDED PRECEDING)), s AS (SELECT *, coalesce(open = 1, FALSE) AND piece <> '<think>' AS in_block FROM b), t AS (SELECT *, sum(in_block::INT) OVER (PARTITION BY ctx, block ORDER BY pos ROWS UNBOUNDED PRECEDING) AS spent FROM s) SELECT ctx, pos, piece, in_block, spent::BIGINT AS spent, in_block AND spent > 4 AS forced FROM t")
def _(t):
    k = t("conversations").select(F.col("conv_id").alias("ctx"), "turn", F.posexplode(F.split("text", " ")).alias("i", "w")).withColumn("i", F.col("i") + 1)
    k = k.select("ctx", (F.col("turn") * 100_000_000 + F.col("i")).alias("pos"), F.when(F.col("i") == 2, "<think>").when(F.col("i") == 9, "</think>").otherwise(F.col("w")).alias("piece"))
    return M.within_budget(k, "<think>", "</think>", 4)


@query("sample_mirostat", "M14")
def _(t):
    steps = t("embeddings").select((F.col("vec_id") % 10).alias("stream"), F.floor(F.col("vec_id") / 10).alias("step"), F.posexplode(V.doubles("embedding")).alias("id", "x"))
    return M.mirostat(steps.select("stream", "step", F.col("id").cast("bigint").alias("id"), (F.col("x") * 10).alias("logit")), 2, 3.0)


_GRID = "(SELECT vec_id AS m, k // 8 AS i, k % 8 AS j, v FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings))"


def _grid(t):
    e = t("embeddings").select(F.col("vec_id").alias("m"), F.posexplode(V.doubles("embedding")).alias("k", "v"))
    return e.select("m", F.floor(F.col("k") / 8).alias("i"), (F.col("k") % 8).cast("bigint").alias("j"), "v")


@query("tensor_pool_2d", "tensor.pool_2d", f"SELECT g.m, a.a::BIGINT AS i, b.b::BIGINT AS j, round(avg(v), 6) AS v, round(max(v), 6) AS top FROM {_GRID} g, range(0, 3) a(a), range(0, 3) b(b) WHERE g.i BETWEEN a.a * 2 AND a.a * 2 + 3 AND g.j BETWEEN b.b * 2 AND b.b * 2 + 3 GROUP BY 1, 2, 3")
def _(t):
    g = _grid(t)
    top = V.pool_2d(g, 4, 2, "max").withColumnRenamed("v", "top")
    return V.pool_2d(g, 4, 2).join(top, ["m", "i", "j"]).select("m", "i", "j", F.round("v", 6).alias("v"), F.round("top", 6).alias("top"))


@query("tensor_im2col", "tensor.im2col tensor.im2col_3d", f"SELECT g.m, a.a::BIGINT AS oi, b.b::BIGINT AS oj, (g.i - a.a) * 3 + g.j - b.b AS k, round(v, 6) AS v FROM {_GRID} g, range(0, 6) a(a), range(0, 6) b(b) WHERE g.i BETWEEN a.a AND a.a + 2 AND g.j BETWEEN b.b AND b.b + 2")
def _(t):
    return V.im2col(_grid(t), 3).select("m", "oi", "oj", "k", F.round("v", 6).alias("v"))


@query("tensor_upscale", "tensor.upscale", f"SELECT m, i * 2 + a AS i, j * 2 + b AS j, round(v, 6) AS v FROM {_GRID} g, range(0, 2) r(a), range(0, 2) s(b)")
def _(t):
    return V.upscaled(_grid(t), 2).select("m", "i", "j", F.round("v", 6).alias("v"))


@query("tensor_by_id", "tensor.mul_mat_id tensor.add_id", "WITH a AS (SELECT vec_id AS i, label % 3 AS id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings), b AS (SELECT vec_id // 4 AS id, vec_id % 4 AS j, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings WHERE vec_id < 12) SELECT i, a.id::BIGINT AS id, j, round(sum(a.v * b.v) + CASE WHEN a.id = 1 THEN j ELSE 0 END, 6) AS v FROM a JOIN b ON a.id = b.id AND a.k = b.k GROUP BY i, a.id, j")
def _(t):
    """Every vector by one of three 4 by 64 matrices, which are the first twelve vectors."""
    e = t("embeddings").select("vec_id", "label", F.posexplode(V.doubles("embedding")).alias("k", "v"))
    a = e.select(F.col("vec_id").alias("i"), (F.col("label") % 3).cast("bigint").alias("id"), "k", "v")
    b = e.where("vec_id < 12").select(F.floor(F.col("vec_id") / 4).alias("id"), (F.col("vec_id") % 4).alias("j"), "k", "v")
    bias = t.spark.range(4).select(F.lit(1).cast("bigint").alias("id"), F.col("id").alias("j"), F.col("id").cast("double").alias("w"))
    return V.add_by_id(V.matmul_by_id(a, b), bias).select("i", "id", "j", F.round("v", 6).alias("v"))


@query("tensor_solve_tri", "tensor.solve_tri", "SELECT vec_id, list_transform([embedding[1]::DOUBLE / 2, (embedding[2]::DOUBLE - embedding[1]::DOUBLE / 2) / 3, (embedding[3]::DOUBLE - 4 * embedding[1]::DOUBLE / 2 - 5 * (embedding[2]::DOUBLE - embedding[1]::DOUBLE / 2) / 3) / 6], lambda x: round(x, 6) + 0.0) AS x FROM embeddings")
def _(t):
    rows = F.array(*(F.array(*(F.lit(float(x)) for x in r)) for r in ((2, 0, 0), (1, 3, 0), (4, 5, 6))))
    return t("embeddings").select("vec_id", _rounded(V.solve_lower(rows, F.slice(V.doubles("embedding"), 1, 3))).alias("x"))
