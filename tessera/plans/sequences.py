"""Queries over n-grams, statistics, conversation trees, cache cells and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import scratch
from tessera.functions import vector as V
from tessera.operators import batching as B
from tessera.operators import ngram as N
from tessera.operators import stats as S
from tessera.operators import tree as R
from tessera.registry import query, r6
from tessera.sources import writers as W

_TOK = r"tok AS (SELECT doc_id AS seq_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents))"


def _gram(n):
    own = ", ".join(f"lead(token, {i}) OVER o" for i in range(n))
    return f"SELECT seq_id, pos, [{own}] AS ngram, lead(token, {n}) OVER o AS next FROM tok WINDOW o AS (PARTITION BY seq_id ORDER BY pos)"


_COUNTS = " UNION ALL ".join(f"SELECT {n} AS n, ngram, next, count(*) AS cnt FROM ({_gram(n)}) WHERE next IS NOT NULL GROUP BY ngram, next" for n in (1, 2))


def _tokens(t):
    return N.word_tokens(t.spread("documents"))


@query("ngram_counts", "W3 A24 Z6", f"WITH {_TOK}, c AS ({_COUNTS}) SELECT n::BIGINT AS n, array_to_string(ngram, ' ') AS ngram, next, cnt FROM c WHERE cnt > 1")
def _(t):
    return N.text_counts(t.spread("documents"), (1, 2)).where("cnt > 1")


@query("ngram_merge", "A25", f"WITH {_TOK}, c AS ({_COUNTS}) SELECT n::BIGINT AS n, array_to_string(ngram, ' ') AS ngram, next, cnt::BIGINT AS cnt FROM c WHERE n = 1 AND cnt > 2")
def _(t):
    k = _tokens(t)
    return N.merged(N.counts(k.where("seq_id % 2 = 0"), (1,)), N.counts(k.where("seq_id % 2 = 1"), (1,))).where("cnt > 2").withColumn("ngram", F.array_join("ngram", " "))


_DRAFT = "d AS (SELECT n, ngram, min_by(next, {'c': -cnt, 't': next}) AS draft, max(cnt) AS cnt, sum(cnt)::BIGINT AS total FROM c GROUP BY n, ngram), g AS (SELECT * FROM d WHERE (n = 1 AND total >= 2 AND 100 * cnt >= 66 * total) OR (n = 2 AND total >= 2 AND 100 * cnt >= 50 * total))"


@query("ngram_draft", "A26", f"WITH {_TOK}, c AS ({_COUNTS}), {_DRAFT} SELECT n::BIGINT AS n, array_to_string(ngram, ' ') AS ngram, draft, cnt, total FROM g")
def _(t):
    return N.drafts(N.text_counts(t.spread("documents"), (1, 2)))


@query("ngram_probe", "J10 K13", f"WITH {_TOK}, c AS ({_COUNTS}), {_DRAFT}, x AS (SELECT seq_id AS ctx, list(token ORDER BY pos)[-2:] AS tail FROM tok GROUP BY 1) SELECT ctx, coalesce(b.draft, a.draft) AS draft, CASE WHEN b.draft IS NOT NULL THEN 2 WHEN a.draft IS NOT NULL THEN 1 END::BIGINT AS n FROM x LEFT JOIN g b ON b.n = 2 AND b.ngram = tail AND len(tail) = 2 LEFT JOIN g a ON a.n = 1 AND a.ngram = tail[-1:]")
def _(t):
    k = _tokens(t)
    tails = k.groupBy(F.col("seq_id").alias("ctx")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("w")).select("ctx", F.slice("w", F.greatest(F.size("w") - 1, F.lit(1)), F.lit(2)).alias("tail"))
    path = scratch.path(t.spark, "ngram-cache")  # saved once, probed for each length
    W.append(N.drafts(N.text_counts(t.spread("documents"), (1, 2))), path)
    cache = t.spark.read.parquet(path).withColumn("ngram", F.split("ngram", " "))
    return N.probe(tails, [cache], (2, 1)).select("ctx", "draft", "n")


@query("ngram_weighted", "J11", f"WITH {_TOK}, c AS ({_COUNTS}), s AS (SELECT ngram, next, cnt * coalesce(CASE WHEN cnt > 3 THEN 100 * cnt END, 1) AS score FROM c WHERE n = 1) SELECT array_to_string(ngram, ' ') AS ngram, min_by(next, {{'s': -score, 't': next}}) AS draft, max(score)::BIGINT AS score FROM s GROUP BY ngram")
def _(t):
    c = N.text_counts(t.spread("documents"), (1,))
    return N.weighted(c, c.where("cnt > 3")).select("ngram", "draft", "score")


@query("acceptance", "A27", f"WITH {_TOK}, c AS ({_COUNTS}), {_DRAFT}, y AS ({_gram(2)}) SELECT count(*) AS n_drafted, count(*) FILTER (WHERE draft = next) AS n_accepted, round(count(*) FILTER (WHERE draft = next) / count(*), 6) AS rate FROM y JOIN g ON g.n = 2 AND g.ngram = y.ngram WHERE next IS NOT NULL")
def _(t):
    k = _tokens(t)
    return N.acceptance(k, N.drafts(N.text_counts(t.spread("documents"), (2,))).withColumn("ngram", F.split("ngram", " ")), 2).select("n_drafted", "n_accepted", *r6("rate"))


@query("lookup_previous", "W4 W5", f"WITH {_TOK}, y AS ({_gram(2)}), z AS (SELECT *, lag(pos) OVER s AS prev, row_number() OVER s - 1 AS hits FROM y WHERE next IS NOT NULL WINDOW s AS (PARTITION BY seq_id, ngram ORDER BY pos)), q AS (SELECT seq_id, list(token ORDER BY pos) AS w FROM tok GROUP BY 1) SELECT seq_id, pos::BIGINT AS pos, prev::BIGINT AS prev, hits, array_to_string(w[prev + 3:prev + 5], ' ') AS copied FROM z JOIN q USING (seq_id) WHERE hits >= 1")
def _(t):
    return N.last_match(_tokens(t), 2, 3).select("seq_id", "pos", F.col("at").alias("prev"), "hits", F.array_join("copied", " ").alias("copied"))


@query("modulo_table", "W6")
def _(t):
    return N.modulo_table(_tokens(t), 2, 4096)


@query("token_history", "W8 X10", f"WITH {_TOK} SELECT seq_id, pos::BIGINT AS pos, array_to_string(list(token) OVER (PARTITION BY seq_id ORDER BY pos ROWS 4 PRECEDING), ' ') AS last FROM tok")
def _(t):
    return N.history(_tokens(t), 5).select("seq_id", "pos", F.array_join("last", " ").alias("last"))


@query("moving_average", "W9", "SELECT vec_id, round(list_reduce(embedding::DOUBLE[], lambda s, x: s * 0.9 + x * 0.1), 6) AS ema FROM embeddings")
def _(t):
    return t("embeddings").select("vec_id", F.round(N.moving_average(V.doubles("embedding")), 6).alias("ema"))


_VALS = "vals AS (SELECT 'blk.' || label || '.w' AS tensor, vec_id * 64 + generate_subscripts(embedding, 1) AS j, abs(unnest(embedding)::DOUBLE) * (1 + vec_id % 3) AS v, vec_id % 3 AS count FROM embeddings)"


def _values(t):
    e = t("embeddings").select("vec_id", "label", F.posexplode(V.doubles("embedding")).alias("k", "x"))
    return e.select(F.concat(F.lit("blk."), F.col("label").cast("string"), F.lit(".w")).alias("tensor"), (F.col("vec_id") * 64 + F.col("k") + 1).alias("j"), (F.abs("x") * (1 + F.col("vec_id") % 3)).alias("v"), (F.col("vec_id") % 3).alias("count"))


@query("tensor_stats", "A17 A19 O5", f"WITH {_VALS}, r AS (SELECT tensor, v / count AS v FROM vals WHERE count <> 0), f AS (SELECT tensor, count(*) AS n, sum(v) AS total, min(v) AS least, max(v) AS most, avg(v) AS mean, stddev_pop(v) AS sd, count(*) FILTER (WHERE abs(v) > 1e-5) / count(*) AS active FROM r GROUP BY 1), s AS (SELECT tensor, -sum(CASE WHEN v > 0 THEN v / total * log2(v / total) END) AS entropy, count(*) FILTER (WHERE (v - mean) / sd > 1) / count(*) AS z_share FROM r JOIN f USING (tensor) GROUP BY 1) SELECT tensor, n, round(total, 6) AS total, round(least, 9) AS least, round(most, 6) AS most, round(mean, 6) AS mean, round(sd, 6) AS sd, round(active, 6) AS active, round(entropy, 6) AS entropy, round(z_share, 6) AS z_share, round(100 * entropy / log2(n), 6) AS entropy_share FROM f JOIN s USING (tensor)")
def _(t):
    out = S.tensor_statistics(_values(t)).orderBy("tensor", F.col("total").desc())
    return out.select("tensor", "n", *r6("total"), F.round("least", 9).alias("least"), *r6("most", "mean", "sd", "active", "entropy", "z_share", "entropy_share"))


@query("layer_weighted", "A18 C27", f"WITH {_VALS}, f AS (SELECT tensor, sum(v) AS total, count(*) AS n FROM vals WHERE count <> 0 GROUP BY 1) SELECT regexp_extract(tensor, 'blk\\.(\\d+)\\.', 1)::BIGINT AS layer, round(sum(n * total) / sum(n), 6) AS mean, count(*) AS n FROM f GROUP BY 1")
def _(t):
    f = _values(t).where("count <> 0").groupBy("tensor").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("size"))
    out = S.layer_mean(f.withColumn("layer", F.regexp_extract("tensor", r"blk\.(\d+)\.", 1).cast("bigint")), "layer", "total", "size")
    return out.select("layer", *r6("mean"), "n")


@query("layer_cossim", "J9 W11", "WITH e AS (SELECT label::BIGINT AS layer, 'w' || row_number() OVER (PARTITION BY label ORDER BY vec_id) AS name, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.layer, a.name, round(list_cosine_similarity(a.v, b.v), 6) AS cossim FROM e a LEFT JOIN e b ON b.layer = a.layer - 1 AND b.name = a.name")
def _(t):
    from pyspark.sql import Window

    e = t("embeddings").select(F.col("label").cast("bigint").alias("layer"), F.concat(F.lit("w"), F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("string")).alias("name"), V.doubles("embedding").alias("v"))
    return S.previous_layer(e, "layer", "name", "v").select("layer", "name", *r6("cossim"))


@query("stats_merge", "A20 K14", f"WITH {_VALS} SELECT tensor, j % 100 AS j, round(sum(v), 6) AS v, sum(count)::BIGINT AS count FROM vals GROUP BY 1, 2")
def _(t):
    v = _values(t).withColumn("j", F.col("j") % 100)
    return S.merged(v.where("count < 2"), v.where("count >= 2")).select("tensor", "j", *r6("v"), "count")


@query("perplexity", "A21", "WITH x AS (SELECT label::BIGINT AS label, ln(list_sum(list_transform(embedding::DOUBLE[], lambda y: exp(y)))) - embedding[label + 1]::DOUBLE AS nll FROM embeddings) SELECT label, count(*) AS n, round(exp(avg(nll)), 6) AS ppl, round(exp(avg(nll)) * sqrt((avg(nll * nll) - avg(nll) * avg(nll)) / (count(*) - 1)), 6) AS error FROM x GROUP BY 1")
def _(t):
    x = t("embeddings").select(F.col("label").cast("bigint").alias("label"), (-F.get(V.log_softmax(V.doubles("embedding")), F.col("label"))).alias("nll"))
    return S.perplexity(x, "nll", ["label"]).select("label", "n", *r6("ppl", "error"))


@query("kl_report", "A22", """WITH l AS (SELECT a.vec_id AS pos, generate_subscripts(a.embedding, 1) - 1 AS id, unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y, a.label AS target FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
    p AS (SELECT pos, id, target, exp(x) / sum(exp(x)) OVER (PARTITION BY pos) AS p, exp(y) / sum(exp(y)) OVER (PARTITION BY pos) AS q FROM l),
    g AS (SELECT pos, sum(p * ln(p / q)) AS kld, max(CASE WHEN id = target THEN p END) AS pt, max(CASE WHEN id = target THEN q END) AS qt, (arg_min(id, {'a': -p, 'b': id}) = arg_min(id, {'a': -q, 'b': id}))::INT AS same FROM p GROUP BY pos)
    SELECT count(*) AS n, round(avg(kld), 6) AS mean_kld, round(exp(-avg(ln(pt))), 6) AS ppl_p, round(exp(-avg(ln(qt))), 6) AS ppl_q, round(exp(avg(ln(pt)) - avg(ln(qt))), 6) AS ppl_ratio, round(corr(ln(pt), ln(qt)), 6) AS rho, round(quantile_cont(qt - pt, 0.05), 6) AS dp_p05, round(quantile_cont(qt - pt, 0.5), 6) AS dp_p50, round(quantile_cont(qt - pt, 0.95), 6) AS dp_p95, round(sqrt(avg((qt - pt) * (qt - pt))), 6) AS dp_rms, round(avg(same), 6) AS same_top, round(sqrt(avg(same) * (1 - avg(same)) / (count(*) - 1)), 6) AS same_top_error FROM g""")  # fmt: skip
def _(t):
    e = t("embeddings").select("vec_id", "label", V.softmax(V.doubles("embedding")).alias("p"))
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q"))
    pairs = e.join(other, "vec_id").select(F.col("vec_id").alias("pos"), F.col("label").alias("target"), F.posexplode(F.arrays_zip("p", "q")).alias("id", "x")).select("pos", "target", "id", "x.p", "x.q")
    out = S.divergence(pairs)
    return out.select("n", *r6(*out.columns[1:]))


@query("nmse", "A23", "WITH l AS (SELECT a.label::BIGINT AS label, unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT label, round(sum((x - y) * (x - y)) / sum(x * x), 6) AS nmse, sum((x - y) * (x - y)) / sum(x * x) <= 1e-6 AS passed FROM l GROUP BY 1")
def _(t):
    e = t("embeddings").select("vec_id", F.col("label").cast("bigint").alias("label"), V.doubles("embedding").alias("a"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id").select("label", F.explode(F.arrays_zip("a", "b")).alias("x")).select("label", "x.a", "x.b")
    return S.nmse(pairs, "a", "b", ["label"]).select("label", *r6("nmse"), "passed")


@query("mean_direction", "A30", "WITH d AS (SELECT label::BIGINT AS label, j, avg(v) AS v FROM (SELECT label, generate_subscripts(embedding, 1) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY 1, 2), n AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY label)) AS s FROM d) SELECT label, list(round(v / s, 6) + 0.0 ORDER BY j) AS direction FROM n GROUP BY label")
def _(t):
    e = t("embeddings").select(F.col("label").cast("bigint").alias("label"), V.doubles("embedding").alias("v"))
    return S.mean_direction(e, "label", "v").select("label", F.transform("direction", lambda x: F.round(x, 6) + 0.0).alias("direction"))


@query("principal_direction", "A31")
def _(t):
    x = S.principal_direction(t("embeddings"), "embedding", 64)
    return t.spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(x)], "j long, v double")


@query("parameter_totals", "A32", "SELECT p_brand, sum(p_size)::BIGINT AS total, coalesce(sum(p_size) FILTER (WHERE p_type = 'SMALL'), 0)::BIGINT AS expert, sum(p_size)::BIGINT - coalesce(sum(p_size) FILTER (WHERE p_type = 'SMALL'), 0)::BIGINT AS shared, count(*) FILTER (WHERE p_type = 'SMALL') AS n_expert FROM part GROUP BY 1")
def _(t):
    expert = F.sum(F.when(F.col("p_type") == "SMALL", F.col("p_size")).otherwise(0))
    return t("part").groupBy("p_brand").agg(F.sum("p_size").alias("total"), expert.alias("expert"), (F.sum("p_size") - expert).alias("shared"), F.count_if(F.col("p_type") == "SMALL").alias("n_expert"))


@query("content_hashes", "A33", "SELECT doc_id, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def _(t):
    return t.spread("documents").select("doc_id", F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"))


# Each turn answers the one before it; every fourth hangs one turn higher, so conversations branch.
_MSG = "msg AS (SELECT conv_id || '-' || turn AS id, conv_id AS \"convId\", CASE WHEN turn = 0 THEN NULL WHEN turn % 4 = 3 THEN conv_id || '-' || (turn - 2) ELSE conv_id || '-' || (turn - 1) END AS parent, turn AS timestamp, role, text AS content FROM conversations)"


def _messages(t):
    k = lambda d: F.concat(F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - d).cast("string"))
    parent = F.when(F.col("turn") == 0, None).when(F.col("turn") % 4 == 3, k(2)).otherwise(k(1))
    return t("conversations").select(k(0).alias("id"), F.col("conv_id").alias("convId"), parent.alias("parent"), F.col("turn").alias("timestamp"), "role", F.col("text").alias("content"))


@query("conv_path", "R2 O6 J13", f"WITH RECURSIVE {_MSG}, p(id, parent, up) AS (SELECT id, parent, 0 FROM msg WHERE id = '19-5' UNION ALL SELECT m.id, m.parent, up + 1 FROM p JOIN msg m ON m.id = p.parent) SELECT p.id, timestamp, role FROM p JOIN msg ON msg.id = p.id")
def _(t):
    return R.path(t.spark, _messages(t), "19-5").select("id", "timestamp", "role")


@query("conv_latest_path", "R2", f"WITH RECURSIVE {_MSG}, p(id, parent, up) AS (SELECT * FROM (SELECT id, parent, 0 FROM msg WHERE \"convId\" = 9 ORDER BY timestamp DESC, id LIMIT 1) UNION ALL SELECT m.id, m.parent, up + 1 FROM p JOIN msg m ON m.id = p.parent) SELECT p.id, timestamp FROM p JOIN msg ON msg.id = p.id")
def _(t):
    return R.path(t.spark, _messages(t), "no such leaf", 9).select("id", "timestamp")


@query("conv_all_paths", "J13 R2", f"WITH RECURSIVE {_MSG}, p(leaf, id, parent, up) AS (SELECT id, id, parent, 0 FROM msg WHERE id NOT IN (SELECT parent FROM msg WHERE parent IS NOT NULL) UNION ALL SELECT leaf, m.id, m.parent, up + 1 FROM p JOIN msg m ON m.id = p.parent) SELECT leaf, id, up::BIGINT AS up FROM p")
def _(t):
    return R.paths(_messages(t), t.spark)


@query("conv_leaf", "R3", f"WITH RECURSIVE {_MSG}, l AS (SELECT parent, max_by(id, (timestamp, id)) AS child FROM msg WHERE parent IS NOT NULL GROUP BY 1), d(start, id, depth) AS (SELECT id, id, 0 FROM msg UNION ALL SELECT start, child, depth + 1 FROM d JOIN l ON l.parent = d.id) SELECT start, max_by(id, depth) AS leaf FROM d GROUP BY 1")
def _(t):
    m = _messages(t)
    return R.leaf_of(t.spark, m, m.select("id"))


@query("conv_descendants", "R4", f"WITH RECURSIVE {_MSG}, d(start, id, depth) AS (SELECT id, id, 0 FROM msg WHERE timestamp < 2 UNION ALL SELECT start, m.id, depth + 1 FROM d JOIN msg m ON m.parent = d.id) SELECT start, id, depth::BIGINT AS depth FROM d WHERE depth > 0")
def _(t):
    m = _messages(t)
    return R.descendants(t.spark, m, m.where("timestamp < 2").select("id"))


@query("conv_siblings", "R5 W12", f"WITH {_MSG} SELECT \"convId\", id, row_number() OVER o - 1 AS place, count(*) OVER (PARTITION BY \"convId\", parent) AS n_siblings, lag(id) OVER o AS previous, lead(id) OVER o AS next FROM msg WINDOW o AS (PARTITION BY \"convId\", parent ORDER BY timestamp, id)")
def _(t):
    return R.siblings(_messages(t))


@query("conv_branch", "R1", f"WITH {_MSG} SELECT id, parent FROM msg UNION ALL SELECT 'new-' || id, id FROM msg WHERE timestamp = 1")
def _(t):
    m = _messages(t)
    new = m.where("timestamp = 1").select(F.concat(F.lit("new-"), "id").alias("id"), "convId", F.col("id").alias("parent"), "timestamp", "role", "content")
    orphan = m.where("timestamp = 2").select(F.concat(F.lit("lost-"), "id").alias("id"), "convId", F.lit("nowhere").alias("parent"), "timestamp", "role", "content")
    return R.with_branch(m, new.unionByName(orphan)).select("id", "parent")


@query("conv_delete", "R6 R4", f"WITH RECURSIVE {_MSG}, d(id) AS (SELECT id FROM msg WHERE timestamp = 2 UNION ALL SELECT m.id FROM d JOIN msg m ON m.parent = d.id) SELECT id FROM msg WHERE id NOT IN (SELECT id FROM d)")
def _(t):
    m = _messages(t)
    return R.delete_cascading(t.spark, m, m.where("timestamp = 2").select("id")).select("id")


@query("conv_reparent", "R6", f"WITH {_MSG} SELECT m.id, CASE WHEN g.id IS NOT NULL THEN g.parent ELSE m.parent END AS parent FROM msg m LEFT JOIN (SELECT * FROM msg WHERE timestamp = 1) g ON m.parent = g.id WHERE m.timestamp <> 1")
def _(t):
    m = _messages(t)
    return R.delete_reparenting(m, m.where("timestamp = 1").select("id")).select("id", "parent")


@query("conv_fork", "R7", f"WITH RECURSIVE {_MSG}, p(id, parent) AS (SELECT id, parent FROM msg WHERE id = '19-5' UNION ALL SELECT m.id, m.parent FROM p JOIN msg m ON m.id = p.parent) SELECT id || '@900' AS id, 900::BIGINT AS \"convId\", parent || '@900' AS parent FROM p")
def _(t):
    return R.fork(t.spark, _messages(t), "19-5", 900).select("id", "convId", "parent")


@query("conv_import", "R8 K16", f"WITH {_MSG} SELECT count(*) FILTER (WHERE timestamp >= 2) AS imported, count(*) FILTER (WHERE timestamp = 1) AS skipped FROM msg WHERE timestamp >= 1")
def _(t):
    m = _messages(t)
    return R.imported(m.where("timestamp < 2"), m.where("timestamp >= 1"))[1]


@query("conv_counts", "R9 A36 O7", "SELECT c_custkey AS id, coalesce(n, 0) AS n_messages FROM customer LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) ON conv_id = c_custkey")
def _(t):
    return R.message_counts(t("customer").select(F.col("c_custkey").alias("id")), _messages(t)).orderBy("id")


_CELLS = "cells AS (SELECT conv_id AS seq, turn AS pos, conv_id * 100 + turn AS cell FROM conversations)"


def _cells(t):
    return t("conversations").select(F.col("conv_id").alias("seq"), F.col("turn").alias("pos"), (F.col("conv_id") * 100 + F.col("turn")).alias("cell"))


@query("kv_seq_ops", "R10 R11 R12 R13 R14", f"WITH {_CELLS} SELECT 'remove' AS op, * FROM cells WHERE NOT (pos >= 1 AND pos < 3) UNION ALL SELECT 'copy', * FROM cells UNION ALL SELECT 'copy', 5000, pos, cell FROM cells WHERE seq = 3 AND pos >= 1 AND pos < 4 UNION ALL SELECT 'keep', * FROM cells WHERE seq = 4 UNION ALL SELECT 'shift', seq, CASE WHEN seq = 3 AND pos >= 1 THEN pos - 2 ELSE pos END, cell FROM cells WHERE NOT (seq = 3 AND pos >= 1 AND pos < 2) UNION ALL SELECT 'divide', seq, CASE WHEN seq = 3 AND pos >= 2 THEN pos // 2 ELSE pos END, cell FROM cells")
def _(t):
    c = _cells(t)
    steps = {"remove": R.remove_range(c, -1, 1, 3), "copy": R.copy_range(c, 3, 5000, 1, 4), "keep": R.keep_only(c, 4), "shift": R.shift_range(c, 3, 1, 10**6, -2), "divide": R.divide_range(c, 3, 2, 10**6, 2)}
    out = None
    for name, df in steps.items():
        df = df.select(F.lit(name).alias("op"), "seq", "pos", "cell")
        out = df if out is None else out.unionByName(df)
    return out


@query("seq_spans", "W18", f"WITH {_CELLS} SELECT seq, min(pos) AS first, max(pos) AS last FROM cells GROUP BY 1")
def _(t):
    return R.span_of(_cells(t))


@query("ubatch_simple", "W13 W17", "SELECT conv_id AS batch, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS ubatch FROM conversations")
def _(t):
    return B.split_simple(t("conversations").select(F.col("conv_id").alias("batch"), "turn"), 3, ["turn"], "batch")


@query("ubatch_equal", "W14")
def _(t):
    return B.split_equal(t("conversations").select((F.col("conv_id") % 10).alias("batch"), F.col("conv_id").alias("seq"), F.col("turn").alias("pos")), 16)


@query("ubatch_sequences", "W15")
def _(t):
    rows = t("conversations").select((F.col("conv_id") % 10).alias("batch"), (F.col("conv_id") * 100 + F.col("turn")).alias("pos"), F.when(F.col("turn") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("seqs"))
    return B.split_sequences(rows, 8).select("batch", "pos", "ubatch")


def _greedy(name, value, full):
    """SQL of a greedy rule: a source's documents in order; `full` says that the next one, of that value, starts a new number."""
    return f"WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, {value} AS v, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents), s AS (SELECT d.*, 0::BIGINT AS {name}, v AS held, 1 AS k FROM d WHERE r = 1 UNION ALL SELECT d.*, s.{name} + ({full})::INT, CASE WHEN {full} THEN d.v ELSE s.held + d.v END, CASE WHEN {full} THEN 1 ELSE s.k + 1 END FROM s JOIN d ON d.source IS NOT DISTINCT FROM s.source AND d.r = s.r + 1) SELECT source, doc_id, n_chars, {name} FROM s"


@query("prompt_packing", "W16", _greedy("batch", "n_chars", "s.held + d.v > 20000 OR s.k >= 8"))
def _(t):
    return B.pack(t.spread("documents").select("source", "doc_id", "n_chars"), "n_chars", 20_000, 8, "source", "doc_id")


@query("shard_plan", "W17 K11", _greedy("shard", "(n_chars + 31) // 32 * 32", "s.held > 0 AND s.held + d.v > 50000"))
def _(t):
    return B.shards_by_bytes(t.spread("documents").select("source", "doc_id", "n_chars"), "n_chars", 50_000, "doc_id", "source")
