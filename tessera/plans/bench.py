"""Queries over the comparison and report operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import compare as C
from tessera.registry import query, r6


@query(
    "bench_compare", "J1 A1 O1",
    """SELECT b.event_type, round(avg(b.value), 6) AS avg_value_base, round(avg(c.value), 6) AS avg_value_other, round(avg(c.value) / avg(b.value), 6) AS ratio_value
    FROM events b JOIN events c ON b.user_id = c.user_id AND b.event_type = c.event_type
    WHERE b.ts < TIMESTAMP '2024-01-16' AND c.ts >= TIMESTAMP '2024-01-16' GROUP BY 1""",
)
def _(t):
    events, cut = t("events"), F.lit("2024-01-16").cast("timestamp")
    out = C.compare_builds(events.where(F.col("ts") < cut), events.where(F.col("ts") >= cut), ["user_id", "event_type"], ["event_type"], ["value"])
    return out.select("event_type", *r6("avg_value_base", "avg_value_other", "ratio_value"))


@query(
    "bench_compare_passed", "J2 P8",
    """WITH l AS (SELECT * FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag <> 'N')
    SELECT b.l_linenumber::BIGINT AS l_linenumber, round(avg(b.l_quantity), 6) AS avg_l_quantity_base, round(avg(c.l_quantity), 6) AS avg_l_quantity_other,
      round(avg(b.l_extendedprice), 4) AS avg_l_extendedprice_base, round(avg(c.l_extendedprice), 4) AS avg_l_extendedprice_other
    FROM l b JOIN l c ON b.l_suppkey = c.l_suppkey AND b.l_linenumber = c.l_linenumber WHERE b.l_returnflag = 'A' AND c.l_returnflag = 'R' GROUP BY 1""",
)
def _(t):
    rows = t("lineitem").where("l_linestatus = 'F' AND l_returnflag <> 'N'")
    out = C.compare_builds(rows.where("l_returnflag = 'A'"), rows.where("l_returnflag = 'R'"), ["l_suppkey", "l_linenumber"], ["l_linenumber"], ["l_quantity", "l_extendedprice"])
    return out.select("l_linenumber", *r6("avg_l_quantity_base", "avg_l_quantity_other"), *(F.round(c, 4).alias(c) for c in ("avg_l_extendedprice_base", "avg_l_extendedprice_other")))


@query(
    "auto_show_columns", "P1 P2 P3",
    """WITH p AS (SELECT *, 'same' AS same, CASE WHEN p_size > 25 THEN 1 END AS some_null, CAST(NULL AS VARCHAR) AS no_value FROM part)
    SELECT 'p_partkey' AS column_name, count(DISTINCT p_partkey) + max((p_partkey IS NULL)::INT) > 1 AS shown FROM p
    UNION ALL SELECT 'p_brand', count(DISTINCT p_brand) + max((p_brand IS NULL)::INT) > 1 FROM p
    UNION ALL SELECT 'same', count(DISTINCT same) + max((same IS NULL)::INT) > 1 FROM p
    UNION ALL SELECT 'some_null', count(DISTINCT some_null) + max((some_null IS NULL)::INT) > 1 FROM p
    UNION ALL SELECT 'no_value', count(DISTINCT no_value) + max((no_value IS NULL)::INT) > 1 FROM p""",
)
def _(t):
    p = t("part").select("p_partkey", "p_brand", F.lit("same").alias("same"), F.when(F.col("p_size") > 25, 1).alias("some_null"), F.lit(None).cast("string").alias("no_value"))
    return C.varying_columns(p)


@query(
    "build_normalise", "A2 A3 A4",
    """WITH m AS (SELECT min(length(p_type)) AS min_len, max(length(p_type)) AS max_len FROM part)
    SELECT DISTINCT p_brand, substring(p_type, 1, min_len) AS p_type, min_len::BIGINT AS min_len, max_len::BIGINT AS max_len FROM part, m""",
)
def _(t):
    return C.shortened(t("part").select("p_brand", "p_type"), "p_type").distinct()


@query(
    "test_names", "P4 P5 P6 P7",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'pp' || p_size WHEN p_size % 5 = 0 THEN 'tg' || p_size % 3 ELSE 'pp' || p_size || '+tg' || (p_size % 3) END
      || CASE WHEN p_size % 7 > 0 THEN '@d' || p_size % 7 ELSE '' END AS test_name, CASE WHEN p_size > 10 THEN 'Yes' ELSE 'No' END AS large,
      CASE WHEN p_size % 2 = 0 THEN '2x ' || p_brand ELSE p_brand || ', other' END AS gpu,
      round(p_retailprice / 1073741824.0, 12) AS size_gib, regexp_replace(replace(p_type, 'ECONOMY', 'ECO'), '^SM', '') AS short_type FROM part""",
)
def _(t):
    p = t("part").withColumn("n_prompt", F.when((F.col("p_size") % 3 != 0) & (F.col("p_size") % 5 == 0), 0).otherwise(F.col("p_size")))
    p = p.withColumn("n_gen", F.when(F.col("p_size") % 3 == 0, 0).otherwise(F.col("p_size") % 3)).withColumn("depth", F.col("p_size") % 7)
    p = p.withColumn("gpus", F.when(F.col("p_size") % 2 == 0, F.concat("p_brand", F.lit(", "), "p_brand")).otherwise(F.concat("p_brand", F.lit(", other"))))
    return p.select(
        "p_partkey", C.test_name("n_prompt", "n_gen", "depth").alias("test_name"), C.yes_no(F.col("p_size") > 10).alias("large"), C.collapsed("gpus").alias("gpu"),
        F.round(F.col("p_retailprice") / 1073741824.0, 12).alias("size_gib"), F.regexp_replace(F.replace(F.col("p_type"), F.lit("ECONOMY"), F.lit("ECO")), "^SM", "").alias("short_type"),
    )


@query(
    "profile_top_n", "A5 O3",
    """SELECT l_returnflag, l_linestatus, l_linenumber::BIGINT AS l_linenumber, count(*) AS n, max(l_quantity) AS max_a, round(avg(l_quantity), 6) AS avg_a, max(l_extendedprice) AS max_b, round(avg(l_extendedprice), 4) AS avg_b,
      round(coalesce(avg(CASE WHEN l_discount > 0.05 THEN l_tax END), 0), 6) AS avg_c FROM lineitem GROUP BY 1, 2, 3 ORDER BY n DESC, 1, 2, 3 LIMIT 10""",
)
def _(t):
    out = C.top_groups(t("lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], "l_quantity", "l_extendedprice", F.when(F.col("l_discount") > 0.05, F.col("l_tax")), "n", 10)
    return out.select("l_returnflag", "l_linestatus", "l_linenumber", "n", "max_a", *r6("avg_a"), "max_b", F.round("avg_b", 4).alias("avg_b"), *r6("avg_c"))


@query("support_matrix", "A8 S10", """SELECT l_shipdate::DATE AS day, l_returnflag, CASE WHEN bool_and(l_quantity < 48) THEN 'supported' WHEN bool_or(l_quantity < 48) THEN 'partially' ELSE 'unsupported' END AS state FROM lineitem GROUP BY 1, 2""")
def _(t):
    return C.support(t("lineitem").withColumn("day", F.to_date("l_shipdate")), ["day", "l_returnflag"], F.col("l_quantity") < 48)


@query("support_across", "A9", """SELECT user_id, count(DISTINCT event_type) AS n_recorded, (SELECT count(DISTINCT event_type) FROM events) AS n_backends, count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events) AS everywhere FROM events GROUP BY 1""")
def _(t):
    return C.support_across(t("events"), "user_id", "event_type")


@query(
    "support_pivot", "A15 A9",
    """WITH x AS (SELECT o_orderpriority, o_orderstatus, max_by(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1, 2)
    SELECT o_orderpriority, max(CASE WHEN o_orderstatus = 'F' THEN v END) AS "F", max(CASE WHEN o_orderstatus = 'O' THEN v END) AS "O", max(CASE WHEN o_orderstatus = 'missing' THEN v END) AS missing FROM x GROUP BY 1""",
)
def _(t):
    return C.pivot_last(t("orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderkey", ["F", "O", "missing"])


@query(
    "model_summary", "A6 P13 T16",
    """WITH e AS (SELECT c_mktsegment AS model, floor(o_totalprice / 1000 * 100 + 0.5) / 100 AS total, floor(o_totalprice / 1000 / (1 + o_orderkey % 7) * 60 * 100 + 0.5) / 100 AS per_min, o_orderstatus = 'F' AND length(c_name) > 0 AS ok FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT model, count(*) AS n, round(avg(total), 4) AS avg_total, round(avg(per_min), 4) AS avg_per_min, count(*) FILTER (WHERE ok) AS n_ok, count(*) - count(*) FILTER (WHERE ok) AS n_fail FROM e GROUP BY 1""",
)
def _(t):
    e = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    e = e.select(F.col("c_mktsegment").alias("model"), C.half_up(F.col("o_totalprice") / 1000, 2).alias("total"), C.half_up(F.col("o_totalprice") / 1000 / (1 + F.col("o_orderkey") % 7) * 60, 2).alias("per_min"), ((F.col("o_orderstatus") == "F") & (F.length("c_name") > 0)).alias("ok"))
    ok = F.count_if("ok")
    return e.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("total"), 4).alias("avg_total"), F.round(F.avg("per_min"), 4).alias("avg_per_min"), ok.alias("n_ok"), (F.count(F.lit(1)) - ok).alias("n_fail")).orderBy("avg_total")


@query("backend_summary", "A7", """SELECT event_type, round(avg(floor(value / 3 * 1000 + 0.5) / 1000), 6) AS rtf, count(*) AS n FROM events WHERE json_extract_string(props, '$.k')::BIGINT % 5 <> 0 GROUP BY 1""")
def _(t):
    rows = t("events").withColumn("error", F.when(F.get_json_object("props", "$.k").cast("bigint") % 5 == 0, "failed"))
    return rows.where("error is null").groupBy("event_type").agg(F.round(F.avg(C.half_up(F.col("value") / 3, 3)), 6).alias("rtf"), F.count(F.lit(1)).alias("n")).orderBy(F.col("rtf").desc())


_WORDS = r"list_filter(string_split_regex({c}, '\s+'), lambda w: w <> '')"


@query(
    "token_match", "J5 J14 T9 Z6 O9",
    f"""WITH w AS (SELECT conv_id, turn, {_WORDS.format(c="text")} AS words FROM conversations), r AS (SELECT conv_id, words AS ref FROM w WHERE turn = 0)
    SELECT w.conv_id, turn, round(CASE WHEN ref IS NULL THEN 1.0 WHEN len(ref) = 0 THEN CASE WHEN len(words) = 0 THEN 1.0 ELSE 0.0 END ELSE len(list_filter(ref, lambda x: list_contains(words, x)))::DOUBLE / len(ref) END, 6) AS match_vs_ref
    FROM w LEFT JOIN r ON w.conv_id = r.conv_id""",
)
def _(t):
    w = t("conversations").select("conv_id", "turn", C.words("text").alias("words"))
    ref = w.where("turn = 0").select("conv_id", F.col("words").alias("ref"))
    return w.join(ref, "conv_id", "left").select("conv_id", "turn", F.round(F.coalesce(C.overlap(F.col("ref"), F.col("words")), F.lit(1.0)), 6).alias("match_vs_ref"))


@query(
    "latency_report", "A12",
    """WITH e AS (SELECT event_id % 500 AS tokens, value AS seconds FROM events) SELECT count(*) AS n_requests, sum(tokens)::BIGINT AS sum_tokens, round(avg(tokens), 6) AS avg_tokens, round(sum(seconds), 4) AS sum_seconds, max(seconds) AS max_seconds,
      round(sum(tokens) / sum(seconds), 6) AS tokens_per_second, sum(tokens * tokens + tokens * (tokens + 1) / 2)::BIGINT AS depth_sum FROM e""",
)
def _(t):
    out = C.throughput(t("events").select((F.col("event_id") % 500).alias("tokens"), F.col("value").alias("seconds")), "tokens", "seconds")
    return out.select("n_requests", "sum_tokens", *r6("avg_tokens"), F.round("sum_seconds", 4).alias("sum_seconds"), "max_seconds", *r6("tokens_per_second"), "depth_sum")


@query("latency_percentiles", "A13", """SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.5), 6) AS p50, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM events GROUP BY 1""")
def _(t):
    return t("events").groupBy("event_type").agg(F.round(F.percentile("value", 0.95), 6).alias("p95"), F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"))


@query(
    "second_histogram", "A14",
    """WITH t AS (SELECT greatest(ceil(max(value)), 1)::BIGINT AS n_bins FROM events), c AS (SELECT least(floor(value), n_bins - 1)::BIGINT AS bin, count(*) AS n FROM events, t WHERE value >= 0 GROUP BY 1)
    SELECT b.bin::BIGINT AS bin, coalesce(c.n, 0) AS n FROM (SELECT unnest(range(n_bins)) AS bin FROM t) b LEFT JOIN c ON b.bin = c.bin""",
)
def _(t):
    return C.histogram(t("events"), "value")


@query(
    "zip_compare", "J3 U1",
    """WITH a AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_orderkey, o_totalprice FROM orders), b AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, o_orderkey AS other_key FROM orders)
    SELECT a.pos::BIGINT AS pos, o_orderkey, other_key, o_orderkey <> other_key AS differs FROM a JOIN b ON a.pos = b.pos""",
)
def _(t):
    o = t("orders")
    out = C.zipped(o.select("o_orderkey"), o.select(F.col("o_orderkey").alias("other_key"), "o_orderdate"), ["o_orderkey"], ["o_orderdate", "other_key"])
    return out.select("pos", "o_orderkey", "other_key", (F.col("o_orderkey") != F.col("other_key")).alias("differs"))


@query(
    "pattern_select", "P15 P16",
    rf"""WITH w AS (SELECT doc_id, unnest(list_filter({_WORDS.format(c="text")}, lambda w: NOT contains(w, '<'))) AS word, generate_subscripts(list_filter({_WORDS.format(c="text")}, lambda w: NOT contains(w, '<')), 1) - 1 AS pos FROM documents)
    SELECT doc_id, pos::BIGINT AS pos, word FROM w WHERE pos < 3 OR (pos >= 23 AND pos < 25) OR (pos >= 75 AND pos < 80)""",
)
def _(t):
    w = t.spread("documents").select("doc_id", F.posexplode(F.filter(C.words("text"), lambda x: ~x.contains("<"))).alias("pos", "word"))
    return C.select_pattern(w, "pos", "3,20,2,50,5")


@query("grid", "J6", "SELECT r_name, n_name, size::BIGINT AS size FROM region CROSS JOIN nation CROSS JOIN (VALUES (1), (2), (4)) AS s(size)")
def _(t):
    """The experiment grid is all combinations by definition, of constant lists."""
    return t("region").select("r_name").crossJoin(t("nation").select("n_name")).crossJoin(t.spark.range(3).select(F.pow(F.lit(2), F.col("id")).cast("bigint").alias("size")))


_PHRASES = ("the", "and", "of", "la", "de", "thank you")


@query("hallucination_filter", "P9 T10", f"""SELECT conv_id, turn, rtrim(trim(lower(split_part(text, ' ', 1))), '.!?,;:') IN {_PHRASES} AS hallucinated FROM conversations""")
def _(t):
    first = F.split_part("text", F.lit(" "), F.lit(1))
    return t("conversations").select("conv_id", "turn", F.rtrim(F.trim(F.lower(first)), F.lit(".!?,;:")).isin(*_PHRASES).alias("hallucinated"))


@query("regex_filters", "P10", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_brand, '[0-9]$') AND regexp_matches(p_type, 'S|B')")
def _(t):
    return t("part").where(F.rlike("p_brand", F.lit("[0-9]$")) & F.rlike("p_type", F.lit("S|B"))).select("p_partkey", "p_name")


@query("triage", "P11 P12 P14", """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_discount <= 0.05 AS is_low, CASE WHEN l_discount >= 0.09 THEN 'accept' WHEN l_discount > 0.05 THEN 'check' WHEN l_discount > 0.02 THEN 'review' ELSE 'reject' END AS action, l_returnflag IN ('A', 'R') AND l_linestatus IN ('F') AS highlight FROM lineitem""")
def _(t):
    d = F.col("l_discount")
    return t("lineitem").select("l_orderkey", "l_linenumber", (d <= 0.05).alias("is_low"), F.when(d >= 0.09, "accept").when(d > 0.05, "check").when(d > 0.02, "review").otherwise("reject").alias("action"), (F.col("l_returnflag").isin("A", "R") & F.col("l_linestatus").isin("F")).alias("highlight"))


@query("row_page", "P18", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') ORDER BY p_name, p_partkey LIMIT 20 OFFSET 40")
def _(t):
    return t("part").where(F.lower("p_name").contains("a")).orderBy("p_name", "p_partkey").offset(40).limit(20).select("p_partkey", "p_name")


@query("json_paths", "P19 G1", """SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, to_json(map_from_entries(list_filter([{'key': 'k', 'value': json_extract_string(props, '$.k')}, {'key': 'a/b', 'value': json_extract_string(props, '$.a.b')}], lambda e: e.value IS NOT NULL)))::VARCHAR AS found FROM events""")
def _(t):
    paths = {"k": "$.k", "a/b": "$.a.b"}
    found = F.map_filter(F.create_map(*(x for k, p in paths.items() for x in (F.lit(k), F.get_json_object("props", p)))), lambda _, v: v.isNotNull())
    return t("events").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"), F.to_json(found).alias("found"))


@query("model_files", "P20", r"""SELECT p_partkey, 'model-' || p_size || 'B-Q' || (p_size % 8 + 1) || '_K.bin' AS file, regexp_extract('model-' || p_size || 'B-Q' || (p_size % 8 + 1) || '_K.bin', '[Qq](\d+)', 1)::BIGINT AS bits, regexp_matches('model-' || p_size || 'B-Q' || (p_size % 8 + 1) || '_K.bin', '\.bin$') AS is_model FROM part""")
def _(t):
    name = F.concat(F.lit("model-"), F.col("p_size").cast("string"), F.lit("B-Q"), (F.col("p_size") % 8 + 1).cast("string"), F.lit("_K.bin"))
    return t("part").select("p_partkey", name.alias("file"), F.regexp_extract(name, r"[Qq](\d+)", 1).cast("bigint").alias("bits"), F.rlike(name, F.lit(r"\.bin$")).alias("is_model"))


@query("point_lookup", "P21 P22", "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 7 AND text IS NOT NULL")
def _(t):
    return t("conversations").where("conv_id = 7 AND text IS NOT NULL").select("conv_id", "turn", "role")


@query("plot_series", "A16 K17", "SELECT l_returnflag, l_linestatus, to_json(list({'x': x, 'y': y} ORDER BY x))::VARCHAR AS points FROM (SELECT l_returnflag, l_linestatus, l_linenumber AS x, count(*) AS y FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1, 2")
def _(t):
    rows = t("lineitem").groupBy("l_returnflag", "l_linestatus", F.col("l_linenumber").alias("x")).agg(F.count(F.lit(1)).alias("y"))
    return C.series(rows, ["l_returnflag", "l_linestatus"], "x", ["y"]).withColumn("points", F.to_json("points"))


@query("first_seen", "A38 U4", "SELECT o_orderpriority, min(o_orderkey) AS first_at FROM orders GROUP BY 1")
def _(t):
    return C.first_seen(t("orders"), "o_orderpriority", "o_orderkey").orderBy("first_at")


@query("measure_lookup", "A39", "SELECT p_brand, count(*) AS n, max(peak)::DOUBLE AS peak FROM part LEFT JOIN (VALUES ('Brand#11', 3.5), ('Brand#12', 4.0)) AS m(brand, peak) ON p_brand = brand GROUP BY 1")
def _(t):
    peaks = F.create_map(F.lit("Brand#11"), F.lit(3.5), F.lit("Brand#12"), F.lit(4.0))
    return t("part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).withColumn("peak", F.try_element_at(peaks, F.col("p_brand")))


@query("batch_speeds", "A28 A29", """SELECT l_suppkey, round(sum(l_quantity) / sum(l_tax + 0.01), 6) AS speed_pp, round(sum(l_quantity * l_linenumber) / sum(l_discount + 0.01), 6) AS speed_tg, round((sum(l_quantity) + sum(l_quantity * l_linenumber)) / (sum(l_tax + 0.01) + sum(l_discount + 0.01)), 6) AS speed, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS sd FROM lineitem GROUP BY 1""")
def _(t):
    pp, tg, tp, tt = F.sum("l_quantity"), F.sum(F.col("l_quantity") * F.col("l_linenumber")), F.sum(F.col("l_tax") + 0.01), F.sum(F.col("l_discount") + 0.01)
    return t("lineitem").groupBy("l_suppkey").agg(F.round(pp / tp, 6).alias("speed_pp"), F.round(tg / tt, 6).alias("speed_tg"), F.round((pp + tg) / (tp + tt), 6).alias("speed"), F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.round(F.stddev_samp("l_extendedprice"), 4).alias("sd"))


@query("gather_rows", "J12 tensor.get_rows", "SELECT i.pos, i.idx, p_name FROM (SELECT o_orderkey AS pos, o_custkey % 50 + 1 AS idx FROM orders) i JOIN part ON p_partkey = idx")
def _(t):
    """GET_ROWS: rows of a table by an index, in the index's order; the table side is as large as it likes."""
    index = t("orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_custkey") % 50 + 1).alias("idx"))
    return index.join(t("part"), F.col("idx") == F.col("p_partkey")).select("pos", "idx", "p_name")


@query("scatter_rows", "J12 tensor.set_rows", "SELECT p_partkey, coalesce(v, p_retailprice) AS price FROM part LEFT JOIN (SELECT l_partkey, max_by(l_extendedprice, (l_orderkey, l_linenumber)) AS v FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON p_partkey = l_partkey")
def _(t):
    """SET_ROWS: rows overwritten by index; of several, the last."""
    last = t("lineitem").where("l_quantity > 45").groupBy("l_partkey").agg(F.max_by("l_extendedprice", F.struct("l_orderkey", "l_linenumber")).alias("v"))
    return t("part").join(last, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("v", "p_retailprice").alias("price"))


@query("latest_not_merged", "J15 O2", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def _(t):
    return t("orders").join(t("lineitem").where("l_quantity > 25"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(1).select("o_orderkey", "o_orderdate")


_EDGES = "SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey > 1 UNION SELECT p_partkey, p_partkey - 3 FROM part WHERE p_partkey % 10 = 0 AND p_partkey > 3"


@query("ancestors", "J16 J17", f"WITH RECURSIVE e AS ({_EDGES}), up(node, depth) AS (SELECT 190::BIGINT, 0 UNION ALL SELECT e.parent, depth + 1 FROM up JOIN e ON e.child = up.node) SELECT node, min(depth)::BIGINT AS depth FROM up GROUP BY node")
def _(t):
    p = t("part")
    edges = p.where("p_partkey > 1").selectExpr("p_partkey AS child", "p_partkey div 2 AS parent").union(p.where("p_partkey % 10 = 0 AND p_partkey > 3").selectExpr("p_partkey AS child", "p_partkey - 3 AS parent"))
    return C.reachable(t.spark, edges, 190)


@query("nearest_ancestor", "J17", f"WITH RECURSIVE e AS ({_EDGES}), up(node, depth) AS (SELECT 190::BIGINT, 0 UNION ALL SELECT e.parent, depth + 1 FROM up JOIN e ON e.child = up.node) SELECT min_by(node, (depth, node)) AS node, min(depth)::BIGINT AS depth FROM up WHERE node IN (SELECT p_partkey FROM part WHERE p_size % 4 = 0)")
def _(t):
    p = t("part")
    edges = p.where("p_partkey > 1").selectExpr("p_partkey AS child", "p_partkey div 2 AS parent").union(p.where("p_partkey % 10 = 0 AND p_partkey > 3").selectExpr("p_partkey AS child", "p_partkey - 3 AS parent"))
    return C.nearest_with_data(C.reachable(t.spark, edges, 190), p.where("p_size % 4 = 0").select(F.col("p_partkey").alias("node")))


@query("set_operations", "U1 U2 U3 U5 U6", """SELECT k, array_agg(src ORDER BY src) AS srcs FROM (
      SELECT 'both' AS src, o_custkey AS k FROM orders INTERSECT SELECT 'both', c_custkey FROM customer WHERE c_acctbal > 0
      UNION ALL (SELECT 'customer only', c_custkey FROM customer EXCEPT SELECT 'customer only', o_custkey FROM orders)
      UNION ALL (SELECT DISTINCT 'order', o_custkey FROM orders)) GROUP BY k""")  # fmt: skip
def _(t):
    o, c = t("orders").select(F.col("o_custkey").alias("k")), t("customer")
    tag = lambda df, s: df.withColumn("src", F.lit(s))
    every = tag(o.intersect(c.where("c_acctbal > 0").select("c_custkey")), "both").unionByName(tag(c.select(F.col("c_custkey").alias("k")).subtract(o), "customer only"), allowMissingColumns=True).unionByName(tag(o.distinct(), "order"))
    return every.groupBy("k").agg(F.array_sort(F.collect_list("src")).alias("srcs"))


@query("sorts", "O1 O5 O6 O10", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'system' THEN 0 ELSE 1 END, turn) AS system_first, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN turn % 3 = 0 THEN NULL ELSE turn END ASC NULLS FIRST, turn DESC) AS nulls_first FROM conversations")
def _(t):
    own = Window.partitionBy("conv_id")
    a = own.orderBy(F.when(F.col("role") == "system", 0).otherwise(1), "turn")
    b = own.orderBy(F.when(F.col("turn") % 3 != 0, F.col("turn")).asc_nulls_first(), F.col("turn").desc())
    return t("conversations").select("conv_id", "turn", F.row_number().over(a).alias("system_first"), F.row_number().over(b).alias("nulls_first"))


@query("first_line", "O11 T15", r"SELECT min_by(regexp_extract(text, '^\S+'), doc_id) AS first_word, min(doc_id) AS doc_id FROM documents WHERE regexp_matches(text, 'the')")
def _(t):
    return t.spread("documents").where(F.rlike("text", F.lit("the"))).agg(F.min_by(F.regexp_extract("text", r"^\S+", 0), "doc_id").alias("first_word"), F.min("doc_id").alias("doc_id"))
