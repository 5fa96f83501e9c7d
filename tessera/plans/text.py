"""Queries over the string, template and JSON functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import structured as G
from tessera.functions import template as J
from tessera.functions import text as T
from tessera.registry import query

@query(
    "core_strings", "C1 C2 C4 C5 C6 C8 C12 C20 C30",
    r"""SELECT p_partkey, trim(' ' || p_name || '  ') AS stripped, replace(p_name, 'e', 'EE') AS replaced, array_to_string([p_brand, p_type, p_name], '; ') AS joined, len(string_split(p_name || '  ' || p_brand, ' ')) AS n_parts,
      repeat('ab', p_size % 4) AS repeated, starts_with(p_name, 'b') AS starts, ends_with(p_name, 't') AS ends, CASE WHEN ends_with(p_name, 'bolt') THEN left(p_name, length(p_name) - 4) ELSE p_name END AS without, '[' || array_to_string([p_size, p_size + 1], ', ') || ']' AS ints,
      CASE WHEN length(p_brand) <= 4 THEN '....' ELSE '....' || right(p_brand, 4) END AS redacted, strlen(p_name || 'é') AS n_bytes, regexp_matches(p_name || '漢', '\p{Han}') AS has_han, lower(p_name) AS low FROM part""",
)
def _(t):
    n = F.col("p_name")
    return t("part").select(
        "p_partkey", T.strip(F.concat(F.lit(" "), n, F.lit("  "))).alias("stripped"), T.replace_all(n, "e", "EE").alias("replaced"), F.array_join(F.array("p_brand", "p_type", n), "; ").alias("joined"), F.size(T.split_exact(F.concat(n, F.lit("  "), "p_brand"), " ")).alias("n_parts"),
        F.repeat(F.lit("ab"), F.col("p_size") % 4).alias("repeated"), n.startswith("b").alias("starts"), n.endswith("t").alias("ends"), F.when(n.endswith("bolt"), F.left(n, F.char_length(n) - 4)).otherwise(n).alias("without"),
        F.concat(F.lit("["), F.array_join(F.array(F.col("p_size").cast("string"), (F.col("p_size") + 1).cast("string")), ", "), F.lit("]")).alias("ints"), T.redact(F.col("p_brand")).alias("redacted"), F.octet_length(F.concat(n, F.lit("é"))).alias("n_bytes"), F.rlike(F.concat(n, F.lit("漢")), F.lit(r"\p{IsHan}")).alias("has_han"), F.lower(n).alias("low"),
    )


@query("regex_escape", "C3", r"""SELECT doc_id, regexp_replace(text, '([.^$|()*+?\[\]{}\\])', '\\\1', 'g') AS escaped FROM documents""")
def _(t):
    return t.spread("documents").select("doc_id", T.regex_escape(F.col("text")).alias("escaped"))


@query("escapes", "C7", r"""SELECT p_partkey, p_name || chr(10) || 'x' || chr(9) || '\n' || 'A' || '"' AS out FROM part""")
def _(t):
    return t("part").select("p_partkey", T.process_escapes(F.concat(F.col("p_name"), F.lit(r"\nx\t\\n\x41\""))).alias("out"))


@query("partial_stop", "C9 X12", """SELECT p_partkey, CASE WHEN ends_with(s, '<end>') THEN length(s) - 5 WHEN ends_with(s, '<end') THEN length(s) - 4 WHEN ends_with(s, '<en') THEN length(s) - 3 WHEN ends_with(s, '<e') THEN length(s) - 2 WHEN ends_with(s, '<') THEN length(s) - 1 ELSE -1 END::BIGINT AS at
  FROM (SELECT p_partkey, p_name || left('<end>', p_size % 7) AS s FROM part)""")  # fmt: skip
def _(t):
    s = F.concat(F.col("p_name"), F.left(F.lit("<end>"), F.col("p_size") % 7))
    return t("part").select("p_partkey", T.partial_stop(s, "<end>").alias("at"))


@query("sortable_time", "C10", "SELECT o_orderkey, strftime(o_orderdate, '%Y_%m_%d-%H_%M_%S.') || lpad((epoch_us(o_orderdate) % 1000000)::VARCHAR, 6, '0') || '000' AS stamp FROM orders")
def _(t):
    return t("orders").select("o_orderkey", T.sortable_time("o_orderdate").alias("stamp"))


@query("formatted", "C11", "SELECT p_partkey, printf('%05d|%s|%x', p_partkey, p_brand, p_size) AS line FROM part")
def _(t):
    return t("part").select("p_partkey", F.format_string("%05d|%s|%x", "p_partkey", "p_brand", "p_size").alias("line"))


@query("overrides", "C13", """SELECT p_partkey, 'k' || p_size % 4 AS key, ['int', 'float', 'bool', 'str'][p_size % 4 + 1] AS kind, CASE WHEN p_size % 4 = 0 THEN p_size::BIGINT END AS as_int, CASE WHEN p_size % 4 = 1 THEN p_size + 0.5::DOUBLE END AS as_float, CASE WHEN p_size % 4 = 2 THEN TRUE END AS as_bool, CASE WHEN p_size % 4 = 3 THEN p_brand END AS as_str FROM part""")
def _(t):
    k = F.col("p_size") % 4
    value = F.when(k == 0, F.concat(F.lit("int:"), F.col("p_size").cast("string"))).when(k == 1, F.concat(F.lit("float:"), F.col("p_size").cast("string"), F.lit(".5"))).when(k == 2, "bool:true").otherwise(F.concat(F.lit("str:"), "p_brand"))
    return t("part").select("p_partkey", T.override(F.concat(F.lit("k"), k.cast("string"), F.lit("="), value)).alias("o")).select("p_partkey", "o.*")


@query("base64_round_trip", "C14", "SELECT p_partkey, to_base64(encode(p_name)) AS b64, p_name AS back FROM part")
def _(t):
    b = F.base64(F.col("p_name").cast("binary"))
    return t("part").select("p_partkey", b.alias("b64"), F.unbase64(b).cast("string").alias("back"))


@query("common_prefix", "C15", """WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS a, lag(string_split(text, ' ')) OVER (PARTITION BY conv_id, role ORDER BY turn) AS b FROM conversations)
  SELECT conv_id, turn, coalesce((SELECT min(i) - 1 FROM range(1, 4000) r(i) WHERE i <= least(len(a), len(b)) AND a[i] <> b[i]), least(len(a), len(b)))::BIGINT AS n FROM w WHERE b IS NOT NULL""")  # fmt: skip
def _(t):
    from pyspark.sql import Window

    w = t("conversations").withColumn("a", F.split("text", " ")).withColumn("b", F.lag("a").over(Window.partitionBy("conv_id", "role").orderBy("turn"))).where("b IS NOT NULL")
    short = F.least(F.size("a"), F.size("b"))
    return w.select("conv_id", "turn", T.common_prefix(F.slice("a", F.lit(1), short), F.slice("b", F.lit(1), short)).alias("n"))


@query("title_preview", "C17 T18", r"""SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1] AS title, CASE WHEN length(text) > 150 THEN substring(text, 1, 150) || '...' ELSE text END AS preview FROM documents""")
def _(t):
    return t.spread("documents").select("doc_id", T.title("text").alias("title"), T.preview(F.col("text")).alias("preview"))


@query("human_units", "C18 C25", """SELECT o_orderkey, CASE WHEN n >= 1099511627776 THEN round(n / 1099511627776.0, 2)::DOUBLE || ' TB' WHEN n >= 1073741824 THEN round(n / 1073741824.0::DOUBLE, 2) || ' GB' WHEN n >= 1048576 THEN round(n / 1048576.0::DOUBLE, 2) || ' MB' WHEN n >= 1024 THEN round(n / 1024.0::DOUBLE, 2) || ' KB' ELSE n || ' B' END AS size,
  CASE WHEN n >= 1e12 THEN round(n / 1e12)::BIGINT || 'T' WHEN n >= 1e9 THEN round(n / 1e9)::BIGINT || 'B' WHEN n >= 1e6 THEN round(n / 1e6)::BIGINT || 'M' WHEN n >= 1e3 THEN round(n / 1e3)::BIGINT || 'K' ELSE n::VARCHAR END AS params,
  CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN ms // 1000 || 's' ELSE ms // 60000 || 'm ' || (ms // 1000) % 60 || 's' END AS took FROM (SELECT o_orderkey, o_orderkey * o_custkey * 37 + 5 AS n, o_orderkey * 13 AS ms FROM orders)""")  # fmt: skip
def _(t):
    o = t("orders").select("o_orderkey", (F.col("o_orderkey") * F.col("o_custkey") * 37 + 5).alias("n"), (F.col("o_orderkey") * 13).alias("ms"))
    return o.select("o_orderkey", T.file_size(F.col("n")).alias("size"), T.rounded_count(F.col("n")).alias("params"), T.duration(F.col("ms")).alias("took"))


@query("pretty_json", "C19", """SELECT event_id, CASE WHEN json_valid(props) THEN '{' || chr(10) || array_to_string(list_transform(json_keys(props), lambda k: '  "' || k || '": ' || json_extract(props, '$.' || k)::VARCHAR), ',' || chr(10)) || chr(10) || '}' ELSE props END AS pretty FROM events""")
def _(t):
    return t("events").select("event_id", G.pretty_json(F.col("props").cast("string")).alias("pretty"))


@query(
    "url_root_domain", "C21 C22",
    r"""WITH h AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages), p AS (SELECT *, string_split(host, '.') AS parts FROM h)
    SELECT page_id, CASE WHEN regexp_matches(host, '^\d+(\.\d+){3}$') OR len(parts) < 2 THEN NULL WHEN len(parts) > 2 AND array_to_string(parts[-2:], '.') IN ('co.uk', 'com.au', 'co.jp', 'com.br', 'co.in') THEN array_to_string(parts[-3:], '.') ELSE array_to_string(parts[-2:], '.') END AS root,
      CASE WHEN regexp_matches(url, '^https?://') THEN url END AS safe FROM p""",
)
def _(t):
    return t("pages").select("page_id", T.root_domain(F.col("url")).alias("root"), T.safe_url(F.col("url")).alias("safe"))


@query("uri_templates", "C23", "SELECT p_partkey, '/models/' || url_encode(p_brand) || '/files//' || p_size AS uri, ['brand', 'none', 'size'] AS names FROM part")
def _(t):
    c = F.lit("/models/{brand}/files/{none}/{size}")
    return t("part").select("p_partkey", T.expand_template(c, {"brand": F.col("p_brand"), "size": F.col("p_size").cast("string")}).alias("uri"), T.template_names(c).alias("names"))


@query("markdown_cells", "C24", r"""SELECT doc_id, replace(replace(replace(replace(text, chr(10), '\n'), chr(9), '\t'), chr(13), '\r'), '|', '\|') AS cell FROM documents""")
def _(t):
    return t.spread("documents").select("doc_id", T.markdown_cell(F.col("text")).alias("cell"))


@query("size_suffix", "C26", "SELECT p_partkey, p_size::BIGINT * CASE p_size % 4 WHEN 0 THEN 1000 WHEN 1 THEN 1000000 WHEN 2 THEN 1000000000 ELSE 1 END::BIGINT AS bytes FROM part")
def _(t):
    unit = F.element_at(F.array(F.lit("K"), F.lit("M"), F.lit("G"), F.lit("")), (F.col("p_size") % 4 + 1).cast("int"))
    return t("part").select("p_partkey", T.size_in_bytes(F.concat(F.col("p_size").cast("string"), unit)).alias("bytes"))


@query("tensor_names", "C27", "SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN -1 ELSE label END::BIGINT AS layer, 'attn_' || vec_id % 3 || '.weight' AS tensor FROM embeddings")
def _(t):
    tail = F.concat(F.lit("attn_"), (F.col("vec_id") % 3).cast("string"), F.lit(".weight"))
    name = F.when(F.col("vec_id") % 5 == 0, tail).otherwise(F.concat(F.lit("blk."), F.col("label").cast("string"), F.lit("."), tail, F.lit("#x")))
    return t("embeddings").select("vec_id", T.tensor_parts(name).alias("p")).select("vec_id", "p.*")


@query("model_names", "C28 C25", "SELECT p_partkey, 'Widget' AS base, p_size || 'B' AS size, CASE WHEN p_size % 2 = 0 THEN 'Instruct' END AS finetune, 'v' || p_size % 3 || '.1' AS version, 'Q4_K_M' AS quant FROM part")
def _(t):
    s = F.col("p_size")
    name = F.concat(F.lit("Widget-"), s.cast("string"), F.lit("B"), F.when(s % 2 == 0, "-Instruct").otherwise(""), F.lit("-v"), (s % 3).cast("string"), F.lit(".1-Q4_K_M.bin"))
    return t("part").select("p_partkey", T.model_name_parts(name).alias("p")).select("p_partkey", "p.*")


@query("language_names", "T11", "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' ELSE lang END AS language FROM documents")
def _(t):
    return t.spread("documents").select("doc_id", T.language_name(F.col("lang")).alias("language"))


@query("tagged_text", "T12 T14", "SELECT conv_id, turn, replace(text, chr(10), '') AS answer, 'Translate from ' || role || ':' || chr(10) || text AS prompt FROM conversations")
def _(t):
    tagged = F.concat(F.lit("language en<asr_text>a\nb<asr_text>"), "text")
    return t("conversations").select("conv_id", "turn", T.after_tag(tagged).alias("answer"), F.concat(F.lit("Translate from "), "role", F.lit(":\n"), "text").alias("prompt"))


@query("output_cleanup", "T13 T15", "SELECT conv_id, turn, array_to_string(list_filter(string_split(replace(text, '<', ''), chr(10)), lambda x: trim(x) <> '' ), chr(10)) AS answer, turn || '.5' AS asr_time FROM conversations WHERE NOT contains(text, '> ')")
def _(t):
    c = t("conversations").where(~F.col("text").contains("> "))
    out = F.concat(F.lit("loading\n> question\n"), F.replace("text", F.lit("<"), F.lit("")), F.lit("<|im_end|>rest\n\n[ Prompt: 3 t/s ]\nASR_time: "), F.col("turn").cast("string"), F.lit(".5\nExiting"))
    return c.select("conv_id", "turn", T.answer_lines(out).alias("answer"), T.key_line(out, "ASR_time").alias("asr_time"))


@query("ratios", "T16 T17", "SELECT event_id, round(CASE WHEN value > 10 THEN 5 / value ELSE 0 END, 6) AS rtf, round(greatest(value + 0.1, 1 / (value + 0.1)), 6) AS speed FROM events")
def _(t):
    v = F.col("value")
    return t("events").select("event_id", F.round(T.real_time_factor(F.lit(5.0), F.when(v > 10, v).otherwise(0.0)), 6).alias("rtf"), F.round(T.speed_up(v + 0.1), 6).alias("speed"))


@query(
    "chunk_text", "T20 S16",
    """WITH RECURSIVE p AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), q AS (SELECT doc_id, parts, len(parts) AS n FROM p),
    f(doc_id, i, open, done, parts, n) AS (SELECT doc_id, 0, '', []::VARCHAR[], parts, n FROM q
      UNION ALL SELECT doc_id, i + 1, CASE WHEN length(g) > 64 THEN '' ELSE g END, CASE WHEN length(g) > 64 THEN list_append(done, g) ELSE done END, parts, n
      FROM (SELECT *, open || parts[i + 1] || CASE WHEN i + 1 < n THEN chr(10) ELSE '' END AS g FROM f WHERE i < n)),
    e AS (SELECT doc_id, CASE WHEN open = '' THEN done WHEN len(done) = 0 THEN [open] ELSE list_append(done[1:len(done) - 1], done[-1] || open) END AS c FROM f WHERE i = n)
    SELECT doc_id, generate_subscripts(c, 1)::BIGINT - 1 AS chunk, unnest(c) AS text FROM e""",
)
def _(t):
    return t.spread("documents").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("chunk", "text"))


_ASCII = "regexp_replace({c}, '[^A-Za-z .]', '', 'g')"


@query(
    "normalise_endings", "T7",
    r"""WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[^A-Za-z .]', '', 'g'), 'e\b', 'ee', 'g'), 'a', 'aa', 'g') AS s FROM documents)
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, 'ee\b', 'i', 'g'), '([bcdfghjklmnpqrstvwxyz])aa\b', '\1a', 'g'), '([bcdfghjklmnpqrstvwxyz])aa([bcdfghjklmnpqrstvwxyz][aeiouy])\b', '\1a\2', 'g'), '([bcdfghjklmnpqrstvwxyz])aao\b', '\1ao', 'g') AS text FROM d""",
)
def _(t):
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "[^A-Za-z .]", ""), r"e\b", "ee"), "a", "aa")
    return t.spread("documents").select("doc_id", T.plain_endings(s).alias("text"))


@query(
    "lexicon_fix", "J4 T8 O8",
    r"""WITH p AS (SELECT doc_id, unnest(l) AS piece, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+') AS l FROM documents)),
    f AS (SELECT doc_id, pos, CASE lower(piece) WHEN 'the' THEN CASE WHEN regexp_matches(piece, '^[A-Z]') THEN 'De' ELSE 'de' END WHEN 'of' THEN 'OF' ELSE piece END AS piece FROM p)
    SELECT doc_id, regexp_replace(string_agg(piece, '' ORDER BY pos), '\bin de\b', 'inside', 'gi') AS text FROM f GROUP BY doc_id""",
)
def _(t):
    lexicon = t.spark.createDataFrame([("correction", "the", "de"), ("correction", "of", "off"), ("proper_noun", "of", "OF"), ("correction", "in de", "inside")], "kind string, key string, value string")
    out = T.fix_words(t.spread("documents"), "doc_id", "text", lexicon)
    return out.select("doc_id", T.fix_phrases(F.col("text"), {"in de": "inside"}).alias("text"))


@query(
    "word_confidence", "W1 A10 A11 P11 T19",
    """WITH k AS (SELECT conv_id AS seq_id, turn, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations),
    tok AS (SELECT *, -((length(w) * 7 + i) % 100) / 100.0::DOUBLE AS lp1, -((length(w) * 3 + i) % 100) / 100.0::DOUBLE AS lp2 FROM k WHERE w <> ''),
    w AS (SELECT seq_id, turn, i, w, exp(least(lp1, lp2)) AS min_conf, exp((lp1 + lp2) / 2) AS geo_conf FROM tok)
    SELECT seq_id, count(*) AS n_words, count(*) FILTER (WHERE min_conf <= 0.65) AS n_low, string_agg(w || '(' || round(min_conf, 2) || CASE WHEN min_conf <= 0.65 THEN '*' ELSE '' END || ')', ' ' ORDER BY turn, i) AS line, round(avg(geo_conf), 6) AS geo FROM w GROUP BY seq_id""",
)
def _(t):
    k = t("conversations").select(F.col("conv_id").alias("seq_id"), "turn", F.posexplode(F.split("text", " ")).alias("i", "w")).where("w <> ''").withColumn("i", F.col("i") + 1)
    lp = lambda m: -((F.char_length("w") * m + F.col("i")) % 100) / 100.0
    pos = F.col("turn") * 100_000_000 + F.col("i") * 3
    # Each word as two tokens, its first letter and the rest; a special token stands between turns.
    two = F.array(F.struct(pos.alias("pos"), F.concat(F.lit("Ġ"), F.left("w", F.lit(1))).alias("piece"), F.lit(False).alias("is_special"), lp(7).alias("logprob")), F.struct((pos + 1).alias("pos"), F.substr("w", F.lit(2)).alias("piece"), F.lit(False).alias("is_special"), lp(3).alias("logprob")))
    tokens = k.select("seq_id", F.inline(two)).unionByName(k.select("seq_id", "turn").distinct().select("seq_id", (F.col("turn") * 100_000_000 + 99_999_999).alias("pos"), F.lit("<eot>").alias("piece"), F.lit(True).alias("is_special"), F.lit(-0.1).alias("logprob")))
    words = T.word_confidence(tokens)
    mark = F.concat("word", F.lit("("), F.round("min_conf", 2).cast("string"), F.when(F.col("is_low"), "*").otherwise(""), F.lit(")"))
    return words.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n_words"), F.count_if("is_low").alias("n_low"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", mark.alias("m")))), lambda x: x["m"]), " ").alias("line"), F.round(F.avg("geo_conf"), 6).alias("geo"))


@query(
    "template_strings", "jinja.string jinja.tests",
    r"""SELECT conv_id, turn, upper(role) AS up, lower(s) AS low, trim(s) AS strip, upper(left(role, 1)) || lower(substring(role, 2)) AS capitalize, length(s) AS length, starts_with(s, 'L') AS starts, string_split(s, ' ')[1] AS first_part, replace(s, 'e', '') AS replaced, coalesce(try_cast(s AS BIGINT), 0) AS as_int,
      substring(s, 3, greatest(least(6, length(s)) - 2, 0)) AS sliced, regexp_replace(s, '\n([^\n\r\x{85}\x{2028}\x{2029}])', chr(10) || '    \1', 'g') AS indented, (s = lower(s) AND s <> upper(s)) AS is_lower, length(s) % 2 <> 0 AS is_odd, role IN ('user', 'system') AS is_in FROM (SELECT *, text AS s FROM conversations)""",
)
def _(t):
    c, s = t("conversations").withColumn("s", F.col("text")), F.col("s")
    S = J.STRING
    return c.select(
        "conv_id", "turn", S["upper"](F.col("role")).alias("up"), S["lower"](s).alias("low"), F.trim(s).alias("strip"), S["capitalize"](F.col("role")).alias("capitalize"), S["length"](s).alias("length"), S["startswith"](s, "L").alias("starts"), S["split"](s, " ")[0].alias("first_part"), S["replace"](s, "e", "").alias("replaced"), S["int"](s).alias("as_int"),
        S["slice"](s, 2, 6).alias("sliced"), S["indent"](s).alias("indented"), J.TESTS["lower"](s).alias("is_lower"), J.TESTS["odd"](F.char_length(s)).alias("is_odd"), J.TESTS["in"](F.col("role"), ("user", "system")).alias("is_in"),
    )


@query(
    "template_arrays", "jinja.array jinja.object jinja.global",
    """WITH g AS (SELECT conv_id, list(role ORDER BY turn) AS r, list(turn ORDER BY turn) AS n FROM conversations GROUP BY 1)
    SELECT conv_id, r[1] AS first, r[-1] AS last, len(r) AS length, r[2:3] AS sliced, list_filter(n, lambda x: x % 2 = 0) AS even, list_filter(n, lambda x: NOT x % 2 = 0) AS rest, array_to_string(r, ',') AS joined, list_transform(n, lambda x: x * 2) AS doubled, list_append(r, 'end') AS appended, r[1:len(r) - 1] AS popped,
      list_sort(r) AS sorted, list_reverse(n) AS reversed, list_sort(list_distinct(r)) AS uniq, [0, 2, 4]::BIGINT[] AS ranged FROM g""",
)
def _(t):
    g = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x")).select("conv_id", F.col("x.role").alias("r"), F.col("x.turn").alias("n"))
    A, r, n = J.ARRAY, F.col("r"), F.col("n")
    return g.select(
        "conv_id", A["first"](r).alias("first"), A["last"](r).alias("last"), A["length"](r).alias("length"), A["slice"](r, 1, 3).alias("sliced"), A["select"](n, lambda x: x % 2 == 0).alias("even"), A["reject"](n, lambda x: x % 2 == 0).alias("rest"), A["join"](r, ",").alias("joined"), A["map"](n, lambda x: x * 2).alias("doubled"),
        A["append"](r, "end").alias("appended"), A["pop"](r).alias("popped"), A["sort"](r).alias("sorted"), A["reverse"](n).alias("reversed"), A["sort"](A["unique"](r)).alias("uniq"), J.GLOBAL["range"](0, 6, 2).cast("array<bigint>").alias("ranged"),
    )


@query("template_objects", "jinja.object jinja.int jinja.float jinja.bool jinja.none", """SELECT p_partkey, p_name AS got, 'none' AS missing, ['brand', 'name'] AS keys, 2::BIGINT AS n, p_size::DOUBLE AS as_float, abs(p_size - 25)::BIGINT AS absolute, CASE WHEN p_size > 25 THEN 'True' ELSE 'False' END AS flag FROM part""")
def _(t):
    m = F.create_map(F.lit("name"), "p_name", F.lit("brand"), "p_brand")
    O = J.OBJECT  # noqa: E741
    return t("part").select("p_partkey", O["get"](m, "name").alias("got"), O["get"](m, "other", "none").alias("missing"), F.array_sort(O["keys"](m)).alias("keys"), O["length"](m).alias("n"), J.NUMBER["float"](F.col("p_size")).alias("as_float"), J.NUMBER["abs"](F.col("p_size") - 25).alias("absolute"), J.BOOL["string"](F.col("p_size") > 25).alias("flag"))


for _style, _before, _after in (("chatml", "'<|im_start|>' || role || chr(10)", "'<|im_end|>' || chr(10)"), ("header", "'<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10)", "'<|eot_id|>'"), ("gemma", "'<start_of_turn>' || CASE role WHEN 'assistant' THEN 'model' ELSE role END || chr(10)", "'<end_of_turn>' || chr(10)"), ("inst", "CASE role WHEN 'system' THEN '<<SYS>>' || chr(10) WHEN 'user' THEN '[INST] ' WHEN 'assistant' THEN ' ' ELSE '' END", "CASE role WHEN 'system' THEN chr(10) || '<</SYS>>' || chr(10) || chr(10) WHEN 'user' THEN ' [/INST]' WHEN 'assistant' THEN '</s>' ELSE '' END")):

    @query(f"chat_template_{_style}", "chat.template S2", f"SELECT conv_id, string_agg({_before} || trim(text) || {_after}, '' ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id")
    def _(t, style=_style):
        return J.conversations(t("conversations"), style)
