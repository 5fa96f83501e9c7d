"""Queries over structured text, tokenisers, codecs, audio, readers, writers and streams."""

from __future__ import annotations

import io
import json
import struct
import wave

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import scratch
from tessera.functions import audio as A
from tessera.functions import codecs as Q
from tessera.functions import packed as P
from tessera.functions import romanise as O
from tessera.functions import structured as G
from tessera.functions import tokenise as Y
from tessera.functions import vector as V
from tessera.registry import query
from tessera.sources import container as K
from tessera.sources import readers as S
from tessera.sources import writers as W
from tessera.streaming import streams as X

# Structured text


@query("romanise", "T1 T2 T3 T4 T5 T6 T8")
def _(t):
    text = F.translate("text", "abcdefghiklmnoprstuy", "अबचदएफगहइकलमनओपरसतउय")
    return t.spread("documents").select("doc_id", O.romanise(text).alias("roman"), O.ascii_digits(F.lit("१२३। ")).alias("digits"))


@query("format_checks", "G6", r"""SELECT o_orderkey, regexp_matches(strftime(o_orderdate, '%Y-%m-%d'), '^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[1-2]\d|3[0-1])$') AS is_date, regexp_matches(strftime(o_orderdate, '%H:%M:%S') || CASE WHEN o_orderkey % 2 = 0 THEN 'Z' ELSE '' END, '^([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{3})?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)$') AS is_time FROM orders""")
def _(t):
    return t("orders").select("o_orderkey", G.has_format(F.date_format("o_orderdate", "yyyy-MM-dd"), "date").alias("is_date"), G.has_format(F.concat(F.date_format("o_orderdate", "HH:mm:ss"), F.when(F.col("o_orderkey") % 2 == 0, "Z").otherwise("")), "time").alias("is_time"))


_SCHEMA = {"type": "object", "properties": {"k": {"type": "integer", "minimum": 0}, "tags": {"type": "array", "items": {"enum": ["a", "b"]}}}, "required": ["k"]}


@query("schema_check", "G4 G8", r"""SELECT event_id, regexp_matches(j, '^\{"k": ?\d+(, "tags": \["a"\])?\}$') AS ok FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '{"k": ' || event_id || ', "tags": ["a"]}' ELSE '{"k": "x"}' END AS j FROM events)""")
def _(t):
    j = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"k": '), F.col("event_id").cast("string"), F.lit(', "tags": ["a"]}'))).otherwise('{"k": "x"}')
    return t("events").select("event_id", G.matches_schema(j, _SCHEMA).alias("ok"))


@query("grammar_check", "G5 M17", r"""SELECT event_id, regexp_matches(props, '^\{"k": [0-9]+\}$') AS ok, event_id % 2 = 0 AS may_go_on FROM events""")
def _(t):
    g = 'root ::= "{" pair "}"\npair ::= "\\"k\\": " number\nnumber ::= [0-9]+'
    # A prefix of any length, behind which every other row has a letter that the grammar allows nowhere.
    prefix = F.concat(F.left("props", F.col("event_id") % F.char_length("props")), F.when(F.col("event_id") % 2 == 1, "x").otherwise(""))
    return t("events").select("event_id", G.matches_grammar(F.col("props"), g).alias("ok"), G.matches_grammar(prefix, g, prefix=True).alias("may_go_on"))


@query(
    "heal_json", "G3",
    """WITH p AS (SELECT event_id, props, 1 + event_id % length(props) AS n FROM events)
    SELECT event_id, CASE WHEN n <= 2 THEN '{"$foo":1}' WHEN n = 3 THEN '{"k$foo":1}' WHEN n < length(props) THEN '{"k":"$foo"}' ELSE replace(props, ' ', '') END AS json,
      CASE WHEN n = 1 THEN '"$foo' WHEN n IN (2, 3) THEN '$foo' WHEN n = 4 THEN ':"$foo' WHEN n < length(props) THEN '"$foo' ELSE '' END AS marker FROM p""",
)
def _(t):
    """Each row cut at another place, from one character to all of them."""
    cut = F.left("props", (1 + F.col("event_id") % F.char_length("props")).cast("int"))
    return t("events").select("event_id", G.heal_json(cut).alias("h")).select("event_id", "h.*")


@query("first_logprobs", "G7", "SELECT event_id, event_type AS token, -value AS logprob FROM events")
def _(t):
    one = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.array(F.struct(F.col("event_type").alias("token"), (-F.col("value")).alias("logprob"))).alias("top_logprobs"))).alias("content")).alias("logprobs"))).alias("choices")))
    two = F.to_json(F.struct(F.array(F.struct(F.struct(F.array("event_type").alias("tokens"), F.array(-F.col("value")).alias("token_logprobs")).alias("logprobs"))).alias("choices")))
    return t("events").select("event_id", G.first_logprob(F.when(F.col("event_id") % 2 == 0, one).otherwise(two)).alias("p")).select("event_id", "p.*")


@query("tool_calls", "G9", """SELECT event_id, 'f' || event_id % 5 AS name, props AS arguments, 2::BIGINT AS n_calls FROM events""")
def _(t):
    call = F.concat(F.lit('<tool_call>{"name": "f'), (F.col("event_id") % 5).cast("string"), F.lit('", "arguments": '), F.regexp_replace("props", " ", ""), F.lit("}</tool_call>"))
    calls = G.tool_calls(F.concat(F.lit("Let me see. "), call, F.lit("\n<tool_call>broken</tool_call>")))
    return t("events").select("event_id", calls.alias("c")).select("event_id", F.col("c")[0]["name"].alias("name"), F.regexp_replace(F.col("c")[0]["arguments"], ":", ": ").alias("arguments"), F.size("c").alias("n_calls"))


@query("number_arrays", "G2 Z5", "SELECT p_partkey, p_size % 2 = 0 AS numbers, p_size % 2 = 0 AS first_is_id FROM part")
def _(t):
    j = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("[1, "), F.col("p_size").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit('["'), "p_brand", F.lit('", 7]')))
    return t("part").select("p_partkey", G.is_number_array(j).alias("numbers"), G.mixed_prompt(j)[0]["id"].isNotNull().alias("first_is_id"))


@query("partial_patterns", "C29", "SELECT p_partkey, CASE WHEN p_size % 7 >= 5 THEN 'full' WHEN p_size % 7 > 0 THEN 'partial' END AS kind FROM part")
def _(t):
    s = F.concat(F.lit("xyz "), F.left(F.lit("<end>"), F.col("p_size") % 7))
    return t("part").select("p_partkey", G.partial_match(s, "<end>").alias("m")).select("p_partkey", "m.kind")


@query(
    "pretokens", "Z1 Z4",
    r"""SELECT doc_id, regexp_extract_all(trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x85\p{Z}]+', ' ', 'g'), ' '), '(?i:''s|''t|''re|''ve|''m|''ll|''d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^ \p{L}\p{N}]+| ') AS pieces,
      len(regexp_extract_all(text, '[^\n]+|[\n]+')) AS n_lines FROM documents""",
)
def _(t):
    """Pieces of texts whose white space has become single blanks, where a pattern without lookahead gives the same."""
    even = F.trim(F.regexp_replace("text", r"[\s\x0b\x1c-\x1f\x85\p{Z}]+", " "))
    return t.spread("documents").select("doc_id", G.pretokens(even, "digits").alias("pieces"), F.size(G.pretokens(F.col("text"), "newlines")).alias("n_lines"))


@query("pretoken_counts", "Z1 Z2")
def _(t):
    return t.spread("documents").select("doc_id", *(F.size(G.pretokens(F.col("text"), n)).alias(n) for n in ("gpt2", "threes", "digits")), F.size(G.split_again(G.pretokens(F.col("text"), "gpt2"), r"\p{N}{1,3}|\P{N}+")).alias("twice"), G.byte_letters("text").alias("letters"))


# Codecs and audio

# What DuckDB needs to say the same: a number rounded to a float16 or bfloat16 (halves to even), and to a whole number (halves away from 0).
_HALF = "CASE WHEN {x} = 0 THEN 0 ELSE round_even(({x})::DOUBLE / pow(2, greatest(floor(log2(abs(({x})::DOUBLE))), -14) - 10), 0)::DOUBLE * pow(2, greatest(floor(log2(abs(({x})::DOUBLE))), -14) - 10) END"
_BRAIN = "CASE WHEN {x} = 0 THEN 0 ELSE round_even(({x})::DOUBLE / pow(2, floor(log2(abs(({x})::DOUBLE))) - 7), 0)::DOUBLE * pow(2, floor(log2(abs(({x})::DOUBLE))) - 7) END"
_TOP = "list_max(list_transform(b, lambda x: abs(x)))"
_FIRST = f"b[list_position(list_transform(b, lambda x: abs(x)), {_TOP})]"  # the first value of the greatest size
_LOW, _SPAN = "list_min(b)", "(list_max(b) - list_min(b))"


def _coded(scale, value, low="0"):
    """Blocks b of 32: a scale, and each value x as the number that its code stands for."""
    return f"SELECT vec_id, k, list_transform(b, lambda x: ({value})::DOUBLE * ({_HALF.format(x='scale')}) + ({_HALF.format(x='low')})) AS v FROM (SELECT *, ({scale})::FLOAT AS scale, ({low})::FLOAT AS low, CASE WHEN ({scale})::FLOAT = 0 THEN 0 ELSE 1::FLOAT / ({scale})::FLOAT END::FLOAT AS inv FROM blocks)"


_CODES = {
    "q8_0": _coded(f"{_TOP} / 127::FLOAT", "round(x * inv)"),
    "q5_1": _coded(f"{_SPAN} / 31::FLOAT", "least(31, trunc((x - low) * inv + 0.5::FLOAT))", _LOW),
    "q5_0": _coded(f"{_FIRST} / -16::FLOAT", "least(31, trunc(x * inv + 16.5::FLOAT)) - 16"),
    "q4_1": _coded(f"{_SPAN} / 15::FLOAT", "least(15, trunc((x - low) * inv + 0.5::FLOAT))", _LOW),
    "q4_0": _coded(f"{_FIRST} / -8::FLOAT", "least(15, trunc(x * inv + 8.5::FLOAT)) - 8"),
    # The nearest of the numbers of four bits, the first of equals, by a power of two two below the greatest value's.
    "mxfp4": f"SELECT vec_id, k, list_transform(b, lambda x: list_sort(list_transform([0, 1, 2, 3, 4, 6, 8, 12, -1, -2, -3, -4, -6, -8, -12]::FLOAT[], lambda c: {{'d': abs((x / scale)::FLOAT - c), 'v': c}}))[1].v::DOUBLE * scale) AS v FROM (SELECT *, pow(2, floor(log2({_TOP}::DOUBLE)) - 3)::FLOAT AS scale FROM blocks)",
    "bf16": f"SELECT vec_id, k, list_transform(b, lambda x: {_BRAIN.format(x='x')}) AS v FROM blocks",
    "f16": f"SELECT vec_id, k, list_transform(b, lambda x: {_HALF.format(x='x')}) AS v FROM blocks",
}
for _kind, _sql in _CODES.items():

    @query(f"quant_{_kind}", "Q A23", f"WITH blocks AS (SELECT vec_id, k, embedding[32 * k + 1:32 * k + 32] AS b FROM embeddings, range(0, 2) r(k)), codes AS ({_sql}) SELECT vec_id, list_transform(flatten(list(v ORDER BY k)), lambda x: round(x, 6) + 0.0) AS v FROM codes GROUP BY vec_id")
    def _(t, kind=_kind):
        """What is left of each value after a round through the codec."""
        return t("embeddings").select("vec_id", F.transform(V.doubles(Q.dequantised(Q.quantised("embedding", kind), kind)), lambda x: F.round(x, 6) + 0.0).alias("v"))


_THIRDS = f"list_transform(range(0, 256), lambda i: round(round(embedding[i % 64 + 1] / list_max(list_transform(embedding, lambda x: abs(x))))::DOUBLE * ({_HALF.format(x='list_max(list_transform(embedding, lambda x: abs(x)))')}), 6) + 0.0)"


@query("quant_ternary", "Q", f"SELECT vec_id, {_THIRDS} AS tq1_0, {_THIRDS} AS tq2_0 FROM embeddings")
def _(t):
    e = t("embeddings").select("vec_id", F.flatten(F.array_repeat("embedding", 4)).alias("e"))
    return e.select("vec_id", *(F.transform(V.doubles(Q.dequantised(Q.quantised("e", k), k)), lambda x: F.round(x, 6) + 0.0).alias(k) for k in ("tq1_0", "tq2_0")))


for _kind in P.LAYOUTS:

    @query(f"decode_{_kind}", "Q")
    def _(t, kind=_kind):
        """Blocks of pseudo-random bits; the scales are set to 1."""
        k = P.LAYOUTS[kind]
        bits = F.repeat(F.sha2(F.col("p_name").cast("binary"), 512), F.lit(2))
        raw = F.substring(F.unhex(F.repeat(bits, F.lit(1 + k.size // 128))).cast("binary"), 1, k.size)
        one = F.unhex(F.lit("003C"))
        for at in (k.d, k.dmin):
            if at is not None:
                raw = F.concat(F.substring(raw, 1, at), one, F.substring(raw, at + 3, k.size))
        return t("part").select("p_partkey", P.dequantised(raw, kind).alias("values"))


@query(
    "subwords", "Z3 Z4",
    # Each letter in brackets; a merge joins brackets, and merges come in the order of their ranks.
    r"""SELECT doc_id, replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(text, '[\s\x0b\x1c-\x1f\x85\p{Z}]+', ' ', 'g'), '([^ ])', '<\1>', 'g'), '<t><h>', '<th>'), '<th><e>', '<the>'), '<a><n>', '<an>'), '<e><r>', '<er>'), '<an><d>', '<and>'), ' ', '') AS pieces FROM documents""",
)
def _(t):
    ranks = {p: i for i, p in enumerate([("t", "h"), ("th", "e"), ("a", "n"), ("e", "r"), ("an", "d")])}
    pieces = Y.encode(F.col("text"), "merges", ranks)
    return t.spread("documents").select("doc_id", F.array_join(F.transform(pieces, lambda p: F.concat(F.lit("<"), p, F.lit(">"))), "").alias("pieces"))


@query("hann_window", "F1", "SELECT p_partkey, list_transform(range(0, 8), lambda i: round(0.5 * (1 - cos(2 * pi() * i / 8)), 6) + 0.0) AS w FROM part")
def _(t):
    return t("part").select("p_partkey", F.transform(A.hann(8), lambda x: F.round(x, 6) + 0.0).alias("w"))


@query("frames", "W10 F7", "SELECT vec_id, i::BIGINT AS frame, round(list_sum(embedding[i * 8 + 1:i * 8 + 16]::DOUBLE[]), 6) AS total, i // 3 AS chunk FROM embeddings, range(0, 7) r(i)")
def _(t):
    rows = t("embeddings").select("vec_id", F.posexplode(V.framed(V.doubles("embedding"), 16, 8)).alias("frame", "f"))
    return A.chunked(rows, 3).select("vec_id", "frame", F.round(V.total(F.col("f")), 6).alias("total"), "chunk")


_DFT = "list_transform(range(0, 64), lambda k: round(list_sum(list_transform(range(0, 64), lambda n: embedding[n + 1]::DOUBLE * {f}(2 * pi() * ((k * n) % 64) / 64))), 5) + 0.0)"


@query("spectrum", "F3", f"SELECT vec_id, {_DFT.format(f='cos')} AS re, {_DFT.format(f='-sin')} AS im, list_transform(embedding::DOUBLE[], lambda x: round(x, 6) + 0.0) AS back FROM embeddings")
def _(t):
    e = t("embeddings").select("vec_id", A.spectrum("embedding").alias("s")).select("vec_id", "s", A.spectrum(F.col("s"), inverse=True).alias("b"))
    return e.select("vec_id", *(F.transform(F.col("s")[c], lambda x: F.round(x, 5) + 0.0).alias(c) for c in ("re", "im")), F.transform("b", lambda x: F.round(x, 6) + 0.0).alias("back"))


def _mel(t):
    return A.log_mel(t("embeddings").select(F.col("vec_id").alias("clip_id"), F.col("embedding").alias("samples")), 8, 16, 8, 16_000)


# Windows of 16 every 8 samples, their power spectrum by its definition, and triangles between points that are even on the mel scale.
_MEL_SQL = """
w AS (SELECT vec_id AS clip_id, f AS frame, list_transform(range(0, 16), lambda n: embedding[f * 8 + n + 1]::DOUBLE * 0.5 * (1 - cos(2 * pi() * n / 16))) AS x FROM embeddings, range(0, 7) r(f)),
p AS (SELECT clip_id, frame, k, pow(list_sum(list_transform(range(0, 16), lambda n: x[n + 1] * cos(2 * pi() * k * n / 16))), 2) + pow(list_sum(list_transform(range(0, 16), lambda n: x[n + 1] * sin(2 * pi() * k * n / 16))), 2) AS power FROM w, range(0, 9) r(k)),
pt AS (SELECT i, (15 + ln(8.0::DOUBLE) * 27 / ln(6.4::DOUBLE)) * i / 9 AS mel FROM range(0, 10) r(i)),
hz AS (SELECT i, CASE WHEN mel < 15 THEN mel * 200 / 3 ELSE 1000 * exp((mel - 15) * ln(6.4::DOUBLE) / 27) END AS hz FROM pt),
flt AS (SELECT a.i AS band, k, greatest(0, least((k * 1000 - a.hz) / (b.hz - a.hz), (c.hz - k * 1000) / (c.hz - b.hz))) * 2 / (c.hz - a.hz) AS wt FROM hz a JOIN hz b ON b.i = a.i + 1 JOIN hz c ON c.i = a.i + 2, range(0, 9) r(k)),
m AS (SELECT clip_id, frame, band, log10(greatest(sum(power * wt), 5.960464477539063e-08::DOUBLE)) AS v FROM p JOIN flt USING (k) GROUP BY 1, 2, 3)"""


def _mel_rounded(df):
    return df.select("clip_id", "frame", F.transform("mel", lambda x: F.round(x, 5) + 0.0).alias("mel"))


@query("log_mel", "F2 F4", f"WITH {_MEL_SQL} SELECT clip_id, frame, list(round(v, 5) + 0.0 ORDER BY band) AS mel FROM m GROUP BY 1, 2")
def _(t):
    return _mel_rounded(_mel(t))


@query("mel_clamped", "F5", f"WITH {_MEL_SQL}, top AS (SELECT *, max(v) OVER (PARTITION BY clip_id) AS top FROM m) SELECT clip_id, frame, list(round((greatest(v, top - 8) + 4) / 4, 5) + 0.0 ORDER BY band) AS mel FROM top GROUP BY 1, 2")
def _(t):
    return _mel_rounded(A.clamped(_mel(t)))


@query("feature_norm", "F6", "WITH r AS (SELECT vec_id % 20 AS clip_id, vec_id AS frame, generate_subscripts(embedding, 1) - 1 AS bin, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT clip_id, frame, bin, round((v - avg(v) OVER w) / sqrt(var_samp(v) OVER w + 1e-5), 5) AS v FROM r WINDOW w AS (PARTITION BY clip_id, bin)")
def _(t):
    f = t("embeddings").select((F.col("vec_id") % 20).alias("clip_id"), F.col("vec_id").alias("frame"), V.doubles("embedding").alias("mel"))
    return A.standardised(f).withColumn("v", F.round("v", 5))


# Readers and writers: tables written in a format and read back

_PART = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType()), T.StructField("p_size", T.IntegerType())])
_PART_SQL = "SELECT p_partkey, p_name, p_size::BIGINT AS p_size FROM part"


@query("json_lines", "S2 K10 K1", _PART_SQL)
def _(t):
    path = scratch.path(t.spark, "json")
    W.bench_output(t("part").withColumn("extra", F.lit(1)), path, "jsonl")
    return S.json_lines(t.spark, path, _PART, ["p_partkey"])


@query("json_arrays", "S3 U1", _PART_SQL)
def _(t):
    path = scratch.path(t.spark, "arrays")
    W.json_arrays(t("part").select(*_PART.names), path)
    return S.json_arrays(t.spark, [f"{path}/*"], _PART)


@query("csv_files", "S4 S5 K3 K4 K9", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'say \"hi\", ' || p_name ELSE p_name END AS p_name, p_size::BIGINT AS p_size FROM part")
def _(t):
    path = scratch.path(t.spark, "csv")
    W.csv(t("part").withColumn("p_name", F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit('say "hi", '), "p_name")).otherwise(F.col("p_name"))).coalesce(1), path, ["p_partkey", "p_name", "p_size", "absent"], quote_all=True, mark=True)
    return S.csv(t.spark, path, _PART, ["p_name"], not_empty=True)


@query("tolerant_json", "S7", "SELECT p_partkey, p_name, p_size::BIGINT AS p_size FROM part WHERE p_partkey % 3 <> 0")
def _(t):
    path = scratch.path(t.spark, "tolerant")
    t("part").select(F.when(F.col("p_partkey") % 3 == 0, '{"p_partkey": oops').otherwise(F.to_json(F.struct(*_PART.names))).alias("value")).write.text(path)
    return S.tolerant_json_lines(t.spark, path, _PART)


@query("log_scan", "S8", "SELECT event_type AS op, event_id AS usec, CASE WHEN user_id % 2 = 0 THEN user_id END AS pmu FROM events WHERE event_id % 7 <> 0")
def _(t):
    path = scratch.path(t.spark, "log")
    line = F.concat(F.lit("profile-op "), "event_type", F.lit(": usec "), F.col("event_id").cast("string"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit(" pmu ["), F.col("user_id").cast("string"), F.lit("]"))).otherwise(""))
    t("events").select(F.when(F.col("event_id") % 7 == 0, "something else").otherwise(line).alias("value")).write.text(path)
    return S.log_lines(t.spark, path, r"^profile-op (\w+): usec (\d+)(?: pmu \[(\d+)\])?", {"op": "string", "usec": "bigint", "pmu": "bigint"})


@query("open_blocks", "S9", "WITH l AS (SELECT user_id, event_id, CASE WHEN event_type = 'view' THEN 'v' || event_id END AS opened FROM events), b AS (SELECT *, last_value(opened IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS block FROM l) SELECT user_id, event_id, block, event_id::VARCHAR AS content FROM b WHERE opened IS NULL AND block IS NOT NULL")
def _(t):
    line = F.when(F.col("event_type") == "view", F.concat(F.lit("Function: v"), F.col("event_id").cast("string"))).otherwise(F.concat(F.lit("Regs: "), F.col("event_id").cast("string")))
    return S.open_blocks(t("events").select("user_id", "event_id", line.alias("value")), r"^Function: (\w+)", r"^(Regs): (\d+)", ["user_id"], "event_id").select("user_id", "event_id", "block", "content")


@query("ini_files", "S17", "SELECT p_brand, 's' || (p_partkey // 10 * 10) AS section, 'k' || p_partkey AS key, p_name AS value FROM part WHERE p_partkey % 10 <> 0 AND p_partkey > 10")
def _(t):
    p = t("part").where("p_partkey >= 10").select(F.lit("f").alias("file"), "p_brand", "p_partkey", F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("[s"), F.col("p_partkey").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("k"), F.col("p_partkey").cast("string"), F.lit(" = "), "p_name")).alias("value"))
    out = S.ini(p, ["file"], "p_partkey")
    return out.join(t("part").select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("key"), "p_brand"), "key").select("p_brand", "section", "key", "value")


@query("metric_series", "S18 X8", "SELECT event_type AS metric, time_bucket(INTERVAL '6 hours', ts) AS start, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def _(t):
    path = scratch.path(t.spark, "metrics")
    e = t("events").select("event_type", W.in_chunks().alias("f"), F.array(F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, 6).cast("string"), F.col("value").cast("string")).alias("v"))
    rows = e.groupBy("event_type", "f").agg(F.collect_list("v").alias("values"))
    doc = F.to_json(F.struct(F.struct(F.array(F.struct(F.create_map(F.lit("__name__"), "event_type").alias("metric"), "values")).alias("result")).alias("data")))
    W.text_files(rows.select(doc.alias("value")), path)
    # A mean that lies between two numbers of six places is summed to one side of that by the order of its rows; ten places put it back.
    mean = F.round(F.round(F.avg("value"), 10), 6)
    return S.metric_series(t.spark, f"{path}/*").groupBy("metric", F.window("ts", "6 hours")["start"].cast("timestamp_ntz").alias("start")).agg(F.count(F.lit(1)).alias("n"), mean.alias("mean"))


@query("synthetic_prompts", "S19")
def _(t):
    return S.synthetic_prompts(t.spark, 500, 5, 20, 3).select("id", "n_tokens", F.size("tokens").alias("size"))


@query("json_report", "K5", "SELECT to_json({'meta': {'tool': 'bench', 'n': 5}, 'results': list({'r_regionkey': r_regionkey, 'r_name': r_name} ORDER BY r_regionkey)})::VARCHAR AS report FROM region")
def _(t):
    return W.json_report(t("region"), {"tool": F.lit("bench"), "n": F.count(F.lit(1))}, ["r_regionkey"])


@query("markdown_table", "K6 C24", "WITH w AS (SELECT greatest(max(length(r_regionkey::VARCHAR)), 11) AS a, greatest(max(length(r_name)), 6) AS b FROM region) SELECT '| ' || rpad('r_regionkey', max(a)::INT, ' ') || ' | ' || rpad('r_name', max(b)::INT, ' ') || ' |' || chr(10) || '| ' || repeat('-', max(a)::INT) || ' | ' || repeat('-', max(b)::INT) || ' |' || chr(10) || string_agg('| ' || rpad(r_regionkey::VARCHAR, a::INT, ' ') || ' | ' || rpad(r_name, b::INT, ' ') || ' |', chr(10) ORDER BY r_regionkey) AS text FROM region, w")
def _(t):
    return W.aligned(t("region"), ["r_regionkey"])


@query("text_table", "K7", "WITH w AS (SELECT greatest(max(length(r_regionkey::VARCHAR)), 11) AS a, greatest(max(length(r_name)), 6) AS b FROM region) SELECT lpad('r_regionkey', max(a)::INT, ' ') || '  r_name' || chr(10) || repeat('-', max(a)::INT) || '  ' || repeat('-', max(b)::INT) || chr(10) || string_agg(lpad(r_regionkey::VARCHAR, a::INT, ' ') || '  ' || r_name, chr(10) ORDER BY r_regionkey) AS text FROM region, w")
def _(t):
    return W.aligned(t("region"), ["r_regionkey"], "text", right=("r_regionkey",))


@query("sheet_highlight", "K8 P14", "SELECT p_partkey::VARCHAR AS p_partkey, p_brand, p_name, p_size::VARCHAR AS p_size, p_brand IN ('Brand#1', 'Brand#2') AND p_size IN (1, 2, 3) AS highlight FROM part")
def _(t):
    """A sheet per brand, read back with what is highlighted."""
    part = t("part").select("p_partkey", "p_brand", "p_name", "p_size", (F.col("p_brand").isin("Brand#1", "Brand#2") & F.col("p_size").isin(1, 2, 3)).alias("highlight"))
    return S.sheet_rows(W.sheets(part, ["p_brand"], ["p_partkey"], "highlight"), ["p_partkey", "p_brand", "p_name", "p_size"])


@query("insert_statements", "K9 K1", "SELECT 'INSERT INTO part (p_partkey, p_name) VALUES (''' || p_partkey || ''', ''' || p_name || ''');' AS sql FROM part")
def _(t):
    return W.insert_statements(t("part").select("p_partkey", "p_name"), "part")


@query("texts_per_key", "K15 S15 S16", "SELECT r_name, count(*) AS n FROM region GROUP BY 1")
def _(t):
    path = scratch.path(t.spark, "texts")
    W.text_per_key(t("region"), path, "r_regionkey", "r_name")
    return S.whole_texts(t.spark, f"{path}/*").select(F.regexp_replace("text", "\n$", "").alias("r_name")).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))


@query("embedding_output", "K12")
def _(t):
    return W.embeddings_as(t("embeddings"), "json")


def _floats(c):
    """Bytes of 32-bit floats as an array."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: np.frombuffer(b, "<f4"))

    return run(c)


@query("container_round_trip", "S11 K11 P17 A32 A33 C27", "SELECT 'blk.' || vec_id || '.w' AS name, 'F32' AS dtype, 64::BIGINT AS n, 256::BIGINT AS n_bytes, embedding::DOUBLE[] AS v, '\"m' || vec_id || '\"' AS model, '[1, 2, ' || label || ']' AS sizes FROM embeddings")
def _(t):
    """Vectors written as tensors of a container by one Arrow UDF, and described by the reader, with pairs and contents."""

    @F.pandas_udf("binary")
    def pack(ids: pd.Series, vectors: pd.Series, labels: pd.Series) -> pd.Series:
        return pd.Series([K.write([("general.name", "string", f"m{i}"), ("sizes", "array", ("int32", [1, 2, n]))], [(f"blk.{i}.w", "F32", [64], np.asarray(v, "<f4").tobytes())]) for i, v, n in zip(ids, vectors, labels, strict=True)])

    files = t("embeddings").select(F.col("vec_id").cast("string").alias("path"), pack("vec_id", "embedding", "label").alias("content"))
    pairs = K.pairs_of(files).groupBy("path").agg(F.max(F.when(F.col("key") == "general.name", F.col("value"))).alias("model"), F.max(F.when(F.col("key") == "sizes", F.col("value"))).alias("sizes"))
    return K.tensors_of(files, content=True).join(pairs, "path").select("name", "dtype", F.col("shape")[0].alias("n"), "n_bytes", V.doubles(_floats("content")).alias("v"), "model", "sizes")


@query("safetensors_headers", "S13", "SELECT 'v' || vec_id AS name, 'F32' AS dtype, 64::BIGINT AS n, 256::BIGINT AS n_bytes, embedding::DOUBLE[] AS v FROM embeddings")
def _(t):
    """Each file with a tensor that the headers' offsets must lead to, behind another one."""

    @F.pandas_udf("binary")
    def pack(ids: pd.Series, vectors: pd.Series) -> pd.Series:
        heads = [json.dumps({"__metadata__": {"format": "pt"}, "first": {"dtype": "I8", "shape": [8], "data_offsets": [0, 8]}, f"v{i}": {"dtype": "F32", "shape": [64], "data_offsets": [8, 264]}}).encode() for i in ids]
        return pd.Series([struct.pack("<Q", len(h)) + h + bytes(8) + np.asarray(v, "<f4").tobytes() for h, v in zip(heads, vectors, strict=True)])

    files = t("embeddings").select(F.col("vec_id").cast("string").alias("path"), pack("vec_id", "embedding").alias("content"))
    found = K.safetensors(files).where("dtype = 'F32'").join(files, "path")
    return found.select("name", "dtype", F.col("shape")[0].alias("n"), "n_bytes", V.doubles(_floats(F.substr("content", (F.col("offset") + 1).cast("int"), F.col("n_bytes").cast("int")))).alias("v"))


_WAV = "list_transform(embedding, lambda x: trunc(x * 20000::FLOAT)::DOUBLE / 32768)"


@query("wav_decode", "S14", f"SELECT vec_id, 0.008::DOUBLE AS seconds, list_transform(range(0, 128), lambda i: round(CASE WHEN i % 2 = 0 OR i = 127 THEN ({_WAV})[i // 2 + 1] ELSE (({_WAV})[i // 2 + 1] + ({_WAV})[i // 2 + 2]) / 2 END, 6) + 0.0) AS samples FROM embeddings")
def _(t):
    """Vectors as one-channel files of 8,000 samples a second, decoded at 16,000."""

    @F.pandas_udf("binary")
    def pack(vectors: pd.Series) -> pd.Series:
        def one(v):
            out = io.BytesIO()
            with wave.open(out, "wb") as w:
                w.setnchannels(1)
                w.setsampwidth(2)
                w.setframerate(8000)
                w.writeframes((np.asarray(v, np.float32) * np.float32(20_000)).astype("<i2").tobytes())
            return out.getvalue()

        return vectors.map(one)

    rows = t("embeddings").select("vec_id", S.decoded_wav(pack("embedding")).alias("w"))
    return rows.select("vec_id", "w.seconds", F.transform(V.doubles("w.samples"), lambda x: F.round(x, 6) + 0.0).alias("samples"))


@query("sqlite_table", "S1 S6 K2", "SELECT p_partkey, p_name, p_size::BIGINT AS p_size FROM part")
def _(t):
    """A table written to SQLite files in the folder that driver and executors share, sniffed and read back by row ranges."""
    path = scratch.path(t.spark, "sqlite")
    if not path.startswith(("file:", "/")):
        raise ValueError("SQLite opens files only: spark.checkpoint.dir must be a folder that is mounted everywhere")
    path = "/" + path.removeprefix("file:").lstrip("/")
    W.sqlite(t("part").select(*_PART.names), path, "part")
    return S.load_any(t.spark, path, _PART, "part")


# Streams, each against the answer of a batch


@query("stream_tumbling", "X6 X8 A37 X2", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def _(t):
    out = X.run(X.tumbling(X.events(t.spark, t.sf_dir), "1 hour", ["event_type"], "value"), "complete", "tumbling")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("stream_sliding", "X10", "SELECT time_bucket(INTERVAL '30 minutes', ts) - INTERVAL 30 MINUTE * k AS start, event_type, round(avg(value), 6) AS mean FROM events, range(0, 2) r(k) GROUP BY 1, 2")
def _(t):
    out = X.run(X.sliding(X.events(t.spark, t.sf_dir), "1 hour", "30 minutes", ["event_type"], "value"), "complete", "sliding")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", F.round("mean", 6).alias("mean"))


@query("stream_sessions", "X11", "WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER o + INTERVAL 4 HOUR OR lag(ts) OVER o IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 4 HOUR AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def _(t):
    out = X.run(X.sessions(X.events(t.spark, t.sf_dir), "4 hours", "user_id"), "complete", "sessions")
    return out.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")), "n")


@query("stream_distinct", "X6", "SELECT event_id, user_id, value FROM events")
def _(t):
    e = X.events(t.spark, t.sf_dir)
    return X.run(X.distinct_events(e.withColumn("twice", F.explode(F.array(F.lit(1), F.lit(2)))).drop("twice")), "append", "distinct").select("event_id", "user_id", "value")


@query("stream_join", "X3 X7", "SELECT a.event_id AS req_id, b.event_id AS res_id, round((epoch_us(b.ts) - epoch_us(a.ts)) / 1e6, 6) AS seconds FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 3 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def _(t):
    side = lambda kind, tag: X.events(t.spark, t.sf_dir).where(F.col("event_type") == kind).select(F.col("user_id").alias(f"{tag}_key"), F.col("event_id").alias(f"{tag}_id"), F.col("ts").alias(f"{tag}_ts"))
    out = X.run(X.answered(side("click", "req"), side("purchase", "res"), "3 hours"), "append", "join")
    return out.select("req_id", "res_id", F.round("seconds", 6).alias("seconds"))


@query("stream_gather", "X4 X5 X12", "SELECT user_id AS task_id, count(*) AS n_parts, string_agg(event_type, '' ORDER BY event_id) AS text FROM events WHERE user_id % 7 <> 0 GROUP BY 1")
def _(t):
    from pyspark.sql import Window

    own = Window.partitionBy("task_id")
    rows = t("events").select(F.col("user_id").alias("task_id"), "event_id", F.col("event_type").alias("text"))
    rows = rows.withColumn("idx", F.row_number().over(own.orderBy("event_id")).cast("long") - 1).withColumn("kind", F.when((F.col("task_id") % 7 == 0) & (F.col("idx") == 0), "cancel").when(F.col("idx") == F.count(F.lit(1)).over(own) - 1, "final").otherwise("partial"))
    path = scratch.path(t.spark, "parts")
    # All parts at one moment, as the files hold them in no order of time.
    rows.select("task_id", "idx", "kind", "text", F.lit("2024-01-31").cast("timestamp").alias("ts")).repartition(3).write.parquet(path)
    return X.run(X.gathered(t.spark.readStream.schema("task_id long, idx long, kind string, text string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)), "append", "gather")


@query("stream_queue", "X1 X2 X7", "WITH RECURSIVE e AS (SELECT user_id % 4 AS server, event_id AS task_id, epoch_us(ts) AS due, round(value * 60 * 1e6)::BIGINT AS lasts, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS r FROM events), s AS (SELECT e.*, due AS begun, 0::BIGINT AS a, due + lasts AS b FROM e WHERE r = 1 UNION ALL SELECT e.*, greatest(e.due, least(s.a, s.b)), greatest(s.a, s.b), greatest(e.due, least(s.a, s.b)) + e.lasts FROM s JOIN e ON e.server = s.server AND e.r = s.r + 1) SELECT server, task_id, (begun - due) / 1e6 AS waited FROM s")
def _(t):
    e = X.events(t.spark, t.sf_dir).select((F.col("user_id") % 4).alias("server"), "ts", F.col("event_id").alias("task_id"), (F.col("value") * 60).alias("seconds"))
    return X.run(X.slot_queue(e, 2), "append", "queue")


@query("stream_pairs", "X9 A24 A25", "WITH p AS (SELECT user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, event_type AS next FROM events) SELECT user_id, prev, next, count(*) AS cnt FROM p WHERE prev IS NOT NULL GROUP BY 1, 2, 3")
def _(t):
    out = X.run(X.pair_counts(X.events(t.spark, t.sf_dir), "user_id", "event_type"), "append", "pairs")
    return out.groupBy("user_id", "prev", "next").agg(F.sum("cnt").alias("cnt"))


@query("time_to_first", "X7", "SELECT user_id, round((epoch_us(min(ts) FILTER (WHERE event_type = 'view')) - epoch_us(min(ts))) / 1e6, 6) AS first_view, count(*) AS n FROM events GROUP BY 1")
def _(t):
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    e = t("events")
    return e.groupBy("user_id").agg(F.round((F.min(F.when(F.col("event_type") == "view", us(F.col("ts")))) - F.min(us(F.col("ts")))) / 1e6, 6).alias("first_view"), F.count(F.lit(1)).alias("n"))
