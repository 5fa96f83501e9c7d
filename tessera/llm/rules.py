"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Base measures and the base rule come from the text alone. On top, each further rule rejects a document
whose measure is above a cutoff. Cutoffs are chosen per stratum (language) from labelled
documents: for each cutoff of a fixed ladder, the number of good documents it would reject is
tested against "it rejects a share of RISK / rules or more of the good ones" by the exact binomial tail. A
rule walks its ladder from the mildest cutoff on and stops at the first that can't be
certified; that order is fixed beforehand, so a walk needs no correction, while the level is divided
by the number of walks (all strata, all rules). So with probability 1 - DELTA, no stratum
loses more than RISK of its good documents to all rules together. Where nothing can be certified, a rule
stays silent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import stored, table

WINDOW = 8
MIN_WORDS, MAX_REPEAT = 20, 30
RISK, DELTA = 0.02, 0.05
#: Measure -> ladder of cutoffs, mildest first. Fixed before any label is seen.
LADDERS = {
    "symbols_per_char": (0.5, 0.3, 0.2, 0.1, 0.05, 0.03, 0.02, 0.01),
    "dup_line_share": (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05),
    "repeat_share": (0.3, 0.25, 0.2, 0.15, 0.1, 0.05, 0.02, 0.01),
    "mean_word": (40.0, 25.0, 15.0, 12.0, 10.0, 9.0, 8.0, 7.0),
}
_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def _with(value, use):
    """use(value), where value is worked out once however often use mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(words):
    """Words in windows that stand twice or more in the text.

    Windows are named by a 64-bit hash; (name, place) pairs are sorted, so equal windows are neighbours;
    the places of those with an equal neighbour, sorted again, cover up to WINDOW words each."""
    n = F.size(words) - WINDOW + 1
    names = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(hashes):
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        mates = _with(pairs, lambda s: F.filter(F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull()))
        return _with(F.array_sort(mates), lambda p: F.aggregate(F.transform(p, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

    # Most texts repeat no window; a set of names shows that without sorting.
    return F.when(n < 2, 0).otherwise(_with(names, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))))


def measures(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """docs(doc_id, text, ...) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Null and empty texts have no words and fail. Text is worked on whole, by expressions that stay in the row;
    nothing is shuffled. Extra columns are left aside, repeated rows measured each."""
    keep = columns or ["doc_id"]
    out = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    text = F.col("_text")
    bare = F.trim(text, F.lit(_SPACE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(_SPACE)) != "")
    values = _with(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words")))
    dups = _with(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    n_lines = F.size(lines)
    out = out.select(
        *keep,
        values.alias("_v"),
        F.char_length(F.translate(text, _SPACE, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        dups.cast("long").alias("n_dup_lines"),
        n_lines.cast("long").alias("n_lines"),
    )
    out = out.select(*keep, F.col("_v.n_words").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("_v.n_repeat_words").alias("n_repeat_words"), "n_lines")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))


def _share(a, b):
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


def shares(df: DataFrame) -> DataFrame:
    """The measures that the ladders are about, as doubles."""
    return (
        df.withColumn("symbols_per_char", _share("n_symbols", "word_chars"))
        .withColumn("dup_line_share", _share("n_dup_lines", "n_lines"))
        .withColumn("repeat_share", _share("n_repeat_words", "n_words"))
        .withColumn("mean_word", _share("word_chars", "n_words"))
    )


def _log_gamma(x):
    """ln gamma(x), x >= 1: Stirling's series at x + 8, less the logarithms passed on the way."""
    y = x + 8.0
    series = (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return series - sum((F.ln(x + float(i)) for i in range(1, 8)), F.ln(x))


def binomial_tail(k, n, p: float):
    """P(Bin(n, p) <= k), for columns k and n: terms from k downwards, each from the one above it.

    For k under the mean they shrink; past 40 standard deviations and 60 terms more, what is left is
    below any double's precision, so this many terms are summed. For k at or above the mean the tail is about a half or more,
    which no level used here accepts; it is given as 1."""
    x, m = k.cast("double"), n.cast("double")
    top = _log_gamma(m + 1) - _log_gamma(x + 1) - _log_gamma(m - x + 1) + x * F.ln(F.lit(p)) + (m - x) * F.ln(F.lit(1 - p))
    terms = F.least(k.cast("long"), F.ceil(40 * F.sqrt(m * p * (1 - p))) + 60).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(s, i):
        term = s["term"] * (x - i + 1) / (m - x + i) * F.lit((1 - p) / p)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    steps = F.when(terms >= 1, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, start, step, lambda s: s["total"])
    return F.when((n == 0) | (x >= m * p), 1.0).otherwise(F.exp(top) * total)


def thresholds(scored: DataFrame, labels: DataFrame, stratum: str = "stratum", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, cut_<measure>...) : the certified cutoff of each rule, null where none is.

    scored: a row per document, with doc_id, stratum, base_failed and the ladders' measures. labels(doc_id, quality): documents of quality 1
    (and of no other label) that pass the base rule are the holdout; nothing else was fitted on them. Only these rows' few numbers are shuffled,
    and counted per stratum before that."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("least")).where("least = 1").select("doc_id")
    holdout = scored.where("not base_failed").join(good, "doc_id", "left_semi")
    counts = [F.count(F.lit(1)).alias("n")]
    steps = [(m, i, c) for m, ladder in LADDERS.items() for i, c in enumerate(ladder)]
    counts += [F.count_if(F.col(m) > c).alias(f"k_{m}_{i}") for m, i, c in steps]
    per = holdout.groupBy(stratum).agg(*counts)
    walks = F.count(F.lit(1)).over(Window.partitionBy()) * len(LADDERS)
    per = per.withColumn("level", F.lit(delta) / walks)
    share = risk / len(LADDERS)
    tests = per.select(stratum, "level", "n", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.lit(i).alias("step"), F.lit(c).alias("cut"), F.col(f"k_{m}_{i}").alias("k")) for m, i, c in steps))).alias("t")).select(stratum, "level", "n", "t.*")
    tests = tests.withColumn("p_value", binomial_tail(F.col("k"), F.col("n"), share))
    walk = Window.partitionBy(stratum, "measure").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    certified = tests.withColumn("ok", F.max(F.when(F.col("p_value") <= F.col("level"), 0).otherwise(1)).over(walk) == 0)
    return certified.groupBy(stratum).agg(*(F.max_by("cut", F.when(F.col("ok") & (F.col("measure") == m), F.col("step"))).alias(f"cut_{m}") for m in LADDERS))


def _stratum():
    return F.coalesce(F.col("lang").cast("string"), F.lit(""))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Each row of docs(doc_id, text, lang) with its measures, base_failed and kept.

    kept is false where the base rule fails, else false where a certified cutoff of the row's language is passed.
    Null languages are one stratum with empty ones. Without labels nothing is certified and the base rule decides. An empty table gives an empty
    result."""
    scored = stored(shares(measures(docs.select("doc_id", "text", _stratum().alias("stratum")), ["doc_id", "stratum"])), "measures")
    cuts = stored(thresholds(scored, labels), "cutoffs")
    # A row per stratum; Spark broadcasts it as long as it is under the session's size limit, else splits skewed partitions.
    both = scored.join(cuts, "stratum", "left")
    passed = [F.coalesce(F.col(m) > F.col(f"cut_{m}"), F.lit(False)) for m in LADDERS]
    fires = passed[0]
    for p in passed[1:]:
        fires = fires | p
    return both.withColumn("kept", ~F.col("base_failed") & ~fires)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    share = RISK / len(LADDERS)
    fires = " OR ".join(f"coalesce({m} > cut_{m}, FALSE)" for m in LADDERS)
    steps = ", ".join(f"('{m}', {i}, {c}::DOUBLE)" for m, ladder in LADDERS.items() for i, c in enumerate(ladder))
    value = "CASE s.measure " + " ".join(f"WHEN '{m}' THEN {m}" for m in LADDERS) + " END"
    cuts = ", ".join(f"max_by(cut, step) FILTER (WHERE ok AND measure = '{m}') AS cut_{m}" for m in LADDERS)
    return f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, stratum, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
win AS (SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW})))::BIGINT AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, stratum, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
b AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AS base_failed,
  CASE WHEN word_chars > 0 THEN n_symbols::DOUBLE / word_chars ELSE 0 END AS symbols_per_char, CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS dup_line_share,
  CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0 END AS repeat_share, CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS mean_word FROM m),
h AS (SELECT * FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1)),
k AS (SELECT stratum, s.measure, s.step, s.cut, count(*) AS n, count(*) FILTER (WHERE {value} > s.cut) AS k FROM h, (VALUES {steps}) AS s(measure, step, cut) GROUP BY ALL),
p AS (SELECT *, CASE WHEN k >= n * {share!r} THEN 1 ELSE
  list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share!r}) + (n - i) * ln(1 - {share!r})))) END AS p_value FROM k),
c AS (SELECT *, max(CASE WHEN p_value <= {DELTA!r} / ({len(LADDERS)} * (SELECT count(DISTINCT stratum) FROM h)) THEN 0 ELSE 1 END) OVER (PARTITION BY stratum, measure ORDER BY step) = 0 AS ok FROM p),
cuts AS (SELECT stratum, {cuts} FROM c GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({fires}) AS kept FROM b LEFT JOIN cuts ON b.stratum = cuts.stratum
"""


OP2_SQL = _sql()
