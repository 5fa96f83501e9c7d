"""String functions as column expressions; everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: ISO code -> language name. Fixed values.
LANGUAGES = {
    "en": "English", "zh": "Chinese", "ar": "Arabic", "de": "German", "fr": "French", "es": "Spanish", "pt": "Portuguese", "it": "Italian",
    "ru": "Russian", "ko": "Korean", "ja": "Japanese", "th": "Thai", "vi": "Vietnamese", "tr": "Turkish", "hi": "Hindi", "ur": "Urdu",
}
_C, _V = "[bcdfghjklmnpqrstvwxyz]", "[aeiouy]"


def strip(c) -> Column:
    """C1."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def replace_all(c, search: str, to: str) -> Column:
    """An empty search changes nothing."""
    return F.replace(c, F.lit(search), F.lit(to)) if search else c


def regex_escape(c) -> Column:
    """C3."""
    return F.regexp_replace(c, r"([.^$|()*+?\[\]{}\\])", r"\\$1")


def split_exact(c, separator: str) -> Column:
    """Keeps empty parts."""
    return F.split(c, "\\Q" + separator + "\\E", -1)


def process_escapes(c) -> Column:
    r"""C7: \n, \t, \r, \', \", \\ and \xHH for bytes below 128, each taken once from left to right; any other text stays."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)\\x[0-7][0-9A-Fa-f]|\\.|[^\\]+|\\"), F.lit(0))

    def plain(p):
        out = F.when(F.rlike(p, F.lit(r"^\\x..$")), F.char(F.conv(F.substring(p, 3, 2), 16, 10).cast("int")))
        for code, char in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ("\\'", "'"), ('\\"', '"'), ("\\\\", "\\")):
            out = out.when(p == code, char)
        return out.otherwise(p)

    return F.array_join(F.transform(parts, plain), "")


def partial_stop(c, stop: str) -> Column:
    """Where the longest end of c that begins `stop` starts, from 0; -1 if none."""
    found = [F.when(c.endswith(stop[:k]), F.char_length(c) - k) for k in range(len(stop), 0, -1)]
    return F.coalesce(*found, F.lit(-1))


def sortable_time(c) -> Column:
    """C10."""
    return F.date_format(c, "yyyy_MM_dd-HH_mm_ss.SSSSSSSSS")


def override(c) -> Column:
    """key=kind:value as a struct with the value in the field of its kind."""
    part = lambda i: F.regexp_extract(c, r"^([^=]+)=(int|float|bool|str):(.*)$", i)
    kind, value = part(2), part(3)
    return F.struct(
        F.nullif(part(1), F.lit("")).alias("key"), F.nullif(kind, F.lit("")).alias("kind"), F.when((kind == "int") & F.rlike(value, F.lit(r"^[+-]?\d+$")), value.try_cast("bigint")).alias("as_int"),
        F.when(kind == "float", value.try_cast("double")).alias("as_float"), F.when(kind == "bool", F.when(value == "true", True).when(value == "false", False)).alias("as_bool"), F.when(kind == "str", value).alias("as_str"),
    )


def common_prefix(a, b) -> Column:
    """How many leading elements two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, False)
    return F.when(at == 0, F.size(same)).otherwise(at - 1).cast("bigint")


def title(c) -> Column:
    """C17: the first line that isn't blank, trimmed."""
    return F.try_element_at(F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != ""), F.lit(1))


def preview(c, n: int = 150) -> Column:
    """C17, T18."""
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def file_size(n) -> Column:
    """Bytes with a unit, two places."""
    steps = [("TB", 2.0**40), ("GB", 2.0**30), ("MB", 2.0**20), ("KB", 2.0**10)]
    out = F.concat(n.cast("string"), F.lit(" B"))
    for unit, size in reversed(steps):
        out = F.when(n >= size, F.concat(F.round(n / size, 2).cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def duration(ms) -> Column:
    """Milliseconds as ms, s, or m and s."""
    s = F.floor(ms / 1000)
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60_000, F.concat(s.cast("string"), F.lit("s")))
        .otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))
    )


def redact(c, keep: int = 4) -> Column:
    """C20."""
    return F.when(F.char_length(c) <= keep, F.lit("....")).otherwise(F.concat(F.lit("...."), F.right(c, F.lit(keep))))


def root_domain(url, two_part: tuple[str, ...] = ("co.uk", "com.au", "co.jp", "com.br", "co.in")) -> Column:
    """The registrable part of a URL's host; null for IP addresses and single names."""
    host = F.lower(F.parse_url(url, F.lit("HOST")))
    parts = F.split(host, "\\.")
    n = F.size(parts)
    tail = lambda k: F.array_join(F.slice(parts, n - k + 1, F.lit(k)), ".")
    return F.when(F.rlike(host, F.lit(r"^\d+(\.\d+){3}$")) | (n < 2), None).when((n > 2) & tail(2).isin(*two_part), tail(3)).otherwise(tail(2))


def safe_url(url) -> Column:
    """Http and https only."""
    return F.when(F.lower(F.parse_url(url, F.lit("PROTOCOL"))).isin("http", "https"), url)


def template_names(c) -> Column:
    """The variables of a URI template."""
    return F.regexp_extract_all(c, F.lit(r"\{([A-Za-z0-9_]+)\}"), F.lit(1))


def expand_template(c, values: dict[str, Column]) -> Column:
    """Variables replaced by URL-encoded values; unknown ones go."""
    for name, value in values.items():
        c = F.replace(c, F.lit("{" + name + "}"), F.url_encode(F.coalesce(value, F.lit(""))))
    return F.regexp_replace(c, r"\{[A-Za-z0-9_]+\}", "")


def markdown_cell(c) -> Column:
    """C24."""
    for a, b in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r"), ("|", "\\|")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def rounded_count(n) -> Column:
    """A parameter count in K, M, B or T."""
    steps = ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K"))
    out = n.cast("bigint").cast("string")
    for size, unit in reversed(steps):
        out = F.when(n >= size, F.concat(F.round(n / size, 0).cast("bigint").cast("string"), F.lit(unit))).otherwise(out)
    return out


def size_in_bytes(c) -> Column:
    """500M, 2G or a number of bytes; null if none of these."""
    n = F.regexp_extract(c, r"^(\d+)([KMG]?)$", 1)
    unit = F.regexp_extract(c, r"^(\d+)([KMG]?)$", 2)
    return F.when(n != "", n.cast("bigint") * F.when(unit == "K", 1000).when(unit == "M", 1_000_000).when(unit == "G", 1_000_000_000).otherwise(1))


def tensor_parts(c) -> Column:
    """A tensor name's layer (-1 if none) and what follows it, anything after # left out."""
    name = F.split_part(c, F.lit("#"), F.lit(1))
    layer = F.regexp_extract(name, r"blk\.(\d+)\.", 1)
    return F.struct(F.when(layer == "", -1).otherwise(layer.cast("bigint")).alias("layer"), F.regexp_replace(name, r"^.*blk\.\d+\.", "").alias("tensor"))


def model_name_parts(c) -> Column:
    """Base name, size label, fine-tune, version and quantisation in a model's file name."""
    get = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return F.struct(
        get(r"^([A-Za-z][A-Za-z0-9]*(?:[-.][A-Za-z][A-Za-z]*)*?)[-_]").alias("base"), get(r"(?i)[-_](\d+(?:\.\d+)?(?:x\d+(?:\.\d+)?)?[KMBT])(?:[-_.]|$)").alias("size"),
        get(r"(?i)[-_](instruct|chat|base|it)(?:[-_.]|$)").alias("finetune"), get(r"[-_](v\d+(?:\.\d+)*)(?:[-_]|$)").alias("version"), get(r"[-_.]([QF]\d+(?:_[0-9A-Z]+)*|BF16)(?:[-_.]|$)").alias("quant"),
    )


def language_name(c) -> Column:
    """Identity for codes that aren't listed."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), c), c)


def after_tag(c, tag: str = "<asr_text>") -> Column:
    """What follows the last tag, on one line."""
    return F.replace(F.element_at(split_exact(c, tag), -1), F.lit("\n"), F.lit(""))


def answer_lines(c, start: str = "> ", stops: tuple[str, ...] = ("[ Prompt:", "Exiting")) -> Column:
    """Of a program's output, the lines after the one that begins with start and before the first stop, blanks dropped, cut at an end mark."""
    lines = F.split(c, "\n")
    begin = F.array_position(F.transform(lines, lambda x: x.startswith(start)), True)
    tail = F.when(begin == 0, F.array().cast("array<string>")).otherwise(F.slice(lines, begin.cast("int") + 1, F.size(lines)))
    is_stop = lambda x: x.startswith(stops[0]) | x.startswith(stops[1])
    end = F.array_position(F.transform(tail, is_stop), True)
    kept = F.when(end == 0, tail).otherwise(F.slice(tail, F.lit(1), end.cast("int") - 1))
    return F.split_part(F.array_join(F.filter(kept, lambda x: F.trim(x) != ""), "\n"), F.lit("<|im_end|>"), F.lit(1))


def key_line(c, key: str, default: str = "0") -> Column:
    """The value of the first `key: value` line."""
    return F.coalesce(F.nullif(F.regexp_extract(c, rf"(?m)^{key}: (.*)$", 1), F.lit("")), F.lit(default))


def real_time_factor(seconds, length) -> Column:
    """T16."""
    return F.when(length > 0, seconds / length).otherwise(0.0)


def speed_up(s) -> Column:
    """T17."""
    return F.greatest(s, 1 / s)


def chunks(c, size: int = 64, separator: str = "\n") -> Column:
    """Parts between separators, gathered until a chunk is longer than size; a tail that isn't joins the last chunk.

    Each part keeps its separator. A fold over the parts of one text."""
    parts = F.split(c, "\\Q" + separator + "\\E", -1)
    parts = F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, F.concat(p, F.lit(separator))).otherwise(p))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s, p):
        grown = F.concat(s["open"], p)
        full = F.char_length(grown) > size
        return F.struct(F.when(full, F.array_append(s["done"], grown)).otherwise(s["done"]).alias("done"), F.when(full, F.lit("")).otherwise(grown).alias("open"))

    def finish(s):
        n = F.size(s["done"])
        tail = F.concat(F.try_element_at(s["done"], F.lit(-1)), s["open"])
        return F.when(s["open"] == "", s["done"]).when(n == 0, F.array(s["open"])).otherwise(F.array_append(F.slice(s["done"], F.lit(1), n - 1), tail))

    return F.aggregate(parts, start, step, finish)


def plain_endings(c) -> Column:
    """Long vowels at word ends made short, in this order: ee; aa after a consonant; aa before consonant and vowel; aao."""
    c = F.regexp_replace(c, r"ee\b", "i")
    c = F.regexp_replace(c, rf"(?<={_C})aa\b", "a")
    c = F.regexp_replace(c, rf"(?<={_C})aa({_C}{_V})\b", "a$1")
    return F.regexp_replace(c, rf"(?<={_C})aao\b", "ao")


def fix_words(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """Words of a text replaced from lexicon(kind, key, value), proper nouns first; a capital first letter stays.

    lexicon is a dictionary with one row per word, broadcast by Spark below its size limit, else joined by word."""
    pieces = df.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9]+"), F.lit(0))).alias("pos", "piece"))
    names = lexicon.where("kind = 'proper_noun'").select(F.col("key").alias("low"), F.col("value").alias("name"))
    right = lexicon.where("kind = 'correction' AND instr(key, ' ') = 0").select(F.col("key").alias("low"), F.col("value").alias("fixed"))
    out = pieces.withColumn("low", F.lower("piece")).join(names, "low", "left").join(right, "low", "left")
    fixed = F.when(F.rlike("piece", F.lit("^[A-Z]")), F.concat(F.upper(F.substring("fixed", 1, 1)), F.substr("fixed", F.lit(2)))).otherwise(F.col("fixed"))
    rows = out.select(key, "pos", F.coalesce("name", fixed, "piece").alias("piece"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "").alias(text))


def fix_phrases(c, phrases: dict[str, str]) -> Column:
    """Phrases replaced whatever their case, longest first."""
    for phrase in sorted(phrases, key=lambda p: (-len(p), p)):
        c = F.regexp_replace(c, rf"(?i)\b\Q{phrase}\E\b", phrases[phrase])
    return c


def word_confidence(tokens: DataFrame, low: float = 0.65) -> DataFrame:
    """tokens(seq_id, pos, piece, is_special, logprob) to words with min_conf, geo_conf, n_tokens and is_low.

    A word begins at a piece marked with U+0120, at the first piece and after a special one; specials are dropped."""
    order = Window.partitionBy("seq_id").orderBy("pos")
    start = F.col("piece").startswith("Ġ") | F.coalesce(F.lag("is_special").over(order), F.lit(True))
    words = tokens.withColumn("word_no", F.sum(F.when(start, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("not is_special")
    out = words.groupBy("seq_id", "word_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "").alias("word"),
        F.exp(F.min("logprob")).alias("min_conf"), F.exp(F.avg("logprob")).alias("geo_conf"), F.count(F.lit(1)).alias("n_tokens"),
    )
    out = out.withColumn("word", F.trim(F.replace("word", F.lit("Ġ"), F.lit(" ")))).where("word <> ''")
    return out.withColumn("is_low", F.col("min_conf") <= low)
