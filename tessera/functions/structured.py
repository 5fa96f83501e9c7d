"""Partial JSON, schemas, grammars, tool calls, and patterns matched up to the end of a text (G2-G9, C29), and pre-tokenisers."""

from __future__ import annotations

import json
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Indented JSON --------------------------------------------------------------------------------------------------


def _number(x: float) -> str:
    """A double as ECMAScript writes it: the shortest digits that give it back, with an exponent outside 1e-6 to 1e21."""
    if x in (float("inf"), float("-inf")):
        return "null"
    if x == 0:
        return "0"
    if 1e-6 <= abs(x) < 1e21:
        text = format(Decimal(repr(x)), "f")
        return text.rstrip("0").rstrip(".") if "." in text else text
    digits, _, power = f"{Decimal(repr(x)).normalize():e}".partition("e")
    return f"{digits}e{int(power):+d}"


def _index(key: str) -> bool:
    return key.isascii() and key.isdigit() and (key == "0" or key[0] != "0") and int(key[:11]) < 2**32 - 1


def _indented(x, blank: str = "") -> str:
    if isinstance(x, float):
        return _number(x)
    if not isinstance(x, (dict, list)):
        return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", json.dumps(x, ensure_ascii=False))
    more = blank + "  "
    if isinstance(x, list):
        inside = [_indented(v, more) for v in x]
    else:  # keys that are array indices stand first
        keys = [*sorted(filter(_index, x), key=int), *(k for k in x if not _index(k))]
        inside = [f"{_indented(k)}: {_indented(x[k], more)}" for k in keys]
    left, right = "[]" if isinstance(x, list) else "{}"
    return left + "".join(f"{',' * (i > 0)}\n{more}{v}" for i, v in enumerate(inside)) + f"\n{blank}" * bool(inside) + right


def _no_constant(name: str):
    raise ValueError(name)


def pretty_json(c) -> Column:
    """JSON indented by two blanks, as ECMAScript's JSON.stringify does; what isn't JSON passes as it is."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            try:
                return _indented(json.loads(x, parse_int=float, parse_constant=_no_constant))
            except (ValueError, RecursionError):
                return x

        return s.map(one)

    return run(c)


# Partial JSON ---------------------------------------------------------------------------------------------------


class _Cut(Exception):
    """The text ends here; healed: what stands for the rest."""


class _Reader:
    """A recursive reader that returns (value as JSON text, whole) and, where the text ends early, puts the marker in."""

    def __init__(self, text: str, marker: str):
        self.s, self.at, self.marker, self.magic = text, 0, marker, ""

    def blank(self):
        while self.at < len(self.s) and self.s[self.at] in " \t\n\r":
            self.at += 1

    def value(self) -> tuple[str, bool]:
        self.blank()
        if self.at >= len(self.s):
            self.magic = f'"{self.marker}'
            return json.dumps(self.marker), False
        c = self.s[self.at]
        if c == "{":
            return self.object()
        if c == "[":
            return self.array()
        if c == '"':
            return self.string()
        m = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null").match(self.s, self.at)
        word = re.compile(r"[-+.\w]+").match(self.s, self.at)
        if word is None:
            raise ValueError(f"unexpected {c!r} at {self.at}")
        if word.end() == len(self.s) and self.depth:  # might go on
            self.at = len(self.s)
            self.magic = f'"{self.marker}'
            return json.dumps(self.marker), False
        if m is None or m.end() != word.end():
            raise ValueError(f"unexpected {word[0]!r} at {self.at}")
        self.at = m.end()
        return m[0], True

    depth = 0

    def string(self) -> tuple[str, bool]:
        start = self.at
        at = start + 1
        while at < len(self.s):
            if self.s[at] == "\\":
                if at + 1 >= len(self.s) or (self.s[at + 1] == "u" and not re.compile(r"[0-9a-fA-F]{4}").match(self.s, at + 2)):
                    break
                at += 6 if self.s[at + 1] == "u" else 2
            elif self.s[at] == '"':
                self.at = at + 1
                return json.dumps(json.loads(self.s[start : at + 1])), True
            else:
                at += 1
        body, rest = self.s[start + 1 : at], self.s[at:]
        self.at = len(self.s)
        if rest == "\\":
            self.magic = "\\" + self.marker
            return json.dumps(json.loads(f'"{body}"'))[:-1] + "\\\\" + self.marker + '"', False
        self.magic = self.marker
        return json.dumps(json.loads(f'"{body}"') + self.marker), False

    def array(self) -> tuple[str, bool]:
        self.at += 1
        self.depth += 1
        items, comma = [], False
        while True:
            self.blank()
            if self.at < len(self.s) and self.s[self.at] == "]" and not comma:
                self.at += 1
                self.depth -= 1
                return "[" + ",".join(items) + "]", True
            item, whole = self.value()
            items.append(item)
            if not whole:
                return "[" + ",".join(items) + "]", False
            self.blank()
            if self.at >= len(self.s):
                items.append(json.dumps(self.marker))
                self.magic = f',"{self.marker}'
                return "[" + ",".join(items) + "]", False
            if self.s[self.at] not in ",]":
                raise ValueError(f"unexpected {self.s[self.at]!r} at {self.at}")
            comma = self.s[self.at] == ","
            self.at += comma

    def object(self) -> tuple[str, bool]:
        self.at += 1
        self.depth += 1
        items, first = [], True
        done = lambda whole: ("{" + ",".join(items) + "}", whole)
        while True:
            self.blank()
            if self.at < len(self.s) and self.s[self.at] == "}" and first:
                self.at += 1
                self.depth -= 1
                return done(True)
            if self.at >= len(self.s):
                items.append(f"{json.dumps(self.marker)}:1")
                self.magic = f'"{self.marker}'
                return done(False)
            if self.s[self.at] != '"':
                raise ValueError(f"unexpected {self.s[self.at]!r} at {self.at}")
            key, whole = self.string()
            if not whole:
                items.append(f"{key}:1")
                return done(False)
            self.blank()
            if self.at >= len(self.s):
                items.append(f"{key}:{json.dumps(self.marker)}")
                self.magic = f':"{self.marker}'
                return done(False)
            if self.s[self.at] != ":":
                raise ValueError(f"unexpected {self.s[self.at]!r} at {self.at}")
            self.at += 1
            value, whole = self.value()
            items.append(f"{key}:{value}")
            if not whole:
                return done(False)
            self.blank()
            if self.at >= len(self.s):
                items.append(f"{json.dumps(self.marker)}:1")
                self.magic = f',"{self.marker}'
                return done(False)
            if self.s[self.at] == "}":
                self.at += 1
                self.depth -= 1
                return done(True)
            if self.s[self.at] != ",":
                raise ValueError(f"unexpected {self.s[self.at]!r} at {self.at}")
            self.at, first = self.at + 1, False


def healed(text: str, marker: str = "$foo") -> tuple[str, str]:
    """A JSON text that may end early as whole JSON with the marker where it was cut, and the marker as it stands there. Raises ValueError where it is no JSON."""
    reader = _Reader(text, marker)
    out, whole = reader.value()
    reader.blank()
    if whole and reader.at < len(text):
        raise ValueError(f"trailing characters at {reader.at}")
    return out, reader.magic


def heal_json(c, marker: str = "$foo") -> Column:
    """G3 as a column: struct(json, marker); both null where the text is no beginning of JSON."""

    @F.pandas_udf("json string, marker string")
    def run(s: pd.Series) -> pd.DataFrame:
        def one(x):
            try:
                return healed(x, marker) if x else (None, None)
            except ValueError:
                return (None, None)

        return pd.DataFrame([one(x) for x in s], columns=["json", "marker"])

    return run(c)


# Schemas and grammars ---------------------------------------------------------------------------------------------

#: Formats as patterns. Fixed values.
FORMATS = {
    "date": r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[1-2]\d|3[0-1])", "time": r"([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{3})?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)",
    "date-time": r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[1-2]\d|3[0-1])T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{3})?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)", "uuid": r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
}


def has_format(c, name: str) -> Column:
    return F.rlike(c, F.lit(f"^{FORMATS[name]}$"))


def schema_to_pattern(schema: dict, root: dict | None = None, depth: int = 6) -> str:
    """A JSON schema as a regular expression over JSON text without optional white space but one blank.

    Types, enum, const, $ref (down to `depth` when recursive), anyOf, oneOf, formats, string and array lengths, integer ranges by sign, required and
    optional properties in their order. What a regular expression can't say (other ranges) is left to a check of the value."""
    root = root or schema
    space = r"\s?"
    if "$ref" in schema:
        if depth <= 0:
            return r"(?!)"
        at = root
        for part in filter(None, schema["$ref"].lstrip("#/").split("/")):
            at = at[part]
        return schema_to_pattern(at, root, depth - 1)
    if "const" in schema:
        return re.escape(json.dumps(schema["const"]))
    if "enum" in schema:
        return "(?:" + "|".join(re.escape(json.dumps(v)) for v in schema["enum"]) + ")"
    for key in ("anyOf", "oneOf"):
        if key in schema:
            return "(?:" + "|".join(schema_to_pattern(s, root, depth) for s in schema[key]) + ")"
    kind = schema.get("type")
    if isinstance(kind, list):
        return "(?:" + "|".join(schema_to_pattern({**schema, "type": k}, root, depth) for k in kind) + ")"
    if kind == "string":
        if schema.get("format") in FORMATS:
            return f'"{FORMATS[schema["format"]]}"'
        if "pattern" in schema:
            return '"' + schema["pattern"].removeprefix("^").removesuffix("$") + '"'
        return r'"(?:[^"\\\x00-\x1f]|\\(?:["\\bfnrt/]|u[0-9a-fA-F]{4}))' + "{%s,%s}" % (schema.get("minLength", 0), schema.get("maxLength", "")) + '"'
    if kind == "integer":
        return ("" if schema.get("minimum", -1) >= 0 else "-?") + r"(?:0|[1-9]\d{0,15})"
    if kind == "number":
        return r"-?(?:0|[1-9]\d{0,15})(?:\.\d{1,16})?(?:[eE][-+]?\d{1,16})?"
    if kind == "boolean":
        return "(?:true|false)"
    if kind == "null":
        return "null"
    if kind == "array":
        if depth <= 0:
            return r"\[\s?\]"
        item = schema_to_pattern(schema.get("items", {}), root, depth - 1)
        lo, hi = schema.get("minItems", 0), schema.get("maxItems")
        some = f"{item}(?:{space},{space}{item}){{{max(0, lo - 1)},{'' if hi is None else max(0, hi - 1)}}}"
        return rf"\[{space}" + (f"(?:{some})?" if lo == 0 else some) + rf"{space}\]" if hi != 0 else rf"\[{space}\]"
    if kind == "object" or "properties" in schema:
        props, required = schema.get("properties", {}), set(schema.get("required", []))
        pairs = {k: rf"{re.escape(json.dumps(k))}{space}:{space}{schema_to_pattern(v, root, depth - 1)}" for k, v in props.items()}
        need, may = [pairs[k] for k in props if k in required], [pairs[k] for k in props if k not in required]
        body = f"{space},{space}".join(need)
        for i, p in enumerate(may):
            body += f"(?:{space},{space}{p})?" if need else ""
            if not need and i == 0:
                tails = ["".join([p2, *(f"(?:{space},{space}{q})?" for q in may[j + 1 :])]) for j, p2 in enumerate(may)]
                body = f"(?:{'|'.join(tails)})?"
        return rf"\{{{space}{body}{space}\}}"
    if depth <= 0:
        return r"(?:true|false|null|-?\d+)"
    return "(?:" + "|".join(schema_to_pattern({"type": k}, root, 0) for k in ("string", "number", "boolean", "null")) + ")"


def matches_schema(c, schema: dict) -> Column:
    """Whether a text is JSON of a schema, by its pattern in the JVM."""
    return F.coalesce(F.rlike(c, F.lit("^" + schema_to_pattern(schema) + "$")), F.lit(False))


class Grammar:
    """Rules `name ::= alternatives` with strings, [classes], (groups), | and * + ? {m,n}; root is where a match starts."""

    def __init__(self, text: str):
        self.rules: dict[str, object] = {}
        joined = re.sub(r"#[^\n]*", "", text)
        for m in re.finditer(r"([\w-]+)\s*::=\s*((?:(?![\w-]+\s*::=).)*)", joined, re.S):
            self.tokens = re.findall(r'"(?:[^"\\]|\\.)*"|\[(?:[^\]\\]|\\.)*\]|[\w-]+|\{\d+(?:,\d*)?\}|[()|*+?.]', m[2])
            self.rules[m[1]] = self._either()
        if "root" not in self.rules:
            raise ValueError("no rule named root")
        missing = {n for r in self.rules.values() for n in self._names(r)} - set(self.rules)
        if missing:
            raise ValueError(f"no such rules: {sorted(missing)}")

    def _names(self, node):
        if node[0] == "rule":
            yield node[1]
        elif node[0] in ("seq", "alt"):
            for x in node[1]:
                yield from self._names(x)
        elif node[0] == "times":
            yield from self._names(node[1])

    def _either(self):
        options = [self._row()]
        while self.tokens and self.tokens[0] == "|":
            self.tokens.pop(0)
            options.append(self._row())
        return options[0] if len(options) == 1 else ("alt", options)

    def _row(self):
        items = []
        while self.tokens and self.tokens[0] not in "|)":
            t = self.tokens.pop(0)
            if t == "(":
                item = self._either()
                self.tokens.pop(0)
            elif t[0] == '"':
                item = ("text", t[1:-1].encode().decode("unicode_escape") if "\\" in t else t[1:-1])
            elif t[0] == "[":
                item = ("class", re.compile(t, re.S))
            elif t == ".":
                item = ("class", re.compile(".", re.S))
            else:
                item = ("rule", t)
            while self.tokens and (self.tokens[0] in "*+?" or self.tokens[0][0] == "{"):
                q = self.tokens.pop(0)
                lo, hi = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(q) or self._range(q)
                item = ("times", item, lo, hi)
            items.append(item)
        return ("seq", items)

    @staticmethod
    def _range(q):
        a, comma, b = q[1:-1].partition(",")
        return int(a), (int(b) if b else None) if comma else int(a)

    def _ends(self, node, text: str, starts: frozenset, seen: frozenset) -> frozenset:
        """All places where a match that starts at one of starts can end; len(text) + 1 stands for: the text may go on."""
        more = len(text) + 1
        kind = node[0]
        go, open_ = frozenset(x for x in starts if x < more), frozenset({more} & starts)
        if kind == "text":
            out = set(open_)
            for s in go:
                w = node[1]
                if text.startswith(w, s):
                    out.add(s + len(w))
                elif w.startswith(text[s:]):
                    out.add(more)
            return frozenset(out)
        if kind == "class":
            return frozenset(s + 1 if s < len(text) else more for s in go if s >= len(text) or node[1].match(text[s])) | open_
        if kind == "seq":
            now = starts
            for x in node[1]:
                now = self._ends(x, text, now, seen)
            return now
        if kind == "alt":
            return frozenset().union(*(self._ends(x, text, starts, seen) for x in node[1]))
        if kind == "times":
            _, x, lo, hi = node
            now = starts
            for _ in range(lo):
                now = self._ends(x, text, now, seen)
            out, k = now, lo
            while now and (hi is None or k < hi):
                now = self._ends(x, text, now - {more}, seen) - out
                out, k = out | now, k + 1
            return out
        key = (node[1], go)
        if key in seen:  # left recursion adds nothing
            return open_
        return self._ends(self.rules[node[1]], text, go, seen | {key}) | open_ if go else open_

    def accepts(self, text: str) -> bool:
        return len(text) in self._ends(("rule", "root"), text, frozenset({0}), frozenset())

    def may_go_on(self, text: str) -> bool:
        """Whether text is accepted, or the beginning of something that is."""
        ends = self._ends(("rule", "root"), text, frozenset({0}), frozenset())
        return len(text) in ends or len(text) + 1 in ends


def _cached(text: str, memo: dict = {}):  # noqa: B006
    if text not in memo:
        memo[text] = Grammar(text)
    return memo[text]


def matches_grammar(c, grammar: str, prefix: bool = False) -> Column:
    """Whether a text is in a grammar's language, or with prefix, may begin something that is."""
    Grammar(grammar)

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        g = _cached(grammar)
        return s.map(lambda x: None if x is None else (g.may_go_on(x) if prefix else g.accepts(x)))

    return run(c)


# Tool calls, dialects, mixed prompts -----------------------------------------------------------------------------


def tool_calls(c, tag: str = "tool_call") -> Column:
    """The (name, arguments) of calls written as JSON between tags; what doesn't parse has a null name."""
    inner = F.regexp_extract_all(c, F.lit(rf"(?s)<{tag}>\s*(.*?)\s*</{tag}>"), F.lit(1))
    return F.transform(inner, lambda x: F.struct(F.get_json_object(x, "$.name").alias("name"), F.get_json_object(x, "$.arguments").alias("arguments")))


def first_logprob(c) -> Column:
    """(token, logprob) of the first token in either dialect of an answer."""
    get = lambda p: F.get_json_object(c, p)
    a = "$.choices[0].logprobs."
    return F.struct(F.coalesce(get(a + "content[0].top_logprobs[0].token"), get(a + "tokens[0]")).alias("token"), F.coalesce(get(a + "content[0].top_logprobs[0].logprob"), get(a + "token_logprobs[0]")).cast("double").alias("logprob"))


def is_number_array(c) -> Column:
    """A JSON array of whole numbers only, at least one."""
    return F.coalesce(F.rlike(c, F.lit(r"^\s*\[\s*-?\d+(\s*,\s*-?\d+)*\s*\]\s*$")), F.lit(False))


def mixed_prompt(c) -> Column:
    """A JSON array of strings and ids as parts, each with one of text and id."""
    parts = F.from_json(c, T.ArrayType(T.StringType()))
    return F.transform(parts, lambda x: F.struct(F.when(~F.rlike(x, F.lit(r"^-?\d+$")), x).alias("text"), F.when(F.rlike(x, F.lit(r"^-?\d+$")), x.cast("bigint")).alias("id")))


def partial_match(c, pattern: str) -> Column:
    """struct(kind, start, end): kind full, partial (some beginning of the pattern stands at the text's end) or null."""

    @F.pandas_udf("kind string, start long, end long")
    def run(s: pd.Series) -> pd.DataFrame:
        import regex

        find = regex.compile(pattern).search

        def one(x):
            m = find(x, partial=True) if x is not None else None
            return (None, None, None) if m is None or (m.partial and m.start() == len(x)) else ("partial" if m.partial else "full", m.start(), m.end())

        return pd.DataFrame([one(x) for x in s], columns=["kind", "start", "end"]).astype({"start": "Int64", "end": "Int64"})

    return run(c)


#: Pre-token patterns by name, as Java reads them. Fixed values. "threes" takes digits in groups of up to three, "digits" one by one.
PRETOKENS = {
    "gpt2": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "threes": r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+",
    "digits": r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+",
    "newlines": r"[^\n]+|[\n]+",
}


def pretokens(c, name: str = "digits") -> Column:
    """Z1; what no alternative takes stays as pieces of its own, so the pieces always make up the text again."""
    return F.regexp_extract_all(c, F.lit(f"(?U){PRETOKENS[name]}|(?s:.)"), F.lit(0))


def split_again(pieces, pattern: str) -> Column:
    """Each piece split by a further pattern."""
    return F.flatten(F.transform(pieces, lambda p: F.regexp_extract_all(p, F.lit(f"{pattern}|(?s:.)"), F.lit(0))))


def byte_letters(c) -> Column:
    """A text's bytes as the letters byte-level vocabularies use: printable bytes as they are, others from U+0100 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    letters = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}
    source = "".join(map(chr, range(256)))
    target = "".join(letters[b] for b in range(256))
    return F.translate(F.decode(F.encode(c, "UTF-8"), "ISO-8859-1"), source[1:], target[1:])
