import re

import pytest

from tessera.functions import structured as G

# Text, healed JSON, marker. Fixed values.
HEALED = [
    ('[{"a":"b"}, "y"]', '[{"a":"b"},"y"]', ""), ("[1", '["$foo"]', '"$foo'), ("[tru", '["$foo"]', '"$foo'), ("[23.2", '["$foo"]', '"$foo'), ('{"a": 1', '{"a":"$foo"}', '"$foo'), ('{"a": nul', '{"a":"$foo"}', '"$foo'), ("{", '{"$foo":1}', '"$foo'),
    ("[", '["$foo"]', '"$foo'), ("1 ", "1", ""), ("true", "true", ""), ("[1 ", '[1,"$foo"]', ',"$foo'), ("[{}", '[{},"$foo"]', ',"$foo'), ("[true ", '[true,"$foo"]', ',"$foo'), ("[true,", '[true,"$foo"]', '"$foo'), ('[{"a": [{"b": [{', '[{"a":[{"b":[{"$foo":1}]}]}]', '"$foo'),
    ('[{"a": "b"}, ', '[{"a":"b"},"$foo"]', '"$foo'), ('{ "code', '{"code$foo":1}', "$foo"), ('{ "code\\', '{"code\\\\$foo":1}', "\\$foo"), ('{ "code"', '{"code":"$foo"}', ':"$foo'),
]


@pytest.mark.parametrize(("text", "whole", "marker"), HEALED)
def test_healing(text, whole, marker):
    assert G.healed(text) == (whole, marker)


def test_every_prefix_heals_to_json():
    import json

    for text in ('{"a": "b"}', '{"hey": 1, "ho\\"ha": [1]}', '[{"a": "b", "c": [null, {"d": "\\u00e9"}]}]'):
        for i in range(1, len(text) + 1):
            json.loads(G.healed(text[:i])[0])
    for bad in ("}", "[1}", "{1", '{"a" 1}', "[1] x"):
        with pytest.raises(ValueError):
            G.healed(bad)


def test_schema_patterns():
    schema = {"type": "object", "properties": {"name": {"type": "string", "minLength": 1}, "age": {"type": "integer", "minimum": 0}, "tags": {"type": "array", "items": {"enum": ["a", "b"]}, "minItems": 1, "maxItems": 2}, "next": {"anyOf": [{"type": "null"}, {"$ref": "#"}]}}, "required": ["name", "age"]}
    ok = re.compile(G.schema_to_pattern(schema)).fullmatch
    for good in ('{"name":"x","age":3}', '{"name": "x", "age": 0, "tags": ["a"]}', '{"name":"x","age":1,"next":{"name":"y","age":2}}', '{"name":"x","age":1,"tags":["a","b"],"next":null}'):
        assert ok(good), good
    for bad in ('{"name":"","age":3}', '{"age":3}', '{"name":"x","age":-1}', '{"name":"x","age":1,"tags":[]}', '{"name":"x","age":1,"tags":["c"]}', '{"name":"x","age":1,}'):
        assert not ok(bad), bad
    optional = re.compile(G.schema_to_pattern({"type": "object", "properties": {"a": {"type": "boolean"}, "b": {"type": "null"}}})).fullmatch
    assert all(optional(s) for s in ("{}", '{"a":true}', '{"b":null}', '{"a":false,"b":null}')) and not optional('{"b":null,"a":true}')


def test_grammar():
    g = G.Grammar('root ::= expr  # a sum\nexpr ::= term ("+" term)*\nterm ::= [0-9]{1,3} | "(" expr ")"')
    assert g.accepts("1+(22+333)") and not g.accepts("1+") and not g.accepts("1234") and not g.accepts("")
    assert g.may_go_on("1+") and g.may_go_on("(1") and not g.may_go_on("1+)") and g.may_go_on("")
    assert G.Grammar('root ::= [^\\n]+ "\\n"?').accepts("é x\n")
    with pytest.raises(ValueError):
        G.Grammar("root ::= other")
    with pytest.raises(ValueError):
        G.Grammar('start ::= "x"')


def test_byte_letters(spark):
    got = spark.createDataFrame([("a b\né",)], "s string").select(G.byte_letters("s").alias("b")).first().b
    assert got == "aĠbĊÃ©"


def test_pretokens(spark):
    rows = spark.createDataFrame([("I'll go  to 12345!\n\n é漢字 x",)], "s string")
    get = lambda n: rows.select(G.pretokens("s", n).alias("p")).first().p
    assert get("gpt2")[:6] == ["I", "'ll", " go", " ", " to", " 12345"]
    assert get("threes")[5:9] == [" ", "123", "45", "!\n\n"]
    assert get("digits")[5:11] == [" ", "1", "2", "3", "4", "5"]
    for n in G.PRETOKENS:
        assert "".join(get(n)) == "I'll go  to 12345!\n\n é漢字 x"


def test_pretty_json(spark):
    cases = {
        '{"b": [1, 2.50, {"x": null}], "a": {}, "2": [], "1": true}': '{\n  "1": true,\n  "2": [],\n  "b": [\n    1,\n    2.5,\n    {\n      "x": null\n    }\n  ],\n  "a": {}\n}',
        "[1e21, 1e-7, 12345678901234567890, 0.00001, -0, 1e999, 1.5e300]": "[\n  1e+21,\n  1e-7,\n  12345678901234567000,\n  0.00001,\n  0,\n  null,\n  1.5e+300\n]",
        '"\\u00e9\\ud800\\n"': '"é\\ud800\\n"',
        "[NaN]": "[NaN]", "no json": "no json", "": "", "[" * 100_000: "[" * 100_000, "  7 ": "7",
    }
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "s string").select("s", G.pretty_json("s").alias("p"))
    got = {r.s: r.p for r in df.collect()}
    assert got == {**cases, None: None}
