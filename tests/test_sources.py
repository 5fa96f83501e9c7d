import sqlite3
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import types as T

from tessera.functions import audio as A
from tessera.functions import codecs as Q
from tessera.sources import container as K
from tessera.sources import readers as S
from tessera.sources import writers as W

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])


def test_sqlite_and_sniffing(spark, tmp_path):
    with sqlite3.connect(tmp_path / "x.db") as con:
        con.execute("CREATE TABLE bench (a INTEGER, b TEXT, c REAL)")
        con.executemany("INSERT INTO bench VALUES (?, ?, ?)", [(i, f"t{i}", i / 2) for i in range(100)])
    df = S.sqlite(spark, str(tmp_path / "x.db"), "bench", 3)
    assert df.dtypes == [("a", "bigint"), ("b", "string"), ("c", "double")] and df.count() == 100
    assert S.sqlite_tables(str(tmp_path / "x.db")) == ["bench"]
    sqlite3.connect(tmp_path / "empty.db").close()
    (tmp_path / "x.json").write_text('[{"a": 1, "b": "x", "z": 0}, {"a": 2}]')
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "x"}\n{"a": 2, "b": null}\n')
    (tmp_path / "x.csv").write_text('﻿a,b\n1,"say ""hi"""\nx,y\n')
    for name, kind, n in (("x.db", "sqlite", 100), ("x.json", "json", 2), ("x.jsonl", "jsonl", 2), ("x.csv", "csv", 2)):
        assert S.sniff(str(tmp_path / name)) == kind
        got = S.load_any(spark, str(tmp_path / name), SCHEMA)
        assert got.count() == n and got.columns == ["a", "b"]
    rows = S.load_any(spark, str(tmp_path / "x.csv"), SCHEMA).collect()
    assert [tuple(r) for r in rows] == [(1, 'say "hi"'), (None, "y")]
    with pytest.raises(S.SchemaError):
        S.csv(spark, str(tmp_path / "x.csv"), None, ["missing"])
    with pytest.raises(Exception, match="required"):
        S.json_lines(spark, str(tmp_path / "x.jsonl"), SCHEMA, ["b"]).collect()


def test_tolerant_lines(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"a": 1}\nnot json\n\n{"a": 2, "b": "x"}\n')
    assert sorted(r.a for r in S.tolerant_json_lines(spark, str(tmp_path / "t.jsonl"), SCHEMA).collect()) == [1, 2]
    (tmp_path / "bad.jsonl").write_text("nope\n")
    with pytest.raises(S.SchemaError):
        S.tolerant_json_lines(spark, str(tmp_path / "bad.jsonl"), SCHEMA)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("align", [32, 64])
def test_container_round_trip(order, align):
    values = {"uint8": 200, "int8": -3, "uint16": 60_000, "int16": -5, "uint32": 4_000_000_000, "int32": -7, "float32": 0.5, "bool": True, "string": "é x", "uint64": 2**63, "int64": -(2**62), "float64": 0.1}
    pairs = [(f"k.{k}", k, v) for k, v in values.items()] + [("list", "array", ("string", ["a", "bc"]))]
    raw = np.arange(64, dtype="<f4").tobytes()
    data = K.write(pairs, [("blk.0.w", "F32", [8, 8], raw), ("t", "Q8_0", [32], b"\1" * 34)], align, order)
    got, tensors = K.parse(data)
    import json

    assert {k: json.loads(v) for k, _, v in got if k != "general.alignment"} == {f"k.{k}": v for k, v in values.items()} | {"list": ["a", "bc"]}
    assert [(t[0], t[1], t[2], t[4]) for t in tensors] == [("blk.0.w", "F32", [8, 8], 256), ("t", "Q8_0", [32], 34)]
    assert data[tensors[0][3] : tensors[0][3] + 256] == raw and tensors[1][3] % align == 0
    assert K.parse(K.write([], [])) == ([], [])
    for bad in (b"nope", data[:40], K.MAGIC + struct.pack("<I", 9)):
        with pytest.raises(K.ContainerError):
            K.parse(bad)


def test_container_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.bin").write_bytes(K.write([("n", "int32", i)], [("blk.0.a", "F32", [4], bytes([i] * 16)), ("blk.0.b", "F32", [2], b"x" * 8)]))
    pairs, tensors = K.read(spark, str(tmp_path))
    assert sorted(r.value for r in pairs.collect()) == ["0", "1", "2"] and tensors.count() == 6
    import hashlib

    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    hashes = K.tensor_hashes(files, (".b",)).where("path like '%/1.bin'").collect()
    assert {(r.name, r.sha1) for r in hashes} == {("blk.0.a", hashlib.sha1(bytes([1] * 16)).hexdigest()), (None, hashlib.sha1(bytes([1] * 16)).hexdigest())}


def test_safetensors(spark):
    import json

    head = json.dumps({"w": {"dtype": "F32", "shape": [2], "data_offsets": [0, 8]}, "__metadata__": {"x": "y"}}).encode()
    files = spark.createDataFrame([("f", struct.pack("<Q", len(head)) + head + b"\0" * 8)], "path string, content binary")
    assert [tuple(r) for r in K.safetensors(files).collect()] == [("f", "w", "F32", [2], 8 + len(head), 8)]


# Largest root-mean-square error over values 0.1 + 2 cos(i), per kind. Fixed values.
@pytest.mark.parametrize(("kind", "most"), [("q8_0", 0.002), ("q5_1", 0.02), ("q5_0", 0.03), ("q4_1", 0.04), ("q4_0", 0.06), ("mxfp4", 0.12), ("bf16", 0.005), ("f16", 0.001)])
def test_codec_errors(kind, most):
    x = (0.1 + 2 * np.cos(np.arange(4096))).astype(np.float32).reshape(-1, 32)
    assert np.sqrt(np.mean((Q.decode(kind, Q.encode(kind, x), 32) - x) ** 2)) / np.sqrt(np.mean(x**2)) < most * 2
    zero = np.zeros((2, 32), np.float32)
    assert (Q.decode(kind, Q.encode(kind, zero), 32) == 0).all()
    spike = zero.copy()
    spike[0, 5] = -3
    assert Q.decode(kind, Q.encode(kind, spike), 32)[0, 5] == pytest.approx(-3, rel=0.04)


@pytest.mark.parametrize("kind", ["tq1_0", "tq2_0"])
def test_ternary_is_exact(kind):
    x = np.random.default_rng(1).integers(-1, 2, (20, 256)).astype(np.float32) * 0.25
    assert (Q.decode(kind, Q.encode(kind, x), 256) == x).all()


def test_audio(spark, tmp_path):
    rate, n = 8000, 8000
    tone = (np.sin(2 * np.pi * 440 * np.arange(n) / rate) * 20_000).astype("<i2")
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.repeat(tone, 2).tobytes())
    row = S.wav_files(spark, str(tmp_path), 16_000).first()
    assert row.seconds == 1.0 and len(row.samples) == 16_000 and max(row.samples) == pytest.approx(20_000 / 32_768, rel=0.01)
    clips = spark.createDataFrame([(1, [float(v) for v in row.samples]), (2, [0.0] * 800), (3, [1.0] + [0.0] * 799), (4, [0.5])], "clip_id long, samples array<double>")
    mel = A.log_mel(clips, 40, 400, 160, 16_000)
    frames = {r.clip_id: [] for r in mel.select("clip_id").distinct().collect()}
    for r in mel.orderBy("frame").collect():
        frames[r.clip_id].append(r.mel)
    assert len(frames[1]) == 98 and 4 not in frames and {v for f in frames[2] for v in f} == {np.log10(5.960464477539063e-08)}
    peak = int(np.argmax(frames[1][10]))
    filters = A.mel_filters(40, 400, 16_000)
    assert filters[peak, round(440 / 40)] > 0
    assert A.clamped(mel.where("clip_id = 1")).count() == 98


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "x long, y string")
    text = W.aligned(df, ["x"]).first().text.split("\n")
    assert text == ["| x | y   |", "| - | --- |", "| 1 | a,b |", "| 2 |     |"]
    assert [r.sql for r in W.insert_statements(df, "t").orderBy("sql").collect()][1] == "INSERT INTO t (x, y) VALUES ('2', NULL);"
    W.append(df, f"{tmp_path}/t")
    W.append(df, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 4
    for _ in range(2):
        W.create_table(spark, "tessera_made", "x bigint, y string")
    assert spark.table("tessera_made").count() == 0
    spark.sql("DROP TABLE tessera_made")
    for kind in ("csv", "jsonl", "sql", "md"):
        W.bench_output(df, f"{tmp_path}/{kind}", kind)
    with pytest.raises(ValueError):
        W.bench_output(df, f"{tmp_path}/x", "xml")


def test_open_blocks_and_series(spark, tmp_path):
    rows = [("a.cpp:1", 0, "Function: f"), ("a.cpp:1", 1, "VGPRs: 5"), ("b.cpp:9", 2, "VGPRs: 7"), ("a.cpp:1", 3, "Function: g"), ("a.cpp:1", 4, "VGPRs: 9")]
    df = spark.createDataFrame(rows, "loc string, n long, value string")
    got = S.open_blocks(df, r"^Function: (\w+)", r"^(\w+): (\d+)", ["loc"], "n").select("block", "content").collect()
    assert sorted(map(tuple, got)) == [("f", "5"), ("g", "9")]


def test_sheets(spark):
    from tessera.sources import readers as S
    from tessera.sources import writers as W

    df = spark.createDataFrame([("g", 2, "a<b & \"c\"\n\x01", True), ("g", 1, None, None), ("h", 1, "é漢", False)], "k string, i long, t string, mark boolean")
    files = W.sheets(df, ["k"], ["i"], "mark")
    got = sorted(tuple(r) for r in S.sheet_rows(files, ["k", "i", "t"]).collect())
    assert got == [("g", "1", "", False), ("g", "2", 'a<b & "c"\n\ufffd', True), ("h", "1", "é漢", False)]
    assert W.sheets(df.limit(0), ["k"], ["i"], "mark").count() == 0
