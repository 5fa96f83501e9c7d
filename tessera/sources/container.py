"""Tensor containers: a header, typed key-value pairs, tensor descriptions and their bytes; and safetensors headers."""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"GGUF"
#: Value kinds by number: name and struct code. Fixed values.
KINDS = ["uint8", "int8", "uint16", "int16", "uint32", "int32", "float32", "bool", "string", "array", "uint64", "int64", "float64"]
CODES = {"uint8": "B", "int8": "b", "uint16": "H", "int16": "h", "uint32": "I", "int32": "i", "float32": "f", "bool": "?", "uint64": "Q", "int64": "q", "float64": "d"}
#: Tensor kinds by number: name, values in a block, bytes of a block. Fixed values.
TENSORS = {0: ("F32", 1, 4), 1: ("F16", 1, 2), 2: ("Q4_0", 32, 18), 3: ("Q4_1", 32, 20), 6: ("Q5_0", 32, 22), 7: ("Q5_1", 32, 24), 8: ("Q8_0", 32, 34), 24: ("I8", 1, 1), 25: ("I16", 1, 2), 26: ("I32", 1, 4), 27: ("I64", 1, 8), 28: ("F64", 1, 8), 30: ("BF16", 1, 2), 34: ("TQ1_0", 256, 54), 35: ("TQ2_0", 256, 66), 39: ("MXFP4", 32, 17)}
NUMBERS = {name: k for k, (name, _, _) in TENSORS.items()}


class ContainerError(ValueError):
    pass


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at, self.order = data, 0, "<"

    def take(self, code: str):
        size = struct.calcsize(code)
        if self.at + size > len(self.data):
            raise ContainerError(f"cut off at byte {self.at}")
        (value,) = struct.unpack_from(self.order + code, self.data, self.at)
        self.at += size
        return value

    def string(self) -> str:
        n = self.take("Q")
        if self.at + n > len(self.data):
            raise ContainerError(f"cut off at byte {self.at}")
        self.at += n
        return self.data[self.at - n : self.at].decode("utf-8", "replace")

    def value(self, kind: str):
        if kind == "string":
            return self.string()
        if kind == "array":
            own = self._kind()
            return [self.value(own) for _ in range(self.take("Q"))]
        return self.take(CODES[kind])

    def _kind(self) -> str:
        k = self.take("I")
        if k >= len(KINDS):
            raise ContainerError(f"value kind {k} at byte {self.at}")
        return KINDS[k]


def parse(data: bytes) -> tuple[list[tuple], list[tuple]]:
    """(pairs, tensors): (key, kind, value as JSON) and (name, dtype, shape, offset in the file, bytes). Versions 2 and 3, both byte orders."""
    c = _Cursor(data)
    if data[:4] != MAGIC:
        raise ContainerError("not a tensor container")
    c.at = 4
    version = c.take("I")
    if version & 0xFFFF == 0:
        c.order, c.at = ">", 4
        version = c.take("I")
    if version not in (2, 3):
        raise ContainerError(f"version {version}")
    n_tensors, n_pairs = c.take("Q"), c.take("Q")
    pairs, align = [], 32
    for _ in range(n_pairs):
        key = c.string()
        kind = c._kind()
        value = c.value(kind)
        if key == "general.alignment":
            align = value
        pairs.append((key, kind, json.dumps(value)))
    tensors = []
    for _ in range(n_tensors):
        name = c.string()
        shape = [c.take("Q") for _ in range(c.take("I"))]
        number, offset = c.take("I"), c.take("Q")
        if number not in TENSORS:
            raise ContainerError(f"tensor kind {number} of {name}")
        dtype, block, size = TENSORS[number]
        tensors.append((name, dtype, shape, offset, int(np.prod(shape, dtype=np.int64)) // block * size))
    start = -(-c.at // align) * align
    return pairs, [(n, d, s, start + o, b) for n, d, s, o, b in tensors]


def write(pairs: list[tuple], tensors: list[tuple], align: int = 32, order: str = "<") -> bytes:
    """Pairs (key, kind, value), arrays as (key, "array", (kind, values)); tensors (name, dtype, shape, bytes)."""
    pack = lambda code, v: struct.pack(order + code, v)
    text = lambda s: pack("Q", len(s.encode())) + s.encode()

    def value(kind, v):
        if kind == "string":
            return text(v)
        if kind == "array":
            own, items = v
            return pack("I", KINDS.index(own)) + pack("Q", len(items)) + b"".join(value(own, x) for x in items)
        return pack(CODES[kind], v)

    if align != 32:
        pairs = [*pairs, ("general.alignment", "uint32", align)]
    head = MAGIC + pack("I", 3) + pack("Q", len(tensors)) + pack("Q", len(pairs))
    head += b"".join(text(k) + pack("I", KINDS.index(t)) + value(t, v) for k, t, v in pairs)
    blob = b""
    for name, dtype, shape, raw in tensors:
        head += text(name) + pack("I", len(shape)) + b"".join(pack("Q", d) for d in shape) + pack("I", NUMBERS[dtype]) + pack("Q", len(blob))
        blob += raw + b"\0" * (-len(raw) % align)
    return head + b"\0" * (-len(head) % align) + blob


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pairs, tensors) of all containers under a path, one row per pair and per tensor; files are read by Spark's binary source."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return pairs_of(files), tensors_of(files)


def pairs_of(files: DataFrame) -> DataFrame:
    def op(batches):
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = parse(data)[0]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), *(pa.array(x, pa.string()) for x in zip(*rows, strict=True))], ["path", "key", "kind", "value"])

    return files.mapInArrow(op, "path string, key string, kind string, value string")


def tensors_of(files: DataFrame, content: bool = False) -> DataFrame:
    """content: also the tensors' bytes."""

    def op(batches):
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = parse(data)[1]
                if not rows:
                    continue
                name, dtype, shape, offset, size = zip(*rows, strict=True)
                cols = [pa.array([path] * len(rows)), pa.array(name), pa.array(dtype), pa.array(shape, pa.list_(pa.int64())), pa.array(offset, pa.int64()), pa.array(size, pa.int64())]
                if content:
                    cols.append(pa.array([data[o : o + s] for o, s in zip(offset, size, strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, ["path", "name", "dtype", "shape", "offset", "n_bytes", *["content"] * content])

    return files.mapInArrow(op, "path string, name string, dtype string, shape array<long>, offset long, n_bytes long" + ", content binary" * content)


def tensor_hashes(files: DataFrame, skip_suffix: tuple[str, ...] = ()) -> DataFrame:
    """SHA-1 and SHA-256 of each tensor, and of all of a file's tensors in their order (name null)."""
    each = tensors_of(files, content=True)
    for s in skip_suffix:
        each = each.where(~F.col("name").endswith(s))
    rows = each.select("path", "name", F.sha1("content").alias("sha1"), F.sha2("content", 256).alias("sha256"), "offset")
    whole = each.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("offset", "content"))), lambda x: F.hex(x["content"])).alias("parts")).select("path", F.unhex(F.array_join("parts", "")).alias("content"))
    return rows.drop("offset").unionByName(whole.select("path", F.lit(None).cast("string").alias("name"), F.sha1("content").alias("sha1"), F.sha2("content", 256).alias("sha256")))


def safetensors(files: DataFrame) -> DataFrame:
    """(path, name, dtype, shape, offset, n_bytes) by the headers of safetensors files(path, content)."""

    def op(batches):
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                (n,) = struct.unpack_from("<Q", data)
                rows = [(k, v["dtype"], v["shape"], 8 + n + v["data_offsets"][0], v["data_offsets"][1] - v["data_offsets"][0]) for k, v in json.loads(data[8 : 8 + n]).items() if k != "__metadata__"]
                if rows:
                    name, dtype, shape, offset, size = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(name), pa.array(dtype), pa.array(shape, pa.list_(pa.int64())), pa.array(offset, pa.int64()), pa.array(size, pa.int64())], ["path", "name", "dtype", "shape", "offset", "n_bytes"])

    return files.mapInArrow(op, "path string, name string, dtype string, shape array<long>, offset long, n_bytes long")
