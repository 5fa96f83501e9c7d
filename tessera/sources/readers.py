"""Readers with explicit schemas: JSON lines, arrays, CSV, logs, INI, SQLite, WAV, metric series."""

from __future__ import annotations

import glob
import io
import os
import wave
from contextlib import closing

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class SchemaError(ValueError):
    pass


def _required(df: DataFrame, required: list[str], have: set[str]) -> DataFrame:
    missing = [c for c in required if c not in have]
    if missing:
        raise SchemaError(f"missing columns: {missing}")
    return df


def json_lines(spark: SparkSession, path, schema: T.StructType, required: list[str] = ()) -> DataFrame:
    """One object per line; keys outside the schema are dropped; a row without a required value is an error when it is read."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    for c in _required(df, list(required), set(schema.names)).columns:
        if c in required:
            df = df.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is required")).cast(schema[c].dataType)))
    return df


def json_arrays(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """Files that each hold one array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(paths)


def csv(spark: SparkSession, path, schema: T.StructType | None = None, required: list[str] = (), not_empty: bool = False, line_breaks: bool = False) -> DataFrame:
    """With a header, a byte order mark or not; all strings unless a schema names kinds, which are tried, not forced.

    line_breaks: quoted cells may hold line breaks; such files can't be split, so it is off unless asked for."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", line_breaks).option("escape", '"').csv(path)
    df = df.withColumnsRenamed({c: c.lstrip("\ufeff") for c in df.columns})
    _required(df, list(required), set(df.columns))
    if not_empty and df.isEmpty():
        raise SchemaError(f"no rows in {path}")
    if schema is not None:
        df = df.select(*((F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))
    return df


def tolerant_json_lines(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """Lines that don't parse are skipped; no good line at all is an error."""
    bad = "_corrupt"
    text = spark.read.text(path).where("trim(value) <> ''")
    rows = text.select(F.from_json("value", T.StructType([*schema.fields, T.StructField(bad, T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).alias("r")).select("r.*")
    good = rows.where(F.col(bad).isNull()).drop(bad)
    if good.isEmpty():
        raise SchemaError(f"no good line in {path}")
    return good


def log_lines(spark: SparkSession, path, pattern: str, columns: dict[str, str]) -> DataFrame:
    """Lines that match, their groups as columns (name -> kind) in order; an empty group is null."""
    lines = spark.read.option("encoding", "UTF-8").text(path).where(F.rlike("value", F.lit(pattern)))
    part = lambda i: F.nullif(F.regexp_extract("value", pattern, i), F.lit(""))
    return lines.select(*(part(i).try_cast(kind).alias(name) for i, (name, kind) in enumerate(columns.items(), 1)))


def open_blocks(lines: DataFrame, start: str, field: str, keys: list[str], order: str) -> DataFrame:
    """lines(keys, order, value): each line that matches `field` with the block last opened by a line that matches `start` for the same keys."""
    name = F.nullif(F.regexp_extract("value", start, 1), F.lit(""))
    opened = F.last(name, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("block", opened).where(F.rlike("value", F.lit(field)) & F.col("block").isNotNull()).withColumn("field", F.regexp_extract("value", field, 1)).withColumn("content", F.regexp_extract("value", field, 2))


def ini(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """lines(keys, order, value) of INI files as (keys, section, key, value); comments and blank lines are left out."""
    section = F.nullif(F.regexp_extract("value", r"^\s*\[([^\]]*)\]\s*$", 1), F.lit(""))
    rows = lines.withColumn("section", F.coalesce(F.last(section, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)), F.lit("")))
    pair = r"^\s*([^;#\[=][^=]*?)\s*=\s*(.*?)\s*$"
    return rows.where(F.rlike("value", F.lit(pair))).select(*keys, "section", F.regexp_extract("value", pair, 1).alias("key"), F.regexp_extract("value", pair, 2).alias("value"))


def metric_series(spark: SparkSession, path) -> DataFrame:
    """A range query's answer as (metric, ts, value)."""
    schema = "data struct<result: array<struct<metric: map<string,string>, values: array<array<string>>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("data.result").alias("r"))
    rows = rows.select(F.element_at("r.metric", "__name__").alias("metric"), F.explode("r.values").alias("v"))
    return rows.select("metric", F.timestamp_seconds(F.col("v")[0].cast("double")).alias("ts"), F.col("v")[1].try_cast("double").alias("value"))


def whole_texts(spark: SparkSession, path, extensions: tuple[str, ...] = ("txt",)) -> DataFrame:
    """Files of the allowed kinds as (path, text), sorted by path."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").text(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).orderBy("path")


def decoded_wav(c, rate: int = 16_000):
    """PCM bytes as struct(seconds, samples): channels averaged, resampled to a rate by linear interpolation, from -1 to 1."""

    @F.pandas_udf("seconds double, samples array<float>")
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for raw in s:
            with wave.open(io.BytesIO(raw)) as w:
                kind = {1: np.uint8, 2: "<i2", 4: "<i4"}[w.getsampwidth()]
                x = np.frombuffer(w.readframes(w.getnframes()), kind).astype(float).reshape(-1, w.getnchannels()).mean(axis=1)
                x = (x - 128) / 128 if w.getsampwidth() == 1 else x / float(2 ** (8 * w.getsampwidth() - 1))
                seconds, own = w.getnframes() / w.getframerate(), w.getframerate()
            at = np.arange(int(len(x) * rate / own)) * own / rate
            out.append((seconds, np.interp(at, np.arange(len(x)), x).astype(np.float32) if len(x) else x.astype(np.float32)))
        return pd.DataFrame(out, columns=["seconds", "samples"])

    return run(c)


def wav_files(spark: SparkSession, path, rate: int = 16_000) -> DataFrame:
    """Files under a path as (path, seconds, samples)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", decoded_wav("content", rate).alias("w")).select("path", "w.seconds", "w.samples")


def synthetic_prompts(spark: SparkSession, n: int, low: int, high: int, seed: int = 0, partitions: int = 8) -> DataFrame:
    """N prompts of random token ids, their lengths even between low and high; the same for a seed and partition number."""
    length = (low + F.floor(F.rand(seed) * (high - low + 1))).cast("int")
    rows = spark.range(0, n, numPartitions=partitions).withColumn("n_tokens", length)
    return rows.withColumn("tokens", F.transform(F.sequence(F.lit(1), "n_tokens"), lambda i: F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(32_000)).cast("int")))


class SqliteSource(DataSource):
    """A table of an SQLite file, or of all such files of a folder, split by rowid. Options: path (where all executors see it), table, schema (DDL), partitions (of a file)."""

    @classmethod
    def name(cls) -> str:
        return "tessera_sqlite"

    def schema(self) -> str:
        if "schema" in self.options:
            return self.options["schema"]
        import sqlite3

        with closing(sqlite3.connect(f"file:{sqlite_files(self.options['path'])[0]}?mode=ro", uri=True)) as con:
            columns = con.execute(f"PRAGMA table_info({self.options['table']})").fetchall()
        if not columns:
            raise SchemaError(f"no table {self.options['table']}")
        return ", ".join(f"`{c[1]}` {({'INTEGER': 'bigint', 'REAL': 'double'}).get(c[2].upper(), 'string')}" for c in columns)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SqliteReader(self.options, schema)


class _SqliteReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.table, self.names, self.n = options["path"], options["table"], schema.names, int(options.get("partitions", 4))

    def _query(self, path, sql):
        import sqlite3

        with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as con:
            yield from con.execute(sql)

    def partitions(self):
        out = []
        for path in sqlite_files(self.path):
            lo, hi = next(self._query(path, f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{self.table}"'))
            step = max(1, -(-(hi - lo + 1) // self.n))
            out += [InputPartition((path, a, min(a + step, hi + 1))) for a in range(lo, hi + 1, step)]
        return out or [InputPartition((None, 0, 0))]

    def read(self, partition):
        path, lo, hi = partition.value
        columns = ", ".join(f'"{c}"' for c in self.names)
        if path:
            yield from self._query(path, f'SELECT {columns} FROM "{self.table}" WHERE rowid >= {lo} AND rowid < {hi}')


def sqlite_files(path: str) -> list[str]:
    """The file at a path, or the files of a folder."""
    return sorted(glob.glob(f"{glob.escape(path)}/*.db")) if os.path.isdir(path) else [path]


def sqlite_tables(path: str) -> list[str]:
    """The tables of a file; a file without a schema is an error."""
    import sqlite3

    with closing(sqlite3.connect(f"file:{sqlite_files(path)[0]}?mode=ro", uri=True)) as con:
        if con.execute("PRAGMA schema_version").fetchone()[0] == 0:
            raise SchemaError(f"{path} has no schema")
        return [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]


def sqlite(spark: SparkSession, path: str, table: str, partitions: int = 4) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("tessera_sqlite").option("path", path).option("table", table).option("partitions", partitions).load()


def sniff(path: str) -> str:
    """Sqlite, json, jsonl or csv, by the first bytes of a file, or of the first SQLite file of a folder."""
    with open(sqlite_files(path)[0], "rb") as f:
        head = f.read(4096).lstrip(b"\xef\xbb\xbf")
    if head.startswith(b"SQLite format 3\0"):
        return "sqlite"
    text = head.lstrip()
    if text.startswith(b"["):
        return "json"
    if text.startswith(b"{"):
        return "jsonl"
    return "csv"


def load_any(spark: SparkSession, path: str, schema: T.StructType, table: str | None = None) -> DataFrame:
    """Whatever the file is, its rows in a schema."""
    kind = sniff(path)
    if kind == "sqlite":
        df = sqlite(spark, path, table or sqlite_tables(path)[0])
        return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
    return {"json": lambda: json_arrays(spark, [path], schema), "jsonl": lambda: json_lines(spark, path, schema), "csv": lambda: csv(spark, path, schema)}[kind]()


def sheet_rows(files: DataFrame, columns: list[str]) -> DataFrame:
    """K8: the rows of workbooks(content) that the sheet writer made, as text, and whether each is highlighted."""
    import zipfile
    from xml.etree import ElementTree

    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"

    def op(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    root = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
                rows = [([c.findtext(f"{ns}is/{ns}t") or "" for c in r], r[0].get("s") == "1") for r in root.iter(f"{ns}row")]
                at = [rows[0][0].index(c) for c in columns]
                cols = [pa.array([cells[i] for cells, _ in rows[1:]], pa.string()) for i in at]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([m for _, m in rows[1:]], pa.bool_())], [*columns, "highlight"])

    return files.select("content").mapInArrow(op, ", ".join(f"`{c}` string" for c in columns) + ", highlight boolean")
