"""Writers and printed tables."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a sheet may have, its header included. A fixed value of the format.
SHEET_ROWS = 1_048_576
_MAIN, _RELS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def append(df: DataFrame, path: str) -> None:
    """K1, K13, K14."""
    df.write.mode("append").parquet(path)


def create_table(spark, name: str, ddl: str) -> None:
    """K2."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet")


def csv(df: DataFrame, path: str, columns: list[str], quote_all: bool = False, mark: bool = False) -> None:
    """K3, K4: columns in a fixed order, missing ones and nulls empty; quotes doubled; mark: a byte order mark before the header of each file."""
    out = df.select(*((F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in columns))
    if mark:
        out = out.withColumnRenamed(columns[0], "\ufeff" + columns[0])
    out.write.mode("overwrite").option("header", True).option("quoteAll", quote_all).option("escape", '"').option("emptyValue", "").csv(path)


def json_report(df: DataFrame, meta: dict[str, Column], order: list[str]) -> DataFrame:
    """K5: one row, one JSON text of meta and all results in an order; for reports, not for tables that grow."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("k"), F.struct(*df.columns).alias("r")))), lambda x: x["r"])
    return df.agg(F.to_json(F.struct(F.struct(*(v.alias(k) for k, v in meta.items())).alias("meta"), rows.alias("results"))).alias("report"))


def aligned(df: DataFrame, order: list[str], style: str = "markdown", right: tuple[str, ...] = ()) -> DataFrame:
    """K6, K7: one text: a header and a line per row, every column as wide as its longest cell; right: columns set to the right."""
    cells = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns))
    keyed = df.select(F.struct(*order).alias("_k"), F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns)).alias("_r"))
    widths = cells.agg(*(F.greatest(F.max(F.char_length(c)), F.lit(len(c))).alias(c) for c in cells.columns))
    table = keyed.agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_r"))), lambda x: x["_r"]).alias("rows")).join(F.broadcast(widths.select(F.struct(*df.columns).alias("w"))))
    pad = lambda v, c: (F.lpad if c in right else F.rpad)(v, F.col("w")[c], F.lit(" "))
    sep, edge = (" | ", "|") if style == "markdown" else ("  ", "")

    def line(values):
        body = F.concat_ws(sep, *values)
        return F.concat(F.lit(f"{edge} "), body, F.lit(f" {edge}")) if edge else F.rtrim(body)

    head = line([pad(F.lit(c), c) for c in df.columns])
    rule = line([F.repeat(F.lit("-"), F.col("w")[c]) for c in df.columns])
    lines = F.transform("rows", lambda r: line([pad(r[c], c) for c in df.columns]))
    return table.select(F.array_join(F.concat(F.array(head, rule), lines), "\n").alias("text"))


def insert_statements(df: DataFrame, name: str) -> DataFrame:
    """K9: each row as an SQL insert."""
    quote = lambda c: F.coalesce(F.concat(F.lit("'"), F.replace(F.col(c).cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))
    return df.select(F.concat(F.lit(f"INSERT INTO {name} ({', '.join(df.columns)}) VALUES ("), F.concat_ws(", ", *(quote(c) for c in df.columns)), F.lit(");")).alias("sql"))


def bench_output(df: DataFrame, path: str, kind: str) -> None:
    """Csv, json lines, sql or markdown."""
    if kind == "csv":
        csv(df, path, df.columns)
    elif kind in ("json", "jsonl"):
        df.write.mode("overwrite").json(path)
    elif kind == "sql":
        insert_statements(df, "bench").write.mode("overwrite").text(path)
    elif kind == "md":
        aligned(df, df.columns[:1]).write.mode("overwrite").text(path)
    else:
        raise ValueError(kind)


def text_files(df: DataFrame, path: str) -> None:
    """Each value of df(value) as a file of its own, in a folder of its own under the path."""
    df.select("value", F.monotonically_increasing_id().alias("f")).write.partitionBy("f").text(path)


def in_chunks(rows: int = 65_536) -> Column:
    """A number for each run of up to so many rows as they lie, so that what is gathered by it doesn't grow with the table."""
    return F.floor(F.monotonically_increasing_id() / rows)


def json_arrays(df: DataFrame, path: str) -> None:
    """Files that each hold one array of objects, a chunk of the rows."""
    rows = df.select(in_chunks().alias("f"), F.struct(*df.columns).alias("r")).groupBy("f")
    text_files(rows.agg(F.to_json(F.collect_list("r")).alias("value")), path)


def text_per_key(df: DataFrame, path: str, key: str, text: str) -> None:
    """A folder per key with its text."""
    df.select(key, F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def sqlite(df: DataFrame, path: str, table: str) -> None:
    """K2: a folder of SQLite files, one for each partition of df, that hold its rows in a table; the folder must be one that all executors see as files."""
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL"}
    ddl = ", ".join(f'"{c}" {kinds.get(k, "TEXT")}' for c, k in df.dtypes)
    marks = ", ".join("?" * len(df.columns))

    def op(batches):
        import os
        import shutil
        import sqlite3
        import tempfile

        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{path}/part-{task.partitionId():05}.db"
        with tempfile.TemporaryDirectory() as own:  # written beside the task and moved when it is whole
            con = sqlite3.connect(f"{own}/x.db")
            con.execute(f'CREATE TABLE "{table}" ({ddl})')
            n = 0
            for b in batches:
                con.executemany(f'INSERT INTO "{table}" VALUES ({marks})', zip(*(c.to_pylist() for c in b.columns), strict=True))
                n += b.num_rows
            con.commit()
            con.close()
            os.makedirs(path, exist_ok=True)
            shutil.copyfile(f"{own}/x.db", f"{name}.{task.taskAttemptId()}")
            os.replace(f"{name}.{task.taskAttemptId()}", name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["path", "rows"])

    df.mapInArrow(op, "path string, rows long").agg(F.sum("rows")).collect()


def embeddings_as(df: DataFrame, style: str) -> DataFrame:
    """Each embedding as an array, an answer-like object, or raw numbers."""
    if style == "array":
        return df.select("vec_id", F.to_json("embedding").alias("text"))
    if style == "json":
        return df.select("vec_id", F.to_json(F.struct(F.lit("embedding").alias("object"), F.col("vec_id").alias("index"), "embedding")).alias("text"))
    return df.select("vec_id", F.concat_ws(" ", F.transform("embedding", lambda x: x.cast("string"))).alias("text"))


def _sheet(rows: list[tuple[list[str], bool]]) -> bytes:
    """A workbook of one sheet: text cells, highlighted rows filled yellow, the first row bold and frozen."""
    body = []
    for i, (cells, marked) in enumerate(rows, 1):
        style = 2 if i == 1 else 1 if marked else 0
        body.append(f'<row r="{i}">' + "".join(f'<c s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(_allowed(c))}</t></is></c>' for c in cells) + "</row>")
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{_RELS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_RELS}"><sheets><sheet name="report" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{_RELS}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{_RELS}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{_MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFFFFF00"/></patternFill></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf fillId="2" applyFill="1"/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_MAIN}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData>{"".join(body)}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()


def _allowed(text: str) -> str:
    """Characters that XML can't hold become U+FFFD."""
    return "".join(c if c in "\t\n\r" or " " <= c and c not in "\ufffe\uffff" and not "\ud800" <= c <= "\udfff" else "\ufffd" for c in text)


def sheets(df: DataFrame, keys: list[str], order: list[str], highlight: str) -> DataFrame:
    """K8: (keys, content): a workbook per key, rows in an order, those where `highlight` is true filled; that column isn't shown.

    A report by nature: a key with more rows than a sheet may have is refused before anything is gathered."""
    over = df.groupBy(*keys).count().where(F.col("count") >= SHEET_ROWS).limit(1).collect()
    if over:
        raise ValueError(f"{over[0]} has more rows than a sheet holds")
    shown = [c for c in df.columns if c != highlight]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", content binary"

    def op(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        cells = pdf[shown].astype(object).where(pdf[shown].notna(), "")
        rows = [(shown, False)] + [([str(v) for v in r], bool(m)) for r, m in zip(cells.itertuples(index=False), pdf[highlight].fillna(False), strict=True)]
        return pd.DataFrame([(*key, _sheet(rows))], columns=[*keys, "content"])

    return df.groupBy(*keys).applyInPandas(op, schema)
