"""Small tables for the operators' tests."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def documents(spark, rows, folder=None):
    """rows: (doc_id, text) or longer; where a folder is given, also documents.parquet in it."""
    full = [(*r, *["en", "src0", len(r[1] or "")][len(r) - 2 :]) if len(r) < 5 else r for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if folder is not None:
        df.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
        df = spark.read.parquet(f"{folder}/documents.parquet")
    return df


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
