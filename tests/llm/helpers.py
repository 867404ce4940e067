"""Small documents with nulls, empty and very long texts, ties, repeated rows and columns whose names clash."""

from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    """Documents of (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s")), None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def clashing(df, *names):
    """With more columns, of names that operators use."""
    for n in names:
        df = df.withColumn(n, F.lit("clash"))
    return df


def documents(spark, sf=DATA):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts(spark, sf=DATA):
    return {r["doc_id"]: r["text"] for r in documents(spark, sf).select("doc_id", "text").collect()}


def saved(spark, df, path):
    df.write.mode("overwrite").parquet(str(path))
    return str(path)
