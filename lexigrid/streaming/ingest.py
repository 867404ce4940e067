"""Ingestion: documents, mapped and preprocessed, into versioned tables; in batches or from a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.text import Normalizer, english, terms
from ..operators.analysis import counted
from ..operators.index import LexicalIndex, doc_lengths, entries, statistics
from ..operators.store import KeyedStore, upserted
from ..operators.vectors import tfidf_weights, vectors

Mapper = Callable[[DataFrame], DataFrame]


class Corpus:
    """Stored documents (doc_id, text) with their terms: one row a document, so texts, postings and statistics are of one version."""

    def __init__(self, spark: SparkSession, path: str, normalizer: Normalizer = english):
        self.spark, self.normalizer = spark, normalizer
        self.store = KeyedStore(spark, path)

    def add(self, docs: DataFrame, order: str | None = None) -> int:
        """Index documents; one that is there already is replaced, its postings too. The new version.

        Of several rows with one doc_id the last by `order` counts, or else the one with the greatest text.
        """
        rows = docs.select("doc_id", "text", *([order] if order else []))
        rows = upserted(rows, "doc_id", order or "text").select("doc_id", "text").where("doc_id is not null")
        own = terms(F.col("text"), self.normalizer)
        rows = rows.withColumn("terms", own).select("doc_id", "text", F.size("terms").alias("length"), counted(F.col("terms"), True).alias("counts"))
        return self.store.save(rows)

    def remove(self, keys: DataFrame) -> int:
        return self.store.delete(keys)

    def documents(self) -> DataFrame:
        return self.store.table().select("doc_id", "text")

    def postings(self) -> DataFrame:
        return entries(self.store.table())

    def lengths(self) -> DataFrame:
        return self.store.table().select("doc_id", "length")

    def index(self) -> LexicalIndex:
        return LexicalIndex(self.postings(), self.lengths())

    def statistics(self) -> DataFrame:
        """The statistics of the current version with its number."""
        return statistics(self.lengths()).withColumn("version", F.lit(self.store.version()))

    def vectors(self) -> DataFrame:
        index = self.index()
        return vectors(tfidf_weights(index.postings, index.frequency, index.statistics))


def ingest(source: DataFrame, corpus: Corpus, mapper: Mapper = lambda df: df) -> int:
    """One batch: map, index. The new version."""
    return corpus.add(source.transform(mapper))


def ingest_stream(source: DataFrame, corpus: Corpus, checkpoint: str, mapper: Mapper = lambda df: df, trigger: dict | None = None):
    """A streaming query that indexes each micro-batch; the trigger's interval is how long statistics may lag behind.

    Replaying a batch after a failure replaces the same documents, so it changes nothing.
    """
    writer = source.writeStream.foreachBatch(lambda df, _: corpus.add(df.transform(mapper)) and None).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "250 milliseconds"})).start()


def incremental_statistics(docs: DataFrame, batch, normalizer: Normalizer = english) -> DataFrame:
    """The statistics after each of a sequence of batches (numbered by the column `batch`): version, document_count, total_length, avg_length.

    Sums per batch, then running sums over the batches' one row each.
    """
    lengths = doc_lengths(docs.select(batch.cast("int").alias("version"), "doc_id", "text"), normalizer=normalizer)
    sums = lengths.groupBy("version").agg(F.count("*").alias("n"), F.sum("length").alias("l"))
    upto = W.orderBy("version").rowsBetween(W.unboundedPreceding, 0)
    sums = sums.select("version", F.sum("n").over(upto).alias("document_count"), F.sum("l").over(upto).alias("total_length"))
    return sums.withColumn("avg_length", F.round(F.col("total_length") / F.col("document_count"), 6))
