"""Preprocessing: a document's terms, normalized content, length, distinct terms and term frequencies, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T


def analyzed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", normalizer: T.Normalizer = T.english, tokenizer: T.Tokenizer = T.whitespace_tokens) -> DataFrame:
    """One row for each document: doc_id, terms. A null or blank text has no terms."""
    return docs.select(F.col(id_col).alias("doc_id"), T.terms(F.col(text_col), normalizer, tokenizer).alias("terms"))


def counted(terms: Column, positions: bool = False) -> Column:
    """The distinct terms, in order: an array of structs term, tf and, if asked for, positions (ascending).

    The terms are sorted once and cut where they change, so long documents cost their length, not its square.
    """
    rows = F.transform(terms, lambda t, i: F.struct(t.alias("term"), i.alias("pos"))) if positions else terms
    name = (lambda x: x["term"]) if positions else (lambda x: x)

    def cut(o: Column) -> Column:
        at = F.when(F.size(o) > 0, F.sequence(F.lit(0), F.size(o) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(at, lambda i: (i == 0) | (name(F.get(o, i)) != name(F.get(o, i - 1))))

        def entries(s: Column) -> Column:
            def entry(a: Column, j: Column) -> Column:
                tf = F.coalesce(F.get(s, j + 1), F.size(o)) - a
                own = [name(F.get(o, a)).alias("term"), tf.alias("tf")]
                return F.struct(*own, F.transform(F.slice(o, a + 1, tf), lambda x: x["pos"]).alias("positions")) if positions else F.struct(*own)

            return F.transform(s, entry)

        return T.let(starts, entries)

    return T.let(F.sort_array(rows), cut)


def frequencies(terms: Column) -> Column:
    """A map of each distinct term to its number."""
    return F.map_from_entries(counted(terms))


def preprocess(docs: DataFrame, *, normalizer: T.Normalizer = T.english, tokenizer: T.Tokenizer = T.whitespace_tokens) -> DataFrame:
    """Documents (see schemas) with normalized_content and metadata's length, unique_terms and term_frequencies.

    A row that has all four stays as it is. Blank content: empty normalized content, length 0, no terms.
    """
    done = F.col("normalized_content").isNotNull() & F.col("metadata.term_frequencies").isNotNull() & F.col("metadata.length").isNotNull() & F.col("metadata.unique_terms").isNotNull()
    rows = docs.withColumn("__terms", T.terms(F.col("raw_content"), normalizer, tokenizer))
    own = F.struct(
        F.col("metadata.title").alias("title"), F.col("metadata.source").alias("source"), F.size("__terms").alias("length"), F.size(F.array_distinct("__terms")).alias("unique_terms"),
        frequencies(F.col("__terms")).alias("term_frequencies"), F.coalesce("metadata.attributes", F.create_map().cast("map<string,string>")).alias("attributes"),
    )
    kind = docs.schema["metadata"].dataType.simpleString()
    return rows.withColumns({"normalized_content": F.when(done, F.col("normalized_content")).otherwise(F.array_join("__terms", " ")), "metadata": F.when(done, F.col("metadata")).otherwise(own.cast(kind))}).drop("__terms")


def require_preprocessed(docs: DataFrame) -> DataFrame:
    """The documents; a row without normalized content or metadata is an error when it is read."""
    ready = F.col("normalized_content").isNotNull() & F.col("metadata.length").isNotNull()
    return docs.withColumn("normalized_content", F.when(ready, F.col("normalized_content")).otherwise(F.raise_error(F.concat(F.lit("document isn't preprocessed: "), F.coalesce("id", F.lit("null"))))))
