"""Ranked search of many queries at once: joins on terms, one aggregation, an order with a defined tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.ranking import RANKERS, Ranker
from ..functions.text import Normalizer, Tokenizer, english, terms, whitespace_tokens
from .index import LexicalIndex


def query_terms(queries: DataFrame, normalizer: Normalizer = english, tokenizer: Tokenizer = whitespace_tokens) -> DataFrame:
    """For each query (query_id, text) and distinct term: qtf (occurrences) and first_pos (where it comes first)."""
    rows = queries.select("query_id", F.posexplode(terms(F.col("text"), normalizer, tokenizer)).alias("pos", "term"))
    return rows.groupBy("query_id", "term").agg(F.count("*").cast("int").alias("qtf"), F.min("pos").alias("first_pos"))


def ranked(found: DataFrame, top: int | None) -> DataFrame:
    """The `top` best of each query with their rank, by score, then doc_id; all of them, in no order, if `top` is None.

    Scores are compared as they are printed, so that the order of summing can't reorder ties. Each task keeps the
    best of its own rows before a query's meet.
    """
    if top is None:
        return found
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id"))).where(F.col("rank") <= top)


def lexical_search(wanted: DataFrame, index: LexicalIndex, ranker: Ranker | str = "bm25", *, top: int | None = None, documents: DataFrame | None = None) -> DataFrame:
    """For query terms `wanted` (see query_terms): query_id, doc_id, score, matched_terms (in query order), rank if `top` is given.

    A document that has any of the terms is a hit, zero scores among them; each occurrence in the query adds its score.
    `top` keeps so many a query. With `documents` (doc_id and more), their columns are joined to the hits, and hits
    without a document go. Which side of a join is broadcast is left to Spark's size checks.
    """
    score = RANKERS[ranker] if isinstance(ranker, str) else ranker
    hits = index.postings.select("term", "doc_id", "tf", "length").join(wanted, "term").join(index.frequency, "term")
    hits = hits.crossJoin(F.broadcast(index.statistics))  # one row
    own = score(F.col("tf"), F.col("df"), F.col("document_count"), F.coalesce("length", F.lit(0)), F.col("avg_length"))
    hits = hits.select("query_id", "doc_id", "term", "first_pos", (F.col("qtf") * own).alias("score"))
    matched = F.transform(F.array_sort(F.collect_list(F.struct("first_pos", "term"))), lambda x: x["term"])
    found = ranked(hits.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"), matched.alias("matched_terms")), top)
    return found.join(documents, "doc_id") if documents is not None else found


def search(queries: DataFrame, docs: DataFrame, ranker: Ranker | str = "bm25", *, top: int | None = None, documents: DataFrame | None = None, normalizer: Normalizer = english, tokenizer: Tokenizer = whitespace_tokens, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """lexical_search straight from texts: only the queries' terms are counted, in one pass over the texts."""
    wanted = query_terms(queries, normalizer, tokenizer)
    index = LexicalIndex.of(docs, wanted, normalizer=normalizer, tokenizer=tokenizer, id_col=id_col, text_col=text_col)
    return lexical_search(wanted, index, ranker, top=top, documents=documents)


def result_lines(found: DataFrame, text: Column) -> DataFrame:
    """Hits with their rank as lines to print: query_id, rank, line."""
    line = F.format_string("%d. %s  %.4f  [%s]  %s", "rank", F.col("doc_id").cast("string"), "score", F.array_join("matched_terms", ", "), text)
    return found.select("query_id", "rank", line.alias("line"))


def print_results(found: DataFrame, text: Column, most: int = 100) -> None:
    """Print the first `most` lines of the result."""
    for row in result_lines(found, text).orderBy("query_id", "rank").limit(most).collect():
        print(row["line"])
