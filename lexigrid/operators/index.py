"""The inverted index and the statistics of a corpus as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions.text import Normalizer, Tokenizer, english, terms, whitespace_tokens
from .analysis import analyzed, counted
from .scratch import kept, numbered

#: So many wanted terms at most are written into a plan; with more of them postings are joined with the wanted table.
LISTED = 20_000


def term_rows(docs: DataFrame, **analysis) -> DataFrame:
    """One row for each term occurrence: doc_id, pos, term. Stop words take no positions."""
    return analyzed(docs, **analysis).select("doc_id", F.posexplode("terms").alias("pos", "term"))


def postings(rows: DataFrame, wanted: DataFrame | None = None, positions: bool = True) -> DataFrame:
    """Of term occurrences one row for each (term, doc_id): tf and, if asked for, positions, ascending. Blank terms and null ids don't count.

    `wanted` (term) restricts to some terms, before the aggregation rather than after it.
    """
    rows = rows.where("doc_id is not null and trim(term) <> ''")
    if wanted is not None:
        rows = rows.join(wanted.select("term").distinct(), "term", "left_semi")
    sums = [F.count("*").cast("int").alias("tf")]
    if positions:
        sums.append(F.array_sort(F.collect_list("pos")).alias("positions"))
    return rows.groupBy("term", "doc_id").agg(*sums)


def forward(docs: DataFrame, positions: bool = False, only: list[str] | None = None, *, normalizer: Normalizer = english, tokenizer: Tokenizer = whitespace_tokens, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document (ids are unique): doc_id, length, counts (its distinct terms; `only` these, if given).

    A document's postings are counted where its text is read: no shuffle, one pass for terms and lengths.
    """
    rows = analyzed(docs, normalizer=normalizer, tokenizer=tokenizer, id_col=id_col, text_col=text_col)
    own = F.col("terms")
    if only is not None and positions:
        raise ValueError("positions of some terms only aren't kept")
    if only is not None:
        own = F.filter(own, lambda x: x.isin(only)) if only else F.array().cast("array<string>")
    return rows.select("doc_id", F.size("terms").alias("length"), counted(own, positions).alias("counts"))


def entries(rows: DataFrame) -> DataFrame:
    """The postings of forward(): doc_id, length, term, tf (and positions). Null ids have none.

    An inner inline would have Spark filter by size(counts) first, for which it analyses each text once more.
    """
    return rows.where("doc_id is not null").select("doc_id", "length", F.inline_outer("counts")).where("term is not null")


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def lookup(post: DataFrame, words: list[str]) -> DataFrame:
    """The postings of some terms; blank and absent ones have none. On a stored index only their buckets are read."""
    words = [w for w in words if w and w.strip()]
    return post.where(F.col("term").isin(words)) if words else post.limit(0)


def as_map(post: DataFrame) -> DataFrame:
    """The whole index, a row for each term: postings, by doc_id."""
    return post.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("doc_id", "tf", "positions"))).alias("postings"))


def doc_lengths(docs: DataFrame, *, normalizer: Normalizer = english, tokenizer: Tokenizer = whitespace_tokens, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, length (terms), and what else `docs` has but the text."""
    more = [c for c in docs.columns if c not in (id_col, text_col, "doc_id", "length")]
    return docs.select(F.col(id_col).alias("doc_id"), *more, F.size(terms(F.col(text_col), normalizer, tokenizer)).alias("length"))


def statistics(lengths: DataFrame) -> DataFrame:
    """One row: document_count, total_length, docs_with_length, avg_length (0 if no document has a length).

    Blank documents have length 0 and count; a null length counts in document_count only.
    """
    total = F.coalesce(F.sum("length"), F.lit(0)).cast("long")
    known = F.count("length")
    return lengths.agg(F.count("*").alias("document_count"), total.alias("total_length"), known.alias("docs_with_length"), F.when(known > 0, total / known).otherwise(0.0).alias("avg_length"))


def vocabulary(post: DataFrame) -> DataFrame:
    """term, term_id: dense ids from 0 in order of the terms."""
    return numbered(post.select("term").distinct(), "term", "term_id")


def extended_vocabulary(known: DataFrame, post: DataFrame) -> DataFrame:
    """The known vocabulary, its ids unchanged, and new terms with the ids that follow, in order of the terms."""
    new = vocabulary(post.join(known, "term", "left_anti"))
    size = known.agg(F.coalesce(F.max("term_id") + 1, F.lit(0)).alias("size"))
    return known.select("term", "term_id").unionByName(new.crossJoin(F.broadcast(size)).select("term", (F.col("term_id") + F.col("size")).alias("term_id")))


def term_ids(vocabulary: DataFrame, words: list[str]) -> DataFrame:
    """term, term_id of those words that the vocabulary has; a null word is an error."""
    if any(w is None for w in words):
        raise ValueError("a term is needed")
    return vocabulary.where(F.col("term").isin(words)) if words else vocabulary.limit(0)


def terms_of(vocabulary: DataFrame, ids: list[int]) -> DataFrame:
    """term, term_id of those ids that the vocabulary has."""
    return vocabulary.where(F.col("term_id").isin(ids)) if ids else vocabulary.limit(0)


class LexicalIndex:
    """A corpus's postings (with each document's length), document frequencies, lengths and statistics, derived or stored."""

    def __init__(self, post: DataFrame, lengths: DataFrame, frequency: DataFrame | None = None):
        self.postings, self.lengths = post, lengths
        self.frequency = document_frequency(post) if frequency is None else frequency
        self.statistics = statistics(lengths)

    @classmethod
    def of(cls, docs: DataFrame, wanted: DataFrame | None = None, *, positions: bool = False, **analysis) -> LexicalIndex:
        """The index of documents; with `wanted` (term) of those terms only, the statistics being of all documents.

        Texts are read and analysed once, into a forward table in the shared folder from which the rest derives.
        """
        only, semi = None, False
        if wanted is not None:
            words = [r["term"] for r in wanted.select("term").distinct().limit(LISTED + 1).collect()]
            semi = len(words) > LISTED
            only = None if semi or positions else words
            semi = semi or positions
        rows = kept(forward(docs, positions, only, **analysis), "forward")
        post = entries(rows)
        if semi:
            post = post.join(wanted.select("term").distinct(), "term", "left_semi")
        return cls(post, rows.select("doc_id", "length"))

    def write(self, path: str, buckets: int = 64) -> None:
        """Store it: postings by bucket of the term, sorted by term within, so that a lookup reads few row groups."""
        rows = self.postings.withColumn("term_bucket", bucket_of(F.col("term"), buckets))
        # a term in very many documents is spread over several tasks of its bucket
        rows = rows.repartition("term_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(8)))
        rows.sortWithinPartitions("term_bucket", "term").write.mode("overwrite").partitionBy("term_bucket").parquet(f"{path}/postings")
        self.frequency.write.mode("overwrite").parquet(f"{path}/frequency")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")

    @classmethod
    def read(cls, spark, path: str, words: list[str] | None = None, buckets: int = 64) -> LexicalIndex:
        """A stored index; with `words`, only their buckets are read."""
        post = spark.read.parquet(f"{path}/postings")
        if words is not None:
            own = spark.createDataFrame([(w,) for w in words], "term string").select(bucket_of(F.col("term"), buckets).alias("b")).distinct()
            post = lookup(post.where(F.col("term_bucket").isin([r["b"] for r in own.collect()])), words)
        return cls(post.drop("term_bucket"), spark.read.parquet(f"{path}/lengths"), spark.read.parquet(f"{path}/frequency"))


def bucket_of(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


#: A stage of a build: the index so far and a path -> what it has written there is ready to be read.
Stage = Callable[[LexicalIndex, str], None]


def lexical_stage(index: LexicalIndex, path: str) -> None:
    index.write(f"{path}/lexical")


def build(docs: DataFrame, path: str, *stages: Stage, resolve: Callable[[DataFrame], DataFrame] = lambda docs: docs, positions: bool = True, **analysis) -> LexicalIndex:
    """Documents, as `resolve` makes them, analysed once and stored by each of the stages in turn (by default the lexical one).

    The index that is returned is read from there if the lexical stage was one of them.
    """
    stages = stages or (lexical_stage,)
    index = LexicalIndex.of(docs.transform(resolve), positions=positions, **analysis)
    index.frequency = kept(index.frequency, "frequency")  # more than one stage reads it
    for stage in stages:
        stage(index, path)
    return LexicalIndex.read(docs.sparkSession, f"{path}/lexical") if lexical_stage in stages else index
