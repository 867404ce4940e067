"""Term weights, sparse vectors and norms in long form, cosine, vector search, similar documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.ranking import classic_idf, sublinear_tf
from ..functions.text import Normalizer, Tokenizer, english, whitespace_tokens
from .index import LexicalIndex, entries, forward
from .pairs import dot_products
from .scratch import kept, numbered
from .search import ranked

#: counts (doc_id, term, tf), frequency (term, df), statistics (one row) -> weights (doc_id, term, weight)
Weighter = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


def tf_weights(counts: DataFrame, frequency: DataFrame | None = None, statistics: DataFrame | None = None) -> DataFrame:
    """Term counts as weights; the corpus doesn't matter."""
    return counts.select("doc_id", "term", F.col("tf").cast("double").alias("weight"))


def tfidf_weights(counts: DataFrame, frequency: DataFrame, statistics: DataFrame) -> DataFrame:
    """Sublinear tf times classic idf. Terms that the corpus doesn't have go; zero weights stay; no documents: no weights.

    If the frequencies come with a term_id, so do the weights.
    """
    ids = [c for c in frequency.columns if c == "term_id"]
    rows = counts.join(frequency, "term").crossJoin(F.broadcast(statistics.select("document_count"))).where("document_count > 0")
    return rows.select("doc_id", "term", (sublinear_tf(F.col("tf")) * classic_idf(F.col("document_count"), F.col("df"))).alias("weight"), *ids)


def vectors(weights: DataFrame) -> DataFrame:
    """The weights that aren't zero; with a vocabulary, join it on term for term_id."""
    return weights.where("weight <> 0")


def with_term_ids(vecs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    return vecs.join(vocabulary, "term").select("doc_id", "term_id", "weight")


def norms(vecs: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """doc_id, dims (active dimensions), norm; with `documents` (doc_id) those without dimensions too, their norm 0."""
    found = vecs.groupBy("doc_id").agg(F.count("*").alias("dims"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    if documents is not None:
        found = documents.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("dims", F.lit(0)).cast("long").alias("dims"), F.coalesce("norm", F.lit(0.0)).alias("norm"))
    return found


def as_map(vecs: DataFrame) -> DataFrame:
    """The compact form, a row for each document: a map of term_id to weight."""
    return vecs.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term_id", "weight")))).alias("vector"))


def weight_of(vector: Column, term_id) -> Column:
    return F.coalesce(F.try_element_at(vector, F.lit(term_id)), F.lit(0.0))


def dimensions(vector: Column) -> Column:
    return F.size(vector)


def _norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(F.map_values(vector), F.lit(0.0), lambda a, w: a + w * w))


def cosine(left: Column, right: Column) -> Column:
    """Of two vectors in compact form: struct(score, matches), matches with dimension, both weights and their product.

    0 and no matches if either norm is 0.
    """
    shared = F.array_intersect(F.map_keys(left), F.map_keys(right))

    def match(d: Column) -> Column:
        a, b = F.element_at(left, d), F.element_at(right, d)
        return F.struct(d.alias("dimension"), a.alias("left_weight"), b.alias("right_weight"), (a * b).alias("contribution"))

    zero = (_norm(left) == 0) | (_norm(right) == 0)
    matches = F.transform(F.array_sort(shared), match)
    dot = F.aggregate(matches, F.lit(0.0), lambda a, m: a + m["contribution"])
    return F.struct(F.when(zero, 0.0).otherwise(dot / (_norm(left) * _norm(right))).alias("score"), F.when(zero, F.slice(matches, 1, 0)).otherwise(matches).alias("matches"))


def cosine_join(left: DataFrame, left_norms: DataFrame, right: DataFrame, right_norms: DataFrame, threshold: float = 0.0) -> DataFrame:
    """For all pairs of vectors that share a term: left_id, doc_id, score over the threshold.

    Pairs that share nothing have cosine 0, which no threshold lets pass, so a join on terms finds all.
    """
    if threshold < 0:
        raise ValueError("the threshold must not be negative")
    scaled = lambda vecs, sizes, name, out: vecs.join(sizes.where("norm > 0").select("doc_id", "norm"), "doc_id").select(F.col("doc_id").alias(name), "term", (F.col("weight") / F.col("norm")).alias(out))
    both = scaled(left, left_norms, "left_id", "l").join(scaled(right, right_norms, "doc_id", "r"), "term")
    return both.groupBy("left_id", "doc_id").agg(F.sum(F.col("l") * F.col("r")).alias("score")).where(F.col("score") > threshold)


def explained(found: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Scored pairs (left_id, doc_id, ...) with matched_terms: the shared terms by contribution, ties by term."""
    own = left.select(F.col("doc_id").alias("left_id"), "term", F.col("weight").alias("l"))
    both = found.select("left_id", "doc_id").join(own, "left_id").join(right.select("doc_id", "term", F.col("weight").alias("r")), ["doc_id", "term"])
    less = (-F.round(F.col("l") * F.col("r"), 9)).alias("less")
    matched = both.groupBy("left_id", "doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(less, "term"))), lambda x: x["term"]).alias("matched_terms"))
    return found.join(matched, ["left_id", "doc_id"])


def vector_search(queries: DataFrame, vecs: DataFrame, vec_norms: DataFrame, frequency: DataFrame, statistics: DataFrame, *, weighter: Weighter = tfidf_weights, threshold: float = 0.0, top: int | None = None, explain: bool = True, normalizer: Normalizer = english, tokenizer: Tokenizer = whitespace_tokens) -> DataFrame:
    """Queries (query_id, text) against document vectors: query_id, doc_id, score (strictly over the threshold), matched_terms, rank if `top` is given.

    A query is weighed like a document against the same corpus. Its norm takes in terms that only it has, if the
    weighter keeps them. Pairs are scored first; only those that stay are explained.
    """
    rows = entries(forward(queries, id_col="query_id", text_col="text", normalizer=normalizer, tokenizer=tokenizer))
    own = vectors(weighter(rows, frequency, statistics))
    vecs = vecs.join(own.select("term").distinct(), "term", "left_semi")
    found = cosine_join(own, norms(own), vecs, vec_norms, threshold)
    if top is not None:
        found = ranked(found.withColumnRenamed("left_id", "query_id"), top).withColumnRenamed("query_id", "left_id")
    found = explained(found, own, vecs) if explain else found
    return found.withColumnRenamed("left_id", "query_id")


def similar_documents(vecs: DataFrame, vec_norms: DataFrame, wanted: DataFrame | None = None, threshold: float = 0.0) -> DataFrame:
    """doc_a, doc_b, score over the threshold: of the documents `wanted` (doc_id; all if None) with all others.

    With all documents each pair comes once, the smaller id first; with `wanted`, each wanted document has its row
    for each other document. Terms may be numbers, else they are numbered. Pairs aren't shuffled (see dot_products).
    """
    if threshold < 0:
        raise ValueError("the threshold must not be negative")
    if dict(vecs.dtypes)["term"] not in ("int", "bigint"):
        ids = numbered(vecs.select("term").distinct(), "term", "id")
        vecs = vecs.join(ids, "term").select("doc_id", F.col("id").alias("term"), "weight")
    rows = vecs.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("term").cast("long").alias("term"), "weight")).alias("entries"))
    rows = rows.join(vec_norms.where("norm > 0").select("doc_id", "norm"), "doc_id")
    if wanted is None:
        rows = rows.withColumn("wanted", F.lit(True))
    else:
        rows = rows.join(wanted.select("doc_id").distinct().withColumn("wanted", F.lit(True)), "doc_id", "left")
    found = dot_products(rows.select("doc_id", "wanted", "norm", "entries"), threshold)
    found = found.where("left_id < doc_id" if wanted is None else "left_id <> doc_id")
    return found.select(F.col("left_id").alias("doc_a"), F.col("doc_id").alias("doc_b"), "score")


def arrival_weights(rows: DataFrame, bucket: int = 4096) -> DataFrame:
    """TF-IDF as if each document of forward() had been weighed on arrival, in the order of doc_id, against itself and those before it.

    df on arrival is the number of postings of the term so far, N on arrival the number of documents with terms so far.
    Documents are numbered densely; a term's documents are counted in ranges of `bucket` numbers, then over the ranges,
    so that a term that nearly all documents have is never sorted in one task.
    """
    rows = kept(rows.where(F.size("counts") > 0), "arrivals")
    nth = numbered(rows.select("doc_id"), "doc_id", "n")
    counts = entries(rows.join(nth, "doc_id").withColumn("length", F.col("n") + 1)).withColumnRenamed("length", "n")
    counts = counts.withColumn("range", F.floor((F.col("n") - 1) / bucket))
    sizes = counts.groupBy("term", "range").agg(F.count("*").alias("size"))
    upto = W.partitionBy("term").orderBy("range").rowsBetween(W.unboundedPreceding, 0)
    before = sizes.select("term", "range", (F.sum("size").over(upto) - F.col("size")).alias("before"))
    seen = counts.withColumn("own", F.row_number().over(W.partitionBy("term", "range").orderBy("n"))).join(before, ["term", "range"])
    return seen.select("doc_id", "term", (sublinear_tf(F.col("tf")) * classic_idf(F.col("n"), F.col("before") + F.col("own"))).alias("weight"))


def vector_stage(weighter: Weighter = tfidf_weights):
    """A stage of index.build: vectors by term_id, norms of all documents and the vocabulary, stored under the path."""

    def stage(index: LexicalIndex, path: str) -> None:
        known = kept(numbered(index.frequency, "term", "term_id"), "vocabulary")
        known.select("term", "term_id").write.mode("overwrite").parquet(f"{path}/vocabulary")
        vecs = vectors(weighter(index.postings, known, index.statistics))
        vecs = vecs if "term_id" in vecs.columns else with_term_ids(vecs, known)
        # by document, so that what is summed for each document is summed within a file
        vecs.select("doc_id", "term_id", "weight").repartition("doc_id").write.mode("overwrite").parquet(f"{path}/vectors")
        vecs = index.postings.sparkSession.read.parquet(f"{path}/vectors")
        norms(vecs, index.lengths).write.mode("overwrite").parquet(f"{path}/norms")

    return stage


def stored_vectors(spark, path: str, terms: bool = True) -> tuple[DataFrame, DataFrame]:
    """Vectors with their terms (or else their term_id), and norms, as vector_stage has stored them."""
    vecs, sizes = spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/norms")
    return vecs.join(spark.read.parquet(f"{path}/vocabulary"), "term_id").select("doc_id", "term", "weight") if terms else vecs, sizes
