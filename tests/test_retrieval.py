import math

import pytest
from pyspark.sql import functions as F

from lexigrid.functions import ranking as R
from lexigrid.functions.text import english, pattern_tokens
from lexigrid.operators import analysis as A, index as I, search as S, vectors as V
from lexigrid.operators.store import KeyedStore, upserted
from lexigrid.streaming.ingest import Corpus, ingest, ingest_stream

# The small corpora on which the expected scores are defined.
RANKING = [("doc1.txt", "Java is a programming language"), ("doc2.txt", "A search engine uses an inverted index"), ("doc3.txt", "Java can be used to build a search engine")]
VECTORS = [("doc1", "java search engine"), ("doc2", "java programming language"), ("doc3", "lucene inverted index search")]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, text string")


def found(spark, rows, query, ranker="bm25", **options):
    asked = spark.createDataFrame([("q", query)], "query_id string, text string")
    return [(r["doc_id"], r["score"], r["matched_terms"]) for r in S.search(asked, docs_of(spark, rows), ranker, **options).orderBy(F.desc(F.round("score", 9)), "doc_id").collect()]


def test_bm25_and_tfidf_values(spark):
    assert [(d, pytest.approx(s, abs=1e-12)) for d, s, _ in found(spark, RANKING, "java")] == [("doc1.txt", 0.5376841518571216), ("doc3.txt", 0.4421744669877645)]
    assert [s for _, s, _ in found(spark, RANKING, "java", "tfidf")] == [pytest.approx(math.log(3 / 2), abs=1e-15)] * 2
    assert found(spark, RANKING, "inverted")[0][1] == pytest.approx(0.9227538367149796, abs=1e-12)
    assert [d for d, _, _ in found(spark, RANKING, "search")] == ["doc2.txt", "doc3.txt"]
    assert [s for _, s, _ in found(spark, RANKING, "java java")] == [pytest.approx(2 * s, abs=1e-12) for _, s, _ in found(spark, RANKING, "java")]
    assert {d: m for d, _, m in found(spark, RANKING, "search engine java")}["doc3.txt"] == ["search", "engine", "java"]
    assert {s for _, s, _ in found(spark, RANKING, "java", "binary")} == {1.0}
    assert found(spark, RANKING, "the") == found(spark, RANKING, "zzz") == found(spark, [], "java") == []
    assert len(found(spark, RANKING, "java search", top=1)) == 1


def test_length_penalty_and_zero_scores(spark):
    pair = [("a", "java code"), ("b", "java code architecture patterns testing deployment monitoring scaling pipelines")]
    assert [s for _, s, _ in found(spark, pair, "java")] == [pytest.approx(0.246490596335961, abs=1e-12), pytest.approx(0.1446616942430722, abs=1e-12)]
    assert [s for _, s, _ in found(spark, pair, "java", "tfidf")] == [0.0, 0.0]
    custom = found(spark, pair, "java", R.bm25(k1=2.0, b=0.0))
    assert custom[0][1] == pytest.approx(custom[1][1])


def test_formulas_at_their_edges(spark):
    row = spark.range(1).select(
        R.classic_idf(F.lit(0), F.lit(0)).alias("a"), R.bm25_idf(F.lit(3), F.lit(0)).alias("b"), R.sublinear_tf(F.lit(0)).alias("c"), R.bm25()(F.lit(1), F.lit(1), F.lit(3), F.lit(0), F.lit(2.0)).alias("d"),
        R.binary(F.lit(3), F.lit(1), F.lit(1), F.lit(1), F.lit(1.0)).alias("e"), R.binary(F.lit(None).cast("int"), F.lit(1), F.lit(1), F.lit(1), F.lit(1.0)).alias("f"), R.bm25()(F.lit(None).cast("int"), F.lit(1), F.lit(3), F.lit(1), F.lit(2.0)).alias("g"),
    ).first()
    assert tuple(row) == (0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def test_index_invariants_and_statistics(spark):
    docs = docs_of(spark, [("a", "Java the java IR"), ("b", ""), ("c", None), ("d", "search")])
    post = I.postings(I.term_rows(docs))
    assert {(r["term"], r["doc_id"]): (r["tf"], r["positions"]) for r in post.collect()} == {("java", "a"): (2, [0, 1]), ("ir", "a"): (1, [2]), ("search", "d"): (1, [0])}
    own = {(r["term"], r["doc_id"]): (r["tf"], r["positions"], r["length"]) for r in I.entries(I.forward(docs, positions=True)).collect()}
    assert own == {("java", "a"): (2, [0, 1], 3), ("ir", "a"): (1, [2], 3), ("search", "d"): (1, [0], 1)}
    assert {(r["term"], r["doc_id"], r["tf"]) for r in I.entries(I.forward(docs, only=["java", "zzz"])).collect()} == {("java", "a", 2)}
    assert tuple(I.statistics(I.doc_lengths(docs)).first()) == (4, 4, 4, 1.0)
    assert tuple(I.statistics(I.doc_lengths(docs.limit(0))).first()) == (0, 0, 0, 0.0)
    assert I.lookup(post, ["java", " "]).count() == 1 and I.lookup(post, []).count() == 0
    assert {r["term"]: len(r["postings"]) for r in I.as_map(post).collect()} == {"java": 1, "ir": 1, "search": 1}
    words = {r["term"]: r["term_id"] for r in I.vocabulary(post).collect()}
    assert words == {"ir": 0, "java": 1, "search": 2}
    more = I.postings(I.term_rows(docs_of(spark, [("x", "apple java zebra")])))
    assert {r["term"]: r["term_id"] for r in I.extended_vocabulary(I.vocabulary(post), more).collect()} == {"ir": 0, "java": 1, "search": 2, "apple": 3, "zebra": 4}


def test_stored_index(spark, tmp_path):
    docs = docs_of(spark, RANKING)
    I.LexicalIndex.of(docs, positions=True).write(str(tmp_path / "i"), buckets=4)
    asked = S.query_terms(spark.createDataFrame([("q", "java search")], "query_id string, text string"))
    whole = S.lexical_search(asked, I.LexicalIndex.read(spark, str(tmp_path / "i"), ["java", "search"], buckets=4)).collect()
    direct = S.lexical_search(asked, I.LexicalIndex.of(docs)).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, direct))
    one = I.LexicalIndex.read(spark, str(tmp_path / "i"), ["java"], buckets=4).postings
    assert len(one.inputFiles()) < len(spark.read.parquet(str(tmp_path / "i" / "postings")).inputFiles()) or one.count() == 2


def test_dangling_hits_go(spark):
    asked = S.query_terms(spark.createDataFrame([("q", "java")], "query_id string, text string"))
    docs = docs_of(spark, RANKING)
    assert [r["doc_id"] for r in S.lexical_search(asked, I.LexicalIndex.of(docs), documents=docs.where("doc_id <> 'doc1.txt'")).collect()] == ["doc3.txt"]


def test_preprocess_and_bypass(spark):
    from lexigrid.schemas import DOCUMENTS

    done = ("done", "raw", "kept", {}, ("t", "s", 9, 8, {"x": 1}, {}))
    rows = [("a", "Java the java IR", None, {}, ("t", "s", None, None, None, None)), ("b", "  ", None, {}, (None, None, None, None, None, None)), done]
    out = {r["id"]: r for r in A.preprocess(spark.createDataFrame(rows, DOCUMENTS)).collect()}
    assert out["a"]["normalized_content"] == "java java ir"
    assert tuple(out["a"]["metadata"])[2:5] == (3, 2, {"java": 2, "ir": 1})
    assert out["b"]["normalized_content"] == "" and tuple(out["b"]["metadata"])[2:5] == (0, 0, {})
    assert out["done"]["normalized_content"] == "kept" and out["done"]["metadata"]["length"] == 9
    with pytest.raises(Exception, match="isn't preprocessed"):
        A.require_preprocessed(spark.createDataFrame(rows[:1], DOCUMENTS)).collect()


def _weights(spark, rows, **analysis):
    index = I.LexicalIndex.of(docs_of(spark, rows), **analysis)
    return index, V.tfidf_weights(index.postings, index.frequency, index.statistics)


def test_weights(spark):
    _, weights = _weights(spark, [("1", "java java search"), ("2", "java programming"), ("3", "index retrieval")])
    own = {r["term"]: r["weight"] for r in weights.where("doc_id = '1'").collect()}
    assert own == {"search": pytest.approx(1.0986122886681098, abs=1e-12), "java": pytest.approx(0.686512104608772, abs=1e-12)}
    _, weights = _weights(spark, [("1", "java java java"), ("2", "search engine")])
    assert weights.where("term = 'java'").first()["weight"] == pytest.approx(1.4546471909787544, abs=1e-12)
    assert _weights(spark, [("1", "   ")])[1].count() == 0
    index = I.LexicalIndex.of(docs_of(spark, [("1", "java search")]))
    other = I.postings(I.term_rows(docs_of(spark, [("x", "java phantomterm")])), positions=False)
    assert [(r["term"], r["weight"]) for r in V.tfidf_weights(other, index.frequency, index.statistics).collect()] == [("java", 0.0)]
    counts = I.postings(I.term_rows(docs_of(spark, [("x", "alpha|beta|alpha")]), tokenizer=pattern_tokens(r"\|")), positions=False)
    assert {r["term"]: r["weight"] for r in V.tf_weights(counts).collect()} == {"alpha": 2.0, "beta": 1.0}


def test_cosine(spark):
    row = spark.range(1).select(V.cosine(F.create_map(F.lit(0), F.lit(2.0), F.lit(1), F.lit(1.0)), F.create_map(F.lit(0), F.lit(1.0), F.lit(2), F.lit(5.0))).alias("c"), V.cosine(F.create_map(F.lit(0), F.lit(0.0)), F.create_map(F.lit(0), F.lit(1.0))).alias("z"), V.weight_of(F.create_map(F.lit(0), F.lit(2.0)), 7).alias("w")).first()
    assert row["c"]["score"] == pytest.approx(0.17541160386140586, abs=1e-12)
    assert [tuple(m) for m in row["c"]["matches"]] == [(0, 2.0, 1.0, 2.0)]
    assert (row["z"]["score"], row["z"]["matches"], row["w"]) == (0.0, [], 0.0)


def test_vector_search(spark):
    index, weights = _weights(spark, VECTORS)
    vecs = V.vectors(weights)
    norms = V.norms(vecs, index.lengths)

    def ask(query, weighter=V.tfidf_weights, threshold=0.0):
        asked = spark.createDataFrame([("q", query)], "query_id string, text string")
        return {r["doc_id"]: (r["rank"], r["score"]) for r in V.vector_search(asked, vecs, norms, index.frequency, index.statistics, weighter=weighter, threshold=threshold, top=9).collect()}

    assert ask("lucene") == {"doc3": (1, pytest.approx(0.5646732768699807, abs=1e-12))}
    assert ask("programming") == {"doc2": (1, pytest.approx(0.6841916012796778, abs=1e-12))}
    assert ask("java") == {"doc1": (1, pytest.approx(0.32718457421366, abs=1e-12)), "doc2": (2, pytest.approx(0.2525147628886298, abs=1e-12))}
    assert ask("java", threshold=0.3).keys() <= {"doc1"}
    assert ask("nowhere") == {}
    # words that only the query has lengthen it if the weighter keeps them
    assert ask("java nowhere", V.tf_weights)["doc2"][1] < ask("java", V.tf_weights)["doc2"][1]
    with pytest.raises(ValueError):
        ask("java", threshold=-0.1)
    pairs = {(r["doc_a"], r["doc_b"]) for r in V.similar_documents(vecs, norms).collect()}
    assert pairs == {("doc1", "doc2"), ("doc1", "doc3")}
    ids = I.vocabulary(index.postings)
    assert V.as_map(V.with_term_ids(vecs, ids)).count() == 3


def test_blank_document_has_norm_zero(spark):
    index, weights = _weights(spark, [("a", "java"), ("b", " "), ("c", "search")])
    assert {r["doc_id"]: (r["dims"], r["norm"] > 0) for r in V.norms(V.vectors(weights), index.lengths).collect()} == {"a": (1, True), "b": (0, False), "c": (1, True)}


def test_upsert_and_store(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "doc_id string, v int, text string")
    assert {(r["doc_id"], r["text"]) for r in upserted(rows, "doc_id", "v").collect()} == {("a", "y"), ("b", "z")}
    store = KeyedStore(spark, str(tmp_path / "s"))
    assert store.version() == 0
    with pytest.raises(ValueError):
        store.table()
    first = rows.where("v = 1").drop("v")
    assert store.save(first) == 1 and store.save(rows.where("v = 2").drop("v")) == 2
    assert {(r["doc_id"], r["text"]) for r in store.table().collect()} == {("a", "y"), ("b", "z")}
    assert {(r["doc_id"], r["text"]) for r in store.table(1).collect()} == {("a", "x"), ("b", "z")}
    assert store.contains("a") and not store.contains("c") and store.size() == 2
    assert store.delete(rows.where("doc_id = 'a'")) == 3 and store.size() == 1
    for i in range(20):  # past the number of changes after which the table is written anew
        store.save(rows.where("v = 2").select("doc_id", F.lit(str(i)).alias("text")))
    store.vacuum()
    assert {(r["doc_id"], r["text"]) for r in store.table().collect()} == {("a", "19"), ("b", "z")}
    left = [p.name for p in (tmp_path / "s").iterdir() if not p.name.startswith(".")]
    assert len(left) <= 2 * KeyedStore.COMPACT and sorted(p.name for p in (tmp_path / "s" / "manifests").iterdir() if p.name.isdigit()) == [str(store.version() - 1), str(store.version())]
    with pytest.raises(ValueError):
        store.get(None)


def test_corpus_replaces_postings(spark, tmp_path):
    corpus = Corpus(spark, str(tmp_path / "c"))
    ingest(docs_of(spark, [("a", "java search engine"), ("b", "index")]), corpus)
    assert tuple(corpus.statistics().first()) == (2, 4, 2, 2.0, 1)
    ingest(docs_of(spark, [("a", "one word java java java")]), corpus)
    assert tuple(corpus.statistics().first()) == (2, 6, 2, 3.0, 2)
    assert {r["term"] for r in corpus.postings().where("doc_id = 'a'").collect()} == {"one", "word", "java"}
    ingest(docs_of(spark, [("a", " ")]), corpus)
    assert corpus.postings().where("doc_id = 'a'").count() == 0 and corpus.statistics().first()["document_count"] == 2
    corpus.remove(docs_of(spark, [("a", "")]))
    assert corpus.statistics().first()["document_count"] == 1
    assert corpus.vectors().count() == 0


def test_streamed_ingestion_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    docs_of(spark, RANKING[:2]).write.parquet(str(source / "1"))
    corpus = Corpus(spark, str(tmp_path / "c"))
    stream = spark.readStream.schema("doc_id string, text string").parquet(f"{source}/*")
    ingest_stream(stream, corpus, str(tmp_path / "ck"), trigger={"availableNow": True}).awaitTermination()
    docs_of(spark, RANKING[2:]).write.parquet(str(source / "2"))
    ingest_stream(stream, corpus, str(tmp_path / "ck"), trigger={"availableNow": True}).awaitTermination()
    row = corpus.statistics().first()
    assert (row["document_count"], row["total_length"], row["version"]) == (3, 13, 2)
    asked = S.query_terms(spark.createDataFrame([("q", "java")], "query_id string, text string"))
    assert [r["doc_id"] for r in S.lexical_search(asked, corpus.index(), top=9).orderBy("rank").collect()] == ["doc1.txt", "doc3.txt"]


def test_arrival_order(spark):
    rows = I.forward(spark.createDataFrame([(1, "java"), (2, "java search"), (3, "search")], "doc_id long, text string"))
    got = {(r["doc_id"], r["term"]): r["weight"] for r in V.arrival_weights(rows, bucket=1).collect()}
    assert got == {(1, "java"): 0.0, (2, "java"): 0.0, (2, "search"): pytest.approx(math.log(2)), (3, "search"): pytest.approx(math.log(3 / 2))}


def test_many_wanted_terms_are_joined_rather_than_listed(spark, monkeypatch):
    docs = docs_of(spark, RANKING)
    wanted = spark.createDataFrame([(w,) for w in ("java", "search", "zzz")], "term string")
    few = sorted(map(tuple, I.LexicalIndex.of(docs, wanted).postings.select("term", "doc_id", "tf", "length").collect()))
    monkeypatch.setattr(I, "LISTED", 1)
    assert few == sorted(map(tuple, I.LexicalIndex.of(docs, wanted).postings.select("term", "doc_id", "tf", "length").collect())) and len(few) == 4


def test_dense_numbers(spark):
    from lexigrid.operators.scratch import numbered

    rows = numbered(spark.range(0, 5000, 3).repartition(7), "id", "n")
    assert [(r["id"], r["n"]) for r in rows.orderBy("id").collect()] == [(i, i // 3) for i in range(0, 5000, 3)]


def test_printed_results(spark, capsys):
    docs = docs_of(spark, RANKING)
    asked = spark.createDataFrame([("q", "java")], "query_id string, text string")
    S.print_results(S.search(asked, docs, "tfidf", top=2, documents=docs), F.col("text"))
    assert capsys.readouterr().out.splitlines()[0] == "1. doc1.txt  0.4055  [java]  Java is a programming language"


def test_english_is_the_default():
    assert A.analyzed.__kwdefaults__["normalizer"] is english


def test_postings_analyse_a_text_once(spark):
    rows = spark.createDataFrame([(1, "a bee sees a bee"), (None, "lost"), (3, None), (4, " ")], "doc_id long, text string")
    post = I.entries(I.forward(rows))
    assert post._jdf.queryExecution().optimizedPlan().toString().count("lower(text") == 1
    assert sorted(map(tuple, post.collect())) == [(1, 3, "bee", 2), (1, 3, "sees", 1)]


def test_similar_pairs_are_not_shuffled(spark):
    """Products are added within blocks: no aggregation of pairs; vectors of nothing, wanted ones and numbers as terms."""
    rows = [(d, f"t{t}", float(1 + (d * t) % 5)) for d in range(1, 60) for t in range(40) if t == 0 or (d * 7 + t * t) % 11 == 0] + [(99, "t0", 0.0)]
    vecs = spark.createDataFrame(rows, "doc_id long, term string, weight double")
    norms, wanted = V.norms(vecs), spark.createDataFrame([(5,), (50,), (1000,)], "doc_id long")
    by_doc = {d: {t: w for e, t, w in rows if e == d} for d in {r[0] for r in rows}}
    size = {d: math.sqrt(sum(w * w for w in v.values())) for d, v in by_doc.items()}
    score = {(a, b): sum(w * by_doc[b].get(t, 0.0) for t, w in by_doc[a].items()) / (size[a] * size[b]) for a in by_doc for b in by_doc if a != b and size[a] and size[b]}
    numbers = vecs.withColumn("term", F.substring("term", 2, 9).cast("long"))
    for found, expected in (
        (V.similar_documents(vecs, norms, threshold=0.5), {(a, b) for (a, b), s in score.items() if a < b and s > 0.5}),
        (V.similar_documents(numbers, norms, wanted, 0.5), {(a, b) for (a, b), s in score.items() if a in (5, 50) and s > 0.5}),
    ):
        assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
        got = {(r["doc_a"], r["doc_b"]): r["score"] for r in found.collect()}
        assert got.keys() == expected and all(math.isclose(got[p], score[p]) for p in got)


def test_block_products(monkeypatch):
    """Blocks of few vectors and entries, terms frequent and rare, against dense products."""
    import numpy as np
    import pyarrow as pa

    from lexigrid.operators import pairs as B

    made = np.random.default_rng(3)
    dense = made.random((50, 300)) * (made.random((50, 300)) < made.random(300) ** 4)
    rows = [{"doc_id": f"d{i}", "wanted": True if i % 3 == 0 else None, "norm": 2.0, "entries": [{"term": int(t), "weight": w[t]} for t in np.nonzero(w)[0]]} for i, w in enumerate(dense)]
    kind = pa.schema({"doc_id": pa.string(), "wanted": pa.bool_(), "norm": pa.float64(), "entries": pa.list_(pa.struct({"term": pa.int64(), "weight": pa.float64()}))})
    monkeypatch.setattr(B, "ENTRIES", 700), monkeypatch.setattr(B, "VECTORS", 20), monkeypatch.setattr(B, "AT_ONCE", 100)
    table = pa.Table.from_pylist(rows, kind).combine_chunks()
    blocks = list(B._blocks(iter([*table.slice(0, 30).to_batches(), *table.slice(30).to_batches()])))
    held = {s: [(b.column("ids")[0].values, *(b.column(n)[0].values.to_numpy() for n in ("terms", "docs", "weights"))) for b in blocks if b.column("side")[0].as_py() == s] for s in (0, 1)}
    assert len(held[0]) > 2 and sum(len(b[0]) for b in held[0]) == 50 and [i for b in held[1] for i in b[0].to_pylist()] == [f"d{i}" for i in range(0, 50, 3)]
    for a in held[1]:
        for b in held[0]:
            own, other = (dense[[int(i[1:]) for i in x[0].to_pylist()]] / 2 for x in (a, b))
            assert np.allclose(B._products(a, b), own @ other.T, atol=1e-12)


def test_vector_stage_counts_terms_once_and_stores_by_document(spark, tmp_path):
    """Frequencies are read by both stages, not counted anew; stored vectors come with their terms or by term_id; any weighter."""
    docs = spark.createDataFrame([(f"d{i}", f"w{i % 7} w{i % 5} same w{i % 7}") for i in range(60)], "doc_id string, text string").repartition(3)
    seen = []
    stage = lambda index, path: seen.append(index.frequency._jdf.queryExecution().optimizedPlan().toString())
    for n, weighter in enumerate((V.tfidf_weights, V.tf_weights)):
        I.build(docs, f"{tmp_path}/{n}", I.lexical_stage, V.vector_stage(weighter), stage, positions=False)
        vecs, norms = V.stored_vectors(spark, f"{tmp_path}/{n}")
        numbers, _ = V.stored_vectors(spark, f"{tmp_path}/{n}", terms=False)
        index = I.LexicalIndex.of(docs)
        expected = {(r["doc_id"], r["term"]): round(r["weight"], 9) for r in V.vectors(weighter(index.postings, index.frequency, index.statistics)).collect()}
        assert {(r["doc_id"], r["term"]): round(r["weight"], 9) for r in vecs.collect()} == expected
        assert numbers.count() == len(expected) and norms.count() == 60 and set(numbers.columns) == {"doc_id", "term_id", "weight"}
        files = numbers.select("doc_id", F.input_file_name().alias("f")).distinct().groupBy("doc_id").count()
        assert files.where("count > 1").count() == 0
    assert not any("Aggregate" in p for p in seen)


def test_streamed_files_grow_in_number(spark, tmp_path):
    """The stream's files are as many as the table is read in (three at least), so no task reads a third of the input."""
    from lexigrid.plans import workflows as W

    text = " ".join(f"word{i}" for i in range(300))
    spark.range(120).select(F.col("id").alias("doc_id"), F.lit(text).alias("text")).repartition(12).write.parquet(f"{tmp_path}/documents.parquet")
    shared = spark.conf.get("spark.checkpoint.dir").rstrip("/")
    from glob import glob

    before, size = set(glob(f"{shared}/arriving-*")), spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        assert {(r["term"], r["df"]) for r in W.ingest_streamed(spark, str(tmp_path)).collect()} == {(f"word{i}", 120) for i in range(300)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    (made,) = set(glob(f"{shared}/arriving-*")) - before
    assert len(glob(f"{made}/part-*.parquet")) >= 12
