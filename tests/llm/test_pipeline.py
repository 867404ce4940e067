import importlib
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from lexigrid.llm.common import shared_dir
from lexigrid.llm.packing import default_tokenizer, token_ids
from lexigrid.llm.simhash import fingerprint

from .helpers import DATA, clashing, documents, frame
from .test_line_dedup import slow as gone_lines
from .test_mixing import slow_targets
from .test_packing import exact
from .test_simhash import slow_components


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_each_stage_on_what_the_one_before_kept(spark):
    """language, lines, near duplicates, mixture, packing: each against brute force on its own input."""
    docs = documents(spark).limit(120).cache()
    columns = docs.columns
    stages = dict(C.STAGES)
    first = stages["language"](spark, docs, DATA).cache()
    assert first.columns == columns and {d for d, t in rows_of(docs) if t and re.search(r"[^\W\d_]", t)} == {d for d, _ in rows_of(first)}

    second = stages["lines"](spark, first, DATA).cache()
    gone = gone_lines(rows_of(first))
    expected = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in rows_of(first)}
    assert second.columns == columns and dict(rows_of(second)) == expected

    third = stages["near_duplicates"](spark, second, DATA).cache()
    ids = [d for d, _ in rows_of(second)]
    components = slow_components(ids, [fingerprint(t) for _, t in rows_of(second)])
    assert third.columns == columns and sorted(d for d, _ in rows_of(third)) == sorted(set(components.values()))

    fourth = stages["mixture"](spark, third, DATA).cache()
    count = lambda df: {r["source"]: r["n"] for r in df.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).collect()}
    sizes, taken = count(third), count(fourth)
    assert fourth.columns == columns and fourth.groupBy("doc_id").count().where("count > 2").count() == 0
    assert {s: pytest.approx(t, abs=0.51) for s, t in slow_targets(sizes).items()} == taken

    fifth = stages["packed"](spark, fourth, DATA).collect()
    assert sum(r["length"] for r in fifth) == sum(len(token_ids(t, *default_tokenizer())) for _, t in rows_of(fourth))
    assert {r["doc_id"] for r in fifth} == {d for d, _ in rows_of(fourth)}
    assert len(exact("a")) == 2


def test_run_equals_the_stages_one_by_one(spark, tmp_path):
    docs = documents(spark)
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.agg(F.sum("length")).first() == C.run(spark, DATA).agg(F.sum("length")).first()


@pytest.mark.parametrize("name", [n for n, _ in C.STAGES])
def test_stages_take_odd_tables(spark, name):
    stage = dict(C.STAGES)[name]
    rows = [(1, "Some plain English text to keep.", "en", "a"), (2, None, "en", None), (3, "", None, "a"), (1, "Some plain English text to keep.", "en", "a"), (None, "A document without an id.", "en", "b"), (4, "Wort " * 20_000, "de", "a")]
    docs = clashing(frame(spark, rows), "size", "fp", "pos", "copy")
    out = stage(spark, docs, DATA)
    assert out.count() >= 3
    if name != C.STAGES[-1][0]:
        assert out.columns == docs.columns
    assert stage(spark, frame(spark, []), DATA).count() == 0


@pytest.mark.parametrize("name", ["lines", "near_duplicates", "mixture"])
def test_stages_leave_one_table(spark, name):
    """What a stage has written on its way goes as soon as it is done, rather than when the driver ends."""
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    out = dict(C.STAGES)[name](spark, documents(spark), DATA)
    assert len(set(folder.iterdir()) - before) == 1 and out.count() > 100


def test_registered():
    from lexigrid.llm.queries import QUERIES, SQL

    assert "pipeline" in QUERIES and "pipeline" not in SQL and C.ORACLE_SQL is None
    assert 4 <= len(C.STAGES) <= 5 and importlib.import_module("__spark_entry__").queries().keys() >= QUERIES.keys()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 11))
