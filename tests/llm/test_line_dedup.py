import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lexigrid.llm import line_dedup as D
from lexigrid.llm.queries import SQL, op9_line_dedup

from .helpers import DATA, clashing, frame


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def slow(rows, k=1, least=20):
    """(doc_id, pos) of the lines that go, by all pairs of different lines."""
    places = {}
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n") if t is not None else []):
            if len(line.strip(" ")) >= least:
                places.setdefault(line, set()).add((d is not None, d, i))
    names = list(places)
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if abs(len(a) - len(b)) <= k and distance(a, b) <= k:
                root[find(a)] = find(b)
    gone = set()
    for r in {find(x) for x in names}:
        own = sorted((p for x in names if find(x) == r for p in places[x]), key=lambda p: (p[0], p[1] or 0, p[2]))
        gone |= {p[1:] for p in own[1:]}
    return gone


def mutated(draw, line, edits):
    for _ in range(edits):
        p = draw.randrange(max(1, len(line)))
        line = draw.choice([line[:p] + line[p + 1 :], line[:p] + draw.choice("abé") + line[p:], line[:p] + draw.choice("xyü") + line[p + 1 :]])
    return line


def _rows(seed, n=30):
    draw = random.Random(seed)
    base = ["".join(draw.choice("ab é") for _ in range(draw.randrange(18, 40))) for _ in range(12)]
    return [(draw.randrange(50), "\n".join(mutated(draw, draw.choice(base), draw.choice([0, 0, 1, 1, 2, 3])) for _ in range(draw.randrange(1, 6)))) for _ in range(n)]


@pytest.mark.parametrize("seed,k,group", [(1, 1, 32), (2, 1, 2), (3, 1, 1), (4, 2, 32), (5, 3, 32), (6, 2, 3), (8, 3, 4)])
def test_equals_brute_force(spark, monkeypatch, seed, k, group):
    """Small limits force the lines through split groups and classes, which must connect as much as pairs."""
    monkeypatch.setattr(D.near_links, "__defaults__", (group,))
    rows = list({d: (d, t) for d, t in _rows(seed)}.values())
    got = {(r["doc_id"], r["pos"]) for r in D.dropped_lines(frame(spark, rows), threshold=k).collect()}
    assert got == slow(rows, k)


def test_edit_distance_is_exact_up_to_the_band(spark):
    draw = random.Random(6)
    pairs = []
    for _ in range(600):
        a = "".join(draw.choice("abé") for _ in range(draw.randrange(0, 14)))
        pairs.append((a, mutated(draw, a, draw.randrange(5)) if a else draw.choice(["", "a", "ab"])))
    rows = spark.createDataFrame(pairs, "a string, b string")
    for k in (1, 2, 3):
        for r in rows.where(F.abs(F.length("a") - F.length("b")) <= k).select("a", "b", D.edit_distance(F.col("a"), F.col("b"), k).alias("d")).collect():
            assert min(r["d"], k + 1) == min(distance(r["a"], r["b"]), k + 1), r


def test_close_lines_share_a_key(spark):
    draw = random.Random(7)
    pairs = [(a, mutated(draw, a, draw.randrange(k + 1)), k) for k in (1, 2, 3) for a in ("".join(draw.choice("abcd") for _ in range(draw.randrange(8, 30))) for _ in range(150))]
    for k in (1, 2, 3):
        rows = spark.createDataFrame([(a, b) for a, b, x in pairs if x == k], "a string, b string")
        keys = lambda c: F.transform(D.segment_keys(F.col(c), k), lambda x: x["key"])
        own = lambda c: F.transform(F.filter(D.segment_keys(F.col(c), k), lambda x: x["own"]), lambda x: x["key"])
        met = rows.select("a", "b", F.arrays_overlap(own("a"), keys("b")).alias("x"), F.arrays_overlap(own("b"), keys("a")).alias("y"))
        assert met.where("not x and not y").count() == 0


def test_edge_cases(spark):
    long = "x" * 150_000
    rows = [(3, "A line that comes again here.\nshort\n\nA line that comes again here!"), (1, "A line that comes again here."), (2, None), (4, ""), (5, "\n\n"), (1, "A line that comes again here."), (6, f"{long}\n{long}y"), (None, "Only null ids have this line here.\nz"), (7, "Only null ids have this line here.")]
    docs = clashing(frame(spark, rows), "pos", "line", "gone", "near", "node", "h", "g", "key")
    out = D.without_repeated_lines(docs)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()), key=str)
    expected = [(3, "short\n"), (1, rows[1][1]), (2, None), (4, ""), (5, "\n\n"), (1, rows[1][1]), (6, long), (None, rows[7][1]), (7, "")]
    assert got == sorted(((d, t, None if t is None else len(t)) for d, t in expected), key=str)
    report = {(r["doc_id"], r["n_lines"]): (r["n_dropped"], r["n_near"], r["dropped"]) for r in D.line_report(docs).collect()}
    assert report[3, 4] == (2, 1, "0,3") and report[2, 0] == (0, 0, "") and report[6, 2] == (1, 1, "1")
    assert D.line_report(frame(spark, [])).count() == 0 and D.without_repeated_lines(frame(spark, [])).count() == 0


def test_hot_lines_and_numbered_lines(spark):
    rows = [(i, f"The very same line in all of them.\nThis is page {i:04d} of the whole collection.") for i in range(500)]
    got = {(r["doc_id"], r["pos"]) for r in D.dropped_lines(frame(spark, rows)).collect()}
    # numbers next to each other in some digit chain all pages together
    assert got == {(i, p) for i in range(1, 500) for p in (0, 1)}


def test_long_hot_lines_and_documents_of_many_lines(spark):
    """Forty lines of 100,000 characters that share nearly all of them, and one document of 32,000 lines."""
    draw = random.Random(9)
    long = "".join(draw.choice("abcdefgh ") for _ in range(100_000))
    rows = [(0, long), *[(i, long[: 2000 * i] + draw.choice(["#", "", "##"]) + long[2000 * i + 1 :]) for i in range(1, 41)]]
    gone = {(r["doc_id"], r["pos"]) for r in D.dropped_lines(frame(spark, rows)).collect()}
    # "##" for one character is a replacement and an insertion, two edits from the first line
    assert gone == {(i, 0) for i, t in rows if i and len(t) <= len(long)}
    many = "\n".join(f"Line {i % 16_000 * 7919:012d} of a very long document" for i in range(32_000))
    out = D.without_repeated_lines(frame(spark, [(1, many)])).first()["text"].split("\n")
    assert len(out) <= 16_000 and out[0] == many.split("\n")[0]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    expected = con.execute(SQL["op9_line_dedup"])
    names = [d[0] for d in expected.description]
    assert sorted(map(tuple, op9_line_dedup(spark, DATA).select(*names).collect())) == sorted(expected.fetchall())
