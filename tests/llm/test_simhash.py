import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexigrid.llm.common import components
from lexigrid.llm.queries import op3_simhash
from lexigrid.llm.simhash import fingerprint, links, one_of_each, simhash, trie_components

from .helpers import DATA, clashing, frame, texts


def slow_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, prints):
    a = np.array(prints, dtype=np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 4
    label = np.array(ids)
    while True:
        new = np.where(near, label[None, :], 1 << 60).min(axis=1)
        if (new == label).all():
            return dict(zip(ids, label.tolist()))
        label = new


def test_fingerprints():
    for text in (None, "", " \n", "one", "One TWO", "ÄÖ a b c d É", "a b c d e f g " * 50, "x y\x85z a b c", "w " * 300_000, "a\tb\x0bc\x0cd\re"):
        assert fingerprint(text) == slow_fingerprint(text)
    assert fingerprint("the quick brown fox") == xxhash.xxh64_intdigest(b"the quick brown fox", 42)


@pytest.mark.parametrize("n,flips", [(2, 3), (60, 6), (500, 7), (1500, 5)])
def test_trie_equals_all_pairs(n, flips):
    draw = random.Random(n)
    base = [draw.getrandbits(64) for _ in range(n // 5 + 1)]
    keys = set()
    for _ in range(n):
        k = draw.choice(base)
        for _ in range(draw.randrange(flips)):
            k ^= 1 << draw.randrange(64)
        keys.add(k)
    keys = np.array(sorted(keys), dtype=np.uint64)
    expected = slow_components(list(range(len(keys))), keys)
    assert trie_components(keys, 4).tolist() == list(expected.values())


def test_large_ball_costs_no_pairs():
    draw = np.random.default_rng(1)
    keys = np.unique(np.bitwise_xor.reduce(np.uint64(1) << draw.integers(0, 51, (30_000, 3)).astype(np.uint64), axis=1))
    assert set(trie_components(keys, 4, 51).tolist()) == {0}


@pytest.mark.parametrize("hot", [1 << 16, 40, 5])
def test_links_connect_what_all_pairs_would(spark, hot):
    """Also where groups are split by blocks of their remaining bits."""
    draw = random.Random(5)
    keys = set()
    for _ in range(60):
        k = draw.getrandbits(64)
        for _ in range(draw.randrange(1, 6)):
            keys.add(k)
            for _ in range(draw.randrange(1, 6)):
                k ^= 1 << draw.randrange(64)
    keys |= {(0xABC << 52) | draw.getrandbits(8) for _ in range(100)}  # one group of the first block
    keys = sorted(keys)
    signed = [k - (1 << 64) if k >> 63 else k for k in keys]
    roots = {r["node"]: r["root"] for r in components(links(spark.createDataFrame([(k,) for k in signed], "fp long"), hot=hot)).collect()}
    expected = slow_components(list(range(len(keys))), keys)
    groups = {}
    for i, k in enumerate(signed):
        groups.setdefault(roots.get(k, k), set()).add(expected[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(expected.values()))


def test_one_row_of_each_group_stays(spark):
    """Two documents of one id that aren't alike both stay; of repeated rows one does."""
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (1, "quite another text with other words in it"), (5, "unlike all of these but alone in it"), (5, "unlike all of these but alone in it"), (None, "a b c d e f g h")]
    got = sorted(((r["doc_id"], r["text"]) for r in one_of_each(frame(spark, rows)).collect()), key=str)
    assert got == sorted([rows[0], rows[2], rows[3], rows[5]], key=str)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (7, 3), (None, 4), (6000, 6001), (6001, 6000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}, 6000: 6000, 6001: 6000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edge_cases(spark):
    rows = [(3, "a b c d e"), (1, None), (2, ""), (9, " \t"), (4, "a  B c\nD e"), (4, "a b c d e"), (None, "zzz"), (8, "x " * 50_000)]
    out = simhash(clashing(frame(spark, rows), "fp", "n", "root", "component_id"))
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in out.collect()), key=str)
    assert got == sorted([(3, 3, True), (1, 1, True), (2, 1, False), (9, 1, False), (4, 3, False), (4, 3, False), (None, None, True), (8, 8, True)], key=str)
    assert {r["fingerprint"] for r in out.where("component_id = 1").collect()} == {"0" * 16}
    assert simhash(frame(spark, [])).count() == 0
    kept = one_of_each(frame(spark, [*rows, (3, "a b c d e")]))
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 3, 8, None] and kept.columns == frame(spark, []).columns


def test_query(spark):
    by = texts(spark)
    prints = [slow_fingerprint(t) for t in by.values()]
    expected = slow_components(list(by), prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op3_simhash(spark, DATA).collect()}
    assert got == {d: (f"{p:016x}", expected[d]) for d, p in zip(by, prints)}


def test_similar_texts_meet(spark):
    base = " ".join(f"word{i}" for i in range(600))
    rows = [(1, base), (2, base.replace("word300", "other")), (3, " ".join(f"else{i}" for i in range(600)))]
    out = {r["doc_id"]: r["component_id"] for r in simhash(frame(spark, rows)).where(F.col("doc_id") > 0).collect()}
    assert out == {1: 1, 2: 1, 3: 3}
