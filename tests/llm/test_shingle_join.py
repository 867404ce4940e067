import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as C
from lexigrid.llm import shingle_join
from lexigrid.llm.shingle_join import HOT, shingle_sets, shingles, similar
from lexigrid.llm.simhash import fingerprint, one_of_each

from .helpers import DATA, clashing, documents, frame


def slow_set(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_kept(rows):
    """The ids that stay: the least of each component, links by fingerprint or by shingles."""
    prints = np.array([fingerprint(t) for _, t in rows], dtype=np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    sets = [slow_set(t) for _, t in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 5 * both >= 4 * len(a | sets[j]):
                near[i, j] = near[j, i] = True
    label = np.array([d for d, _ in rows])
    while True:
        new = np.where(near, label[None, :], 1 << 60).min(axis=1)
        if (new == label).all():
            return sorted(set(label.tolist()))
        label = new


def edited(draw, words, share):
    return [w if draw.random() > share else f"z{draw.randrange(10**9)}" for w in words]


def corpus():
    """Balls of near copies, one larger than HOT with copies unlike each other, a passage in many texts, chains, copies."""
    draw, texts = random.Random(3), []
    word = lambda: f"w{int(draw.paretovariate(0.6)) % 5000}"
    for size, share in ((3 * HOT, 0.02), (6, 0.01), (10, 0.03), (2, 0.005)):
        base = [word() for _ in range(120)]
        texts += [" ".join(edited(draw, base, share)) for _ in range(size)]
    passage = [word() for _ in range(60)]
    texts += [" ".join([word() for _ in range(draw.choice((10, 30, 60)))] + passage) for _ in range(2 * HOT)]
    chain = [word() for _ in range(200)]
    for _ in range(8):
        at = draw.randrange(190)
        chain = chain[:at] + [word() for _ in range(3)] + chain[at + 3 :]
        texts.append(" ".join(chain))
    texts += ["a b c d e", "A b c D e", "a b c d", "a b c d f", "", "x", " ".join(chain).upper()]
    texts += [" ".join(word() for _ in range(draw.randrange(1, 80))) for _ in range(60)]
    texts += texts[:5]
    draw.shuffle(texts)
    return list(enumerate(texts))


def test_sets():
    for text in (None, "", "one", "One TWO", "a b c d e f a b c d e f", "x y\x85z a b c", "w " * 100_000):
        assert len(shingles(text)) == len(slow_set(text))
    a = np.arange(9, dtype=np.int64)
    assert similar(a, a[:8]) and not similar(a, a[:7]) and not similar(a[:0], a[:0])


def test_sets_of_many_texts(monkeypatch):
    monkeypatch.setattr(shingle_join, "BLOCK", 200)  # words and texts cross blocks, and some words are longer than one
    draw = random.Random(3)
    parts = ["a", "b", " ", "\n\t ", "Z\xe9", "x" * 60, "y" * 300, "z" * 5000, "q w e"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(50))) for _ in range(200)]
    texts += [t + " b a b" for t in texts] + [None, "", " "]
    found, slow = shingle_sets(texts), [slow_set(t) for t in texts]
    for i, text in enumerate(texts):
        assert len(found[i]) == len(slow[i]) and (found[i] == shingles(text)).all()
        j = (i + 200) % len(texts)
        assert len(np.intersect1d(found[i], found[j])) == len(slow[i] & slow[j])


def test_kept_equals_all_pairs(spark):
    rows = corpus()
    out = one_of_each(frame(spark, rows), similar=True)
    assert sorted(r[0] for r in out.select("doc_id").collect()) == slow_kept(rows)
    assert len(slow_kept(rows)) < len({r[0] for r in one_of_each(frame(spark, rows)).select("doc_id").collect()})


def test_sketches_bound_the_difference():
    draw = np.random.default_rng(5)
    for n, shared in ((0, 0), (1, 0), (40, 35), (700, 600), (5000, 10)):
        both = np.unique(draw.integers(-(2**63), 2**63, shared, dtype=np.int64))
        a, b = (np.unique(np.concatenate([both, draw.integers(-(2**63), 2**63, n - shared, dtype=np.int64)])) for _ in "ab")
        bits = int(np.bitwise_count((shingle_join.sketch(a) ^ shingle_join.sketch(b)).view(np.uint64)).sum())
        assert len(shingle_join.sketch(a)) == shingle_join.SKETCH and bits <= len(np.setxor1d(a, b)) and (shared or n < 2 or bits)


def test_texts_unlike_each_other_are_not_read(spark, monkeypatch):
    """Texts of ten passages out of 40, each in more texts than a group holds: no pair gets as far as the texts."""
    draw, asked, confirm = random.Random(4), [], shingle_join._confirm
    passages = [" ".join(f"p{i}w{j}" for j in range(40)) for i in range(40)]
    rows = [(i, " ".join(draw.sample(passages, 10))) for i in range(6 * HOT)]
    monkeypatch.setattr(shingle_join, "_confirm", lambda pairs, texts: (asked.append(pairs.count()), confirm(pairs, texts))[1])
    assert one_of_each(frame(spark, rows), similar=True).count() == len(rows)
    assert len(asked) > 2 and sum(asked) == 0


def test_few_and_many_edges_connect_alike(spark, monkeypatch):
    draw = random.Random(6)
    pairs = [(draw.randrange(60), draw.randrange(60)) for _ in range(40)]
    edges = spark.createDataFrame([(a, b) for a, b in pairs if a != b], "a long, b long")
    labels = spark.createDataFrame([(1000 + i, i) for i in range(60)], "node long, root long")
    few = {tuple(r) for r in shingle_join._relabelled(labels, edges).collect()}
    monkeypatch.setattr(shingle_join, "FEW", 0)
    assert few == {tuple(r) for r in shingle_join._relabelled(labels, edges).collect()} and len(few) == 60 > len({r for _, r in few})


def test_stage_links_similar_texts(spark):
    docs = documents(spark)
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    out = C.near_duplicates(spark, docs, DATA)
    assert out.columns == docs.columns and sorted(r[0] for r in out.select("doc_id").collect()) == slow_kept(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "t " * 9), (3, "b a " * 30_000), (4, "b a " * 30_001), (3, "b a " * 30_000), (5, "q r s t u v w"), (6, "q r s t u v w"), (5, "another text of six words")]
    out = one_of_each(clashing(frame(spark, rows), "node", "root", "t"), similar=True)
    kept = sorted((r[0] is None, r[0] or 0, len(r[1] or "")) for r in out.select("doc_id", "text").collect())
    assert kept == [(False, 1, 0), (False, 3, 120_000), (False, 5, 13), (False, 5, 25), (True, 0, 18)]
    assert one_of_each(frame(spark, []), similar=True).count() == 0
    assert out.where(F.col("t") == "clash").count() == 5
