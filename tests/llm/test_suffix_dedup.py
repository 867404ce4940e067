import hashlib
import random

import numpy as np
import pytest

from lexigrid.llm import suffix_dedup as S
from lexigrid.llm.queries import op7_suffix_dedup

from .helpers import DATA, clashing, frame, texts


def slow(rows):
    """n_bytes, n_removed, n_spans, kept for (doc_id, text) by looking at every window."""
    first, out = {}, []
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            if d is not None:
                first[b[p : p + 50]] = min(d, first.get(b[p : p + 50], d))
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if d is not None and first[b[p : p + 50]] < d:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), sum(bool(x) for x in bytes(gone).split(b"\0")), kept))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in df.collect()), key=str)


def _texts(seed, n=60, words=("ab", "c", "é", "dd", "the", "xyz")):
    draw = random.Random(seed)
    passages = [" ".join(draw.choice(words) for _ in range(draw.randrange(5, 60))) for _ in range(6)]
    return [(i, " ".join(draw.choice([*passages, " ".join(draw.choice(words) for _ in range(20)), str(draw.random())]) for _ in range(draw.randrange(0, 6)))) for i in draw.sample(range(1000), n)]


@pytest.mark.parametrize("seed,run_bytes,bucket_bytes,fan,hot", [(1, 1 << 20, 1 << 20, 64, 1 << 14), (2, 2000, 2000, 64, 1 << 14), (3, 500, 700, 4, 1 << 14), (4, 4000, 1000, 2, 30), (5, 1000, 1000, 3, 3)])
def test_equals_brute_force(spark, seed, run_bytes, bucket_bytes, fan, hot):
    """One level of exchange and several, grams merged as suffixes and hot ones settled by windows."""
    rows = _texts(seed) + [(2000 + seed, "aaaa" * 60), (3000, "aaaa" * 40 + "b"), (2500, "x" * 49), (2501, "x" * 49), (2502, "x" * 50), (2503, "x" * 50)]
    assert got(S.suffix_dedup(frame(spark, rows), run_bytes=run_bytes, bucket_bytes=bucket_bytes, fan=fan, hot=hot, with_kept=True)) == slow(rows)


def test_repeated_ids_with_different_texts(spark):
    """Each row is cut by itself, whatever others have its doc_id."""
    passage = "A passage of well over fifty bytes that document one has had before all the others. "
    rows = [(1, passage + "One."), (5, "Words of the first row five. " + passage), (5, "Words of the second row five, which are of its own and over fifty bytes in all, one hundred and some."), (5, passage * 2), (None, passage)]
    assert got(S.suffix_dedup(frame(spark, rows), with_kept=True)) == slow(rows)


def test_hot_gram_in_very_many_contexts(spark):
    """A phrase too short for a match stands in other words in each document; a few share more."""
    rows = [(i, f"Number {i % 290:05d} says: the very common phrase of them all, and so {(i % 290) * 7919 % 100_003:06d} more.") for i in range(300)]
    for hot in (20, 1 << 14):
        assert got(S.suffix_dedup(frame(spark, rows), run_bytes=3000, bucket_bytes=3000, fan=3, hot=hot, with_kept=True)) == slow(rows)


def test_messages_are_in_proportion_to_runs():
    for runs in (100, 10_000, 1_000_000, 100_000_000):
        shape = S.Shape(runs, runs // 2, 64)
        assert 64 ** (shape.levels - 1) < runs // 2 <= 64**shape.levels
        # a run sends to 64 nodes at most, and a node of any level hears from few: of level 1 from 64 runs
        assert {int(shape.codes(np.array([(1 << 40) - 1], np.uint64), 1)[0])} <= set(range(64))
        top = shape.node(3, 129, 1)
        assert top == (3 << 32 | (129 // 64 if shape.levels > 1 else 0))


def test_a_long_document_next_to_short_ones(spark):
    draw = random.Random(5)
    long = "".join(draw.choice("abcdefgh ") for _ in range(300_000))
    rows = [(1, long[1000:1100]), (2, long), (3, long[:200_000] + "!" + long[200_000:]), (4, "x" + long[250_000:250_060])]
    assert got(S.suffix_dedup(frame(spark, rows), run_bytes=1 << 16, bucket_bytes=1 << 15, fan=4, with_kept=True)) == slow(rows)


def test_edge_cases(spark):
    passage = "This passage of more than fifty bytes repeats in several documents."
    rows = [(1, None), (2, ""), (5, passage), (5, passage), (3, "before " + passage), (None, passage + passage), (9, passage * 3000), (8, "short")]
    out = S.suffix_dedup(clashing(frame(spark, rows), "node", "blob", "covers", "kept"), with_kept=True)
    assert got(out) == slow(rows)
    assert S.suffix_dedup(frame(spark, [])).count() == 0 and S.suffix_dedup(frame(spark, [(1, None)])).count() == 1


def test_passage_in_very_many_documents(spark):
    rows = [(i, f"{i} own words here. " + "A passage that every second document holds, word for word, to its end. " * (i % 2) + f"tail {i * 7}") for i in range(600)]
    assert got(S.suffix_dedup(frame(spark, rows), run_bytes=3000, with_kept=True)) == slow(rows)


def test_loser_tree_and_front_coding():
    draw = random.Random(8)
    runs = []
    for k in range(7):
        items = sorted({bytes(draw.choice(b"ab") for _ in range(draw.randrange(1, 12))) for _ in range(draw.randrange(0, 40))})
        runs.append([(s, b"l%d" % k, [(i, 1, 2, i)]) for i, s in enumerate(items)])
    merged = list(S.LoserTree([S.decoded(S.front_coded(r)) for r in runs]))
    assert [m[0] for m in merged] == sorted(s for r in runs for s, _, _ in r)
    for before, now in zip(merged, merged[1:]):
        assert now[3] == S._common(before[0], now[0])
    for run, rows in enumerate(runs):
        assert [(m[0], m[1], m[2]) for m in merged if m[4] == run] == rows
    assert list(S.LoserTree([])) == []


def test_every_window_has_its_anchor():
    import pyarrow as pa

    text = "".join(random.Random(4).choice("abc de") for _ in range(5000))
    run = S.Run([7], pa.array([text]))
    r = run.records()
    anchor, first, last = r["anchor"], r["first"], r["last"]
    starts = [p for a, b in zip(first.tolist(), last.tolist()) for p in range(a, b + 1)]
    assert starts == list(range(5000 - 49))
    assert all(b <= a <= f + S.SPREAD for a, f, b in zip(anchor.tolist(), first.tolist(), last.tolist()))


def test_query(spark):
    expected = [(d, n, r, s, hashlib.sha256(k).hexdigest()) for d, n, r, s, k in slow(sorted(texts(spark).items()))]
    found = [tuple(r) for r in op7_suffix_dedup(spark, DATA).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
