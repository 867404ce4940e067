import pytest
from pyspark.sql import functions as F

from lexigrid.llm import mixing as M
from lexigrid.llm.queries import op4_mixing

from .helpers import DATA, clashing, frame, texts


def slow_targets(sizes):
    """Excess over twice the size is dealt out again, by weight, until no source is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, budget = set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        rest = budget - sum(2 * sizes[s] for s in capped)
        target = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return {**{s: 2 * sizes[s] for s in capped}, **target}
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 1000, "b": 10, "c": 10}, {"b": 7, None: 900, "é": 50, "z": 0}, {"a": 5, "b": 5, "c": 500, "d": 20, "e": 3, "f": 90}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_docs long")
    got = {r["source"]: r["target"] for r in M.targets(rows).collect()}
    assert got == {s: pytest.approx(t) for s, t in slow_targets(sizes).items()}


def _rows():
    return [(i, " ".join(["w"] * (i % 37)), "en", ("hot" if i % 3 else f"s{i % 5}") if i % 11 else None) for i in range(400)]


def test_mix_reaches_targets_and_reruns_agree(spark):
    docs = clashing(frame(spark, _rows()), "size", "target", "nth", "order", "bucket", "start", "copy", "digest")
    out = M.mix(docs, block=16)
    rows = out.collect()
    assert len(rows) == 400 and sorted(map(str, rows)) == sorted(map(str, M.mix(docs.repartition(7), block=16).collect()))
    source = {d: s for d, _, _, s in _rows()}
    sums = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["size"] == r["doc_id"] % 37
        total = sums.setdefault(source[r["doc_id"]], [0, 0, r["target"], r["source_size"]])
        total[0] += r["taken"]
        total[1] += r["size"]
    for taken, size, target, source_size in sums.values():
        assert abs(taken - target) <= 0.5 and size == source_size
    assert {s: pytest.approx(x[2]) for s, x in sums.items()} == slow_targets({s: x[1] for s, x in sums.items()})


def test_block_length_only_changes_the_schedule(spark):
    docs = frame(spark, _rows())
    taken = [sorted((r["doc_id"], r["taken"]) for r in M.mix(docs, block=b).collect()) for b in (7, 4096)]
    assert taken[0] == taken[1]


def test_schedule_is_spread_evenly(spark):
    sizes = spark.createDataFrame([("a", 60_000, 1), ("b", 60_000, 1), ("c", 60_000, 1), ("tiny", 3, 1)], "source string, source_size long, n_docs long")
    plan = M.targets(sizes).cache()
    slots = M.schedule(plan, 64).orderBy("slot").collect()
    need = {r["nth"]: -(-r["target"] // 64) for r in plan.collect()}
    for nth, n in need.items():
        own = [s["rank"] for s in slots if s["nth"] == nth]
        assert sorted(own) == list(range(int(n)))
    assert len({s["slot"] for s in slots}) == len(slots)
    share = need[1] / sum(need.values())
    for upto in range(200, len(slots), 200):
        assert abs(sum(s["nth"] == 1 for s in slots[:upto]) - share * upto) < 8


def slow_schedule(plan, block):
    """{(nth, rank): slot} by walking through the golden-ratio points one by one."""
    rows = sorted((r["nth"], r["low"], r["high"], -int(-r["target"] // block)) for r in plan)
    n, found, slots = sum(r[3] for r in rows), {r[0]: 0 for r in rows}, {}
    for i in range(n):
        point = i * M.STEP % M.SPAN
        for nth, low, high, most in rows:
            if low * M.SPAN <= point < high * M.SPAN:
                if found[nth] < most:
                    slots[nth, found[nth]] = i
                found[nth] += 1
    left = sorted((rank, nth) for nth, _, _, most in rows for rank in range(found[nth], most))
    return slots | {(nth, rank): n + i for i, (rank, nth) in enumerate(left)}


def test_slots_equal_brute_force_and_reach_the_result(spark, monkeypatch):
    sizes = spark.createDataFrame([("a", 900, 1), ("b", 777, 1), (None, 50, 1), ("d", 3, 1)], "source string, source_size long, n_docs long")
    plan = M.targets(sizes).cache()
    assert {(r["nth"], r["rank"]): r["slot"] for r in M.schedule(plan, 16).collect()} == slow_schedule(plan.collect(), 16)
    docs = frame(spark, _rows())
    before = {r["doc_id"]: r for r in M.mix(docs, block=16).collect()}
    assert all(r["slots"] == sorted(r["slots"]) and r["first_slot"] == r["slots"][0] <= r["last_slot"] for r in before.values() if r["taken"])
    assert all(r["slots"] is None and r["first_slot"] is None for r in before.values() if not r["taken"])
    order = [r["doc_id"] for r in M.mixed_documents(docs, block=16).collect()]
    passes, seen = {}, []
    for d in order:
        passes[d] = passes.get(d, -1) + 1
        seen.append(before[d]["slots"][passes[d]])
    assert seen == sorted(seen) and len(seen) == sum(len(r["slots"]) for r in before.values() if r["taken"])
    monkeypatch.setattr(M, "STEP", 1)  # another schedule: the same words, in other slots
    after = {r["doc_id"]: r for r in M.mix(docs, block=16).collect()}
    assert {d: r["taken"] for d, r in after.items()} == {d: r["taken"] for d, r in before.items()} and {d: r["first_slot"] for d, r in after.items()} != {d: r["first_slot"] for d, r in before.items()}


def test_points_come_round_again(spark, monkeypatch):
    monkeypatch.setattr(M, "SPAN", 1 << 12)
    monkeypatch.setattr(M, "STEP", 2531)
    sizes = spark.createDataFrame([("a", 60_000, 1), ("b", 60_000, 1)], "source string, source_size long, n_docs long")
    plan = M.targets(sizes).cache()
    assert {(r["nth"], r["rank"]): r["slot"] for r in M.schedule(plan, 16).collect()} == slow_schedule(plan.collect(), 16)


def test_a_document_taken_very_often(spark):
    """More passes than any fixed number; each is a row."""
    out = M.mixed_documents(frame(spark, [(1, "a b c", "en", "s"), (2, "w " * 5000, "en", "t")]), most=100.0, share=90.0, weights=(1.0, 1.0))
    assert out.where("doc_id = 1").count() == 100


def test_edge_cases(spark):
    assert M.mix(frame(spark, [])).count() == 0
    rows = M.mix(frame(spark, [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \t", "en", None)])).collect()
    assert sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in rows) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0), (3, 0, 0, 0.0, 0)]
    rows = M.mix(frame(spark, [(1, "a b", "en", "s"), (1, "a b", "en", "s"), (None, "c d", "en", "s"), (2, "w " * 100_000, "en", "s")])).collect()
    assert len(rows) == 4 and sum(r["taken"] for r in rows) == 150_009


def test_mixed_documents(spark):
    docs = clashing(frame(spark, _rows()), "copy", "full")
    out = M.mixed_documents(docs, block=16)
    assert out.columns == docs.columns and out.where("n_chars <> length(text)").count() == 0
    words = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.sum(M.word_count(F.col("text"))).alias("n")).collect()}
    assert words == {r["doc_id"]: r["taken"] for r in M.mix(docs, block=16).collect() if r["taken"]}
    cut = M.mixed_documents(frame(spark, [(1, " a\nb  c d\te f g h", "en", "s")]))
    assert sorted(r["text"] for r in cut.collect()) == [" a\nb  c d", " a\nb  c d\te f g h"]


def _exchanged(plan):
    """Column names of each exchange of a plan that hasn't run."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return _exchanged(plan.initialPlan())
    below, own = plan.children(), plan.output()
    found = [{own.apply(i).name() for i in range(own.length())}] if plan.nodeName() == "Exchange" else []
    return found + [x for i in range(below.length()) for x in _exchanged(below.apply(i))]


def test_texts_are_dealt_out_twice(spark):
    """Once to meet their plan, once into the order of the slots: a third time is beyond the disk that is allowed."""
    docs = M.mixed_documents(frame(spark, _rows()), block=16)
    assert sum(bool({"text", "__text"} & names) for names in _exchanged(docs._jdf.queryExecution().executedPlan())) == 2


def test_rows_of_one_id(spark):
    """Equal rows, rows that differ in source or text only, without an id: each has its own passes."""
    rows = [(1, "a b", "en", "s"), (1, "a b", "en", "s"), (1, "a b", "en", "t"), (1, "c d e", "en", "t"), (None, "f g", "en", None), (None, "f g", "en", None), (None, None, "en", None), (None, "h " * 30, "en", "s")]
    docs = frame(spark, rows)
    got, taken = {}, sum(r["taken"] for r in M.mix(docs, block=4).collect())
    for r in M.mixed_documents(docs, block=4).collect():
        got.setdefault((r["doc_id"], r["source"], r["text"][:1]), []).append(len(r["text"].split()))
    sizes = {}
    for d, text, _, source in rows:
        if text:
            sizes.setdefault((d, source, text[:1]), []).append(len(text.split()))
    assert sum(map(sum, got.values())) == taken and all(sum(n) <= 2 * sum(sizes[k]) and max(n) <= max(sizes[k]) for k, n in got.items())


def test_query(spark):
    got = op4_mixing(spark, DATA)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken", "first_slot", "last_slot"]
    assert {r["doc_id"] for r in got.collect()} == set(texts(spark))
