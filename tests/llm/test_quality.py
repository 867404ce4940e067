import random
import re

from lexigrid.llm import quality as Q
from lexigrid.llm.queries import op5_quality

from .helpers import DATA, clashing, frame, texts


def slow(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    duplicates = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, len(covered)


def test_measurements_equal_brute_force():
    draw = random.Random(3)
    for _ in range(300):
        text = "".join(draw.choice(["a", "b", "é", "c", " ", " ", "\n", "#", "\t", "\x85", " a b c "]) for _ in range(draw.randrange(60)))
        found = Q.measure(text)
        assert found[:5] == slow(text)
        assert bool(found[5] & 1) == (found[0] < 50) and bool(found[5] & 2) == (100 * found[4] > 50 * found[0])


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "word " * 300_000), (4, "word " * 300_000), (None, "a b c")]
    out = {(r["doc_id"], r["n_words"]): r for r in Q.verdicts(Q.ledger(clashing(frame(spark, rows), "failed", "kept", "policy"))).collect()}
    assert all(out[d, 0]["failed"] == 1 and not out[d, 0]["kept"] and out[d, 0]["base_failed"] for d in (1, 2, 3))
    assert out[4, 300_000]["n_repeat_words"] == 300_000 and out[4, 300_000]["base_failed"]
    assert (None, 3) in out
    assert Q.ledger(frame(spark, [])).count() == 0


def test_policies_and_ablations(spark):
    prose = " ".join(f"word{i}" for i in range(60)) + "."
    rows = [(1, prose), (2, prose.replace(" ", " ## ")), (3, "a few short words end here."), (4, "\n".join(f"{prose} line{i}." for i in range(3)))]
    ledger = Q.ledger(frame(spark, rows)).cache()
    kept = {v: {r["doc_id"] for r in Q.verdicts(ledger, v).where("kept").collect()} for v in (1, 2)}
    assert kept == {1: {1, 2}, 2: {1}} and slow(rows[3][1])[4] > 0
    found = {r["rule"]: (r["fails"], r["alone"], r["words_alone"]) for r in Q.ablations(ledger).collect()}
    assert found["symbols"] == (1, 1, 119) and found["few_words"][:2] == (1, 1) and found["repeated_windows"][:2] == (1, 1)
    # an ablation is what dropping the rule would bring back
    policy = Q.POLICIES[2]
    without = Q.Policy(9, tuple(r for r in policy.rules if r != "symbols"), policy.soft, policy.tolerated)
    assert Q.verdicts(ledger, without).where("kept").count() - Q.verdicts(ledger, policy).where("kept").count() == 1
    assert Q.ablations(ledger.limit(0)).where("fails <> 0 or alone <> 0 or words_alone <> 0").count() == 0


def test_query(spark):
    got = {r["doc_id"]: r for r in op5_quality(spark, DATA).collect()}
    by = texts(spark)
    assert set(got) == set(by)
    for doc, text in by.items():
        if len(text) < 4000:
            r = got[doc]
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == slow(text)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    good = [got[d] for d, q in labels.items() if q == 1 and not got[d]["base_failed"]]
    assert all(r["kept"] for r in good)


def test_soft_rules_have_ablations(spark):
    prose = " ".join(f"word{i}" for i in range(60))
    rows = [(1, prose), (2, "\n".join(f"- {prose} {i}" for i in range(1))), (3, prose + " ...")]
    ledger = Q.ledger(frame(spark, rows)).cache()
    policy = Q.POLICIES[2]
    kept = lambda p: {r["doc_id"] for r in Q.verdicts(ledger, p).where("kept").collect()}
    found = {r["rule"]: (r["fails"], r["alone"]) for r in Q.ablations(ledger).collect()}
    assert list(found) == [*policy.rules, *policy.soft] and kept(policy) == {1, 3}
    for name in policy.soft:
        without = Q.Policy(9, policy.rules, tuple(r for r in policy.soft if r != name), policy.tolerated)
        assert found[name][1] == len(kept(without) - kept(policy)), name
    assert found["no_sentence"] == (2, 1) and found["bullet_lines"] == (1, 1) and found["ellipsis_lines"] == (1, 0)
