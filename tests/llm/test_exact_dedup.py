import hashlib

import pytest

from lexigrid.llm.exact_dedup import exact_dedup, read_state, update_state
from lexigrid.llm.queries import op1_exact_dedup

from .helpers import DATA, clashing, frame, saved, texts

ROWS = [(1, "same"), (5, "same"), (3, "other"), (4, None), (2, ""), (6, "long " * 200_000), (7, "long " * 200_000), (None, "same"), (8, "Same")]


def brute(rows):
    out = []
    for doc, text in rows:
        group = [d for d, t in rows if (t or "") == (text or "")]
        out.append((doc, max((d for d in group if d is not None), default=None), len(group), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("bits", [256, 4])
def test_equals_brute_force(spark, tmp_path, bits):
    """With a digest of 4 bits nearly all texts collide, and only their bytes tell them apart."""
    path = saved(spark, clashing(frame(spark, ROWS), "keep_id", "digest", "salt", "row", "text_sha256"), tmp_path / "d")
    out = exact_dedup(spark, path, digest_bits=bits)
    assert got(out) == brute(ROWS)
    assert sorted((r["doc_id"] for r in out.where("kept").collect()), key=str) == [3, 4, 5, 7, 8]


def test_repeated_rows_keep_one(spark, tmp_path):
    path = saved(spark, frame(spark, [(1, "a"), (1, "a"), (1, "a")]), tmp_path / "d")
    rows = exact_dedup(spark, path).collect()
    assert [r["group_size"] for r in rows] == [3, 3, 3] and sum(r["kept"] for r in rows) == 1


def test_hot_text_is_spread(spark, tmp_path):
    rows = [(i, "hot" if i % 2 else f"t{i}") for i in range(3000)]
    assert got(exact_dedup(spark, saved(spark, frame(spark, rows).repartition(8), tmp_path / "d"))) == brute_fast(rows)


def brute_fast(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(t, []).append(d)
    return sorted(((d, max(groups[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in rows), key=str)


def test_empty_table(spark, tmp_path):
    out = exact_dedup(spark, saved(spark, frame(spark, []), tmp_path / "d"))
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and out.count() == 0


def test_state_goes_on_with_new_files(spark, tmp_path):
    path, state = str(tmp_path / "d"), str(tmp_path / "state")
    frame(spark, [(1, "a"), (2, "b")]).write.parquet(path)
    update_state(spark, path, state)
    frame(spark, [(3, "a")]).write.mode("append").parquet(path)
    update_state(spark, path, state)
    assert sorted((r["keep"]["id"], r["n"]) for r in read_state(spark, state).collect()) == [(2, 1), (3, 2)]
    update_state(spark, path, state)
    assert sorted((r["keep"]["id"], r["n"]) for r in read_state(spark, state).collect()) == [(2, 1), (3, 2)]


def test_query(spark):
    assert got(op1_exact_dedup(spark, DATA)) == brute_fast([(d, t or "") for d, t in texts(spark).items()])


def test_old_files_that_come_later_enter_the_state(spark, tmp_path):
    import os
    import time

    path, state = tmp_path / "t", str(tmp_path / "state")
    frame(spark, [(1, "one"), (2, "two")]).coalesce(1).write.parquet(str(path))
    assert exact_dedup(spark, str(path), state=state).count() == 2
    frame(spark, [(3, "one"), (4, "four")]).coalesce(1).write.parquet(str(tmp_path / "more"))
    (file,) = (tmp_path / "more").glob("part-*")
    old = time.time() - 30 * 86400
    os.utime(file, (old, old))
    file.rename(path / file.name)
    assert {(r["doc_id"], r["keep_id"]) for r in exact_dedup(spark, str(path), state=state).collect()} == {(1, 3), (2, 2), (3, 3), (4, 4)}
