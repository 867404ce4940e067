import zlib
from collections import defaultdict

import numpy as np
import pytest

from lexigrid.llm import packing as P
from lexigrid.llm.queries import op8_packing

from .helpers import DATA, clashing, frame, texts

PATHS = P.default_tokenizer()


def exact(text):
    from tokenizers import Tokenizer

    exact.t = getattr(exact, "t", None) or Tokenizer.from_file(PATHS[0])
    return [*exact.t.encode(text or "", add_special_tokens=False).ids, 0]


def test_fast_ids_equal_the_tokenizers_library(spark):
    marks = [chr(c) for c in [*range(9, 14), *range(28, 127), *range(0xA0, 0x180), *range(0x2000, 0x2030), 0x3000, 0x4E2D, 0x1F600, 0x85, 0x200B, 0xFEFF]]
    samples = [*texts(spark).values(), None, "", " ", "<|endoftext|> x", *[f"a{m}b {m} {m}{m} 1{m}'s" for m in marks], "I'll don't WE'RE", "  two  spaces \n\n  ", "x" * 3000, "e\u0301 \u0130"]
    for text in samples:
        assert P.token_ids(text, *PATHS).tolist() == exact(text) == P.token_ids(text, PATHS[0]).tolist(), repr(text)


def check(rows, by):
    """Pieces tile their documents and sequences, ids are right, little is padded."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(by)
    for doc, own in pieces.items():
        ids, at = np.array(exact(by[doc]), dtype="<u4"), 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padded = total = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        waste = 0 if at & (at - 1) == 0 else 1024 - at
        assert {r["tier"] for r in own} == {at + waste}
        padded, total = padded + waste, total + at
    return padded / total


def test_query(spark):
    assert check(op8_packing(spark, DATA).collect(), texts(spark)) < 0.01


def test_steps_hold_equal_tokens(spark):
    rows = op8_packing(spark, "/root/testdata/sf0.01").select("sequence_id", "tier", "step_group").distinct().collect()
    steps = defaultdict(list)
    for r in rows:
        steps[r["step_group"]].append(r["tier"])
    full = [sum(s) for s in steps.values() if sum(s) == P.STEP]
    assert all(len(set(s)) == 1 and sum(s) <= P.STEP for s in steps.values()) and len(full) > len(steps) // 2


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "word " * 30_000), (None, "null id"), (4, "a"), (5, "<|endoftext|>")]
    by = dict(rows)
    assert check(P.pack(clashing(frame(spark, rows), "start", "length", "tier", "offset")).collect(), by) == 0
    assert P.pack(frame(spark, [])).count() == 0
    twice = P.pack(frame(spark, [(7, "same text"), (7, "same text")])).collect()
    assert sum(r["length"] for r in twice) == 2 * len(exact("same text"))


@pytest.mark.parametrize("lengths", [[1], [1023], [1024, 1, 1025], [700] * 9, list(range(1, 400)), [3000, 5, 5, 5]])
def test_packer(lengths):
    packer = P.Packer(3)
    for d, n in enumerate(lengths):
        packer.add(d, np.arange(n, dtype="<u4"))
    packer.pack(0)
    rows = packer.taken()
    assert sum(r[2] for r in rows) == sum(lengths) and all(r[5] >> 40 == 3 for r in rows)
    size = defaultdict(int)
    for r in rows:
        size[r[5]] += r[2]
    assert sum(1024 - s for s in size.values() if s & (s - 1)) <= 8 * len(size)


def test_pool_is_bounded():
    packer = P.Packer(0)
    for d in range(3 * P.POOL):
        packer.add(d, np.arange(1 + d % 50, dtype="<u4"))
        assert len(packer.pool) <= P.POOL
