import math
import random
import zlib

import numpy as np
import pytest

from lexigrid.llm import langid as L
from lexigrid.llm.queries import op6_language_id

from .helpers import clashing, documents, frame


def test_bundle_equals_sum_of_bound_vectors():
    e = L.Encoder(64)
    text = "Ab, c\nÉß 中文 a" * 3
    letters = [c.lower()[0] if c.isalpha() else " " for c in " " + text + " "]
    plain = "".join(c for i, c in enumerate(letters) if c != " " or i == 0 or letters[i - 1] != " ")
    vector = lambda c: e.letter(0 if c == " " else ord(c)).astype(int)
    total = sum(np.roll(vector(plain[i]), 2) * np.roll(vector(plain[i + 1]), 1) * vector(plain[i + 2]) for i in range(len(plain) - 2))
    assert np.allclose(e.bundles([text])[0], total / np.linalg.norm(total), atol=1e-5)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in documents(spark, sf).select("doc_id", "lang").collect()}
    got = op6_language_id(spark, sf).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_labels_of_held_out_documents_are_not_learned(spark):
    docs = documents(spark)
    from pyspark.sql import functions as F

    spoiled = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    assert sorted(map(tuple, L.identify(docs).collect())) == sorted(map(tuple, L.identify(spoiled).collect()))


def test_edge_cases(spark):
    rows = [(1, "the quick brown fox and the dog", "en", "s"), (4, "der schnelle braune Fuchs und der Hund", "de", "s"), (2, None, "en", "s"), (3, "", None, "s"), (5, "123 !?", "de", "s"), (None, "the fox", None, None), (6, "the dog " * 100_000, None, "s"), (6, "the dog " * 100_000, None, "s"), (7, "a", None, "s")]
    out = [(r["doc_id"], r["lang_pred"], r["score"]) for r in L.identify(clashing(frame(spark, rows), "lang_pred", "score", "held_out")).collect()]
    assert {(d, p) for d, p, _ in out if p == "und"} == {(2, "und"), (3, "und"), (5, "und")}
    assert all(s == 0 for _, p, s in out if p == "und")
    assert [p for d, p, _ in out if d == 6] == ["en", "en"] and len(out) == len(rows)
    assert L.identify(frame(spark, [])).count() == 0
    unlabelled = L.identify(frame(spark, [(1, "text", None, "s")])).collect()
    assert [(r["lang_pred"], r["score"]) for r in unlabelled] == [("und", 0.0)]


def test_filter_keeps_rows_as_they_are(spark):
    rows = [(1, "the quick brown fox", "en", "s"), (2, None, "en", "s"), (3, "42", "en", "s"), (4, "le renard", "fr", None)]
    docs = clashing(frame(spark, rows), "score")
    kept = L.known_language(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted(tuple(r) for r in docs.collect() if r["doc_id"] in (1, 4))
    assert L.known_language(docs.limit(0)).count() == 0


def slow_vector(text, dimensions=64, gram=3):
    """The bundle of a text, gram by gram, with plain Python numbers."""
    letters, codes = [], [0]
    for c in text:
        letters.append(ord(c.lower()[0]) if c.isalpha() else 0)
    for x in letters:
        if x or codes[-1]:
            codes.append(x)
    if codes[-1]:
        codes.append(0)
    encoder, out = L.Encoder(dimensions), [0] * dimensions
    for at in range(len(codes) - gram + 1):
        own = [1] * dimensions
        for i in range(gram):
            v = encoder.letter(codes[at + gram - 1 - i]).tolist()
            own = [a * v[(j - i) % dimensions] for j, a in enumerate(own)]
        out = [a + b for a, b in zip(out, own)]
    size = math.sqrt(sum(x * x for x in out))
    return [x / size for x in out] if size else None


def test_prototypes_and_predictions_equal_brute_force(spark):
    """From texts to bundles, prototypes, what they share taken off, cosines and the best of them; more languages than rows of most."""
    draw = random.Random(2)
    alphabets = {f"l{i}": "".join(draw.choice("abcdefghijklmnopqrstuvwxyzäöüßéñ漢字") for _ in range(9)) for i in range(12)}
    rows = [(i, " ".join("".join(draw.choice(alphabets[lang]) for _ in range(draw.randrange(2, 9))) for _ in range(12)), lang, "s") for i, lang in enumerate(draw.choice(list(alphabets)) for _ in range(120))]
    rows += [(500, None, "l1", "s"), (501, "12 34", "l1", "s"), (502, "Nobody labelled this", None, "s")]
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows}
    sums = {}
    for i, text, lang, _ in rows:
        if not held[i] and lang and text and (v := slow_vector(text)):
            sums[lang] = [a + b for a, b in zip(sums.get(lang, [0] * 64), v)]
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    units = {lang: unit(v) for lang, v in sums.items()}
    mean = [sum(c) / len(units) for c in zip(*units.values())]
    own = {lang: unit([a - b for a, b in zip(v, mean)]) for lang, v in units.items()}
    for r in L.identify(frame(spark, rows), dimensions=64).collect():
        text = next(t for i, t, *_ in rows if i == r["doc_id"])
        v = slow_vector(text or "")
        if v is None:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        centred = unit([a - b for a, b in zip(v, mean)])
        cosines = {lang: sum(a * b for a, b in zip(centred, p)) for lang, p in own.items()}
        best = max(sorted(cosines), key=cosines.get)
        assert r["held_out"] == held[r["doc_id"]] and r["score"] == pytest.approx(max(0.0, cosines[best]), abs=1e-4)
        assert r["lang_pred"] == best or cosines[best] - cosines[r["lang_pred"]] < 1e-4
