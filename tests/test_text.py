import random

import pytest
from pyspark.sql import functions as F

from lexigrid.functions import text as T

CASES = [
    ("basic", "«Route66»", "route66"), ("basic", "?!", None), ("basic", None, None),
    ("lowercase", "OsLo", "oslo"), ("lowercase", " A  B ", " a  b "),
    ("trim", "--b52--", "b52"), ("trim", "rock'n'roll", "rock'n'roll"), ("trim", "§§", None), ("trim", None, None), ("trim", "Oslo", "slo"),
    ("accent", "jalapeño", "jalapeno"), ("accent", "ÀÉÎ", "AEI"), ("accent", "Großmaß", "Großmaß"), ("accent", "\u0301", None), ("accent", "o\u0308l", "ol"),
    ("accent", "한글", "\u1112\u1161\u11ab\u1100\u1173\u11af"), ("accent", "가a", "\u1100\u1161a"), ("accent", "\U0002f800", "\u4e3d"), ("accent", "\U0001d15e", "\U0001d157"),
    ("stop", "because", None), ("stop", None, None), ("stop", "harbour", "harbour"), ("stop", "Because", "Because"),
    ("folded", "(Über)", "uber"), ("minimal", "[OsLo]", "oslo"),
    ("english", "Between,", None), ("english", "Sailing,", "sailing"), ("english", "ñame", "ame"),
    ("spanish", "¡MAÑANA!", "manana"), ("spanish", "también", "tambien"), ("spanish", "sí", None),
    ("empty", "AsIs", "AsIs"), ("empty", None, None),
]
STEPS = {
    "basic": T.basic, "lowercase": T.lowercase, "trim": T.trim_non_alphanumeric, "accent": T.fold_accents, "stop": T.stop_words(T.ENGLISH),
    "folded": T.chain(T.lowercase, T.fold_accents, T.trim_non_alphanumeric), "minimal": T.minimal, "english": T.english, "spanish": T.spanish, "empty": T.chain(),
}


def test_normalizers(spark):
    rows = spark.createDataFrame([(i, token) for i, (_, token, _) in enumerate(CASES)], "i int, token string")
    for name, step in STEPS.items():
        got = {r["i"]: r["out"] for r in rows.select("i", step(F.col("token")).alias("out")).collect()}
        for i, (pipeline, token, expected) in enumerate(CASES):
            if pipeline == name:
                assert got[i] == expected, (pipeline, token)


def test_tokens_split_at_ascii_space_only(spark):
    texts = ["  a  b\tc\nd ", "", None, "   ", "x y", "  z"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.whitespace_tokens(F.col("t")).alias("w")).collect()
    assert [r["w"] for r in rows] == [["a", "b", "c", "d"], [], [], [], ["x y"], ["z"]]


def test_whole_texts_and_single_tokens_agree(spark):
    """Terms come from whole texts in one pass; token by token, the same steps give the same."""
    draw = random.Random(3)
    texts = ["".join(draw.choice(["a", "B", "the", "é", "İ", "Σ", "'", "--", " ", " ", "\n", "\u2003", "\u00a0", "한", "9", "\u0301"]) for _ in range(draw.randrange(0, 60))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in [*texts, "", None, "...", "x" * 5000, "漢" * 5000]], "t string")
    for name, step in STEPS.items():
        slow = F.filter(F.transform(T.whitespace_tokens(F.col("t")), lambda x: step(x)), lambda x: x.isNotNull() & (F.trim(x) != ""))
        bad = rows.select("t", T.terms(F.col("t"), step).alias("a"), slow.alias("b")).where("not (a <=> b)")
        assert bad.collect() == [], name


def test_pattern_tokenizer(spark):
    row = spark.createDataFrame([("alpha|beta||alpha",)], "t string").select(T.pattern_tokens(r"\|")(F.col("t")).alias("w")).first()
    assert row["w"] == ["alpha", "beta", "alpha"]


def test_stop_word_lists_and_files(tmp_path, monkeypatch):
    assert (len(T.ENGLISH), len(set(T.ENGLISH)), len(T.SPANISH), len(set(T.SPANISH))) == (123, 123, 199, 199)
    file = tmp_path / "own.txt"
    file.write_text("\n one \n\ntwo\n", encoding="utf-8")
    assert T.load_stop_words(str(file)) == T.load_stop_words(f"file:{file}") == {"one", "two"}
    monkeypatch.setenv("IR_STOPWORDS_PATH", str(file))
    assert T.load_stop_words() == {"one", "two"}
    monkeypatch.delenv("IR_STOPWORDS_PATH")
    assert T.load_stop_words() == frozenset()
    assert T.load_stop_words("classpath:/stopwords_en.txt") == T.load_stop_words("stopwords_en.txt") == set(T.ENGLISH)
    with pytest.raises(FileNotFoundError):
        T.load_stop_words("classpath:/none.txt")
    with pytest.raises(FileNotFoundError):
        T.load_stop_words(str(tmp_path / "none"))


def test_found_tokens_equal_trimmed_ones(spark):
    """Random texts of letters, marks, white space of ASCII and others: tokens found in the text are the tokens split and trimmed."""
    import re

    made = random.Random(5)
    texts = ["".join(made.choice("aZ9é-. \t\n 　𝒳\x0b\x1c") for _ in range(made.randrange(40))) for _ in range(400)] + [None, "", "!" * 2000 + "a" + "-" * 2000 + "b c"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r["i"]: r["t"] for r in rows.select("i", T.terms(F.col("text"), T.minimal).alias("t")).collect()}
    for i, text in enumerate(texts):
        split = re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower())
        assert got[i] == [w for x in split if (w := re.sub(r"^[^a-z0-9]+|[^a-z0-9]+$", "", x))]
