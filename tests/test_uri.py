import pytest
from pyspark.sql import functions as F

from lexigrid.functions import uri as U

CANONICAL = [
    ("https://wiki.example.net/Topic#History", "https://wiki.example.net/Topic"),
    ("HTTPS://WIKI.EXAMPLE.NET/Topic", "https://wiki.example.net/Topic"),
    ("http://mirror.example.net:80/pub/iso", "http://mirror.example.net/pub/iso"),
    ("https://mirror.example.net:443/pub/iso", "https://mirror.example.net/pub/iso"),
    ("https://mirror.example.net:80/pub", "https://mirror.example.net:80/pub"),
    ("http://docs.example.net/v1/ref/../guide", "http://docs.example.net/v1/guide"),
    ("http://docs.example.net/?size=9&order=up&from=3", "http://docs.example.net/?from=3&order=up&size=9"),
    ("http://docs.example.net/v1//api/./", "http://docs.example.net/v1/api/"),
    ("HTTP://Build.Example.net:8443/Log", "http://build.example.net:8443/Log"),
    ("http://docs.example.net/?&size=9&&from=3&", "http://docs.example.net/?from=3&size=9"),
    ("https://example.com/?&&", "https://example.com/"),
    ("https://example.com/a%2Fb?x=%26&y", "https://example.com/a%2Fb?x=%26&y"),
    ("https://User@Example.com/a/..", "https://User@example.com/"),
    ("https://example.com", "https://example.com"),
    ("https://example.com/../x", "https://example.com/../x"),
    ("data:text/plain,hi", None), ("mailto:a@b.c", None), ("not a uri", None), ("", None), (None, None),
]


def _one(spark, values, function):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, u string")
    return [r["o"] for r in rows.select("i", function(F.col("u")).alias("o")).orderBy("i").collect()]


def test_canonicalize_and_idempotence(spark):
    got = _one(spark, [a for a, _ in CANONICAL], U.canonicalize)
    assert got == [b for _, b in CANONICAL]
    assert _one(spark, got, U.canonicalize) == got


def test_custom_steps_come_last_and_errors_propagate(spark):
    custom = U.canonicalizer(lambda u: F.concat(u, F.lit("/custom")))
    assert _one(spark, ["https://example.com/start#x"], custom) == ["https://example.com/start/custom"]
    steps = U.canonicalizer(U.drop_parameters("utm_"), U.drop_trailing_index)
    assert _one(spark, ["http://e.com/a/index?utm_source=x&b=1", "http://e.com/index?utm_a"], steps) == ["http://e.com/a?b=1", "http://e.com/"]
    with pytest.raises(Exception, match="broken"):
        _one(spark, ["https://example.com/"], U.canonicalizer(lambda u: F.raise_error(F.lit("broken"))))


def test_predicates(spark):
    urls = ["http://a.com/x", "HTTPS://A.com/private/x", "ftp://a.com/", None, "http://b.com/"]
    assert _one(spark, urls, U.is_http) == [True, True, False, False, True]
    root = F.lit("http://a.com/")
    assert _one(spark, urls, lambda u: U.is_allowed(u, root)) == [True, True, True, False, False]
    assert _one(spark, urls, lambda u: U.is_allowed(u, root, same_domain=False, external=True, allowed=["B.com"])) == [False, False, False, False, True]
    assert _one(spark, urls[:2], lambda u: U.is_disallowed_path(u, ["/private"])) == [False, True]
    assert _one(spark, [" HTTP://A.com/b/../C#f ", "nothing"], U.normalize_uri) == ["http://a.com/c", None]


def test_resolve(spark):
    base = "http://e.com/a/b?q=1#f"
    cases = {"c": "http://e.com/a/c", "/c/./d": "http://e.com/c/d", "../x#y": "http://e.com/x#y", "//o.org/z": "http://o.org/z", "?z=2": "http://e.com/a/b?z=2", "#top": "http://e.com/a/b?q=1#top", "https://o.org/a/../b": "https://o.org/b", "mailto:x@y": "mailto:x@y", "": None}
    assert _one(spark, list(cases), lambda u: U.resolve(u, F.lit(base))) == list(cases.values())
    assert _one(spark, ["x"], lambda u: U.resolve(u, F.lit("http://e.com"))) == ["http://e.com/x"]
