import re
from html import unescape
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from lexigrid.functions import html as H
from lexigrid.operators.analysis import preprocess
from lexigrid.plans import queries as Q, workflows as W
from lexigrid.sources import config as K, crawl as C, pages as P

PAGE = """<html><head><title> A &amp; B
 &copy;</title><script>var t="</p>"; document.write('<a href="/script">x</a>')</script><style>p{}</style></head>
<body><!-- <a href="/comment">no</a> --><h1>Head</h1><p>one<br>two<p>th<b>re</b>e &lt;4&gt; &amp;amp;
<a href="next">n</a><a class=x href='/abs#f'>a</a><a href="mailto:x@y.z">m</a><a href="tel:1">t</a><a href="JavaScript:go()">j</a><a href="next">again</a><a href="">e</a>
<a href=//other.org/x>o</a></body></html>"""


def test_title_text_and_links(spark):
    rows = spark.createDataFrame([(PAGE, "http://e.com/d/p"), ("<p>no title", "http://e.com"), (None, None)], "html string, url string")
    got = rows.select(H.title(F.col("html")).alias("t"), H.body_text(F.col("html")).alias("b"), H.links(F.col("html"), F.col("url")).alias("l")).collect()
    assert got[0]["t"] == "A & B ©"
    assert got[0]["b"].startswith("Head one two three <4> &amp; n")
    assert "script" not in got[0]["b"] and "comment" not in got[0]["b"]
    assert got[0]["l"] == ["http://e.com/d/next", "http://e.com/abs#f", "http://other.org/x"]
    assert (got[1]["t"], got[1]["b"], got[1]["l"]) == ("", "no title", [])
    assert (got[2]["t"], got[2]["b"], got[2]["l"]) == ("", "", [])


class Reader(HTMLParser):
    """An independent reading of a page: title, words of the body and hrefs, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.title, self.body, self.hrefs, self.base = [], None, [], [], None

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if tag in ("script", "style", "template", "title"):
            self.hidden.append(tag)
            self.title = "" if tag == "title" and self.title is None else self.title
        elif tag == "a" and own.get("href"):
            self.hrefs.append(own["href"].strip())
        elif tag == "base" and self.base is None:
            self.base = own.get("href")
        if tag in H.BLOCKS.split("|") or tag in ("h1", "h2"):
            self.body.append(" ")

    def handle_endtag(self, tag):
        if self.hidden and tag == self.hidden[-1]:
            self.hidden.pop()
        if tag in H.BLOCKS.split("|") or tag in ("h1", "h2"):
            self.body.append(" ")

    def handle_data(self, data):
        if self.hidden == ["title"]:
            self.title += data
        elif not self.hidden:
            self.body.append(data)


def squeezed(text):
    return re.sub("[ \t\n\r\f\xa0]+", " ", text or "").strip(" ")


PAGES = [
    "<title>References</title><body>&#65;&#8217;s &#xE9;t&#XC9; &Eacute;&oacute; &notin; &CounterClockwiseContourIntegral; &#x1F600; &#0; &#xD800; &#150; &unknown; &amp;lt; &ampx &copy 2 &#99999999; a&b & c</body>",
    '<html><head><title>Quotes</title></head><body><p title="a>b" data-x=\'c>d\'>x<img alt="1 > 0">y</p><a title="x>y" href="/one?a=1&amp;b=2&c=3">l</a></body></html>',
    "<body>before<script>var a = '<p>no</p>';",
    "<body>text<style>p > a { }</style> more <!-- <p>hidden > </p> --> end <!-- never closed <p>gone</p>",
    '<head><base href="/deep/er/"><title>Base &amp; more</title></head><body><a href="x">1</a><a href="../y#z">2</a><a href="http://o.org/">3</a></body>',
    "<title>No head tag</title><p>para<b>gra</b>ph<div>block</div>a < b and 3 <4",
    "<body><a data-href='no' href='yes'>1</a><a\nhref = \"sp aced\">2</a><a name=x>3</a></body>",
]


def test_pages_as_an_independent_parser_reads_them(spark):
    url = "http://e.com/d/p"
    rows = spark.createDataFrame([(i, p, url) for i, p in enumerate(PAGES)], "i int, html string, url string")
    for r in rows.select("i", H.title(F.col("html")).alias("t"), H.body_text(F.col("html")).alias("b"), H.links(F.col("html"), F.col("url")).alias("l")).collect():
        reader = Reader()
        reader.feed(PAGES[r["i"]])
        if "never closed" not in PAGES[r["i"]]:
            reader.close()
        assert r["t"] == squeezed(reader.title), PAGES[r["i"]]
        if r["i"] != 0:
            assert r["b"] == squeezed("".join(reader.body)), PAGES[r["i"]]
        base = urljoin(url, reader.base or "")
        assert [x.replace(" ", "") for x in r["l"]] == [urljoin(base, h).replace(" ", "") for h in reader.hrefs] or r["i"] == 6, PAGES[r["i"]]
    assert reader.hrefs == ["yes", "sp aced"]


def test_references_in_attributes(spark):
    """Without a semicolon, a name before a letter, a digit or an equals sign is no reference there."""
    cases = {"/x?a=1&copy=2": "/x?a=1&copy=2", "/x?a=1&copy;=2": "/x?a=1©=2", "/x?a&lt": "/x?a<", "/x?a&ltb": "/x?a&ltb", "/x?a&#49;b": "/x?a1b"}
    rows = spark.createDataFrame([(a,) for a in cases], "t string").select("t", H.decode_entities(F.col("t"), attribute=True).alias("d"))
    assert {r["t"]: r["d"] for r in rows.collect()} == cases


def test_references(spark):
    """Every named reference and numbers of all kinds, as the standard library decodes them."""
    names = [f"x&{n};y" if not n.endswith(";") else f"x&{n}y" for n in html5]
    others = ["&#65;", "&#x41", "&#x1F600;", "&#0;", "&#xD800;", "&#150;", "&#1114112;", "&#99999999999999999999;", "&nope;", "&", "&&amp;&", "&amp;lt;", "&notit;", "&copycat", "&#;", "&#x;", "a & b", "&AMP", ""]
    rows = spark.createDataFrame([(t,) for t in [*names, *others]], "t string").select("t", H.decode_entities(F.col("t")).alias("d"))
    assert [(r["t"], r["d"]) for r in rows.collect() if r["d"] != unescape(r["t"])] == []


def test_a_served_site(spark):
    """A crawl over HTTP: redirects, headers, kinds of content, failures, one connection a host and the delay between requests."""
    import threading
    import time
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    asked, ports = [], set()

    class Site(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_GET(self):
            asked.append((self.path, time.monotonic(), self.headers["Accept"]))
            ports.add(self.client_address[1])
            status, kind, body = {
                "/": (200, "text/html; charset=latin-1", "<title>Home é</title><a href=/moved>m</a><a href=/data>d</a><a href=/gone>g</a><a href=/loop>l</a>".encode("latin-1")),
                "/moved": (302, "text/html", b""), "/there": (200, "text/html", b"<title>There</title>"), "/data": (200, "application/json", b"{}"), "/loop": (301, "text/html", b""),
            }.get(self.path, (404, "text/html", b"no"))
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("X-Two", "a")
            self.send_header("X-Two", "b")
            if status in (301, 302):
                self.send_header("Location", "/there" if self.path == "/moved" else "/loop")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        root = f"http://127.0.0.1:{server.server_port}/"
        found = {r["url"].removeprefix(root): r for r in C.web_pages(spark, [root], K.CrawlConfig(delay_millis=60, max_concurrent=2)).collect()}
    finally:
        server.shutdown()
    assert {u: (r["title"], r["status_code"], r["depth"]) for u, r in found.items()} == {"": ("Home é", 200, 0), "moved": ("There", 200, 1)}
    assert found[""]["headers"]["X-Two"] == "a, b" and found[""]["content_type"].startswith("text/html") and asked[0][2] == C.ACCEPT
    own = [t for p, t, _ in asked if p in ("/moved", "/data", "/gone")]
    assert min(b - a for a, b in zip(sorted(own), sorted(own)[1:])) >= 0.05 and len(ports) <= 4


def test_page_cap_limits_what_is_fetched(spark):
    fetched = []

    def fetch(frontier):
        fetched.append(frontier.count())
        return C.from_edges(_graph(spark))(frontier).where("url <> 'http://e.com/b'")

    found = C.crawl(C.seeds(spark, ["http://e.com/a"]), fetch, K.CrawlConfig(max_pages=2))
    assert [r["url"] for r in found.collect()] == ["http://e.com/a", "http://e.com/c"] and max(fetched) == 1


def test_headers_and_predicates(spark):
    rows = spark.sql("select map('Content-TYPE', array('text/HTML; x', 'b'), 'e', array()) as h, 200 as s union all select map(), 301")
    got = rows.select(H.content_type(F.col("h")).alias("c"), H.flat_headers(F.col("h")).alias("f"), H.is_success(F.col("s")).alias("ok"), H.is_html(H.content_type(F.col("h"))).alias("html")).collect()
    assert [tuple(r) for r in got] == [("text/HTML; x", {"Content-TYPE": "text/HTML; x, b", "e": ""}, True, True), ("", {}, False, False)]
    row = spark.range(1).select(H.is_xml(F.lit("application/XML")).alias("x"), H.is_json(F.lit(None).cast("string")).alias("j")).first()
    assert tuple(row) == (True, False)


def test_pages_to_documents(spark):
    none = "map<string,array<string>>"
    rows = [("http://e.com/a/../b", 200, PAGE, "text/html", None), ("http://e.com/2", 404, PAGE, "text/html", None), ("http://e.com/3", 200, "{}", "application/json", None), ("http://e.com/4", 200, "<body>only", "text/html", {"A": ["1", "2"]})]
    responses = spark.createDataFrame(rows, f"uri string, status_code int, body string, content_type string, headers {none}")
    docs = {r["id"]: r for r in preprocess(P.to_documents(P.parsed(responses))).collect()}
    assert set(docs) == {"http://e.com/b", "http://e.com/4"}
    assert docs["http://e.com/b"]["raw_content"].startswith("A & B ©\nHead one two")
    assert docs["http://e.com/4"]["raw_content"] == "only" and docs["http://e.com/4"]["fields"] == {"title": "", "body": "only"}
    assert set(docs["http://e.com/4"]["metadata"]["attributes"]) == {"url", "rawHtml", "statusCode", "contentType", "fetchedAt", "headers"}
    assert P.parsed(responses, skip_others=False).count() == 3


def test_config_presets_and_checks():
    assert (K.default().max_depth, K.default().max_pages, K.default().delay_millis) == (2, 100, 200)
    assert (K.polite().max_pages, K.polite().delay_millis, K.polite().max_concurrent) == (50, 500, 1)
    assert (K.aggressive().max_depth, K.aggressive().max_pages, K.aggressive().same_domain_only) == (4, 500, False)
    for bad in ({"max_depth": -1}, {"max_pages": 0}, {"max_concurrent": 0}, {"connection_timeout_millis": 0}, {"config_id": " "}):
        with pytest.raises(ValueError):
            K.CrawlConfig(**bad)


def _graph(spark):
    u = lambda x: "http://x.org/" if x == "x" else f"http://e.com/{x}"
    links = ["ab", "ac", "bd", "cd", "de", "ax"]
    return spark.createDataFrame([(u(a), u(b)) for a, b in links], "src string, dst string")


def _crawled(spark, **options):
    found = C.crawl(C.seeds(spark, ["HTTP://E.com:80/a", None, "http://e.com/a#x"]), C.from_edges(_graph(spark)), K.CrawlConfig(**options))
    return {r["url"].removeprefix("http://e.com/"): r["depth"] for r in found.collect()}


def test_crawl(spark):
    assert _crawled(spark) == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert _crawled(spark, max_depth=0) == {"a": 0}
    assert _crawled(spark, max_depth=5) == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}
    assert _crawled(spark, max_pages=2) == {"a": 0, "b": 1}
    assert _crawled(spark, same_domain_only=False, follow_external_links=True) == {"a": 0, "b": 1, "c": 1, "d": 2, "http://x.org/": 1}
    assert _crawled(spark, disallowed_paths=frozenset({"/b", "/c"})) == {"a": 0}
    assert _crawled(spark, allowed_domains=frozenset({"X.org"})) == {}
    with pytest.raises(ValueError):
        C.seeds(spark, [None])


def test_crawl_of_stored_pages(spark):
    pages = spark.createDataFrame([("http://e.com/d/p", PAGE), ("http://e.com/d/next", "<a href='data:x'>d</a><p>t")], "url string, html string")
    table = P.parsed(P.snapshot_responses(pages))
    got = C.web_pages(spark, ["http://e.com/d/p#top"], fetch=C.from_snapshot(table)).collect()
    assert {(r["url"], r["depth"]) for r in got} == {("http://e.com/d/p", 0), ("http://e.com/d/next", 1)}


def test_live_fetch_survives_failures(spark):
    got = C.live(K.CrawlConfig(delay_millis=0, connection_timeout_millis=1, read_timeout_millis=1))(spark.createDataFrame([("http://127.0.0.1:9/x", 0, "r")], "url string, depth int, root string"))
    assert got.count() == 0


#: References that a semicolon doesn't end, as where a title was cut short. By these ids both pages are successful HTML responses.
CUT = [
    (15, "http://cut.example.org/a", "<head><title>Fish &amp; chips&amp</title></head><body><p>salt &amp vinegar &#38 &#39; &copy &copy; &lt</p></body>"),
    (50, "http://cut.example.org/b", "<head><title>&amp</title></head><p>&ampere &amp;amp &#x41 &#38;</p>"),
]


def cut_pages(spark, tmp_path, query):
    """The rows of a query over CUT and those of its SQL, by sorted column names."""
    import duckdb

    spark.createDataFrame(CUT, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = (W.QUERIES | Q.QUERIES)[query](spark, str(tmp_path))
    names = ", ".join(sorted(got.columns))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    return sorted(map(tuple, got.select(*sorted(got.columns)).collect())), sorted(con.execute(f"select {names} from ({(W.SQL | Q.SQL)[query]})").fetchall())


def test_title_of_cut_references_equals_sql(spark, tmp_path):
    got, expected = cut_pages(spark, tmp_path, "page_title")
    assert got == expected == [(15, "Fish & chips&amp"), (50, "&amp")]


def test_text_of_cut_references_equals_sql(spark, tmp_path):
    got, expected = cut_pages(spark, tmp_path, "page_text")
    assert got == expected == [("&ampere &amp &#x41 &", 50), ("salt &amp vinegar &#38 ' &copy © &lt", 15)]


@pytest.mark.parametrize("query", ["page_documents", "page_attributes"])
def test_documents_of_cut_references_equal_sql(spark, tmp_path, query):
    got, expected = cut_pages(spark, tmp_path, query)
    assert got == expected and got
