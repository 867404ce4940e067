"""Breadth-first site traversal, a depth at a time, over any way to fetch pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import uri as U
from ..operators.scratch import kept
from .config import CrawlConfig

#: frontier (url, depth, root) -> pages (url, links: array of absolute urls, and whatever else a page has)
Fetch = Callable[[DataFrame], DataFrame]


def seeds(spark: SparkSession, roots: list[str | None], step: U.Step = U.canonicalize) -> DataFrame:
    """The frontier at depth 0: the roots, canonical, each once, each its own root. No root at all is an error."""
    roots = [r for r in roots if r]
    if not roots:
        raise ValueError("at least one root is needed")
    rows = spark.createDataFrame([(r,) for r in roots], "url string").select(step(F.col("url")).alias("url"))
    return rows.where("url is not null").distinct().select("url", F.lit(0).alias("depth"), F.col("url").alias("root"))


def visitable(config: CrawlConfig):
    """Column: whether (url, depth, root) may be visited."""
    url = F.col("url")
    allowed = U.is_allowed(url, F.col("root"), allowed=config.allowed_domains, same_domain=config.same_domain_only, external=config.follow_external_links)
    return (F.col("depth") <= config.max_depth) & U.is_http(url) & allowed & ~U.is_disallowed_path(url, sorted(config.disallowed_paths))


def crawl(start: DataFrame, fetch: Fetch, config: CrawlConfig = CrawlConfig(), step: U.Step = U.canonicalize) -> DataFrame:
    """The pages that `fetch` delivers with their depth and root, `max_pages` at most, first by (depth, url).

    Each url is visited once, at its least depth; of several roots that reach it at that depth, the smallest.
    Links that can't be canonicalized are dropped, their page isn't. No more urls are fetched at a time than pages are
    still wanted: where some give no page, the next ones of that depth follow.
    """
    frontier = kept(start.where(visitable(config)), "crawl-frontier")
    visited, pages, found = None, None, 0
    for depth in range(config.max_depth + 1):
        level, after = None, None
        while found < config.max_pages:
            rest = frontier if after is None else frontier.where(F.col("url") > after)
            batch = kept(rest.orderBy("url").limit(config.max_pages - found), "crawl-batch")
            last, n = batch.agg(F.max("url"), F.count("*")).first()
            if not n:
                break
            got = kept(fetch(batch).drop("depth", "root").join(batch, "url"), "crawl-pages")
            level = got if level is None else level.unionByName(got)
            found, after = found + got.count(), last
            if n < config.max_pages - found:  # the whole frontier was in this batch
                break
        if level is None:
            break
        pages = level if pages is None else pages.unionByName(level)
        visited = frontier.select("url") if visited is None else visited.union(frontier.select("url"))
        if found >= config.max_pages or depth == config.max_depth:
            break
        links = level.select(F.explode("links").alias("link"), (F.col("depth") + 1).alias("depth"), "root")
        links = links.select(step(F.col("link")).alias("url"), "depth", "root").where("url is not null").where(visitable(config))
        links = links.groupBy("url").agg(F.min("depth").alias("depth"), F.min("root").alias("root"))
        frontier = kept(links.join(visited, "url", "left_anti"), "crawl-frontier")
    if pages is None:
        pages = fetch(frontier.limit(0)).drop("depth", "root").join(frontier, "url")
    return pages.orderBy("depth", "url").limit(config.max_pages)


def from_snapshot(pages: DataFrame, step: U.Step = U.canonicalize) -> Fetch:
    """Fetch from a table (url, links): a join on the canonical url, which is worked out once.

    Of several rows with one url that with the least JSON form counts.
    """
    rows = pages.withColumn("url", step(F.col("url"))).where("url is not null")
    whole = F.struct(*rows.columns)
    known = kept(rows.groupBy("url").agg(F.min_by(whole, F.to_json(whole)).alias("p")).select("p.*"), "crawl-snapshot")
    return lambda frontier: known.join(frontier, "url", "left_semi")


def from_edges(edges: DataFrame) -> Fetch:
    """Fetch from a link graph (src, dst); a page without links to other pages is one too."""
    pages = edges.groupBy("src").agg(F.collect_set("dst").alias("links")).withColumnRenamed("src", "url")
    leaves = edges.select(F.col("dst").alias("url")).distinct().join(pages, "url", "left_anti").withColumn("links", F.array().cast("array<string>"))
    known = kept(pages.unionByName(leaves), "crawl-edges")
    return lambda frontier: known.join(frontier, "url", "left_semi")


ACCEPT, REDIRECTS = "text/html,application/xhtml+xml", 5


class Client:
    """HTTP GET over connections that are kept open by host; redirects are followed, but not from https to http."""

    def __init__(self, config: CrawlConfig):
        self.timeout, self.open = (config.connection_timeout_millis + config.read_timeout_millis) / 1000, {}

    def connection(self, scheme: str, host: str):
        from http.client import HTTPConnection, HTTPSConnection

        if (scheme, host) not in self.open:
            self.open[scheme, host] = (HTTPSConnection if scheme == "https" else HTTPConnection)(host, timeout=self.timeout)
        return self.open[scheme, host]

    def get(self, url: str) -> tuple[int, str, str, dict[str, list[str]]]:
        """Status, body, content type and headers of what the url leads to; OSError if it can't be had."""
        from http.client import HTTPException
        from urllib.parse import urljoin, urlsplit

        for _ in range(REDIRECTS + 1):
            parts = urlsplit(url)
            if parts.scheme not in ("http", "https") or not parts.netloc:
                raise OSError(f"not an HTTP address: {url}")
            try:
                connection = self.connection(parts.scheme, parts.netloc)
                connection.request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers={"Accept": ACCEPT})
                response = connection.getresponse()
                raw = response.read()
            except (HTTPException, OSError) as error:
                self.open.pop((parts.scheme, parts.netloc)).close()
                raise OSError(str(error)) from error
            target = response.getheader("location")
            if response.status in (301, 302, 303, 307, 308) and target and not (parts.scheme == "https" and urljoin(url, target).startswith("http:")):
                url = urljoin(url, target)
                continue
            headers: dict[str, list[str]] = {}
            for name, value in response.getheaders():
                headers.setdefault(name, []).append(value)
            try:
                body = raw.decode(response.headers.get_content_charset() or "utf-8", "replace")
            except LookupError:
                body = raw.decode("utf-8", "replace")
            return response.status, body, response.getheader("content-type") or "", headers
        raise OSError("too many redirects")

    def close(self) -> None:
        for connection in self.open.values():
            connection.close()


def live(config: CrawlConfig) -> Fetch:
    """Fetch over HTTP: `max_concurrent` tasks, urls dealt by host, the delay between requests to one host.

    So one host is asked by one task only, over one connection. A request that fails gives no page; the crawl goes on.
    """

    def get(batches):
        import time
        from urllib.parse import urlsplit

        import pandas as pd

        client, asked = Client(config), {}
        for batch in batches:
            rows = []
            for url in batch["url"]:
                host = urlsplit(url).netloc
                time.sleep(max(0.0, asked.get(host, 0.0) + config.delay_millis / 1000 - time.monotonic()))
                asked[host] = time.monotonic()
                try:
                    rows.append((url, *client.get(url)))
                except (OSError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=["uri", "status_code", "body", "content_type", "headers"])
        client.close()

    def fetch(frontier: DataFrame) -> DataFrame:
        from .pages import parsed

        got = frontier.select("url").repartition(config.max_concurrent, F.expr("parse_url(url, 'HOST')")).mapInPandas(get, "uri string, status_code int, body string, content_type string, headers map<string,array<string>>")
        return parsed(got, accepted=config.allowed_content_types, skip_others=config.skip_non_html)

    return fetch


def web_pages(spark: SparkSession, roots: list[str], config: CrawlConfig = CrawlConfig(), fetch: Fetch | None = None) -> DataFrame:
    """A crawl from the roots, over HTTP unless another way to fetch is given."""
    return crawl(seeds(spark, roots), fetch or live(config), config)


#: There is no reading of site maps behind this: the roots are crawled.
web_pages_from_site_map = web_pages
