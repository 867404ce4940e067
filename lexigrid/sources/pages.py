"""Responses to pages to documents: what a crawl delivers, as projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import html as H, uri as U


def parsed(responses: DataFrame, *, accepted: frozenset[str] = frozenset({"text/html"}), skip_others: bool = True, ended: bool = False) -> DataFrame:
    """Pages (url, raw_html, title, body_text, status_code, content_type, fetched_at, headers, links) of the responses.

    Only successful responses count, and only those with an accepted content type unless others are wanted too. The
    url is the requested one. Null bodies and content types are empty. `ended`: only references that a semicolon ends
    are decoded in titles and texts.
    """
    content = F.lower(F.coalesce("content_type", F.lit("")))
    rows = responses.where(H.is_success(F.col("status_code")))
    if skip_others:
        wanted = F.lit(False)
        for kind in sorted(accepted):
            wanted = wanted | content.contains(kind.lower())
        rows = rows.where(wanted)
    body = F.coalesce("body", F.lit(""))
    return rows.select(
        F.col("uri").alias("url"), body.alias("raw_html"), H.title(body, ended).alias("title"), H.body_text(body, ended).alias("body_text"), "status_code", F.coalesce("content_type", F.lit("")).alias("content_type"),
        F.current_timestamp().alias("fetched_at"), H.flat_headers(F.coalesce("headers", F.create_map().cast("map<string,array<string>>"))).alias("headers"), H.links(body, F.col("uri")).alias("links"),
    )


def snapshot_responses(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A table of stored pages as successful HTML responses."""
    none = F.create_map().cast("map<string,array<string>>")
    return pages.select(F.col(url_col).alias("uri"), F.lit(200).alias("status_code"), F.col(html_col).alias("body"), F.lit("text/html").alias("content_type"), none.alias("headers"))


def to_documents(pages: DataFrame) -> DataFrame:
    """Pages as documents (see schemas): the id is the normalized url, the content title and body, a line each."""
    raw = F.when(F.trim(F.coalesce("title", F.lit(""))) == "", F.col("body_text")).otherwise(F.concat_ws("\n", "title", "body_text"))
    attributes = F.create_map(
        F.lit("url"), F.col("url"), F.lit("rawHtml"), F.col("raw_html"), F.lit("statusCode"), F.col("status_code").cast("string"), F.lit("contentType"), F.col("content_type"),
        F.lit("fetchedAt"), F.col("fetched_at").cast("string"), F.lit("headers"), F.to_json("headers"),
    )
    metadata = F.struct(F.col("title"), F.col("url").alias("source"), F.lit(None).cast("int").alias("length"), F.lit(None).cast("int").alias("unique_terms"), F.lit(None).cast("map<string,int>").alias("term_frequencies"), attributes.alias("attributes"))
    return pages.select(
        F.coalesce(U.normalize_path(F.col("url")), F.col("url")).alias("id"), raw.alias("raw_content"), F.lit(None).cast("string").alias("normalized_content"),
        F.create_map(F.lit("title"), F.coalesce("title", F.lit("")), F.lit("body"), F.coalesce("body_text", F.lit(""))).alias("fields"), metadata.alias("metadata"),
    )
