"""Crawl settings, checked when they are made, and their presets."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field


@dataclass(frozen=True)
class CrawlConfig:
    max_depth: int = 2
    max_pages: int = 100
    same_domain_only: bool = True
    follow_external_links: bool = False
    delay_millis: int = 200
    max_concurrent: int = 2
    allowed_content_types: frozenset[str] = frozenset({"text/html"})
    skip_non_html: bool = True
    allowed_domains: frozenset[str] = frozenset()
    disallowed_paths: frozenset[str] = frozenset()
    connection_timeout_millis: int = 5000
    read_timeout_millis: int = 5000
    config_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self):
        for name, least in (("max_depth", 0), ("max_pages", 1), ("max_concurrent", 1), ("delay_millis", 0), ("connection_timeout_millis", 1), ("read_timeout_millis", 1)):
            if getattr(self, name) < least:
                raise ValueError(f"{name} must be at least {least}")
        if not self.config_id.strip():
            raise ValueError("config_id must not be blank")


def default() -> CrawlConfig:
    return CrawlConfig()


def polite() -> CrawlConfig:
    return CrawlConfig(max_pages=50, delay_millis=500, max_concurrent=1)


def aggressive() -> CrawlConfig:
    return CrawlConfig(max_depth=4, max_pages=500, same_domain_only=False, follow_external_links=True, delay_millis=50, max_concurrent=8, connection_timeout_millis=3000, read_timeout_millis=3000)
