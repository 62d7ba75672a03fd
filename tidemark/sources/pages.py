"""Fetching pages: a Python data source, and the same logic over any opener.

Only https is fetched; robots files are asked once a host, requests to one host
keep their distance, bodies are bounded. Nothing here runs in tests but with an
injected opener.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
import urllib.robotparser
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.functions.text import host

# Bounds of a fetch.
TIMEOUT_S, BODY_LIMIT, ROBOTS_LIMIT, HOST_GAP_S = 45, 8 * 1024 * 1024, 512 * 1024, 2.0
AGENT = "tidemark-fetch"
RESULT = "url string, ok boolean, http_status int, content_type string, body binary, fetched_at timestamp, error string, error_class string, final_url string, redirect_chain array<struct<status:int,url:string>>, bytes_received bigint, truncated boolean"

#: what an opener answers: status, headers, body (at most the given bytes), location of a redirect or None
Opener = Callable[[str, int], tuple[int, dict[str, str], bytes, str | None]]


def https_opener(url: str, limit: int) -> tuple[int, dict[str, str], bytes, str | None]:
    """One request without following redirects."""

    class Stay(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *a, **k):  # noqa: ANN002, ANN003
            return None

    try:
        with urllib.request.build_opener(Stay).open(urllib.request.Request(url, headers={"User-Agent": AGENT}), timeout=TIMEOUT_S) as r:
            return r.status, dict(r.headers), r.read(limit + 1), None
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read(limit + 1), e.headers.get("Location") if 300 <= e.code < 400 else None


@dataclass
class PageFetcher:
    """Fetches pages of one task; keeps robots rules and the time of the last request by host."""

    opener: Opener = https_opener
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    now: Callable[[], pd.Timestamp] = lambda: pd.Timestamp.now(tz="UTC")
    max_redirects: int = 10
    robots: dict[str, urllib.robotparser.RobotFileParser] = field(default_factory=dict)
    last: dict[str, float] = field(default_factory=dict)

    def rules(self, netloc: str) -> urllib.robotparser.RobotFileParser:
        """A host's robots rules; where they can't be read, everything is allowed."""
        if netloc not in self.robots:
            r = urllib.robotparser.RobotFileParser()
            try:
                status, _, body, _ = self.opener(f"https://{netloc}/robots.txt", ROBOTS_LIMIT)
                r.parse(body[:ROBOTS_LIMIT].decode("utf-8", "replace").splitlines() if status == 200 else [])
            except Exception:  # noqa: BLE001
                r.parse([])
            self.robots[netloc] = r
        return self.robots[netloc]

    def refusal(self, url: str) -> str | None:
        if urlsplit(url).scheme != "https":
            return "only https is fetched"
        return None if self.rules(urlsplit(url).netloc).can_fetch(AGENT, url) else "refused by robots rules"

    def space(self, netloc: str) -> None:
        """Waits until the host's last request is long enough ago; the first never waits."""
        gap = max(HOST_GAP_S, float(self.rules(netloc).crawl_delay(AGENT) or 0))
        if netloc in self.last and (wait := self.last[netloc] + gap - self.clock()) > 0:
            self.sleep(wait)
        self.last[netloc] = self.clock()

    def fetch(self, url: str) -> dict:
        """One row of RESULT. A failure has an empty body and a class."""
        chain: list[dict] = []
        out = {"url": url, "ok": False, "http_status": None, "content_type": "", "body": b"", "fetched_at": self.now(), "error": None, "error_class": None, "final_url": url, "redirect_chain": chain, "bytes_received": 0, "truncated": False}
        at = url
        try:
            for _ in range(self.max_redirects + 1):
                if why := self.refusal(at):
                    return out | {"error": why, "error_class": "refused", "final_url": at}
                self.space(urlsplit(at).netloc)
                status, headers, body, to = self.opener(at, BODY_LIMIT)
                out |= {"http_status": status, "final_url": at, "content_type": headers.get("Content-Type", "")}
                if to:
                    at = urljoin(at, to)
                    chain.append({"status": status, "url": at})
                    continue
                if status >= 400:
                    return out | {"error": f"HTTP {status}", "error_class": "http-error", "bytes_received": len(body)}
                if len(body) > BODY_LIMIT:
                    return out | {"error": "body too large", "error_class": "body-too-large", "bytes_received": len(body), "truncated": True}
                return out | {"ok": True, "body": body, "bytes_received": len(body)}
            return out | {"error": "too many redirects", "error_class": "unreachable"}
        except Exception as e:  # noqa: BLE001
            return out | {"error": str(e)[:500] or type(e).__name__, "error_class": "tls" if "SSL" in type(e).__name__ or "certificate" in str(e) else "unreachable"}


def fetch_all(urls: DataFrame, url: str = "url", opener: Opener = https_opener) -> DataFrame:
    """Fetches a column of URLs: one task per host group, so that spacing holds across the cluster."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetcher = PageFetcher(opener)
        for f in frames:
            yield pd.DataFrame([fetcher.fetch(u) for u in f["url"]])

    picked = urls.select(F.col(url).alias("url")).filter(F.col("url").isNotNull()).distinct()
    return picked.repartition(host(F.col("url"))).sortWithinPartitions("url").mapInPandas(run, RESULT)


class _Urls(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str]) -> None:
        self.urls = urls

    def partitions(self) -> list[_Urls]:
        by: dict[str, list[str]] = {}
        for u in self.urls:
            by.setdefault(urlsplit(u).netloc, []).append(u)
        return [_Urls(v) for v in by.values()] or [_Urls([])]

    def read(self, partition: _Urls) -> Iterator[tuple]:
        fetcher = PageFetcher()
        for u in partition.urls:
            r = fetcher.fetch(u)
            yield tuple(r[c.split(" ")[0]] for c in ("url", "ok", "http_status", "content_type", "body", "fetched_at", "error", "error_class", "final_url", "redirect_chain", "bytes_received", "truncated"))


class PageSource(DataSource):
    """``spark.read.format("tidemark-pages").option("urls", "\\n"-separated list)``."""

    @classmethod
    def name(cls) -> str:
        return "tidemark-pages"

    def schema(self) -> str:
        return RESULT

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader([u for u in self.options.get("urls", "").split("\n") if u.strip()])
