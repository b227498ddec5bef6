"""Documents from addresses: encyclopedia articles, files of code hosts, web pages. Fetching is behind an interface."""

from __future__ import annotations

import hashlib
import json
import re
import urllib.parse
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrove.functions import segment
from sparkgrove.sources import files
from sparkgrove.sources.urls import README_NAMES, README_REFS

LEAST_ARTICLE = 200
_MARKDOWN = (".md", ".markdown")


class Fetcher(Protocol):
    """The text behind an address, or None."""

    def get(self, url: str) -> str | None: ...


class UrlFetcher:
    """Fetching by HTTP; bytes that are no UTF-8 are replaced, and any failure is None."""

    def __init__(self, agent: str = "sparkgrove", timeout: float = 30) -> None:
        self.agent, self.timeout = agent, timeout

    def get(self, url: str) -> str | None:
        opener = urllib.request.build_opener()
        opener.addheaders = [("User-Agent", self.agent)]
        try:
            with opener.open(url, timeout=self.timeout) as reply:
                return str(reply.read(), "utf-8", "replace")
        except (OSError, ValueError):
            return None


def _slug(text: str) -> str:
    return "-".join(re.findall("[a-z0-9]+", text.lower()))[:60].rstrip("-") or "doc"


def _document(title: str, url: str, text: str, kind: str) -> dict[str, str]:
    name = f"{_slug(title)}-{hashlib.sha1(url.encode()).hexdigest()[:6]}"
    return dict(zip(files.DOCUMENT.names, (name, title, url, segment.tidy(text), kind), strict=True))


_API, _PAGE = "https://{}.wikipedia.org/w/api.php?{}", "https://{}.wikipedia.org/wiki/{}"


def _article(lang: str, name: str, fetcher: Fetcher) -> dict[str, str]:
    """By the encyclopedia's interface, which follows redirects and gives plain text with wiki headings."""
    wanted = {"format": "json", "formatversion": 2, "action": "query", "prop": "extracts", "explaintext": 1, "redirects": 1, "titles": name.replace("_", " ")}
    reply = fetcher.get(_API.format(lang, urllib.parse.urlencode(wanted)))
    page = next(iter(json.loads(reply or "{}").get("query", {"pages": ()})["pages"]), {"missing": True})
    if page.get("missing"):
        raise LookupError(f"no article {name}")
    text = segment.without_reference_parts(page.get("extract") or "")
    if len(text) < LEAST_ARTICLE:
        raise LookupError(f"hardly any text in {name}")
    own = page["title"]
    return _document(own, _PAGE.format(lang, urllib.parse.quote(own.replace(" ", "_"))), text, "wikipedia")


def _file(url: str, name: str, text: str | None) -> dict[str, str]:
    if not (text or "").strip():
        raise LookupError(f"nothing in {name}")
    markdown = name.lower().endswith(_MARKDOWN)
    title = next((h[1] for line in text.split("\n") if (h := segment.heading(line)) and h[0] == 1 and line.startswith("#")), name) if markdown else name
    return _document(title, url, text, "markdown" if markdown else "text")


def _code_host(url: str, fetcher: Fetcher) -> dict[str, str] | None:
    """A file, or a repository's readme, as it was written; None for other pages of the host."""
    parts = urllib.parse.urlsplit(url)
    path = parts.path.strip("/").split("/")
    if parts.hostname and parts.hostname.startswith("raw."):
        return _file(url, path[-1], fetcher.get(url))
    if len(path) > 2 and path[2] == "tree":
        raise LookupError(f"{url} is a folder: name a file")
    raw = "https://raw.githubusercontent.com"
    if len(path) > 4 and path[2] == "blob":
        return _file(url, path[-1], fetcher.get("/".join([raw, *path[:2], *path[3:]])))
    if len(path) == 2 and all(path):
        for ref in README_REFS:
            for name in README_NAMES:
                if text := fetcher.get("/".join([raw, path[0], path[1].removesuffix(".git"), ref, name])):
                    return _file(url, name, text)
        raise LookupError(f"no readme in {url}")
    return None


def read_url(url: str, fetcher: Fetcher) -> dict[str, str]:
    """The document behind an address; LookupError says why there is none."""
    parts = urllib.parse.urlsplit(url)
    host, path = (parts.hostname or "").lower(), urllib.parse.unquote(parts.path)
    if host.endswith(".wikipedia.org") and path.startswith("/wiki/"):
        return _article(host.split(".")[0], path.removeprefix("/wiki/"), fetcher)
    if host.removeprefix("www.") in ("github.com", "raw.githubusercontent.com") and (found := _code_host(url, fetcher)):
        return found
    html = fetcher.get(url)
    if not html:
        raise LookupError(f"nothing came from {url}")
    title, text = files.extract_html(html)
    if text is None:
        raise LookupError(f"no text in {url}")
    return _document(title or urllib.parse.urlsplit(url).path or url, url, text, "html")


def load(spark: SparkSession, urls: DataFrame, fetcher: Fetcher | None = None) -> DataFrame:
    """The documents of addresses (url), and ``error`` where there is none: one row an address."""
    fetch = fetcher or UrlFetcher()
    names = [*files.DOCUMENT.names, "error"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for url in frame["url"]:
                try:
                    rows.append(read_url(url, fetch) | {"error": None})
                except (LookupError, ValueError) as why:
                    rows.append({"url": url, "error": str(why)})
            yield pd.DataFrame(rows, columns=names)

    return urls.select("url").mapInPandas(run, ", ".join(f"{n} string" for n in names))


def load_sources(spark: SparkSession, sources: list[str], fetcher: Fetcher | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, failures (source, error)) of addresses, files and folders; what can't be read does not stop the rest."""
    addresses = [s for s in sources if re.match(r"(?i)https?://", s)]
    found, failed = spark.createDataFrame([], files.DOCUMENT), spark.createDataFrame([], "source string, error string")
    for path in (s for s in sources if s not in addresses):
        try:
            here = files.load(spark, path)
            if here.isEmpty():
                raise LookupError("no readable document")
            found = found.unionByName(here)
        except Exception as why:  # an absent path, or one without documents
            failed = failed.union(spark.createDataFrame([(path, str(why).split("\n")[0])], failed.schema))
    if addresses:
        got = load(spark, spark.createDataFrame([(a,) for a in addresses], "url string"), fetcher)
        found = found.unionByName(got.where("error is null").select(*files.DOCUMENT.names))
        failed = failed.union(got.where(F.col("error").isNotNull()).select(F.col("url"), "error"))
    return found, failed
