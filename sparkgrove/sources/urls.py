"""Routing and rewriting of URLs as column expressions; fetching stays at the edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RAW = "https://raw.githubusercontent.com/"
README_REFS, README_NAMES = ("main", "master"), ("README.md", "readme.md", *(f"README.{ending}" for ending in ("rst", "txt")))
_CODE = r"^https?://(?:www\.)?github\.com/"


def route(url: Column) -> Column:
    """wikipedia, github, or web."""
    return F.when(url.rlike(r"(?i)^https?://[a-z-]+(\.m)?\.wikipedia\.org/"), "wikipedia").when(url.rlike(r"(?i)^https?://((www\.)?github|raw\.githubusercontent)\.com/"), "github").otherwise("web")


def fallback_title(url: Column) -> Column:
    """The path of a URL, or its host where there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1), F.lit("")), F.regexp_extract(url, r"^[^:]+://([^/?#]*)", 1))


def without_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def raw_file(url: Column) -> Column:
    """The raw address of a file page, without query and fragment; null for other pages."""
    repo, rest = (F.regexp_extract(url, _CODE + r"([^/?#]+/[^/?#]+)/blob/([^/]+/[^?#]+)", k) for k in (1, 2))
    return F.when(repo != "", F.concat(F.lit(RAW), F.concat_ws("/", repo, rest)))


def readme_candidates(url: Column) -> Column:
    """Raw addresses to try for a bare repository, in order."""
    owner, name = F.regexp_extract(url, _CODE + r"([^/?#]+)/([^/?#]+?)(?:\.git)?/?(?:[?#].*)?$", 1), F.regexp_extract(url, _CODE + r"([^/?#]+)/([^/?#]+?)(?:\.git)?/?(?:[?#].*)?$", 2)
    return F.when(owner != "", F.array(*[F.concat(F.lit(RAW), F.concat_ws("/", owner, name, F.lit(ref), F.lit(n))) for ref in README_REFS for n in README_NAMES]))
