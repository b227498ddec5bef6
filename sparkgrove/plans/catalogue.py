"""All plans: importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkgrove.plans import collections_, search, texts
from sparkgrove.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "collections_", "flagship", "texts"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search of all benchmark questions over the documents."""
    return search.hybrid_search(spark, sf_dir)
