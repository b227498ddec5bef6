"""Whole texts go to Python in Arrow batches of a bounded number of rows."""

from __future__ import annotations

from pathlib import Path

import pytest

from sparkgrove.plans import catalogue
from sparkgrove.storage import ARROW_ROWS

DATA = "/root/testdata/sf0.001"
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["wiki_strip", "bm25_batch"])
def test_batches_are_bounded(spark, name):
    before = spark.conf.get(ROWS)
    spark.conf.set(ROWS, "10000")
    try:
        catalogue.QUERIES[name](spark, DATA)
        assert int(spark.conf.get(ROWS)) <= ARROW_ROWS
    finally:
        spark.conf.set(ROWS, before)
