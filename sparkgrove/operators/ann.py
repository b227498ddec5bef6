"""Approximate nearest neighbours: a kept index of random-hyperplane buckets, with exact cosines for its candidates.

Each table hashes a unit vector to the signs of a few random directions; a query meets
the vectors of its own bucket and of those one sign away. The index is a narrow table
(bucket, key) in front of the vectors, so it can be added to.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrove.operators.dense import _matrix, scan
from sparkgrove.operators.lexical import top
from sparkgrove.storage import Scratch

TABLES, BITS, SEED = 12, 6, 1


def _codes(v: np.ndarray) -> np.ndarray:
    """A byte a table for each vector: the signs of its directions."""
    planes = np.random.default_rng(SEED).standard_normal((v.shape[1], TABLES * BITS))
    bits = ((v @ planes) > 0).reshape(len(v), TABLES, BITS)
    return (bits @ (1 << np.arange(BITS))).astype(np.uint8)


def _buckets(vectors: DataFrame, key: str, vector: str, near: bool) -> DataFrame:
    """(key, bucket) of every table; with ``near`` also the buckets one sign away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"))
            own = _codes(v).astype(np.int64)
            flips = np.concatenate(([0], 1 << np.arange(BITS))) if near else np.array([0])
            found = (own[:, :, None] ^ flips) + (np.arange(TABLES)[None, :, None] << BITS)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(np.repeat(np.arange(len(v)), TABLES * len(flips)))), pa.array(found.ravel())], names=["key", "bucket"])

    read = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v"))
    return read.mapInArrow(run, f"key {read.schema['key'].dataType.simpleString()}, bucket bigint").withColumnRenamed("key", key)


@dataclass
class Hashed:
    """Vectors (key, vector) and their buckets."""

    key: str
    vector: str
    vectors: DataFrame
    buckets: DataFrame

    def search(self, queries: DataFrame, vector: str, take: int) -> DataFrame:
        """(query_id, key, cosine, rank) of the best candidates of each query (query_id, vector).

        With so few bits a query's buckets hold a fixed share of all vectors, so candidates are
        as many as queries times vectors. They are told by comparing codes in blocks, and no pair
        is written out or shuffled.
        """
        asked = queries.select("query_id", F.col(vector).alias(self.vector))
        return top(scan(queries.sparkSession, self.vectors, asked, self.key, self.vector, take, _codes), self.key, "cosine", take)

    def add(self, vectors: DataFrame) -> Hashed:
        """The index with the rows whose keys it lacks."""
        new = vectors.join(self.vectors.select(self.key), self.key, "left_anti").select(self.key, self.vector)
        return Hashed(self.key, self.vector, self.vectors.select(self.key, self.vector).union(new), self.buckets.union(_buckets(new, self.key, self.vector, near=False)))


def build(spark: SparkSession, vectors: DataFrame, key: str, vector: str) -> Hashed:
    buckets = Scratch(spark, "ann").table(_buckets(vectors, key, vector, near=False), "buckets")
    return Hashed(key, vector, vectors.select(key, vector), buckets)


def compare(approximate: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """(query_id, overlap, k, same): how many of the exact rows the other search found, and whether it found all."""
    both = exact.select("query_id", key).join(approximate.select("query_id", key, F.lit(1).alias("found")), ["query_id", key], "left")
    return both.groupBy("query_id").agg(F.count("found").alias("overlap"), F.count("*").alias("k")).withColumn("same", F.col("overlap") == F.col("k"))
