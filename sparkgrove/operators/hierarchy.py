"""Clusters of chunks and their summaries: spherical k-means, one aggregation a round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrove.functions.vectors import normalize
from sparkgrove.operators.dense import _matrix

ROUNDS = 25


def cluster_count(n: int, size: int = 20) -> int:
    """No clusters under four rows; else at least two, rounded half to even."""
    return 0 if n < 4 else max(2, round(n / size))


def initial(vectors: DataFrame, k: int, key: str, vector: str) -> np.ndarray:
    """The vectors of the k smallest hashes of the key."""
    rows = vectors.orderBy(F.sha1(F.col(key).cast("string").cast("binary")), key).limit(k).select(vector).collect()
    return np.array([r[0] for r in rows], np.float64)


def assign(vectors: DataFrame, centroids: np.ndarray, key: str, vector: str) -> DataFrame:
    """(key, cluster, cosine): the nearest centroid, the first of equals. Centroids are k rows, k bounded by the parameter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            cosine = _matrix(part.column("v")) @ centroids.T if part.num_rows else np.zeros((0, len(centroids)))
            best = cosine.argmax(axis=1) if part.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(best.astype(np.int32)), pa.array(cosine[np.arange(part.num_rows), best])], names=["k", "cluster", "cosine"])

    read = vectors.select(F.col(key).alias("k"), F.col(vector).alias("v"))
    kind = read.schema["k"].dataType.simpleString()
    return read.mapInArrow(run, f"k {kind}, cluster int, cosine double").withColumnRenamed("k", key)


def centroid_step(vectors: DataFrame, centroids: np.ndarray, vector: str) -> DataFrame:
    """(cluster, n, centroid): normalised means of the vectors nearest to each centroid.

    Assignment and sums are one pass over the vectors: a task sends one row a cluster.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape)
        for part in batches:
            if part.num_rows:
                v = _matrix(part.column("v"))
                best = (v @ centroids.T).argmax(axis=1)
                n += np.bincount(best, minlength=len(n))
                np.add.at(sums, best, v)
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(n[full]), pa.array(list(sums[full]), pa.list_(pa.float64()))], names=["cluster", "n", "sums"])

    parts = vectors.select(F.col(vector).alias("v")).mapInArrow(run, "cluster int, n bigint, sums array<double>")
    # a fixed number of dimensions, so the vectors of sums are added place by place
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(d))).alias(f"d{d}") for d in range(centroids.shape[1])])
    return added.select("cluster", "n", normalize(F.array(*[F.col(f"d{d}") / F.col("n") for d in range(centroids.shape[1])])).alias("centroid"))


def kmeans(spark: SparkSession, vectors: DataFrame, key: str, vector: str, k: int, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Assignments and centroids; an empty cluster keeps its centroid; stops when none moves."""
    centroids = initial(vectors, k, key, vector)
    for _ in range(rounds):
        new = centroids.copy()
        for r in centroid_step(vectors, centroids, vector).collect():  # k rows
            new[r["cluster"]] = r["centroid"]
        if np.allclose(new, centroids, atol=1e-9):
            break
        centroids = new
    return assign(vectors, centroids, key, vector), centroids


def summaries(chunks: DataFrame) -> DataFrame:
    """Summary rows (cluster, doc_id, chunk_id, title, section, text) of chunks (cluster, idx, doc_id, title, text) of two titles or more."""
    counts = chunks.groupBy("cluster").agg(F.count("*").alias("m"), F.countDistinct("doc_id").alias("docs"))
    longest = chunks.groupBy("cluster", "title").agg(F.max_by("text", F.struct(F.length("text"), -F.col("idx"))).alias("text"))
    lead = F.regexp_replace(F.trim(F.substring_index("text", ". ", 1)), r"\.+$", "")
    line = F.struct("title", F.concat(F.lit("- "), F.col("title"), F.lit(": "), lead, F.lit(".")).alias("line"))
    listed = longest.groupBy("cluster").agg(F.count("*").alias("k"), F.array_sort(F.collect_list(line)).alias("lines")).where("k >= 2")
    name = F.concat(F.lit("_cluster_"), F.lpad(F.col("cluster").cast("string"), 3, "0"))
    return listed.join(counts, "cluster").select(
        "cluster", name.alias("doc_id"), F.concat(name, F.lit("#0")).alias("chunk_id"),
        F.concat(F.lit("Cluster summary ("), F.col("k").cast("string"), F.lit(" related items)")).alias("title"),
        F.concat(F.col("m").cast("string"), F.lit(" leaf chunks, "), F.col("docs").cast("string"), F.lit(" documents")).alias("section"),
        F.concat(F.lit("This group covers "), F.col("k").cast("string"), F.lit(" related items:\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("text"),
    )


def summary_chunks(spark: SparkSession, chunks: DataFrame, size: int = 20) -> DataFrame | None:
    """Chunks that each sum up a cluster of ``chunks`` (idx, doc_id, title, text, vector), without vectors; none for a corpus too small to cluster."""
    k = cluster_count(chunks.count(), size)
    if not k:
        return None
    assigned, _ = kmeans(spark, chunks, "idx", "vector", k)
    found = summaries(chunks.join(assigned.select("idx", "cluster"), "idx"))
    return found.select(
        "chunk_id", "doc_id", "title", F.lit("").alias("url"), "section", F.array().cast("array<string>").alias("path"), F.lit(0).alias("chunk_no"), "text",
        F.concat("title", F.lit("\n\n"), "text").alias("embed_text"),
    )
