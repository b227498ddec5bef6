"""The index on disk: chunks with their vectors, partitioned by model, size and mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_index(chunks: DataFrame, path: str, model: str, dim: int, mode: str = "flat") -> None:
    """Replace one namespace; chunk ids must be unique and vectors of the given size."""
    bad = chunks.agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("d"), F.count_if(F.coalesce(F.size("vector"), F.lit(-1)) != dim).alias("w")).first()
    if bad["n"] != bad["d"] or bad["w"]:
        raise ValueError(f"{bad['n'] - bad['d']} repeated chunk ids, {bad['w']} vectors of another size")
    named = chunks.select(*[c for c in chunks.columns if c != "embed_text"], F.lit(model).alias("model"), F.lit(dim).alias("dim"), F.lit(mode).alias("mode"))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "dim", "mode").parquet(path)


def read_index(spark: SparkSession, path: str, model: str, dim: int, mode: str = "flat") -> DataFrame:
    """The chunks of one namespace; only its folders are read."""
    found = spark.read.parquet(path).where((F.col("model") == model) & (F.col("dim") == dim) & (F.col("mode") == mode))
    if found.isEmpty():
        raise ValueError(f"no index of {model}, {dim}, {mode} under {path}")
    return found


def index_meta(chunks: DataFrame) -> DataFrame:
    """One row (chunks, docs, summary_chunks); summaries are not documents."""
    summary = F.col("doc_id").cast("string").startswith("_cluster_")
    return chunks.agg(F.count("*").alias("chunks"), F.countDistinct(F.when(~summary, F.col("doc_id"))).alias("docs"), F.count_if(summary).alias("summary_chunks"))
