"""The overview of a collection: a manifest of its documents and their lead chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkgrove.storage import numbered

MOST_SECTIONS = 12


def manifest(chunks: DataFrame) -> DataFrame:
    """(doc_id, title, n, sections, line): chunks (doc_id, title, section, idx) by document.

    ``sections`` are the first-level ones in order of appearance, the first twelve.
    Summaries of clusters are not documents.
    """
    real = chunks.where(~F.col("doc_id").cast("string").startswith("_cluster_"))
    first = real.groupBy("doc_id").agg(F.count("*").alias("n"), F.min_by("title", "idx").alias("title"))
    level = F.substring_index("section", " > ", 1)
    named = real.where("section <> ''").groupBy("doc_id", level.alias("name")).agg(F.min("idx").alias("at"))
    ranked = named.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))).where(F.col("r") <= MOST_SECTIONS)
    listed = ranked.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), ", ").alias("sections"))
    line = F.concat(F.lit("- "), F.col("title"), F.lit(" ("), F.col("n").cast("string"), F.lit(" passages) - sections: "), F.col("sections"))
    return first.join(listed, "doc_id", "left").withColumn("sections", F.coalesce("sections", F.lit("(no subsections)"))).withColumn("line", line).select("doc_id", "title", "n", "sections", "line")


def leads(chunks: DataFrame) -> DataFrame:
    """The first chunk of each document among those of no section."""
    order = Window.partitionBy("doc_id").orderBy("idx")
    return chunks.where("section = ''").withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def overview_blocks(spark: SparkSession, chunks: DataFrame) -> DataFrame:
    """(n, chunk_id, title, section, url, text): the manifest as block 1, then the leads by title.

    One block holds a line of every document, as the overview's contract has it.
    """
    lines = manifest(chunks)
    total = lines.agg(F.count("*").alias("d"), F.sum("n").alias("c"), F.array_sort(F.collect_list(F.struct("title", "doc_id", "line"))).alias("l"))
    head = F.concat(F.lit("This collection contains "), F.col("d").cast("string"), F.lit(" documents ("), F.coalesce("c", F.lit(0)).cast("string"), F.lit(" indexed passages in total). The documents and their sections are:\n\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    first = total.select(F.lit(1).cast("bigint").alias("n"), F.lit("corpus#manifest").alias("chunk_id"), F.lit("Corpus manifest").alias("title"), *[F.lit("").alias(c) for c in ("section", "url")], head.alias("text"))
    rest = numbered(spark, leads(chunks), "n", "title", "idx").select((F.col("n") + 1).alias("n"), "chunk_id", "title", "section", "url", "text")
    return first.unionByName(rest)
