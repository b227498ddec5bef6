"""The corpus as a table: upsert with content dedup, delete, listing, sync with an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_hash() -> Column:
    return F.sha1(F.col("text").cast("binary"))


def add(corpus: DataFrame, incoming: DataFrame, order: str, replace: bool = False) -> DataFrame:
    """Rows of ``incoming`` that enter: new text under a new id, the first by ``order``.

    A text already there under another id, and an id already there, are skipped; rows of
    one call see the earlier ones. ``replace`` lets every last row of an id in.
    """
    if replace:
        last = Window.partitionBy("doc_id").orderBy(F.desc(order))
        return incoming.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")
    hashed = incoming.withColumn("__h", text_hash())
    known = corpus.select(text_hash().alias("__h")).distinct()
    fresh = hashed.join(known, "__h", "left_anti").join(corpus.select("doc_id").distinct(), "doc_id", "left_anti")
    by_id, by_text = Window.partitionBy("doc_id").orderBy(order), Window.partitionBy("__h").orderBy(order)
    first = fresh.withColumn("__i", F.row_number().over(by_id)).where("__i = 1").withColumn("__t", F.row_number().over(by_text)).where("__t = 1")
    return first.select(*incoming.columns)


def upsert(corpus: DataFrame, incoming: DataFrame, order: str, replace: bool = False) -> DataFrame:
    """The corpus after :func:`add`."""
    entering = add(corpus, incoming, order, replace).select(*corpus.columns)
    stays = corpus.join(entering.select("doc_id"), "doc_id", "left_anti") if replace else corpus
    return stays.unionByName(entering)


def remove(corpus: DataFrame, ids: DataFrame) -> DataFrame:
    return corpus.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def duplicate_groups(corpus: DataFrame) -> DataFrame:
    """(text_sha1, n, first_id) of texts under more than one id."""
    return corpus.groupBy(text_hash().alias("text_sha1")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def sync(index_ids: DataFrame, corpus_ids: DataFrame) -> DataFrame:
    """(doc_id, state): stale ids are only in the index, missing ones only in the corpus."""
    a = index_ids.select("doc_id").distinct().withColumn("__a", F.lit(True))
    b = corpus_ids.select("doc_id").distinct().withColumn("__b", F.lit(True))
    return a.join(b, "doc_id", "full_outer").where("__a is null or __b is null").select("doc_id", F.when(F.col("__b").isNull(), "stale").otherwise("missing").alias("state"))


def totals(corpus: DataFrame) -> DataFrame:
    return corpus.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"), F.countDistinct("doc_id").alias("ids"))


def chunk_sizes(chunks: DataFrame) -> DataFrame:
    """One row (chunks, upper median, max) of chunk lengths; the median by rank over a histogram, not a list of all."""
    by_size = chunks.groupBy(F.length("text").alias("size")).agg(F.count("*").alias("n"))
    running = by_size.withColumn("upto", F.sum("n").over(Window.orderBy("size")))  # one row a length
    total = by_size.agg(F.sum("n").alias("chunks"), F.max("size").alias("largest"))
    return running.crossJoin(F.broadcast(total)).where(F.col("upto") > F.floor(F.col("chunks") / 2)).groupBy("chunks", "largest").agg(F.min("size").alias("median"))
