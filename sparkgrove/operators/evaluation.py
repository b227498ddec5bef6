"""Scores of a labelled set as plain aggregations over one row a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cache_key(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, 16)


def document_ranks(hits: DataFrame) -> DataFrame:
    """(query_id, doc_id, doc_rank): documents in order of their first hit."""
    first = hits.groupBy("query_id", "doc_id").agg(F.min("rank").alias("first"))
    return first.withColumn("doc_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("first"))).select("query_id", "doc_id", "doc_rank")


def wanted_rank(ranks: DataFrame, wanted: DataFrame, exact: bool = False) -> DataFrame:
    """(query_id, want, rank): the first document that is the wanted one, or has its name and a hyphen before its own tail."""
    name = F.col("doc_id").cast("string")
    tail = F.regexp_extract(name, "^(.*)-[0-9a-f]{6}$", 1).eqNullSafe(F.col("want")) if exact else F.startswith(name, F.concat("want", F.lit("-")))
    met = wanted.join(ranks, "query_id").where((name == F.col("want")) | tail)
    best = met.groupBy("query_id").agg(F.min("doc_rank").alias("rank"))
    return wanted.join(best, "query_id", "left").select("query_id", "want", "rank")


def ranking_scores(ranked: DataFrame) -> DataFrame:
    """One row (questions, recall, mrr, ndcg) of (query_id, rank or null)."""
    r = F.col("rank")
    return ranked.agg(
        F.count("*").alias("questions"),
        F.avg(r.isNotNull().cast("int")).alias("recall"),
        F.avg(F.coalesce(1.0 / r, F.lit(0.0))).alias("mrr"),
        F.avg(F.coalesce(1.0 / F.log2(r + 1.0), F.lit(0.0))).alias("ndcg"),
    )


def facts_met(answer: Column, must: Column) -> Column:
    """Whether every pattern is found in the answer, in either case."""
    return F.forall(must, lambda p: F.coalesce(F.rlike(answer, F.concat(F.lit("(?i)"), p)), F.lit(False)))


def context_precision(rows: DataFrame) -> DataFrame:
    """One row: mean share of hits that are cited, over questions with hits."""
    return rows.where("n_hits > 0").agg(F.avg(F.col("n_cited") / F.col("n_hits")).alias("context_precision"))


def refusals(rows: DataFrame) -> DataFrame:
    """(kind, n, refused, rate) by kind, and of all as kind null."""
    return rows.rollup("kind").agg(F.count("*").alias("n"), F.count_if("refused").alias("refused"), F.avg(F.col("refused").cast("int")).alias("rate"))


def accuracy(rows: DataFrame) -> DataFrame:
    """The rows (answer, refused, must ARRAY) with correct, false_refusal, and missed, the patterns that an answer lacks."""
    missed = F.when(F.col("refused"), F.filter("must", lambda p: F.lit(False))).otherwise(F.filter("must", lambda p: ~F.coalesce(F.rlike(F.coalesce("answer", F.lit("")), F.concat(F.lit("(?i)"), p)), F.lit(False))))
    return rows.withColumn("missed", missed).withColumn("correct", ~F.col("refused") & (F.size("missed") == 0)).withColumn("false_refusal", F.col("refused"))


def faithfulness(verdicts: DataFrame, least: int = 80) -> DataFrame:
    """One row (faithfulness, judged, doubtful) of verdicts (score or null)."""
    return verdicts.agg(F.avg("score").alias("faithfulness"), F.count("score").alias("judged"), F.count_if(F.col("score") < least).alias("doubtful"))
