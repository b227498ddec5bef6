"""An engine against a labelled set of questions: retrieval, accuracy, refusals and, if wanted, faithfulness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrove.engine import Engine
from sparkgrove.operators import evaluation, grounding
from sparkgrove.storage import Scratch, Versioned, small

_ANSWERABLE = "array<struct<q: string, doc: string, must: array<string>>>"
_UNANSWERABLE = "array<struct<q: string, kind: string>>"
ANSWERS = "key string, answer string, refused boolean, citations array<int>, gated boolean, best_cosine double, note string"
VERDICTS = "key string, score int, reason string"


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, question, doc, must, kind) of a JSON file with lists ``answerable`` (q, doc, must) and ``unanswerable`` (q, kind); kind is null for the first."""
    spec = spark.read.schema(f"answerable {_ANSWERABLE}, unanswerable {_UNANSWERABLE}").json(path, multiLine=True)
    yes = spec.select(F.posexplode("answerable").alias("at", "x")).select("at", F.col("x.q").alias("question"), "x.doc", "x.must", F.lit(None).cast("string").alias("kind"))
    no = spec.select(F.posexplode("unanswerable").alias("at", "x")).select(F.col("at") + 1_000_000, F.col("x.q").alias("question"), F.lit(None).cast("string").alias("doc"), F.array().cast("array<string>").alias("must"), F.coalesce("x.kind", F.lit("")).alias("kind"))
    return yes.union(no).withColumnRenamed("at", "query_id").withColumn("query_id", F.col("query_id").cast("bigint"))


class Evaluator:
    """Runs questions through an engine. Each lot of answers is kept before the next is asked for, so a stopped run goes on where it was."""

    def __init__(self, engine: Engine, path: str | None = None, judge: grounding.Generator | None = None, lot: int = 1000) -> None:
        self.engine, self.spark, self.judge, self.lot = engine, engine.spark, judge, lot
        root = path or f"{engine.path}/evaluation"
        self.answers, self.verdicts = Versioned(self.spark, f"{root}/answers"), Versioned(self.spark, f"{root}/verdicts")

    def _keyed(self, asked: DataFrame) -> DataFrame:
        e = self.engine
        parts = [F.col("question"), *[F.lit(str(x)) for x in (e.generator.name, e.embedder.name, e.embedder.dim, e.settings.mode, e.settings.top_k)]]
        return asked.withColumn("key", evaluation.cache_key(*parts))

    def answer(self, asked: DataFrame) -> DataFrame:
        """The questions with their answers; only those that are not kept yet are asked."""
        keyed = Scratch(self.spark, "eval").table(self._keyed(asked), "keyed")
        new = keyed.join(self.answers.read(ANSWERS).select("key"), "key", "left_anti").dropDuplicates(["key"])
        new = Scratch(self.spark, "eval").table(new.select("query_id", "question", "key"), "new")
        lots = -(-new.count() // self.lot)
        for k in range(lots):
            part = new.where(F.pmod(F.xxhash64("key"), F.lit(lots)) == k)
            self.answers.append(self.engine.ask(part).join(part.select("query_id", "key"), "query_id").select(*_names(ANSWERS)))
        return keyed.join(self.answers.read(ANSWERS).dropDuplicates(["key"]), "key")

    def _judged(self, answered: DataFrame, contexts: DataFrame) -> DataFrame:
        keyed = answered.withColumn("judged", evaluation.cache_key(F.lit("faith"), F.col("question"), F.coalesce("answer", F.lit("")), F.lit(self.judge.name)))
        keyed = keyed.where(~F.col("refused") & (F.size("citations") > 0))
        new = keyed.join(self.verdicts.read(VERDICTS).select(F.col("key").alias("judged")), "judged", "left_anti")
        found = grounding.judge(new.select("query_id", "answer", "refused"), contexts, self.judge)
        self.verdicts.append(found.join(new.select("query_id", F.col("judged").alias("key")), "query_id").select(*_names(VERDICTS)))
        return keyed.select("query_id", F.col("judged").alias("key")).join(self.verdicts.read(VERDICTS).dropDuplicates(["key"]), "key").select("query_id", "score", "reason")

    def run(self, asked: DataFrame, fresh: bool = False) -> tuple[DataFrame, DataFrame]:
        """(a row a question, one row of summary) of questions (query_id, question, doc, must, kind)."""
        scratch = Scratch(self.spark, "evaluate")
        if fresh:
            self.answers.clear()
            self.verdicts.clear()
        asked = scratch.table(asked, "asked")
        answered = scratch.table(self.answer(asked), "answered")
        hits = scratch.table(self.engine.hits(asked.select("query_id", "question")), "hits")
        wanted = asked.where("kind is null and doc is not null").select("query_id", F.col("doc").alias("want"))
        ranks = evaluation.wanted_rank(evaluation.document_ranks(hits.where("route = 'retrieval'")), wanted).select("query_id", F.col("rank").alias("doc_rank"))
        counts = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"))
        rows = evaluation.accuracy(answered).join(small(scratch.table(ranks, "ranks")), "query_id", "left").join(small(scratch.table(counts, "counts")), "query_id", "left")
        if self.judge is not None:
            rows = rows.join(self._judged(answered.where("kind is null"), grounding.context(hits)), "query_id", "left")
        else:
            rows = rows.withColumn("score", F.lit(None).cast("int")).withColumn("reason", F.lit(None).cast("string"))
        answerable, ranked = F.col("kind").isNull(), F.col("kind").isNull() & F.col("doc").isNotNull()
        detail = scratch.table(
            rows.select(
                "query_id", "question", "kind", "doc", "doc_rank", (F.col("doc").isNull() | F.col("doc_rank").isNotNull()).alias("retrieved"), "answer", "refused", "gated", "best_cosine", "citations", F.coalesce("n_hits", F.lit(0)).alias("n_hits"),
                F.when(answerable, F.col("correct")).alias("correct"), F.when(answerable, F.col("false_refusal")).alias("false_refusal"), "missed", "score", "reason",
            ),
            "detail",
        )
        summary = detail.agg(
            F.count_if(answerable).alias("answerable"),
            F.avg(F.when(answerable, F.col("retrieved").cast("int"))).alias("recall"),
            F.avg(F.when(ranked, F.coalesce(1.0 / F.col("doc_rank"), F.lit(0.0)))).alias("mrr"),
            F.avg(F.when(ranked, F.coalesce(1.0 / F.log2(F.col("doc_rank") + 1.0), F.lit(0.0)))).alias("ndcg"),
            F.avg(F.when(ranked & (F.col("n_hits") > 0), F.size("citations") / F.col("n_hits"))).alias("context_precision"),
            F.avg(F.col("correct").cast("int")).alias("accuracy"),
            F.count_if("false_refusal").alias("false_refusals"),
            F.count_if(answerable & ~F.col("refused") & (F.size("missed") > 0)).alias("fact_misses"),
            F.avg("score").alias("faithfulness"),
            F.count_if(F.col("score") < 80).alias("doubtful"),
            F.count_if(~answerable).alias("unanswerable"),
            F.avg(F.when(~answerable, F.col("refused").cast("int"))).alias("refusal_rate"),
            F.count_if(~answerable & ~F.col("refused")).alias("leaks"),
        )
        return detail, summary

    def by_kind(self, detail: DataFrame) -> DataFrame:
        """(kind, n, refused, rate) of the unanswerable questions, and of all as kind null."""
        return evaluation.refusals(detail.where("kind is not null").select("kind", "refused"))
