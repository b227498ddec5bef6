"""Fusing rankings, collapsing near-duplicates and choosing diverse rows, per query.

Pools have at most a few dozen rows a query, so the greedy steps are folds over one
bounded array in the JVM, after a single shuffle by query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrove.functions.vectors import dot
from sparkgrove.operators.dense import dense_topk
from sparkgrove.operators.lexical import top
from sparkgrove.storage import Scratch, small


def reciprocal_rank_fusion(rankings: list[DataFrame], key: str, take: int, k: int = 60) -> DataFrame:
    """(query_id, key, rrf, rank) of the pool: sums of 1 / (k + rank) over the rankings a row is in."""
    parts = [r.select("query_id", key, (F.lit(1.0) / (k + F.col("rank"))).alias("part")) for r in rankings]
    both = parts[0]
    for other in parts[1:]:
        both = both.unionAll(other)
    return top(both.groupBy("query_id", key).agg(F.sum("part").alias("rrf")), key, "rrf", take)


def drop_near_duplicates(pool: Column, threshold: float) -> Column:
    """Rows of an ordered ARRAY of structs with a field v whose cosine to no kept row reaches the threshold."""
    start = F.filter(pool, lambda x: F.lit(False))
    return F.aggregate(pool, start, lambda kept, x: F.when(F.exists(kept, lambda y: dot(x["v"], y["v"]) >= threshold), kept).otherwise(F.concat(kept, F.array(x))))


def diverse(pool: Column, relevance: str, count: int, balance: float) -> Column:
    """Maximal marginal relevance: ``count`` rows of an ARRAY of structs (v, the relevance field); ties go to the first."""
    none = F.filter(pool, lambda x: F.lit(False))
    start = F.struct(none.alias("chosen"), pool.alias("rest"))

    def step(a: Column, _: Column) -> Column:
        def worth(x: Column) -> Column:
            near = F.aggregate(a["chosen"], F.lit(-2.0), lambda m, y: F.greatest(m, dot(x["v"], y["v"])))
            return F.when(F.size(a["chosen"]) == 0, x[relevance]).otherwise(F.lit(balance) * x[relevance] - F.lit(1 - balance) * near)

        scored = F.transform(a["rest"], lambda x, i: F.struct(worth(x).alias("w"), (-i).alias("at")))
        # the place of the best is bound as a list of one, so that it is worked out once a step
        taken = F.transform(F.array(-F.array_max(scored)["at"]), lambda at: F.struct(F.concat(a["chosen"], F.slice(a["rest"], at + 1, F.lit(1))).alias("chosen"), F.filter(a["rest"], lambda x, i: i != at).alias("rest")))
        return F.when(F.size(a["rest"]) == 0, a).otherwise(F.get(taken, F.lit(0)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(count)), start, step, lambda a: a["chosen"])


def hybrid(dense: DataFrame, lexical: DataFrame, cosines: DataFrame, vectors: DataFrame, key: str, vector: str, take: int = 30, top_k: int = 6, k: int = 60, threshold: float = 0.95, balance: float = 0.7) -> DataFrame:
    """(query_id, key, rrf, cosine, rank): fusion, near-duplicate removal, diversity, then fused order.

    ``cosines`` has (query_id, key, cosine) for at least all pooled rows.
    """
    pool = reciprocal_rank_fusion([dense, lexical], key, take, k)
    full = pool.join(cosines.select("query_id", key, "cosine"), ["query_id", key]).join(vectors.select(key, F.col(vector).alias("v")), key)
    rows = F.array_sort(F.collect_list(F.struct("rank", F.col(key), "rrf", "cosine", "v")))
    kept = full.groupBy("query_id").agg(rows.alias("pool")).select("query_id", drop_near_duplicates(F.col("pool"), threshold).alias("pool"))
    chosen = kept.select("query_id", F.array_sort(diverse(F.col("pool"), "cosine", top_k, balance)).alias("chosen"))
    return chosen.select("query_id", F.posexplode("chosen").alias("at", "x")).select("query_id", F.col(f"x.{key}").alias(key), "x.rrf", "x.cosine", (F.col("at") + 1).alias("rank"))


def search(spark: SparkSession, vectors: DataFrame, queries: DataFrame, lexical_: DataFrame, key: str, vector: str, take: int = 30, **choice: float) -> DataFrame:
    """:func:`hybrid` of vectors (key, vector) and queries (query_id, vector) with a lexical ranking; only pooled rows meet their vectors again."""
    near = Scratch(spark, "near").table(dense_topk(spark, vectors, queries, key, vector, take), "near")
    pool = near.select("query_id", key).union(lexical_.select("query_id", key)).distinct()
    cosines = pool.join(vectors.select(key, vector), key).join(small(queries.select("query_id", F.col(vector).alias("__q"))), "query_id").select("query_id", key, dot(F.col(vector), F.col("__q")).alias("cosine"))
    return hybrid(near, lexical_, cosines, vectors, key, vector, take, **choice)


def relevant(hits: DataFrame, queries: DataFrame, least: float = 0.55) -> DataFrame:
    """(query_id, best_cosine, relevant) for every query; no hits are not relevant."""
    best = hits.groupBy("query_id").agg(F.max("cosine").alias("best_cosine"))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", "best_cosine", F.coalesce(F.col("best_cosine") >= least, F.lit(False)).alias("relevant"))
