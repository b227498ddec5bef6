"""Search plans: lexical, dense, fused, diverse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrove.functions.text import STOP
from sparkgrove.functions.vectors import dot, normalize
from sparkgrove.operators import ann, dense, embedding, fusion, lexical
from sparkgrove.plans.registry import query
from sparkgrove.storage import Scratch
from sparkgrove.tables import table

QUESTION = "the nation of iner and thation with onther ention"
_STOPS = ", ".join(f"'{w}'" for w in STOP)


def sql_tokens(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda t: len(t) > 1 AND NOT list_contains([{_STOPS}], t))"


_INDEX = f"""
d AS (SELECT doc_id, {sql_tokens("text")} AS ts FROM documents),
tf AS (SELECT doc_id, term, count(*) AS f FROM (SELECT doc_id, unnest(ts) AS term FROM d) GROUP BY ALL),
s AS (SELECT count(*) AS n, avg(len(ts)) AS avg_len FROM d),
idf AS (SELECT term, count(*) AS c, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, s GROUP BY term)"""


def _bm25_sql(queries: str) -> str:
    return f"""WITH {_INDEX},
q AS ({queries}),
qt AS (SELECT query_id, term, count(*) AS m FROM (SELECT query_id, unnest({sql_tokens("text")}) AS term FROM q) GROUP BY ALL),
b AS (SELECT query_id, doc_id, sum(m * idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(ts) / avg_len))) AS bm25 FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN d USING (doc_id), s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, doc_id) AS rank FROM b)
"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("tokenize_terms", f"SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({sql_tokens('text')}) AS term FROM documents) GROUP BY term")
def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one row a document and term first: no distinct sets are carried
    return lexical.term_counts(_docs(spark, sf_dir), "doc_id", "text").groupBy("term").agg(F.sum("f").alias("occurrences"), F.count("*").alias("docs"))


@query("doc_length_stats", f"SELECT count(*) AS n, round(avg(len(ts)), 6) AS avg_len, max(len(ts)) AS longest, count(*) FILTER (len(ts) = 0) AS without_tokens FROM (SELECT {sql_tokens('text')} AS ts FROM documents)")
def doc_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = lexical.lengths(_docs(spark, sf_dir), "doc_id", F.col("text"))
    return lens.agg(F.count("*").alias("n"), F.round(F.avg("len"), 6).alias("avg_len"), F.max("len").cast("bigint").alias("longest"), F.count_if(F.col("len") == 0).alias("without_tokens"))


@query("idf_table", f"WITH {_INDEX} SELECT term, c, round(idf, 6) AS idf FROM idf")
def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.inverted(spark, _docs(spark, sf_dir), "doc_id", "text").terms.withColumn("idf", F.round("idf", 6))


@query("bm25_topk", _bm25_sql(f"SELECT 0 AS query_id, '{QUESTION}' AS text") + "SELECT doc_id, round(bm25, 5) AS bm25, rank FROM r WHERE rank <= 30")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(0, QUESTION)], "query_id bigint, q string")
    found = lexical.bm25(spark, _docs(spark, sf_dir), asked, "doc_id", "text", "q")
    return lexical.top(found, "doc_id", "bm25", 30).select("doc_id", F.round("bm25", 5).alias("bm25"), F.col("rank").cast("bigint").alias("rank"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))


@query("bm25_batch", _bm25_sql("SELECT item_id AS query_id, text FROM benchmark") + "SELECT query_id, doc_id, round(bm25, 4) AS bm25 FROM r WHERE rank <= 30")
def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.bm25(spark, _docs(spark, sf_dir), _asked(spark, sf_dir), "doc_id", "text", "q")
    return lexical.top(found, "doc_id", "bm25", 30).select("query_id", "doc_id", F.round("bm25", 4).alias("bm25"))


@query("l2_normalize", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (3 * x::DOUBLE)^2)), 5) AS before, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE)^2)) / greatest(list_sum(list_transform(embedding, lambda x: (x::DOUBLE)^2)), 1e-24), 6) AS after FROM embeddings")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    tripled = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: 3 * x.cast("double")).alias("v"))
    unit = tripled.withColumn("u", normalize(F.col("v")))
    return unit.select("vec_id", F.round(dot(F.col("v"), F.col("v")), 5).alias("before"), F.round(dot(F.col("u"), F.col("u")), 6).alias("after"))


_COS = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_DENSE = f"""c AS (SELECT a.vec_id AS query_id, b.vec_id, {_COS} AS cosine FROM embeddings a, embeddings b WHERE {{which}}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, vec_id) AS rank FROM c)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def _queries(vectors: DataFrame, which: str) -> DataFrame:
    return vectors.where(which).select(F.col("vec_id").alias("query_id"), "embedding")


@query("dense_topk", f"WITH {_DENSE.format(which='a.vec_id = 0')} SELECT vec_id, round(cosine, 5) AS cosine, rank FROM r WHERE rank <= 30")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return dense.dense_topk(spark, v, _queries(v, "vec_id = 0"), "vec_id", "embedding", 30).select("vec_id", F.round("cosine", 5).alias("cosine"), F.col("rank").cast("bigint").alias("rank"))


@query("dense_topk_batch", f"WITH {_DENSE.format(which='a.vec_id % 50 = 0')} SELECT query_id, vec_id, round(cosine, 5) AS cosine FROM r WHERE rank <= 30")
def dense_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return dense.dense_topk(spark, v, _queries(v, "vec_id % 50 = 0"), "vec_id", "embedding", 30).select("query_id", "vec_id", F.round("cosine", 5).alias("cosine"))


#: Two rankings of the same vectors: by the query itself and by the vector after it.
_PAIR = f"""
p AS (SELECT vec_id AS query_id, vec_id + 1 AS other FROM embeddings WHERE vec_id % 50 = 0),
c AS (SELECT p.query_id, b.vec_id, 1 AS side, {_COS} AS cosine FROM p JOIN embeddings a ON a.vec_id = p.query_id, embeddings b
  UNION ALL SELECT p.query_id, b.vec_id, 2, {_COS} FROM p JOIN embeddings a ON a.vec_id = p.other, embeddings b),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, side ORDER BY round(cosine, 9) DESC, vec_id) AS rank FROM c),
f AS (SELECT query_id, vec_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM k WHERE rank <= 30 GROUP BY ALL),
pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, vec_id) AS rank FROM f QUALIFY rank <= 30)"""


def _pool(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    v = _vectors(spark, sf_dir)
    first = dense.dense_topk(spark, v, _queries(v, "vec_id % 50 = 0"), "vec_id", "embedding", 30)
    second = dense.dense_topk(spark, v, v.where("vec_id % 50 = 1").select((F.col("vec_id") - 1).alias("query_id"), "embedding"), "vec_id", "embedding", 30)
    return v, first, fusion.reciprocal_rank_fusion([first, second], "vec_id", 30)


@query("rrf_fusion", f"WITH {_PAIR} SELECT query_id, vec_id, round(rrf, 8) AS rrf FROM pool")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pool(spark, sf_dir)[2].select("query_id", "vec_id", F.round("rrf", 8).alias("rrf"))


_POOLED = f"""{_PAIR},
v AS (SELECT pool.query_id, pool.vec_id, pool.rank, b.embedding, {_COS} AS cosine FROM pool JOIN embeddings b USING (vec_id) JOIN embeddings a ON a.vec_id = pool.query_id)"""


def _pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, _, pool = _pool(spark, sf_dir)
    asked = _queries(v, "vec_id % 50 = 0").withColumnRenamed("embedding", "q")
    full = pool.join(v, "vec_id").join(asked, "query_id").withColumn("cosine", dot(F.col("embedding"), F.col("q")))
    return full.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "cosine", F.col("embedding").alias("v")))).alias("pool"))


@query(
    "greedy_dedup",
    f"""WITH RECURSIVE {_POOLED},
g AS (SELECT query_id, 0 AS pos, []::BIGINT[] AS kept FROM p
  UNION ALL SELECT g.query_id, pos + 1, CASE WHEN EXISTS (SELECT 1 FROM v b WHERE b.query_id = g.query_id AND list_contains(g.kept, b.vec_id) AND {_COS} >= 0.3) THEN kept ELSE list_append(kept, a.vec_id) END
  FROM g JOIN v a ON a.query_id = g.query_id AND a.rank = pos + 1),
z AS (SELECT query_id, max(pos) AS pos FROM g GROUP BY 1)
SELECT query_id, unnest(kept) AS vec_id FROM g JOIN z USING (query_id, pos)""",
)
def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _pooled(spark, sf_dir).select("query_id", fusion.drop_near_duplicates(F.col("pool"), 0.3).alias("kept"))
    return kept.select("query_id", F.explode("kept.vec_id").alias("vec_id"))


@query(
    "mmr_select",
    f"""WITH RECURSIVE {_POOLED},
g AS (SELECT query_id, 0 AS step, []::BIGINT[] AS chosen FROM p
  UNION ALL SELECT g.query_id, step + 1, list_append(chosen, (
    SELECT arg_min(x.vec_id, x.o) FROM (SELECT a.vec_id, {{'w': -round(CASE WHEN len(g.chosen) = 0 THEN a.cosine ELSE 0.7 * a.cosine - (1 - 0.7) * (SELECT max({_COS}) FROM v b WHERE b.query_id = g.query_id AND list_contains(g.chosen, b.vec_id)) END, 12), 'r': a.rank}} AS o
      FROM v a WHERE a.query_id = g.query_id AND NOT list_contains(g.chosen, a.vec_id)) x))
  FROM g WHERE step < 6)
SELECT query_id, step, chosen[step] AS vec_id FROM g WHERE step > 0""",
)
def mmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = _pooled(spark, sf_dir).select("query_id", fusion.diverse(F.col("pool"), "cosine", 6, 0.7).alias("chosen"))
    return chosen.select("query_id", F.posexplode("chosen.vec_id").alias("at", "vec_id")).select("query_id", (F.col("at") + 1).alias("step"), "vec_id")


@query("near_duplicate_pairs", f"SELECT a.vec_id, min(b.vec_id) FILTER (a.embedding = b.embedding) AS class_id, count(*) FILTER (a.vec_id <> b.vec_id AND ({_COS} >= 0.3 OR a.embedding = b.embedding)) AS links FROM embeddings a, embeddings b GROUP BY a.vec_id")
def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report: each vector's class of equals, and how many others are within the cosine."""
    return dense.similar_pairs(spark, _vectors(spark, sf_dir), "vec_id", "embedding", 0.3)


def _hybrid(spark: SparkSession, sf_dir: str, dim: int = 64) -> tuple[DataFrame, DataFrame]:
    """Hits of all benchmark questions, and the vectors of the documents; each text is embedded once."""
    scratch, embedder = Scratch(spark, "hybrid"), embedding.HashingEmbedder(dim)
    docs = scratch.table(embedding.embed_column(_docs(spark, sf_dir).select("doc_id", "text"), "text", embedder).select("doc_id", "vector"), "docs")
    asked = scratch.table(embedding.embed_column(_asked(spark, sf_dir), "q", embedder, "query", "vector"), "asked")
    words = lexical.top(lexical.bm25(spark, _docs(spark, sf_dir), asked, "doc_id", "text", "q"), "doc_id", "bm25", 30)
    return fusion.search(spark, docs, asked, words, "doc_id", "vector"), docs


#: The embedder's buckets and vectors in SQL, 64 wide.
_EMBED = """SELECT {id}, list_transform(range(64), lambda i: (list_count(list_filter(list_transform({tokens}, lambda t: ('0x' || substr(sha1(t), 1, 7))::BIGINT % 64), lambda b: b = i))::DOUBLE)) AS raw FROM {table}"""
_UNIT = "list_transform(raw, lambda x: (x / greatest(sqrt(list_sum(list_transform(raw, lambda y: y * y))), 1e-12))::FLOAT)"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_HYBRID = f"""{_INDEX},
dv AS (SELECT doc_id, {_UNIT} AS v FROM ({_EMBED.format(id='doc_id', tokens=sql_tokens('text'), table='documents')})),
qv AS (SELECT item_id AS query_id, {_UNIT} AS v FROM ({_EMBED.format(id='item_id', tokens=sql_tokens('text'), table='benchmark')})),
qt AS (SELECT query_id, term, count(*) AS m FROM (SELECT item_id AS query_id, unnest({sql_tokens("text")}) AS term FROM benchmark) GROUP BY ALL),
bm AS (SELECT query_id, doc_id, sum(m * idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(ts) / avg_len))) AS score FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN d USING (doc_id), s GROUP BY ALL),
co AS MATERIALIZED (SELECT query_id, doc_id, {_DOT.format('qv.v', 'dv.v')} AS score FROM qv, dv),
ra AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm QUALIFY rank <= 30
  UNION ALL SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM co QUALIFY rank <= 30),
fu AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM ra GROUP BY ALL),
pool AS MATERIALIZED (SELECT query_id, doc_id, rrf, co.score AS cosine, dv.v, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, doc_id) AS rank FROM fu JOIN co USING (query_id, doc_id) JOIN dv USING (doc_id) QUALIFY rank <= 30),
near AS MATERIALIZED (SELECT a.query_id, a.rank AS ar, b.rank AS br, {_DOT.format('a.v', 'b.v')} AS cosine FROM pool a JOIN pool b ON a.query_id = b.query_id),
g AS (SELECT DISTINCT query_id, 0::BIGINT AS pos, []::BIGINT[] AS kept FROM pool
  UNION ALL SELECT g.query_id, pos + 1, CASE WHEN EXISTS (SELECT 1 FROM near n WHERE n.query_id = g.query_id AND n.ar = pos + 1 AND list_contains(g.kept, n.br) AND n.cosine >= 0.95) THEN kept ELSE list_append(kept, p.rank) END FROM g JOIN pool p ON p.query_id = g.query_id AND p.rank = pos + 1),
k AS (SELECT query_id, arg_max(kept, pos) AS kept FROM g GROUP BY query_id),
m AS (SELECT query_id, kept, 0 AS step, []::BIGINT[] AS chosen FROM k
  UNION ALL SELECT m.query_id, kept, step + 1, list_append(chosen, (
    SELECT arg_min(x.rank, x.o) FROM (SELECT a.rank, {{'w': -round(CASE WHEN len(m.chosen) = 0 THEN a.cosine ELSE 0.7 * a.cosine - (1 - 0.7) * (SELECT max(n.cosine) FROM near n WHERE n.query_id = m.query_id AND n.ar = a.rank AND list_contains(m.chosen, n.br)) END, 12), 'r': a.rank}} AS o
      FROM pool a WHERE a.query_id = m.query_id AND list_contains(m.kept, a.rank) AND NOT list_contains(m.chosen, a.rank)) x))
  FROM m WHERE step < least(6, len(kept))),
hits AS (SELECT query_id, unnest(arg_max(chosen, step)) AS hit FROM m GROUP BY query_id),
found AS (SELECT query_id, doc_id, rrf, cosine, row_number() OVER (PARTITION BY query_id ORDER BY p.rank) AS rank FROM hits JOIN pool p USING (query_id) WHERE p.rank = hit)"""


@query("hybrid_search", f"WITH RECURSIVE {_HYBRID} SELECT query_id, doc_id, round(rrf, 8) AS rrf, round(cosine, 5) AS cosine, rank FROM found")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir)[0].select("query_id", "doc_id", F.round("rrf", 8).alias("rrf"), F.round("cosine", 5).alias("cosine"), F.col("rank").cast("bigint").alias("rank"))


@query("relevance_gate", f"WITH {_DENSE.format(which='a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id')} SELECT query_id, round(max(cosine), 5) AS best_cosine, max(cosine) >= 0.35 AS relevant FROM r WHERE rank <= 6 GROUP BY query_id")
def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    asked = _queries(v, "vec_id % 50 = 0")
    hits = dense.dense_topk(spark, v, asked, "vec_id", "embedding", 7).where("query_id <> vec_id")
    return fusion.relevant(hits, asked, 0.35).withColumn("best_cosine", F.round("best_cosine", 5))


@query("ann_vs_exact")
def ann_vs_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query the overlap of exact and hashed nearest neighbours; exact stays the default."""
    v = _vectors(spark, sf_dir)
    asked = _queries(v, "vec_id % 50 = 0")
    index = ann.build(spark, v, "vec_id", "embedding")
    return ann.compare(index.search(asked, "embedding", 6), dense.dense_topk(spark, v, asked, "vec_id", "embedding", 6), "vec_id")
