"""BM25 over an inverted index: postings that carry the document's length, term weights, and two numbers of the corpus.

A document is a row, so its terms are counted where it is read, without a shuffle. An
index is built once and kept (see :mod:`sparkgrove.sources.index`); without one, a search
reads the corpus once and keeps only the postings of the terms that are asked for.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkgrove.functions.text import STOP, tokens
from sparkgrove.storage import Scratch, bound_batches, small

#: Up to this many distinct query terms are looked for while the corpus is read; beyond it, all postings meet them in a join.
BROADCAST_TERMS = 200_000
K1, B = 1.5, 0.75
#: Postings that a worker holds before it hands them on.
FLUSH = 50_000
_RUN = re.compile("[0-9a-z]+")


def words(text: str | None, stop: frozenset[str] = frozenset(STOP)) -> list[str]:
    """The tokens of a text, as :func:`sparkgrove.functions.text.tokens` has them."""
    return [t for t in _RUN.findall((text or "").lower()) if t[1:] and t not in stop]


def postings(docs: DataFrame, key: str, text: str, only: frozenset[str] | None = None) -> DataFrame:
    """(key, term, f, len): how often a term occurs in a document, and the document's tokens.

    Each document also has one row of the null term, which keeps its length where no
    term is left. ``only``: the terms that are wanted.
    """
    bound_batches(docs.sparkSession)
    read = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = read.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            took: list[int] = []
            terms: list[str | None] = []
            counts: list[int] = []
            lens: list[int] = []

            def flush(ids=batch.column("key"), took=took, terms=terms, counts=counts, lens=lens) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([ids.take(pa.array(took, pa.int64())), pa.array(terms, pa.string()), pa.array(counts, pa.int64()), pa.array(lens, pa.int64())], names=["key", "term", "f", "len"])

            for row, t in enumerate(batch.column("text")):  # one text at a time is a Python string
                found = words(t.as_py())
                counted = Counter(found) if only is None else Counter(w for w in found if w in only)
                took += [row] * (len(counted) + 1)
                terms += [None, *counted]
                counts += [0, *counted.values()]
                lens += [len(found)] * (len(counted) + 1)
                if len(terms) > FLUSH:
                    yield flush()
                    for part in (took, terms, counts, lens):
                        part.clear()
            yield flush()

    return read.mapInArrow(run, f"key {kind}, term string, f bigint, len bigint").withColumnRenamed("key", key)


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, f): how often a term occurs in a document."""
    return postings(docs, key, text).where("term is not null").select(key, "term", "f")


def lengths(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, len): tokens of a document, also where there are none."""
    return docs.select(key, F.size(tokens(text)).alias("len"))


def corpus_stats(found: DataFrame) -> DataFrame:
    """One row (n, avg_len) of rows with a length, one a document."""
    return found.agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg_len"))


def weight(n: Column, c: Column) -> Column:
    """The weight of a term in ``c`` of ``n`` documents: ln(1 + (n - c + 1/2) / (c + 1/2)), never negative."""
    return F.log((n + 1) / (c + 0.5))


def idf_table(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, c, idf): documents with the term, and its weight."""
    return counts.groupBy("term").agg(F.count("*").alias("c")).crossJoin(F.broadcast(stats)).select("term", "c", weight(F.col("n"), F.col("c")).alias("idf"))  # stats: one row


@dataclass
class Inverted:
    """An inverted index: postings (key, term, f, len), terms (term, c, idf), and the corpus's size and mean length."""

    key: str
    postings: DataFrame
    terms: DataFrame
    n: int
    avg_len: float

    def score(self, asked: DataFrame) -> DataFrame:
        """(query_id, key, bm25) of all documents that share a term with a query; asked: (query_id, term, m), its terms and their numbers."""
        weighed = asked.join(self.terms.select("term", "idf"), "term")
        # few terms are asked for, so the postings are filtered where they lie
        met = self.postings.join(small(weighed.select("query_id", "term", (F.col("m") * F.col("idf")).alias("w"))), "term")
        norm = F.col("f") + K1 * (1 - B + B * F.col("len") / F.lit(self.avg_len or 1.0))
        return met.groupBy("query_id", self.key).agg(F.sum(F.col("w") * F.col("f") * (K1 + 1) / norm).alias("bm25"))


def asked_terms(queries: DataFrame, query: str) -> DataFrame:
    """(query_id, term, m) of (query_id, query)."""
    return queries.select("query_id", F.explode(tokens(F.col(query))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("m"))


def inverted(spark: SparkSession, docs: DataFrame, key: str, text: str, asked: DataFrame | None = None) -> Inverted:
    """An index of all terms, or of those that are asked for, in the shared folder; the corpus is read once."""
    scratch, only = Scratch(spark, "inverted"), None
    if asked is not None:
        wanted = asked.select("term").distinct().limit(BROADCAST_TERMS + 1).collect()  # bounded by the limit
        only = frozenset(r["term"] for r in wanted) if len(wanted) <= BROADCAST_TERMS else None
    found = scratch.table(postings(docs, key, text, only), "postings")
    stats = corpus_stats(found.where("term is null")).first()
    hits = found.where("term is not null")
    terms = hits.groupBy("term").agg(F.count("*").alias("c")).select("term", "c", weight(F.lit(stats["n"]), F.col("c")).alias("idf"))
    return Inverted(key, hits, scratch.table(terms, "terms"), stats["n"], stats["avg_len"])


def bm25(spark: SparkSession, docs: DataFrame, queries: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """(query_id, key, bm25) without a kept index; repeated query terms count again."""
    asked = Scratch(spark, "asked").table(asked_terms(queries, query), "terms")
    return inverted(spark, docs, key, text, asked).score(asked)


def top(scored: DataFrame, key: str, score: str, take: int, by: str = "query_id") -> DataFrame:
    """The best rows of each query with their rank; ties, to nine digits, go to the smaller key.

    The rounding keeps the order of summation from deciding between equal scores.
    """
    order = Window.partitionBy(by).orderBy(F.round(score, 9).desc(), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= take)
