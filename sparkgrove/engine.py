"""A document collection from its sources to answers: a corpus, its index, and questions in batches.

    corpus = Corpus(spark, "/data/mine/corpus"); corpus.add(files.load(spark, "/texts"))
    engine = Engine(spark, "/data/mine"); engine.ingest(); engine.ask(questions)

The index keeps what every question needs, so that nothing of the corpus is read or
worked out again: chunks with their vectors, postings, term weights, and the corpus's size.
"""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrove.config import Settings
from sparkgrove.functions.text import is_corpus_question
from sparkgrove.operators import ann, chunking, dense, embedding, fusion, grounding, hierarchy, lexical, overview
from sparkgrove.operators import corpus as rows
from sparkgrove.sources.files import DOCUMENT
from sparkgrove.storage import Scratch, Versioned, numbered, releasing, small

_SHOWN = ("chunk_id", "doc_id", "title", "url", "section", "text")


class Corpus:
    """Documents (doc_id, title, url, text, kind), one row each, with content dedup."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.table = spark, Versioned(spark, path)

    def documents(self, strict: bool = False) -> DataFrame:
        """All documents; with ``strict`` an empty corpus is an error."""
        found = self.table.read(DOCUMENT)
        if strict and found.isEmpty():
            raise ValueError("the corpus is empty: add documents first")
        return found

    def add(self, incoming: DataFrame, replace: bool = False) -> DataFrame:
        """The documents that came in; see :func:`sparkgrove.operators.corpus.add`."""
        old = self.documents()
        ordered = incoming.select(*DOCUMENT.names).withColumn("__o", F.monotonically_increasing_id())
        new = Scratch(self.spark, "corpus").table(rows.add(old, ordered, "__o", replace).select(*DOCUMENT.names), "new")
        if replace:
            self.table.write(old.join(new.select("doc_id"), "doc_id", "left_anti").select(*DOCUMENT.names).unionByName(new))
        elif not new.isEmpty():
            self.table.append(new)
        return new

    def remove(self, *doc_ids: str) -> dict[str, bool]:
        """Whether each document was there; the index keeps it until the next ingest."""
        there = {r["doc_id"] for r in self.documents().where(F.col("doc_id").isin(*doc_ids)).select("doc_id").collect()}  # the ids that were named
        if there:
            self.table.write(self.documents().where(~F.col("doc_id").isin(*there)))
        return {i: i in there for i in doc_ids}

    def list(self) -> DataFrame:
        """(title, doc_id, kind, url, characters) by title in either case."""
        return self.documents().select("title", "doc_id", "kind", "url", F.length("text").alias("characters")).orderBy(F.lower("title"), "doc_id")

    def clear(self) -> bool:
        return self.table.clear()


@dataclass
class Meta:
    """What an index was built with, and what it holds."""

    model: str
    dim: int
    mode: str
    chunks: int
    docs: int
    summary_chunks: int
    n: int
    avg_len: float


class Engine:
    """The index of a corpus and the questions to it. ``path`` has the folders corpus, cache and index."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings | None = None, embedder: embedding.Embedder | None = None, generator: grounding.Generator | None = None) -> None:
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings or Settings()
        self.embedder = embedder or embedding.HashingEmbedder(self.settings.embed_dim)
        self.generator = generator or grounding.ExtractiveGenerator()
        self.corpus = Corpus(spark, f"{self.path}/corpus")
        self.cache = Versioned(spark, f"{self.path}/cache")
        self.space = f"{self.path}/index/{self.embedder.name}-{self.embedder.dim}-{self.settings.mode}"

    def _table(self, name: str) -> Versioned:
        return Versioned(self.spark, f"{self.space}/{name}")

    def ingest(self) -> Meta:
        """Build the index of the whole corpus; only texts that the cache lacks are embedded."""
        with releasing():
            return self._ingest()

    def _ingest(self) -> Meta:
        s, scratch = self.settings, Scratch(self.spark, "ingest")
        docs = self.corpus.documents(strict=True)
        cut = chunking.chunk(docs, s.chunk_chars, s.chunk_overlap, s.min_chunk_chars).withColumn("__file", F.concat("doc_id", F.lit(".json")))
        leaves = scratch.table(numbered(self.spark, cut, "idx", "__file", "chunk_no").drop("__file"), "leaves")
        whole = scratch.table(self._embedded(leaves), "vectors")
        if s.mode == "hierarchical" and (more := hierarchy.summary_chunks(self.spark, whole, s.cluster_size)) is not None:
            first = leaves.count()
            more = numbered(self.spark, more, "idx", "doc_id").withColumn("idx", F.col("idx") + first)
            whole = whole.unionByName(self._embedded(scratch.table(more, "summaries")))
        self._checked(whole)
        chunks = self._table("chunks").write(whole.repartitionByRange("idx").sortWithinPartitions("idx"))
        index = lexical.inverted(self.spark, chunks, "idx", "embed_text")
        # postings lie by term, so a question reads few of them
        self._table("postings").write(index.postings.select("idx", "term", "f", "len").repartitionByRange("term").sortWithinPartitions("term", "idx"))
        self._table("terms").write(index.terms)
        summary = F.col("doc_id").startswith("_cluster_")
        count = chunks.agg(F.count("*").alias("chunks"), F.countDistinct(F.when(~summary, F.col("doc_id"))).alias("docs"), F.count_if(summary).alias("summaries")).first()
        meta = Meta(self.embedder.name, self.embedder.dim, s.mode, count["chunks"], count["docs"], count["summaries"], index.n, index.avg_len)
        self._table("meta").write(self.spark.createDataFrame([(json.dumps(asdict(meta)),)], "meta string"))
        return meta

    def _embedded(self, chunks: DataFrame) -> DataFrame:
        return embedding.embed_with_cache(self.spark, chunks, "embed_text", self.cache, self.embedder, batch=self.settings.embed_batch)

    def _checked(self, chunks: DataFrame) -> None:
        bad = chunks.agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("d"), F.count_if(F.coalesce(F.size("vector"), F.lit(-1)) != self.embedder.dim).alias("w")).first()
        if bad["n"] != bad["d"] or bad["w"]:
            raise ValueError(f"{bad['n'] - bad['d']} repeated chunk ids, {bad['w']} vectors of another size")

    def exists(self) -> bool:
        return self._table("meta").exists()

    def meta(self) -> Meta:
        if not self.exists():
            raise FileNotFoundError(f"no index under {self.space}: ingest first")
        found = Meta(**json.loads(self._table("meta").read().first()["meta"]))
        if (found.model, found.dim) != (self.embedder.name, self.embedder.dim):
            raise ValueError(f"the index was built with {found.model} of {found.dim}, not {self.embedder.name} of {self.embedder.dim}")
        return found

    def chunks(self) -> DataFrame:
        return self._table("chunks").read()

    def sync(self) -> DataFrame:
        """(doc_id, state): documents that only the index or only the corpus has; summaries of clusters are not documents."""
        return rows.sync(self.chunks().where(~F.col("doc_id").startswith("_cluster_")), self.corpus.documents())

    def status(self) -> DataFrame:
        """One row: models, documents and characters of the corpus, chunks and documents of the index, and whether both agree."""
        total = self.corpus.documents().agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters")).first()
        meta = self.meta() if self.exists() else None
        agree = meta is not None and self.sync().isEmpty()
        names = "embedder string, dim int, generator string, mode string, documents long, characters long, chunks long, indexed_documents long, cached_vectors long, in_sync boolean"
        row = (self.embedder.name, self.embedder.dim, self.generator.name, self.settings.mode, total["documents"], total["characters"], meta.chunks if meta else None, meta.docs if meta else None, self.cache.read(embedding.CACHE).count(), agree)
        return self.spark.createDataFrame([row], names)

    def clear(self, corpus: bool = False, index: bool = False) -> dict[str, bool]:
        """Delete the corpus, or all indexes and the cache, or both; without a target nothing is deleted."""
        if not (corpus or index):
            raise ValueError("name what to delete: the corpus, the index, or both")
        gone = {"corpus": self.corpus.clear()} if corpus else {}
        return gone | ({"index": Versioned(self.spark, f"{self.path}/index").clear(), "cache": self.cache.clear()} if index else {})

    def search(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        """(query_id, rank, the chunk's columns, cosine, bm25, rrf) of queries (query_id, question)."""
        s, meta = self.settings, self.meta()
        scratch = Scratch(self.spark, "search")
        asked = scratch.table(embedding.embed_column(queries.select("query_id", "question"), "question", self.embedder, "query", batch=s.embed_batch), "asked")
        chunks = self.chunks()
        index = lexical.Inverted("idx", self._table("postings").read(), self._table("terms").read(), meta.n, meta.avg_len)
        words = scratch.table(lexical.top(index.score(lexical.asked_terms(asked, "question")), "idx", "bm25", s.candidates), "words")
        hits = fusion.search(self.spark, chunks.select("idx", "vector"), asked, words, "idx", "vector", s.candidates, top_k=top_k or s.top_k, k=s.rrf_k, threshold=s.dedup_cosine, balance=s.mmr_lambda)
        found = scratch.table(hits, "hits")
        full = chunks.select("idx", *_SHOWN).join(small(found), "idx")
        return full.join(small(words.select("query_id", "idx", "bm25")), ["query_id", "idx"], "left").select("query_id", "rank", *_SHOWN, "cosine", F.coalesce("bm25", F.lit(0.0)).alias("bm25"), "rrf")

    def overview(self) -> DataFrame:
        """(rank, the chunk's columns, cosine, bm25, rrf): the manifest and the documents' leads, shaped like hits."""
        blocks = overview.overview_blocks(self.spark, self.chunks())
        return blocks.select(F.col("n").cast("int").alias("rank"), "chunk_id", F.lit("").alias("doc_id"), "title", "url", "section", "text", F.lit(1.0).alias("cosine"), F.lit(0.0).alias("bm25"), F.lit(0.0).alias("rrf"))

    def hits(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        """What an answer to each query (query_id, question) may rest on, and by which route; facts without a relevant hit have ``gated``."""
        scratch = Scratch(self.spark, "hits")
        routed = scratch.table(queries.select("query_id", "question", is_corpus_question(F.col("question")).alias("whole")), "routed")
        facts = routed.where("not whole")
        found = scratch.table(self.search(facts, top_k), "facts")
        gate = fusion.relevant(found, facts, self.settings.min_cosine)
        near = found.join(small(scratch.table(gate.select("query_id", (~F.col("relevant")).alias("gated"), F.col("best_cosine")), "gate")), "query_id").withColumn("route", F.lit("retrieval"))
        whole = routed.where("whole")
        if whole.isEmpty():
            return near
        blocks = scratch.table(self.overview(), "overview")
        every = blocks.crossJoin(F.broadcast(whole.select("query_id"))) if whole.limit(1001).count() <= 1000 else blocks.crossJoin(whole.select("query_id"))  # the same blocks for each such question
        return near.unionByName(every.select("query_id", "rank", *_SHOWN, "cosine", "bm25", "rrf", F.lit(False).alias("gated"), F.lit(None).cast("double").alias("best_cosine"), F.lit("corpus-overview").alias("route")))

    def ask(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        """(query_id, answer, refused, citations, sources, note, gated, route, best_cosine) of queries (query_id, question).

        Questions about the collection go to its overview, others to search; a question
        without a relevant hit is refused before anything is generated.
        """
        scratch = Scratch(self.spark, "ask")
        queries = scratch.table(queries.select("query_id", "question"), "queries")
        hits = scratch.table(self.hits(queries, top_k), "hits")
        usable = hits.where("not gated")
        seen = usable.groupBy("query_id").agg(F.count("*").alias("n_hits"), F.first("route").alias("route"))
        ready = queries.join(grounding.context(usable), "query_id").join(seen, "query_id")
        system = F.when(F.col("route") == "retrieval", grounding.FACTUAL).otherwise(grounding.OVERVIEW)
        prompts = ready.select("query_id", "n_hits", system.alias("system"), grounding.prompt(F.col("question"), F.col("context")).alias("prompt"))
        checked = scratch.table(grounding.verify(grounding.generate(prompts, self.generator)), "checked")
        cited = grounding.sources(checked, usable).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", "title", "section", "url", "chunk_id", "cosine"))).alias("sources"))
        told = hits.groupBy("query_id").agg(F.first("gated").alias("gated"), F.first("route").alias("route"), F.round(F.first("best_cosine"), 3).alias("best_cosine"))
        every = queries.select("query_id").join(told, "query_id", "left").join(checked, "query_id", "left").join(cited, "query_id", "left")
        return every.select(
            "query_id", F.coalesce("answer", F.lit(grounding.REFUSAL)).alias("answer"), F.coalesce("refused", F.lit(True)).alias("refused"), F.coalesce("citations", F.array().cast("array<int>")).alias("citations"),
            F.coalesce("sources", F.array().cast(cited.schema["sources"].dataType)).alias("sources"), "note", F.coalesce("gated", F.lit(True)).alias("gated"), F.coalesce("route", F.lit("retrieval")).alias("route"), "best_cosine",
        )

    def inspect(self, queries: DataFrame) -> DataFrame:
        """What search returns, without an answer."""
        return grounding.shown(self.search(queries), self.spark.createDataFrame([], "query_id bigint, citations array<int>")).drop("use")

    def compare(self, queries: DataFrame, take: int = 6) -> tuple[DataFrame, dict[str, float]]:
        """Exact against hashed neighbours by query (overlap, k, same), and the seconds of either. The hashed index is added to when it lacks chunks."""
        scratch, chunks = Scratch(self.spark, "compare"), self.chunks().select("idx", "vector")
        asked = scratch.table(embedding.embed_column(queries.select("query_id", "question"), "question", self.embedder, "query").select("query_id", "vector"), "asked")
        kept = self._table("buckets")
        if not kept.exists() or kept.read().select("idx").distinct().count() != chunks.count():
            kept.write(ann.build(self.spark, chunks, "idx", "vector").buckets)
        index = ann.Hashed("idx", "vector", chunks, kept.read())
        seconds = {}
        begun = time.perf_counter()
        exact = scratch.table(dense.dense_topk(self.spark, chunks, asked, "idx", "vector", take), "exact")
        seconds["exact"] = time.perf_counter() - begun
        begun = time.perf_counter()
        near = scratch.table(index.search(asked, "vector", take), "near")
        seconds["hashed"] = time.perf_counter() - begun
        return ann.compare(near, exact, "idx"), seconds
