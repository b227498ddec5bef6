"""Embedding with a content-addressed cache: only distinct texts that the cache lacks are embedded."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkgrove.functions.edge import KeyRing, Limiter, with_retry
from sparkgrove.functions.text import STOP
from sparkgrove.storage import Scratch, Versioned, bound_batches

_RUN = re.compile("[0-9a-z]+")


class Embedder(Protocol):
    """One row of ``dim`` numbers a text; ``task`` is document or query."""

    name: str
    dim: int

    def embed(self, texts: list[str], task: str) -> np.ndarray: ...


class HashingEmbedder:
    """Token counts by bucket (28 bits of SHA-1 modulo ``dim``); deterministic and offline."""

    name = "hashing"

    def __init__(self, dim: int = 256) -> None:
        self.dim = dim
        self._bucket: dict[str, int] = {}

    def embed(self, texts: list[str], task: str) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        stop, known = frozenset(STOP), self._bucket
        for row, text in zip(out, texts, strict=True):
            for t in _RUN.findall(text.lower()):
                if len(t) > 1 and t not in stop:
                    if (b := known.get(t)) is None:
                        if len(known) > 500_000:
                            known.clear()
                        b = known[t] = int(hashlib.sha1(t.encode()).hexdigest()[:7], 16) % self.dim
                    row[b] += 1
        return out


def cache_key(model: str, dim: int, task: str, text: Column) -> Column:
    """SHA-1 of model, size, task and text."""
    return F.sha1(F.concat_ws("|", F.lit(model), F.lit(str(dim)), F.lit(task), text).cast("binary"))


def unit(rows: np.ndarray, floor: float = 1e-12) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows**2).sum(axis=1, keepdims=True)), floor)


def embed_column(texts: DataFrame, text: str, embedder: Embedder, task: str = "document", out: str = "vector", batch: int = 32) -> DataFrame:
    """All columns of ``texts`` and a unit vector each; requests hold ``batch`` texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            column, rows = part.column(text), part.num_rows
            found = [embedder.embed([t or "" for t in column.slice(i, batch).to_pylist()], task) for i in range(0, rows, batch)]
            flat = unit(np.concatenate(found)) if found else np.zeros((0, embedder.dim))
            if len(flat) != rows:
                raise ValueError(f"{rows} texts, {len(flat)} vectors")
            offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * embedder.dim)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, pa.array(flat.ravel().astype(np.float32)))], names=[*part.schema.names, out])

    bound_batches(texts.sparkSession)
    return texts.mapInArrow(run, T.StructType([*texts.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))]))


def misses(texts: DataFrame, text: str, cache: DataFrame, embedder: Embedder, task: str = "document") -> DataFrame:
    """(key, text): distinct texts without a cached vector."""
    keyed = texts.select(cache_key(embedder.name, embedder.dim, task, F.col(text)).alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
    return keyed.join(cache.select("key"), "key", "left_anti")


CACHE = T.StructType([T.StructField("key", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType()))])
#: Texts whose vectors are written to the cache at once.
WRITE_EVERY = 200_000


def embed_with_cache(spark: SparkSession, texts: DataFrame, text: str, cache: Versioned, embedder: Embedder, task: str = "document", every: int = WRITE_EVERY, batch: int = 32) -> DataFrame:
    """The texts with their vectors, repeats included. Each lot of new vectors is in the cache before the next is asked for, so a failed run keeps what it got."""
    scratch = Scratch(spark, "embed")
    new = misses(texts, text, cache.read(CACHE), embedder, task)
    new = scratch.table(new, "misses")
    lots = -(-new.count() // every)
    lot = F.pmod(F.xxhash64("key"), F.lit(max(lots, 1)))
    for k in range(lots):
        part = new.where(lot == k)
        cache.append(embed_column(part.coalesce(1) if getattr(embedder, "serial", False) else part, "text", embedder, task, batch=batch).select("key", "vector"))
    keyed = texts.withColumn("key", cache_key(embedder.name, embedder.dim, task, F.col(text)))
    known = cache.read(CACHE).dropDuplicates(["key"])
    return keyed.join(known, "key").drop("key")


class WithPrefix:
    """An embedder that tells documents from queries by what it puts before them."""

    def __init__(self, inner: Embedder, document: str = "passage: ", query: str = "query: ") -> None:
        self.inner, self.prefix = inner, {"document": document, "query": query}
        self.name, self.dim = f"{inner.name}+prefix", inner.dim

    def embed(self, texts: list[str], task: str) -> np.ndarray:
        return self.inner.embed([self.prefix[task] + t for t in texts], task)


class ServiceEmbedder:
    """An outside service behind ``call(key, texts, task) -> rows``, with retries, a limit of texts a minute and several keys.

    The limit holds for one process, so such texts are embedded in one task.
    """

    serial = True

    def __init__(self, name: str, dim: int, call: Callable[[str, list[str], str], list[list[float]]], keys: list[str], per_minute: int = 95, attempts: int = 6, **clock: Callable) -> None:
        self.name, self.dim, self.call, self.attempts = name, dim, call, attempts
        self.ring, self.limiter, self.sleep = KeyRing(keys), Limiter(per_minute, **clock), clock.get("sleep", time.sleep)

    def embed(self, texts: list[str], task: str) -> np.ndarray:
        self.limiter.reserve(len(texts))
        rows = self.ring.call(self.name, lambda key: with_retry(lambda: self.call(key, texts, task), self.attempts, sleep=self.sleep))
        if len(rows) != len(texts) or any(len(r) != self.dim for r in rows):
            raise ValueError(f"{len(texts)} texts of {self.dim} numbers asked for, {len(rows)} rows came")
        return np.array(rows, np.float64)
