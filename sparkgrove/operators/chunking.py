"""Section-aware, sentence-packed chunks.

A document is a row, so cutting needs no shuffle: one pass over Arrow batches turns texts
into finished chunks, in time linear in the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkgrove.functions import segment

_SECTIONS = T.ArrayType(T.StructType([T.StructField("path", T.ArrayType(T.StringType())), T.StructField("body", T.StringType())]))
#: Characters of text that are cut at once.
STEP_CHARS = 1 << 22


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def sections(text: Column) -> Column:
    """ARRAY<STRUCT<path, body>> in order; headings in fenced code are body; blank bodies go."""

    @F.pandas_udf(_SECTIONS)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"path": path, "body": body} for path, body in segment.sections(t)])

    return cut(text)


def chunk(docs: DataFrame, limit: int = segment.LIMIT, overlap: int = segment.OVERLAP, least: int = segment.LEAST) -> DataFrame:
    """Chunks of documents (doc_id, title, url, text): chunk_id, doc_id, title, url, section, path, chunk_no, text, embed_text.

    Pieces under ``least`` characters go, but a document whose pieces are all short
    keeps its longest one (the first of equals). Null titles, addresses and texts are empty.
    """
    read = docs.select("doc_id", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("title", "url", "text")])
    key = read.schema["doc_id"]
    names = ("title", "url", "section", "path", "chunk_no", "text", "embed_text")
    kinds = {"path": "array<string>", "chunk_no": "int"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            took: list[int] = []
            out: dict[str, list] = {n: [] for n in names}
            held = 0
            for row, (title, url, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("title", "url", "text")), strict=True)):
                for number, (path, piece) in enumerate(segment.pieces(title, text, limit, overlap, least)):
                    took.append(row)
                    for name, value in zip(names, (title, url, " > ".join(path), path, number, piece, " > ".join([title, *path]) + "\n\n" + piece), strict=True):
                        out[name].append(value)
                held += len(text)
                if held > STEP_CHARS:
                    yield _batch(batch.column("doc_id"), took, out)
                    took, out, held = [], {n: [] for n in names}, 0
            yield _batch(batch.column("doc_id"), took, out)

    def _batch(ids: pa.Array, took: list[int], out: dict[str, list]) -> pa.RecordBatch:
        kind = {"path": pa.list_(pa.string()), "chunk_no": pa.int32()}
        return pa.RecordBatch.from_arrays([ids.take(pa.array(took, pa.int64())), *[pa.array(out[n], kind.get(n, pa.string())) for n in names]], names=["doc_id", *names])

    found = read.mapInArrow(run, f"doc_id {key.dataType.simpleString()}, " + ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))
    return found.select(F.concat_ws("#", F.col("doc_id").cast("string"), F.col("chunk_no").cast("string")).alias("chunk_id"), "doc_id", "title", "url", "section", "path", "chunk_no", "text", "embed_text")
