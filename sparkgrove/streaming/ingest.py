"""Incremental ingest of a stream of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkgrove.operators.corpus import text_hash
from sparkgrove.storage import delete


def ingest_stream(spark: SparkSession, incoming: DataFrame, corpus_path: str, checkpoint: str, on_new: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Add what is new of each micro-batch (doc_id, text, ...) to the corpus table; ``on_new`` sees the same rows.

    Exact for any age of the corpus: a batch meets the ids and text hashes of the whole table
    by anti joins; hashes are kept with the rows (text_sha1), so old texts are not read. A
    batch writes its own folder, once, before anything else sees it; run again after a
    failure it writes the same folder again.
    """
    schema = incoming.schema.add("text_sha1", "string")

    def step(batch: DataFrame, number: int) -> None:
        own = f"{corpus_path}/batch={number}"
        delete(spark, own)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(corpus_path)
        there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        old = spark.read.schema(schema).parquet(corpus_path) if there else spark.createDataFrame([], schema)
        hashed = batch.withColumn("text_sha1", text_hash())
        fresh = hashed.join(old.select("text_sha1"), "text_sha1", "left_anti").join(old.select("doc_id"), "doc_id", "left_anti")
        by_id, by_text = Window.partitionBy("doc_id").orderBy("text_sha1"), Window.partitionBy("text_sha1").orderBy("doc_id")
        new = fresh.withColumn("__i", F.row_number().over(by_id)).where("__i = 1").withColumn("__t", F.row_number().over(by_text)).where("__t = 1")
        new.select(*schema.names).write.parquet(own)
        if on_new is not None:
            on_new(spark.read.schema(schema).parquet(own), number)

    return incoming.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
