from __future__ import annotations

from sparkgrove.streaming.ingest import ingest_stream


def test_ingest_adds_only_new_texts(spark, tmp_path):
    schema = "doc_id bigint, text string"
    source, target = str(tmp_path / "in"), str(tmp_path / "corpus")
    seen: list[int] = []

    def feed(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        ingest_stream(spark, spark.readStream.schema(schema).parquet(source), target, str(tmp_path / "check"), lambda new, n: seen.append(new.count())).awaitTermination(120)

    feed([(1, "a"), (2, "a"), (3, "b")])
    feed([(4, "b"), (5, "c"), (1, "z")])
    assert sorted(r["doc_id"] for r in spark.read.schema(schema).parquet(target).collect()) == [1, 3, 5]
    assert seen == [2, 1]
