"""The corpus builder: nothing of a guessed size is broadcast, tasks are bounded, documents don't mix."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkgrove.operators import builder
from sparkgrove.plans import catalogue
from sparkgrove.storage import spread

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["furniture_filter", "discover_headings", "segment_body", "thin_sections"])
def test_no_side_is_broadcast(spark, name):
    plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert "REPARTITION_BY_NUM" in plan  # tasks of a counted number of documents


def test_spread_counts_rows_and_keeps_keys_together(spark):
    got = spread(spark.range(1000).selectExpr("id % 50 AS k", "id"), "k", 100)
    assert got.rdd.getNumPartitions() == 10
    parts = got.rdd.mapPartitionsWithIndex(lambda i, rows: {(i, r["k"]) for r in rows}).collect()
    assert len(parts) == 50
    assert spread(spark.range(0), "id", 100).count() == 0


def test_names_hold_in_their_document_only(spark):
    texts = {1: ["Amazon A", "Amazon A runs.", "one 1", "Amazon B", "b", "Amazon A", "again"], 2: ["Amazon B 7", "Amazon A", "text", "Compute", "Compute 3", "9"], 3: []}
    lines = spark.createDataFrame([(d, n, x) for d, t in texts.items() for n, x in enumerate(t)], "doc bigint, line_no int, line string")
    names = spark.createDataFrame([(1, "one"), (1, "Amazon B"), (3, "Amazon C")], "doc bigint, name string")
    kept = builder.content_lines(lines, names, "header", ["Compute"])
    assert {(r["doc"], r["line_no"]) for r in kept.collect()} == {(1, 0), (1, 1), (1, 3), (1, 4), (1, 5), (1, 6), (2, 0), (2, 1), (2, 2), (2, 3)}
    assert [tuple(r) for r in builder.discovered(kept, names, ["Compute"], []).collect()] == [(1, 0, "Amazon A", "Uncategorised")]
    services = names.union(spark.createDataFrame([(1, "Amazon A"), (2, "Amazon A")], names.schema))
    got = {(r["doc"], r["name"]): r["text"] for r in builder.segments(kept, services, ["Compute"], []).collect()}
    assert got == {(1, "one"): "", (1, "Amazon B"): "b", (3, "Amazon C"): "", (1, "Amazon A"): "again", (2, "Amazon A"): "text"}


def held(spark, name):
    """What of a query's plan holds more than one document at a time."""
    plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    steps = [line.lstrip(" +-:*").split("(")[0].split(" ")[0] for line in plan.splitlines()]
    return [s for s in steps if any(k in s for k in ("Sort", "Aggregate", "Window", "Join", "Exchange"))]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["toc_parse", "discover_headings", "segment_body", "thin_sections"])
def test_documents_are_worked_off_one_by_one(spark, name):
    assert held(spark, name) == ["Exchange"]  # the spreading of the documents


def test_spread_bounds_its_tasks(spark):
    assert spread(spark.range(1000), "id", 100, 4).rdd.getNumPartitions() == 4
    assert spread(spark.range(1000), "id", 500, 4).rdd.getNumPartitions() == 2


def test_rows_and_arrays_agree_on_odd_documents(spark):
    toc = {
        1: ["Amazon A .... 1", "Compute ..... 2", "Amazon A .... 3", "AWS  B ..... 99999999999", "Storage .... 4", "Elastic Pool .... 5", "", None, "ab .... 6", "Amazon C"],
        2: [],
        3: ["Storage .... 1", "Compare options .... 2", "Amazon A ..... 7"],
    }
    body = {
        1: ["Amazon A", "a", "Compare options", "\tAmazon B ", "AWS B", "", "", "", "", "b  ", None, "Compute", "lost", "AWS B", "Amazon A", "again", "Amazon N", "", "Amazon N is new", "Elastic Pool 12", "xiv"],
        2: ["Amazon Z", "Amazon Z it is", "9"],
        3: ["Amazon A 3", "Amazon A"],
    }
    docs = spark.createDataFrame([(d, toc[d], body[d]) for d in toc], "doc bigint, toc array<string>, body array<string>").select("doc", *[builder.lines_of(F.col(c)).alias(c) for c in ("toc", "body")])
    rows = {c: docs.select("doc", F.inline(c)).orderBy(F.desc("line_no")) for c in ("toc", "body")}
    lists = (["Compute", "Storage"], ["Compare options"])
    both = lambda array, df: (sorted(map(str, array.collect())), sorted(map(str, df.collect())))

    docs = docs.withColumn("s", builder.contents_in(F.col("toc"), *lists, ["Elastic Pool"]))
    s = builder.contents(rows["toc"], *lists, ["Elastic Pool"])
    got, same = both(docs.select("doc", F.inline("s")), s)
    assert got == same
    assert sorted(map(tuple, s.collect())) == [(1, 0, "Amazon A", "Uncategorised", 1), (1, 3, "AWS B", "Compute", None), (1, 5, "Elastic Pool", "Storage", 5), (3, 2, "Amazon A", "Storage", 7)]

    docs = docs.withColumn("l", builder.content_in(F.col("body"), F.col("s.name"), "head"))
    lines = builder.content_lines(rows["body"], s.select("doc", "name"), "head")
    got, same = both(docs.select("doc", F.inline("l")), lines)
    assert got == same
    left = {d: [r["line_no"] for r in sorted(lines.where(F.col("doc") == d).collect())] for d in toc}
    assert left == {1: [n for n in range(19) if n != 10], 2: [0, 1], 3: [1]}

    docs = docs.withColumn("d", builder.discovered_in(F.col("l"), F.col("s.name"), *lists))
    new = builder.discovered(lines, s, *lists)
    got, same = both(docs.select("doc", F.inline("d")), new)
    assert got == same
    assert sorted(map(tuple, new.collect())) == [(1, 16, "Amazon N", "Compute"), (2, 0, "Amazon Z", "Uncategorised")]

    named = s.select("doc", "name").union(new.select("doc", "name"))
    got, same = both(docs.select("doc", F.inline(builder.segments_in(F.col("l"), F.concat("s.name", "d.name"), *lists))), builder.segments(lines, named, *lists))
    assert got == same
    texts = {(r["doc"], r["name"]): r["text"] for r in builder.segments(lines, named, *lists).collect()}
    assert texts == {(1, "Amazon A"): "again", (1, "AWS B"): "", (1, "Elastic Pool"): "", (1, "Amazon N"): "Amazon N is new", (2, "Amazon Z"): "Amazon Z it is", (3, "Amazon A"): ""}


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["furniture_filter", "toc_parse", "category_counts"])
def test_no_step_is_done_before_the_spreading(spark, name):
    plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan[plan.index("REPARTITION_BY_NUM") :]
    assert name == "category_counts" or held(spark, name) == ["Exchange"]


def test_a_value_named_twice_is_worked_out_once_and_not_copied(spark):
    docs = spark.createDataFrame([], "lines array<struct<line_no:int,line:string>>, names array<string>")
    lines, names, lists = F.col("lines"), F.col("names"), (["Compute"], ["Compare options"])
    for step in (builder.contents_in(lines, *lists, []), builder.content_in(lines, names, "head"), builder.discovered_in(lines, names, *lists), builder.segments_in(lines, names, *lists)):
        plan = docs.select(step)._jdf.queryExecution().analyzed().toString()
        assert "transform(array(" not in plan  # an array of the value: what is done to its one element is copied
    once = spark.range(2).select("id", builder._let(F.when(F.col("id") == 1, F.rand()), lambda v: F.struct(v.alias("a"), (v + 0).alias("b"), F.coalesce(v, F.lit(-1.0)).alias("c"))).alias("s"))
    null, one = [r["s"] for r in once.orderBy("id").collect()]
    assert tuple(null) == (None, None, -1.0)
    assert one["a"] == one["b"] == one["c"] >= 0
