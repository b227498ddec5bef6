"""The pipeline's stages and the entry's guard."""

from __future__ import annotations

import random

import duckdb
import numpy as np
from test_dedup import plain_links, plain_roots

import __spark_entry__ as entry
import corpus_pipeline
from sparkgrove.llm import mixing, toxicity
from sparkgrove.llm.queries import tokenizer_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_every_operator_is_registered():
    names = entry.queries()
    assert {n for n in range(1, 11)} == {int(x[2:].split("_")[0]) for x in names if x.startswith("op")}
    assert "pipeline" in names


def test_pipeline_over_a_small_folder(spark, tmp_path):
    random.seed(1)
    words = [f"w{k}" for k in range(3000)]
    texts = [" ".join(random.choices(words, k=120)) for _ in range(150)]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)]
    rows += [(1000 + k, texts[k].upper(), "en", "s0", 1) for k in range(10)]
    rows += [(2000 + k, texts[k] + " more", "en", "s1", 1) for k in range(10, 20)]
    rows += [(3000 + k, " ".join(random.choices(words, k=60) + [f"nasty{j}" for j in range(6)]), "en", "s2", 1) for k in range(60)]
    rows += [(4000, None, None, None, None), (4001, "", "en", "s1", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3000 + k, 1, 1) for k in range(40)] + [(k, 1, 0) for k in range(100)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        assert docs.columns[: len(columns)] == columns
        kept[name] = [r["doc_id"] for r in docs.collect()]
    clean, exact, near, mixed, last = kept.values()
    assert {x for x in clean if 3000 <= x < 4000} <= set(range(3000, 3060)) and len([x for x in clean if 3000 <= x < 4000]) <= 3
    assert set(range(150)) <= set(clean)
    assert set(range(1000, 1010)) <= set(exact) and not set(range(10)) & set(exact)
    assert 4001 in exact and 4000 not in exact
    assert set(range(10, 20)) <= set(near) and not set(range(2010, 2020)) & set(near)
    assert set(mixed) <= set(near) and sorted(mixed) == sorted(last)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(last)


def plain_pipeline(spark, rows, labels, scorer):
    """The stages in plain Python, but for the classifier's weights: (doc_id, text, copies) of what is left."""
    edge = float(np.log(toxicity.THRESHOLD / (1 - toxicity.THRESHOLD)))
    rows = [r for r in rows if scorer.logit(toxicity.word_hashes((r[1] or "").encode())) < edge]
    last = {}
    for r in rows:
        key = (r[1] or "").encode().lower()
        if key not in last or r[0] > last[key][0]:
            last[key] = r
    rows = list(last.values())
    roots = plain_roots(plain_links([(r[0], r[1]) for r in rows]))
    rows = [r for r in rows if roots.get(r[0], r[0]) == r[0]]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    return con.execute(f"SELECT doc_id, text, count(*) FROM ({mixing.SQL}) GROUP BY 1, 2").fetchall()


def test_pipeline_matches_plain_stages(spark, tmp_path):
    import sentencepiece

    rng = random.Random(21)
    words = [f"w{k}" for k in range(2000)]
    rows = []
    for k in range(120):
        base = rng.choices(words, k=rng.choice((3, 20, 80, 200)))
        rows.append((k, " ".join(base), "en", f"s{k % 4 // 2}", 1))
        near = list(base)
        near[rng.randrange(len(near))] = "changed"
        rows.append((1000 + k, " ".join(near if k % 3 else base).upper(), "en", "s0", 1))
    rows += [(5000 + k, " ".join([*rng.choices(words, k=30), *rng.choices(["nasty1", "nasty2", "nasty3"], k=4)]), "en", "s1", 1) for k in range(60)]
    rows += [(9000, None, None, None, None), (9001, "", "en", "s0", 0), (9002, "  ", None, None, 0)]
    labels = [(5000 + k, 0, 1) for k in range(45)] + [(k + 1000 * j, 1, 0) for k in range(120) for j in (0, 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    scorer = toxicity.fit(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    want = plain_pipeline(spark, rows, labels, scorer)
    assert 60 < len(want) < 200 and not [i for i, _, _ in want if 5000 <= i < 5045]
    got = corpus_pipeline.run(spark, str(tmp_path))
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    found = {}
    for r in got.collect():
        assert r["token_ids"] == [*library.encode(r["text"] or ""), library.eos_id()]
        found[r["doc_id"], r["text"]] = found.get((r["doc_id"], r["text"]), 0) + 1
    assert found == {(i, t): n for i, t, n in want}


def test_pipeline_over_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
