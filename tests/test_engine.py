"""A collection from sources to answers: corpus, index, questions, evaluation, command line, streams."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sparkgrove import __main__ as cli
from sparkgrove.config import Settings
from sparkgrove.engine import Engine
from sparkgrove.evaluator import Evaluator, questions
from sparkgrove.operators import embedding, grounding
from sparkgrove.sources import files, web
from sparkgrove.storage import Versioned, numbered

ANIMALS = {
    "cats": "# Cats\nCats sleep for most of the day and hunt small rodents at night. " + "They purr when they are content and groom their fur with care. " * 4,
    "dogs": "# Dogs\nDogs bark at strangers and guard the house. " + "They follow their owner on long walks through the forest. " * 4,
    "owls": "# Owls\nOwls turn their heads by two hundred and seventy degrees. " + "Their wings make hardly any sound in flight over meadows. " * 4,
    "bees": "# Bees\nBees collect nectar and build combs of wax. " + "A colony has one queen and thousands of workers in summer. " * 4,
}


def documents(spark, names=ANIMALS):
    return spark.createDataFrame([(n, n.title(), f"https://x.org/{n}", ANIMALS[n], "markdown") for n in names], files.DOCUMENT)


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id bigint, question string")


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    made = Engine(spark, str(tmp_path_factory.mktemp("engine")), Settings(embed_dim=128, min_cosine=0.2))
    made.corpus.add(documents(spark))
    made.ingest()
    return made


def test_corpus(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    with pytest.raises(ValueError, match="empty"):
        engine.corpus.documents(strict=True)
    assert engine.corpus.add(documents(spark, ["cats", "dogs"])).count() == 2
    assert engine.corpus.add(documents(spark, ["cats", "owls"])).collect()[0]["doc_id"] == "owls"
    changed = documents(spark, ["cats"]).withColumn("title", F.col("url"))
    assert engine.corpus.add(changed, replace=True).count() == 1
    assert [r["title"] for r in engine.corpus.list().collect()] == ["Dogs", "https://x.org/cats", "Owls"]
    assert engine.corpus.remove("dogs", "none") == {"dogs": True, "none": False}
    assert engine.corpus.documents().count() == 2
    with pytest.raises(ValueError, match="name what"):
        engine.clear()
    assert engine.clear(corpus=True, index=True) == {"corpus": True, "index": False, "cache": False}
    assert engine.corpus.documents().count() == 0


def test_index_and_status(spark, engine):
    meta = engine.meta()
    assert (meta.chunks, meta.docs, meta.summary_chunks, meta.n) == (engine.chunks().count(), 4, 0, meta.chunks)
    status = engine.status().first()
    assert (status["documents"], status["in_sync"], status["cached_vectors"]) == (4, True, meta.chunks)
    assert sorted(r["idx"] for r in engine.chunks().collect()) == list(range(1, meta.chunks + 1))
    other = Engine(spark, engine.path, Settings(embed_dim=64))
    assert not other.exists()
    with pytest.raises(FileNotFoundError, match="ingest"):
        other.search(asked(spark, "x"))


def test_search_and_answers(spark, engine):
    hits = engine.search(asked(spark, "why do dogs bark at strangers", "queen of a colony")).collect()
    first = {r["query_id"]: r["doc_id"] for r in hits if r["rank"] == 1}
    assert first == {0: "dogs", 1: "bees"}
    got = {r["query_id"]: r for r in engine.ask(asked(spark, "why do dogs bark at strangers", "zebra quokka", "What topics do the documents cover?")).collect()}
    assert got[0]["answer"].startswith("Dogs bark at strangers") and got[0]["sources"][0]["title"] == "Dogs" and got[0]["citations"] == [s["n"] for s in got[0]["sources"]]
    assert (got[1]["refused"], got[1]["gated"], got[1]["answer"]) == (True, True, grounding.REFUSAL)
    assert got[2]["route"] == "corpus-overview" and got[2]["best_cosine"] is None
    shown = engine.inspect(asked(spark, "bees wax")).collect()
    assert {"rank", "chunk_id", "head", "preview"} <= set(shown[0].asDict())


def test_bm25_of_the_kept_index_is_that_of_a_fresh_one(spark, engine):
    from sparkgrove.operators import lexical

    q = asked(spark, "dogs guard the house house", "wings over the meadows")
    index = lexical.Inverted("idx", engine._table("postings").read(), engine._table("terms").read(), engine.meta().n, engine.meta().avg_len)
    kept = {(r["query_id"], r["idx"]): r["bm25"] for r in index.score(lexical.asked_terms(q, "question")).collect()}
    fresh = {(r["query_id"], r["idx"]): r["bm25"] for r in lexical.bm25(spark, engine.chunks(), q, "idx", "embed_text", "question").collect()}
    assert kept == pytest.approx(fresh) and kept


def test_only_new_texts_are_embedded_and_lots_are_kept(spark, tmp_path):
    class Failing(embedding.HashingEmbedder):
        def embed(self, texts, task):
            if any("Owls" in t for t in texts):
                raise RuntimeError("gone")
            return super().embed(texts, task)

    texts = documents(spark).select("doc_id", "text")
    cache = Versioned(spark, str(tmp_path / "cache"))
    with pytest.raises(Exception, match="gone"):
        embedding.embed_with_cache(spark, texts, "text", cache, Failing(16), every=1)
    kept = cache.read(embedding.CACHE).count()
    done = embedding.embed_with_cache(spark, texts, "text", cache, embedding.HashingEmbedder(16), every=1)
    assert done.count() == 4 and cache.read(embedding.CACHE).count() == 4 and kept < 4


def test_hierarchy(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), Settings(embed_dim=64, mode="hierarchical", cluster_size=2))
    engine.corpus.add(documents(spark))
    meta = engine.ingest()
    assert meta.docs == 4 and meta.summary_chunks >= 1 and meta.chunks == 4 + meta.summary_chunks
    leaf = engine.chunks().where("doc_id like '\\\\_cluster%'").first()
    assert leaf["text"].startswith("This group covers")
    assert engine.status().first()["in_sync"]


def test_evaluation(spark, engine, tmp_path):
    spec = {
        "answerable": [{"q": "why do dogs bark at strangers", "doc": "dogs", "must": ["guard|bark"]}, {"q": "bees collect nectar and build combs", "doc": "bees", "must": ["never said"]}, {"q": "What topics are covered?", "doc": None, "must": []}],
        "unanswerable": [{"kind": "elsewhere", "q": "zebra quokka"}, {"q": "xylophone tariffs", "kind": "adjacent"}],
    }
    (tmp_path / "spec.json").write_text(json.dumps(spec))
    evaluator = Evaluator(engine, str(tmp_path / "kept"), judge=grounding.OverlapJudge())
    rows = questions(spark, str(tmp_path / "spec.json"))
    assert rows.count() == 5
    detail, summary = evaluator.run(rows)
    s = summary.first()
    assert (s["answerable"], s["unanswerable"], s["recall"], s["mrr"], s["ndcg"], s["refusal_rate"], s["leaks"]) == (3, 2, 1.0, 1.0, 1.0, 1.0, 0)
    assert s["fact_misses"] == 1 and s["faithfulness"] == 100
    assert {(r["kind"], r["n"], r["refused"]) for r in evaluator.by_kind(detail).collect()} == {("elsewhere", 1, 1), ("adjacent", 1, 1), (None, 2, 2)}
    kept = evaluator.answers.read().count()
    evaluator.run(rows)
    assert evaluator.answers.read().count() == kept == 5
    evaluator.run(rows, fresh=True)
    assert evaluator.answers.read().count() == 5


def test_exact_and_hashed_neighbours(spark, engine):
    rows, seconds = engine.compare(asked(spark, "dogs bark", "queen of bees"), take=2)
    got = rows.collect()
    assert [r["k"] for r in got] == [2, 2] and all(r["overlap"] >= 1 for r in got) and set(seconds) == {"exact", "hashed"}


def test_rows_are_numbered_in_order(spark):
    rows = spark.createDataFrame([(k * 37 % 101, "x") for k in range(101)], "k int, t string").repartition(5)
    assert [(r["n"], r["k"]) for r in numbered(spark, rows, "n", "k").orderBy("n").collect()] == [(k + 1, k) for k in range(101)]


def test_addresses(spark, tmp_path):
    class Pages:  # workers get it by value
        def __init__(self, known):
            self.known = known

        def get(self, url):
            return next((v for k, v in self.known.items() if url.startswith(k)), None)

    article = {"query": {"pages": [{"title": "Big Cat", "extract": "Lead. " * 60 + "\n== See also ==\nlinks\n== Use ==\nuse"}]}}
    fetcher = Pages(
        {
            web._API.format("en", "format=json"): json.dumps(article),
            "https://de.wikipedia.org/": json.dumps({"query": {"pages": [{"title": "x", "missing": True}]}}),
            "https://raw.githubusercontent.com/a/b/master/README.rst": "A readme",
            "https://raw.githubusercontent.com/a/c/main/docs/x.md": "intro\n# Heading\nbody",
            "https://page.org/": "<html><head><title>Page</title><meta property='og:title' content='Given'></head><body><nav>" + "menu " * 30 + "</nav><p>" + "words here " * 30 + "</p></body></html>",
            "https://sparse.org/": "<html><head><title>S</title></head><body><nav>" + "only edges " * 20 + "</nav><p>x</p></body></html>",
            "https://empty.org/": "<html><body>x</body></html>",
        }
    )
    urls = ["https://en.wikipedia.org/wiki/Big_cat?x=1", "https://de.wikipedia.org/wiki/X", "https://github.com/a/b", "https://github.com/a/c/blob/main/docs/x.md?raw=1#top", "https://github.com/a/c/tree/main", "https://page.org/p", "https://sparse.org/", "https://empty.org/", "https://gone.org/"]
    (tmp_path / "n.txt").write_text("a note")
    found, failed = web.load_sources(spark, [*urls, str(tmp_path), str(tmp_path / "absent")], fetcher)
    got = {r["url"].split("/")[2] if r["kind"] != "text" else r["title"]: r for r in found.collect()}
    assert set(got) == {"en.wikipedia.org", "README.rst", "github.com", "page.org", "sparse.org", "n"}
    assert got["en.wikipedia.org"]["url"].endswith("/wiki/Big_Cat") and "links" not in got["en.wikipedia.org"]["text"] and got["en.wikipedia.org"]["text"].endswith("use")
    assert (got["github.com"]["title"], got["github.com"]["kind"]) == ("Heading", "markdown")
    assert got["page.org"]["title"] == "Given" and "menu" not in got["page.org"]["text"] and "only edges" in got["sparse.org"]["text"]
    assert {r["source"].split("/")[-1] or r["source"].split("/")[-2] for r in failed.collect()} == {"X", "main", "empty.org", "gone.org", "absent"}


def test_pdf_pages_become_sections(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|| two ")
    (tmp_path / "b.pdf").write_bytes(b"")

    def reader(content):
        if not content:
            raise ValueError("damaged")
        return content.decode().split("|"), None

    rows = files.load(spark, str(tmp_path), pdf_reader=reader).collect()
    assert [(r["title"], r["text"], r["kind"]) for r in rows] == [("a", "## Page 1\n\none\n\n## Page 3\n\ntwo", "pdf")]
    assert files.pdf_text(b"x", "x", lambda b: ([" "], "t")) is None


def test_sinks_and_product_directories(spark, tmp_path):
    items = {"items": [{"item": {"additionalFields": {"productName": "A <b>one</b>", "productUrl": "https://x/y?t=1", "launchDate": "2020"}}}, {"item": {"additionalFields": {"productName": ""}}}]}
    (tmp_path / "c.json").write_text(json.dumps(items))
    rows = files.catalogue_json(spark, str(tmp_path / "c.json"), {"name": "productName", "url": "productUrl", "launched": "launchDate"}).collect()
    assert [(r["cat_ord"], r["name"], r["url"], r["launched"], r["summary"]) for r in rows] == [(0, "A one", "https://x/y", "2020", "")]
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "old.md").write_text("old")
    files.write_pages(spark.createDataFrame([("a.md", "é"), ("b.md", "two")], "file string, page string"), str(tmp_path / "pages"))
    assert {p.name: p.read_text() for p in (tmp_path / "pages").glob("*.md")} == {"a.md": "é", "b.md": "two"}
    files.write_json(documents(spark), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 4
    (tmp_path / "w.md").write_text("a\r\nb")
    assert [(r["line_no"], r["line"]) for r in files.text_lines(spark, str(tmp_path / "w.md")).collect()] == [(0, "a"), (1, "b")]


def test_services():
    calls = []

    def call(model, key, prompt, system):
        calls.append((model, key))
        if model == "a":
            raise RuntimeError("404 no such model")
        if key == "k1":
            raise RuntimeError("RESOURCE_EXHAUSTED per day")
        return "fine [1]"

    quiet = {"sleep": lambda s: None}
    assert grounding.ServiceGenerator(["a", "b"], call, ["k1", "k2"], **quiet).reply("p", "s") == "fine [1]"
    assert calls == [("a", "k1"), ("b", "k1"), ("b", "k2")]
    service = embedding.ServiceEmbedder("m", 2, lambda key, texts, task: [[1.0, 0.0]] * (len(texts) - (task == "query")), ["k"], **quiet)
    assert service.embed(["x", "y"], "document").shape == (2, 2)
    with pytest.raises(ValueError, match="rows came"):
        service.embed(["x"], "query")
    both = embedding.WithPrefix(embedding.HashingEmbedder(64))
    assert (both.embed(["dogs"], "document") != both.embed(["dogs"], "query")).any()


def test_settings_from_a_file(tmp_path):
    (tmp_path / ".env").write_text("# note\nexport SPARKGROVE_TOP_K='4'\nSPARKGROVE_MODE=hierarchical\n")
    found = Settings.from_env(env={"SPARKGROVE_MODE": "flat"}, dotenv=str(tmp_path / ".env"))
    assert (found.top_k, found.mode) == (4, "flat")
    assert Settings.from_env(env={}, dotenv=str(tmp_path / "absent")) == Settings()


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "get_session", lambda: spark)
    (tmp_path / "texts").mkdir()
    for name, text in ANIMALS.items():
        (tmp_path / "texts" / f"{name}.md").write_text(text)
    run = lambda *a: (cli.main(["--path", str(tmp_path / "data"), "--env", str(tmp_path / "none"), *a]), capsys.readouterr().out)[1]
    assert "Cats" in run("add", str(tmp_path / "texts"), str(tmp_path / "absent"))
    assert "docs=4" in run("ingest")
    assert "Bees" in run("list") and "in_sync" in run("status")
    assert "Dogs bark" in run("inspect", "dogs bark")
    assert "Refusing" not in run("clear", "--index") and not Engine(spark, str(tmp_path / "data")).exists()


def test_streams_of_questions_and_evaluation(spark, engine, tmp_path):
    from sparkgrove.streaming.questions import answer_stream, evaluate_stream

    asked(spark, "why do dogs bark", "zebra quokka").write.parquet(str(tmp_path / "q"))
    stream = lambda name: spark.readStream.schema("query_id bigint, question string").parquet(str(tmp_path / name))
    answer_stream(engine, stream("q"), str(tmp_path / "answers"), str(tmp_path / "c1")).awaitTermination(120)
    got = {r["query_id"]: r["refused"] for r in spark.read.parquet(str(tmp_path / "answers")).collect()}
    assert got == {0: False, 1: True}
    evaluator = Evaluator(engine, str(tmp_path / "kept"))
    evaluate_stream(evaluator, stream("q"), str(tmp_path / "c2")).awaitTermination(120)
    assert evaluator.answers.read().count() == 2


def test_rate_limit_of_a_stream(spark, tmp_path):
    from sparkgrove.streaming.questions import limit_stream

    start = dt.datetime(2024, 1, 1)
    rows = [("a", start + dt.timedelta(seconds=s), n) for s, n in ((0, 2), (10, 1), (20, 1), (61, 1), (200, 9))] + [("b", start, 3)]
    schema = "key string, ts timestamp, items long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = limit_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 3)
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    got = sorted((r["key"], (r["ts"] - start).seconds, r["granted"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 0, True), ("a", 10, True), ("a", 20, False), ("a", 61, True), ("a", 200, True), ("b", 0, True)]
