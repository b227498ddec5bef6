"""Search, corpus, grounding and edge helpers on small fixtures."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgrove.config import Settings, unique_list
from sparkgrove.functions import edge
from sparkgrove.operators import corpus, dense, embedding, fusion, grounding, hierarchy, lexical
from sparkgrove.sources import files, index


def test_bm25_counts_repeated_terms(spark):
    texts = {1: "apple pear apple", 2: "pear plum", 3: "", 4: "plum plum plum"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    asked = spark.createDataFrame([(0, "apple apple plum zzz the")], "query_id bigint, q string")
    got = {r["doc_id"]: r["bm25"] for r in lexical.bm25(spark, docs, asked, "doc_id", "text", "q").collect()}
    counts = {i: Counter(t.split()) for i, t in texts.items()}
    lens = {i: sum(c.values()) for i, c in counts.items()}
    avg = sum(lens.values()) / 4
    df = Counter(t for c in counts.values() for t in c)
    want = {}
    for t in ("apple", "apple", "plum"):
        for i, c in counts.items():
            if f := c[t]:
                want[i] = want.get(i, 0) + math.log(1 + (4 - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * lens[i] / avg))
    assert got == pytest.approx(want)


def _plain_search(v, q, pool, count, threshold, balance):
    kept = []
    for i in pool:
        if not any(v[i] @ v[j] >= threshold for j in kept):
            kept.append(i)
    chosen = []
    while kept and len(chosen) < count:
        worth = [v[i] @ q if not chosen else balance * (v[i] @ q) - (1 - balance) * max(v[i] @ v[j] for j in chosen) for i in kept]
        chosen.append(kept.pop(int(np.argmax(worth))))
    return chosen


@pytest.mark.parametrize("balance", [0.0, 0.7, 1.0])
def test_hybrid_matches_plain_version(spark, balance):
    rng = np.random.default_rng(4)
    v = embedding.unit(rng.standard_normal((40, 8)))
    q = embedding.unit(rng.standard_normal((1, 8)))[0]
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, e array<double>")
    asked = spark.createDataFrame([(7, q.tolist())], "query_id bigint, e array<double>")
    near = dense.dense_topk(spark, vectors, asked, "id", "e", 30)
    order = np.argsort(-(v @ q), kind="stable")[:30]
    assert [r["id"] for r in near.orderBy("rank").collect()] == order.tolist()
    words = spark.createDataFrame([(7, i, r) for r, i in enumerate((3, 9, 21), 1)], "query_id bigint, id bigint, rank int")
    fused = {int(i): 1 / (60 + r) for r, i in enumerate(order, 1)}
    for r, i in enumerate((3, 9, 21), 1):
        fused[i] = fused.get(i, 0) + 1 / (60 + r)
    pool = sorted(fused, key=lambda i: (-fused[i], i))[:30]
    want = _plain_search(v, q, pool, 6, 0.6, balance)
    cosines = vectors.select(F.lit(7).cast("bigint").alias("query_id"), "id", F.lit(0.0).alias("cosine"))
    exact = spark.createDataFrame([(7, i, float(v[i] @ q)) for i in range(40)], cosines.schema)
    got = fusion.hybrid(near, words, exact, vectors, "id", "e", threshold=0.6, balance=balance).orderBy("rank").collect()
    assert [r["id"] for r in got] == sorted(want, key=lambda i: (-fused[i], i))


def test_no_vectors_no_hits(spark):
    vectors = spark.createDataFrame([], "id bigint, e array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, e array<double>")
    hits = dense.dense_topk(spark, vectors, asked, "id", "e", 5)
    assert hits.count() == 0
    assert fusion.relevant(hits, asked).collect()[0]["relevant"] is False


def test_corpus_upsert(spark):
    schema = "doc_id bigint, text string, at int"
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], schema)
    new = spark.createDataFrame([(3, "a", 1), (2, "c", 2), (4, "d", 3), (5, "d", 4), (4, "e", 5)], schema)
    assert [(r["doc_id"], r["text"]) for r in corpus.add(old, new, "at").collect()] == [(4, "d")]
    rows = corpus.upsert(old, new, "at", replace=True).collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows) == [(1, "a"), (2, "c"), (3, "a"), (4, "e"), (5, "d")]


def test_embedding_cache_sends_each_missing_text_once(spark):
    e = embedding.HashingEmbedder(16)
    texts = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, "alpha beta"), (4, "")], "id int, text string")
    cache = spark.createDataFrame([], "key string, vector array<float>")
    rows, new = embedding.embed_with_cache(texts, "text", cache, e)
    got = {r["id"]: r["vector"] for r in rows.collect()}
    assert new.count() == 3
    assert got[1] == got[3]
    assert sum(got[4]) == 0
    again, none = embedding.embed_with_cache(texts, "text", new, e)
    assert none.count() == 0
    assert {r["id"]: r["vector"] for r in again.collect()} == got


def test_answers(spark):
    g = grounding.ExtractiveGenerator()
    blocks = "[1] SOURCE: A\nCats sleep. A lot.\n\n[2] SOURCE: B > C\nDogs bark at night."
    assert g.reply(f"CONTEXT:\n{blocks}\n\nQUESTION: why do dogs bark", "") == "Dogs bark at night. [2]"
    assert g.reply(f"CONTEXT:\n{blocks}\n\nQUESTION: zebra", "") == grounding.SENTINEL


def test_cluster_count_rounds_half_to_even():
    assert [hierarchy.cluster_count(n) for n in (3, 4, 50, 70)] == [0, 2, 2, 4]


def test_kmeans_separates(spark):
    rng = np.random.default_rng(0)
    v = embedding.unit(np.concatenate([rng.normal((5, 0), 0.1, (20, 2)), rng.normal((0, 5), 0.1, (20, 2))]))
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, e array<double>")
    found = {r["id"]: r["cluster"] for r in hierarchy.kmeans(spark, frame, "id", "e", 2)[0].collect()}
    assert len({found[i] for i in range(20)}) == 1
    assert len(set(found.values())) == 2 or len({found[i] for i in range(20, 40)}) == 1


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: Given\nsource_url: https://x.org/p\n---\n# Own\nbody")
    (tmp_path / "b.txt").write_bytes("caf\xe9 \x93quoted\x94".encode("latin-1"))
    (tmp_path / "c.html").write_text("<html><head><title>Page</title></head><body><nav>no</nav><h1>Head</h1><p>Text &amp; more</p><script>x</script></body></html>")
    (tmp_path / "d.bin").write_bytes(b"\x00")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.csv").write_text("x,y\n1,2\n")
    rows = {r["title"]: r for r in files.load(spark, str(tmp_path)).collect()}
    assert set(rows) == {"Given", "b", "Page", "e"}
    assert rows["Given"]["url"] == "https://x.org/p"
    assert rows["b"]["text"] == "café “quoted”"
    assert rows["Page"]["text"] == "# Head\n\nText & more"


def test_index_namespaces(spark, tmp_path):
    chunks = spark.createDataFrame([("a#0", "a", [1.0, 0.0]), ("b#0", "b", [0.0, 1.0])], "chunk_id string, doc_id string, vector array<float>")
    path = str(tmp_path / "index")
    index.write_index(chunks, path, "m", 2)
    index.write_index(chunks.limit(1), path, "m", 2, "hierarchical")
    assert index.read_index(spark, path, "m", 2).count() == 2
    with pytest.raises(ValueError, match="no index"):
        index.read_index(spark, path, "m", 3)
    with pytest.raises(ValueError, match="repeated"):
        index.write_index(chunks.union(chunks), path, "m", 2)


def test_retry_limiter_and_keys():
    waits: list[float] = []
    replies = iter([RuntimeError("429 retryDelay: 7s"), RuntimeError("503"), "ok"])

    def call():
        if isinstance(r := next(replies), Exception):
            raise r
        return r

    assert edge.with_retry(call, sleep=waits.append) == "ok"
    assert waits == [8.0, 4.0]
    with pytest.raises(edge.DailyQuota):
        edge.with_retry(lambda: (_ for _ in ()).throw(RuntimeError("RESOURCE_EXHAUSTED per day")), sleep=waits.append)
    with pytest.raises(ValueError, match="no"):
        edge.with_retry(lambda: (_ for _ in ()).throw(ValueError("no")), sleep=waits.append)
    now = [0.0]
    limiter = edge.Limiter(3, 60, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for n in (2, 1, 1):
        limiter.reserve(n)
    assert now[0] == 60
    limiter.reserve(9)
    assert now[0] == 120
    ring = edge.KeyRing(["a", "b"])

    def use(key):
        if key == "a":
            raise edge.DailyQuota("a")
        return key

    assert ring.call("m", use) == "b"
    assert ("m", "a") in ring.spent
    assert edge.with_fallback(["x", "y"], lambda m: m if m == "y" else (_ for _ in ()).throw(RuntimeError("404"))) == "y"


def test_settings():
    assert unique_list(" a, b\na,,c ") == ["a", "b", "c"]
    s = Settings.from_env(env={"SPARKGROVE_TOP_K": "9", "SPARKGROVE_GENERATORS": "x,y,x"})
    assert (s.top_k, s.generators, s.rrf_k) == (9, ("x", "y"), 60)


def test_fusion_is_symmetric(spark):
    random.seed(1)
    a = spark.createDataFrame([(0, i, r) for r, i in enumerate(random.sample(range(30), 10), 1)], "query_id int, id bigint, rank int")
    b = spark.createDataFrame([(0, i, r) for r, i in enumerate(random.sample(range(30), 10), 1)], "query_id int, id bigint, rank int")
    ab = fusion.reciprocal_rank_fusion([a, b], "id", 30).select("id", "rank").collect()
    assert set(ab) == set(fusion.reciprocal_rank_fusion([b, a], "id", 30).select("id", "rank").collect())
