"""Exact and near dedup against brute force, with collisions, nulls and repeats."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgrove.llm import exact_dedup, simhash
from sparkgrove.operators import components

SCHEMA = "doc_id bigint, text string, id string, digest int, n long, __sg_x string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in rows], SCHEMA)


ROWS = [(1, "Abc"), (2, "aBC"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "long " * 40000), (8, "LONG " * 40000), (None, "abc"), (9, "solo"), (9, "solo"), (10, "solo"), (11, "two"), (11, "three")]


@pytest.mark.parametrize(("bits", "fanout"), [(64, 128), (2, 2)])
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact(spark, bits, fanout, keep):
    docs = frame(spark, ROWS).repartition(7)
    got = exact_dedup.lsm_dedup(spark, docs, keep=keep, digest_bits=bits, fanout=fanout).collect()
    low = lambda t: (t or "").encode().lower()
    groups: dict[bytes, list] = {}
    for i, t in ROWS:
        groups.setdefault(hashlib.sha256(low(t)).hexdigest(), []).append(i)
    assert len(got) == len(ROWS)
    for sha, ids in groups.items():
        rows = [r for r in got if r["text_sha256"] == sha]
        known = [i for i in ids if i is not None]
        best = (max if keep == "largest" else min)(known)
        assert sorted(r["doc_id"] or -1 for r in rows) == sorted(i or -1 for i in ids)
        assert {(r["keep_id"], r["group_size"]) for r in rows} == {(best, len(ids))}
        assert [r["doc_id"] for r in rows if r["kept"]] == [best]


def test_exact_matches_sql(spark):
    import duckdb

    docs = frame(spark, ROWS)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", ROWS)
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    want = sorted(map(str, con.execute(f"SELECT {', '.join(names)} FROM ({exact_dedup.SQL})").fetchall()))
    assert sorted(str(tuple(r[c] for c in names)) for r in exact_dedup.lsm_dedup(spark, docs).collect()) == want


def test_compaction_and_filter(spark):
    from sparkgrove.storage import Scratch

    rng = random.Random(3)
    rows = [(run, rng.randrange(-60, 60) * (1 << 50), rng.randrange(1000)) for run in range(9) for _ in range(20)]
    runs = spark.createDataFrame(rows, "run int, digest bigint, id bigint")
    for fanout in (2, 3, 100):
        got = {r["digest"]: (r["run"], r["n"], r["best"]) for r in exact_dedup.compact(Scratch(spark, "t"), runs, "smallest", fanout).collect()}
        assert got == {d: (0, sum(x == d for _, x, _ in rows), min(i for _, x, i in rows if x == d)) for _, d, _ in rows}
    bits = 1 << 13
    keys = spark.range(300).selectExpr("xxhash64(id) AS digest")
    words = exact_dedup.digest_filter(spark, keys, bits)
    asked = spark.range(3000).selectExpr("id", "xxhash64(id) AS digest").crossJoin(words).select("id", exact_dedup.may_hold(F.col("words"), F.col("digest"), bits).alias("may")).collect()
    assert all(r["may"] for r in asked if r["id"] < 300)
    assert sum(r["may"] for r in asked if r["id"] >= 300) < 0.08 * 2700


def test_kept_rows_have_their_columns(spark):
    docs = frame(spark, ROWS)
    kept = exact_dedup.keep_decided(spark, docs, exact_dedup.lsm_dedup(spark, docs))
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], (r["text"] or "")[:5]) for r in kept.collect()) == [(2, "aBC"), (4, ""), (5, "É"), (6, "é"), (8, "LONG "), (10, "solo"), (11, "three"), (11, "two")]


def test_empty_tables(spark):
    docs = frame(spark, [])
    assert exact_dedup.lsm_dedup(spark, docs).count() == 0
    assert exact_dedup.keep_decided(spark, docs, exact_dedup.lsm_dedup(spark, docs)).count() == 0
    assert simhash.simhash_components(spark, docs).count() == 0
    assert simhash.one_of_each(spark, docs).count() == 0


def test_masks_cover():
    family = simhash.masks(2)
    assert len(family) == 7
    for a in range(64):
        for b in range(a, 64):
            gone = (1 << a) | (1 << b)
            assert any(m & gone == 0 for m in family)


def plain_fingerprint(text, width):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(spark):
    random.seed(5)
    words = [f"w{k}" for k in range(30)]
    rows = [(k, " ".join(random.choice(words) for _ in range(random.choice((0, 1, 2, 3, 4, 5, 40))))) for k in range(220)]
    rows += [(300, None), (301, "A  b\tC"), (302, "a b c"), (None, "a b c"), (302, "a b c"), (303, "w1 " * 5000)]
    got = simhash.simhash_components(spark, frame(spark, rows)).collect()
    prints = [plain_fingerprint(t, 3) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    want = sorted(((i if i is not None else -1), f"{prints[k]:016x}", least[find(k)]) for k, (i, _) in enumerate(rows))
    assert sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["fingerprint"], r["component_id"]) for r in got) == want


def test_ids_may_be_strings_and_words_very_long(spark):
    long = "y" * (3 << 20)
    rows = [("b", "one two three four"), ("a", "One two THREE four"), ("z", long), ("c", long.upper()), (None, "other words entirely here")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(spark, docs).collect()}
    assert got == {"b": "a", "a": "a", "z": "c", "c": "c", None: None}
    assert simhash.majority(np.zeros((0, 8), np.uint8)) == 0
    assert sorted((r["doc_id"] or "") for r in simhash.one_of_each(spark, docs).collect()) == ["", "a", "c"]


def test_links_of_crowded_fingerprints(spark):
    from sparkgrove.storage import Scratch

    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 3)
    prints = np.unique(np.concatenate([base, *[base ^ (1 << int(i)) ^ (1 << int(j)) for i, j in rng.integers(0, 62, (200, 2))]]))
    found = simhash.links(spark, Scratch(spark, "t"), spark.createDataFrame([(int(p),) for p in prints], "fp bigint")).collect()
    joined = {frozenset((r["a"], r["b"])) for r in found}
    assert all((a ^ b).bit_count() <= 2 for a, b in map(tuple, joined))
    groups = {n: r for n, r in ((r["node"], r["root"]) for r in components.components(spark, spark.createDataFrame([tuple(x) for x in joined], "a bigint, b bigint")).collect())}
    for a in map(int, prints):
        for b in map(int, prints):
            if a < b and (a ^ b).bit_count() <= 2:
                assert groups[a] == groups[b]


@pytest.mark.parametrize("links", [[(k, k + 1) for k in range(50)], [(0, k) for k in range(1, 40)], [(5, 5), (1, 2), (2, 1), (None, 3)], []])
def test_components(spark, links):
    got = {r["node"]: r["root"] for r in components.components(spark, spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    real = [x for x in links if None not in x and x[0] != x[1]]
    assert set(got) == {n for x in real for n in x}
    assert set(got.values()) == ({min(min(x) for x in real)} if real else set())


def test_near_duplicates_keep_one(spark):
    random.seed(8)
    words = [f"word{k}" for k in range(4000)]
    base = [random.choice(words) for _ in range(300)]

    def edited(n):
        out = list(base)
        for k in random.sample(range(300), n):
            out[k] = "new"
        return " ".join(out)

    rows = [(k, edited(1)) for k in range(30)] + [(100 + k, " ".join(random.choice(words) for _ in range(300))) for k in range(20)] + [(200, ""), (201, None), (None, "x y"), (202, "tiny")]
    docs = frame(spark, rows)
    left = simhash.one_of_each(spark, docs)
    assert left.columns == docs.columns
    ids = {r["doc_id"] for r in left.collect()}
    assert {100 + k for k in range(20)} | {200, 201, None, 202, 0} <= ids
    assert len(ids & set(range(30))) <= 2


def plain_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + simhash.WIDTH]) for k in range(len(w) - simhash.WIDTH + 1)} or ({tuple(w)} if w else set())


def plain_links(rows):
    """Every pair of ids at a Jaccard similarity of 0.8 or more, with its similarity."""
    sets = [(i, plain_shingles(t)) for i, t in rows]
    found = {}
    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and 5 * len(x & y) >= 4 * len(x | y):
                found[min(i, j), max(i, j)] = len(x & y) / len(x | y)
    return found


def plain_roots(links):
    root = {n: n for pair in links for n in pair}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in root}


def test_near_duplicates_of_every_band(spark):
    rng = random.Random(4)
    words = [f"word{k}" for k in range(3000)]
    rows = []
    for k in range(420):
        base = [rng.choice(words) for _ in range((12, 40, 90, 200, 400)[k % 5])]
        near, low = list(base), (0.80, 0.80, 0.84, 0.90)[k // 5 % 4]
        for _ in range(60):  # words are replaced, dropped and added for as long as the text stays in its band
            new, at = list(near), rng.randrange(len(near))
            new[at : at + 1] = rng.choice(([rng.choice(words)], [], [near[at], rng.choice(words)]))
            x, y = plain_shingles(" ".join(base)), plain_shingles(" ".join(new))
            if 100 * len(x & y) >= round(100 * low) * len(x | y):
                near = new
        rows += [(k, " ".join(base)), (1000 + k, " ".join(near).upper())]
    rows += [(5000, "a b c d e"), (5001, "A  b\tc d e"), (5002, "tiny"), (5003, "TINY"), (5004, "x y z " * 50), (5005, "x y z " * 90), (5006, ""), (5007, None), (9999, "tiny")]
    links = plain_links(rows)
    band = [sum(low <= s < high for s in links.values()) for low, high in ((0.80, 0.84), (0.84, 0.90), (0.90, 0.96))]
    assert min(band) >= 40
    docs = frame(spark, [(None if i == 9999 else i, t) for i, t in rows])  # a null id is the largest
    got = {9999 if r["id"] is None else r["id"]: r["root"] for r in simhash.near_duplicates(spark, docs).collect()}
    lost = [s for (i, j), s in links.items() if got.get(i) is None or got.get(i) != got.get(j)]
    assert not lost, sorted(lost)
    assert got == plain_roots(links)


@pytest.mark.parametrize("n", [*range(1, 60), 1000, 4995])
def test_prefixes_are_long_enough(n):
    longest, lesser = simhash.prefix_sizes(n)
    assert 1 <= lesser <= longest <= n
    least = lambda m: min(k for k in range(1, min(n, m) + 1) if 9 * k >= 4 * (n + m))
    sizes = [m for m in range(1, 2 * n + 2) if 5 * min(n, m) >= 4 * max(n, m)]
    assert longest == max(n - least(m) + 1 for m in sizes)
    assert lesser == max(n - least(m) + 1 for m in sizes if m >= n)


@pytest.mark.parametrize("block", [4000, 3])
def test_near_duplicates_in_crowded_shingles(spark, monkeypatch, block):
    """Windows over one long text: ten share each shingle, and only neighbours are alike."""
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", block)
    rng = random.Random(6)
    long = [f"w{rng.randrange(4000)}" for _ in range(2090)]
    rows = [(k, " ".join(long[10 * k : 10 * k + 100])) for k in range(200)]
    links = plain_links(rows)
    assert sorted(links) == [(k, k + 1) for k in range(199)]
    got = {r["id"]: r["root"] for r in simhash.near_duplicates(spark, frame(spark, rows)).collect()}
    assert got == plain_roots(links)


def test_differing_parities_never_outnumber_differing_shingles(spark):
    rng, rows = np.random.default_rng(3), []
    for n in (1, 5, 100, 127, 129, 700, 3000):
        x = np.unique(rng.integers(-(1 << 63), 1 << 63, n))
        for low in (0.8, 0.9, 1.0):
            y = np.unique(np.concatenate((x[: max(1, int(low * len(x)))], rng.integers(-(1 << 63), 1 << 63, rng.integers(0, len(x) // 4 + 1)))))
            if 2 * len(y) > len(x):
                rows.append((len(np.setxor1d(x, y)), simhash.parities(x).tolist(), simhash.parities(y).tolist()))
    got = spark.createDataFrame(rows, "differ int, x array<bigint>, y array<bigint>").select("differ", simhash._apart(F.col("x"), F.col("y")).alias("apart"), simhash._apart(F.col("y"), F.col("x")).alias("back")).collect()
    assert all(r["apart"] == r["back"] <= r["differ"] for r in got)
    assert all(r["apart"] > r["differ"] / 2 for r in got if r["differ"])


def test_repeated_ids_are_decided_by_text(spark):
    """One id with many texts, some of them near-duplicates: what exact dedup keeps under one id is not lost."""
    rng = random.Random(12)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    own = [fresh(12) for _ in range(300)]
    base = fresh(40)
    rows = [(7, t) for t in own] + [(7, base), (7, base + " x"), (8, base + " y"), (7, base.upper()), (7, ""), (7, None), (None, "alone here"), (9, own[0] + " z")]
    kept = simhash.one_of_each(spark, frame(spark, rows)).collect()
    assert sorted(r["text"] for r in kept if r["text"] in own) == sorted(own)
    near = [r for r in kept if (r["text"] or "").lower().startswith(base)]
    assert len(near) == 1 and near[0]["doc_id"] == 7
    assert sorted(((r["doc_id"] is None, r["text"]) for r in kept if not r["text"] or r["text"] == "alone here"), key=str) == [(False, ""), (False, None), (True, "alone here")]
    assert not [r for r in kept if r["doc_id"] == 9]
    exact = exact_dedup.keep_decided(spark, frame(spark, [(11, "two"), (11, "three"), (10, "TWO")]), exact_dedup.lsm_dedup(spark, frame(spark, [(11, "two"), (11, "three"), (10, "TWO")])))
    assert sorted(r["text"] for r in simhash.one_of_each(spark, exact).collect()) == ["three", "two"]


def test_many_rows_of_one_id_and_text(spark):
    docs = spark.range(3000).selectExpr("5L AS doc_id", "'a b c d e f g' AS text", "id AS n")
    assert simhash.one_of_each(spark, docs).count() == 1
