"""Neighbours in blocks: ties to nine digits, candidates by code, no pair shuffled."""

from __future__ import annotations

import numpy as np

from sparkgrove.operators import ann, dense


def test_blocks_rank_as_one_sort():
    r = np.random.default_rng(0)
    v = np.round(r.standard_normal((50, 4)), 1)
    v, keys = np.concatenate((v, v[:20])), r.permutation(70)
    cosine = v[:9] @ v.T
    cosine[0], cosine[1, 3:] = -np.inf, -np.inf
    for take in (1, 3, 7):
        want = [(i, k) for i in range(9) for _, k in sorted((-round(float(c), 9), int(k)) for c, k in zip(cosine[i], keys, strict=True) if c > -np.inf)[:take]]
        rows, found, _ = dense.ranked(keys, take, ((a, cosine[:, a : a + 16]) for a in range(0, 70, 16)))
        assert list(zip(rows.tolist(), found.tolist(), strict=True)) == want


def test_hashed_search_meets_its_buckets_without_a_join(spark):
    v = np.random.default_rng(1).standard_normal((300, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    index = ann.build(spark, vectors, "vec_id", "embedding")
    found = index.search(vectors.where("vec_id < 5").selectExpr("vec_id AS query_id", "embedding"), "embedding", 4)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    of = {}
    for r in index.buckets.collect():
        of.setdefault(r["vec_id"], set()).add(r["bucket"])
    near = lambda q: {b ^ f for b in of[q] for f in (0, *(1 << np.arange(ann.BITS)))}
    want = {(q, i) for q in range(5) for i in sorted((i for i in of if of[i] & near(q)), key=lambda i: (-round(float(v[q] @ v[i]), 9), i))[:4]}
    assert {(r["query_id"], r["vec_id"]) for r in found.collect()} == want
