"""Toxicity, language, URLs and scoring: brute-force versions and held-out accuracy on small data."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkgrove.llm import langid, ppm, toxicity, url_filter

DOCS = "doc_id bigint, text string, lang string, source string, id string, score string, held_out int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", "x", "y", 0) for i, t, g in rows], DOCS)


def make(n, seed=3):
    random.seed(seed)
    plain, bad = [f"plain{k}" for k in range(200)], [f"nasty{k}" for k in range(12)]
    rows, labels = [], []
    for k in range(n):
        toxic = k % 4 == 0
        words = random.choices(plain, k=40) + (random.choices(bad, k=3) if toxic else [])
        random.shuffle(words)
        rows.append((k, " ".join(words), "en"))
        if k % 2 == 0 or not toxic:
            labels.append((k, 1, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = make(1200)
    rows += [(None, "nasty1 nasty2 nasty3", None), (5000, None, None), (5001, "", None), (5002, "plain1 " * 30000, None), (0, rows[0][1], "en")]
    lab = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity(spark, docs(spark, rows), lab).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1200]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    wrong = sum(r["predicted"] != int(r["doc_id"] % 4 == 0) for r in held)
    assert wrong <= 0.03 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    empty = {r["score"] for r in got if r["doc_id"] in (5000, 5001)}
    assert len(empty) == 1


def test_risk_is_corrected_where_it_goes_negative():
    rng = np.random.default_rng(0)
    for shift, sign in ((0.0, 1), (-6.0, -1)):  # far-off unlabelled rows bring the negative part below zero
        gp, gu = rng.normal(1, 1, 5), rng.normal(shift, 0.3, 7)
        _, rest, dp, du = toxicity.corrected_risk(gp, gu, 0.4)
        assert np.sign(rest) == sign

        def goal(p, u):
            plus, rest, _, _ = toxicity.corrected_risk(p, u, 0.4)
            return plus + rest if rest >= 0 else -rest

        for k in range(5):
            e = np.eye(5)[k] * 1e-6
            assert (goal(gp + e, gu) - goal(gp - e, gu)) / 2e-6 == pytest.approx(dp[k], abs=1e-6)
        for k in range(7):
            e = np.eye(7)[k] * 1e-6
            assert (goal(gp, gu + e) - goal(gp, gu - e)) / 2e-6 == pytest.approx(du[k], abs=1e-6)


def test_training_keeps_the_negative_part_near_zero():
    rng = np.random.default_rng(0)
    pos = [np.unique(rng.integers(0, 30, 8)) for _ in range(60)]
    unl = [np.unique(rng.integers(20, 400, 8)) for _ in range(300)]
    s = toxicity.train_nnpu(pos, unl, 0.1)
    gp, gu = (np.array([s.logit(r.tolist()) for r in rows]) for rows in (pos, unl))
    assert gp.mean() > gu.mean()
    assert toxicity.corrected_risk(gp, gu, 0.1)[1] > -0.02


def test_repeated_ids_do_not_multiply_the_samples(spark, monkeypatch):
    rows = [(4, f"plain{k} word nasty{k % 3}", "en") for k in range(10_000)] + [(k, f"text of {k}", "en") for k in range(100, 160)]
    got = {}
    monkeypatch.setattr(toxicity, "train_nnpu", lambda p, u, prior: got.update(p=len(p), u=len(u)) or toxicity.Scorer({}, 0.0))
    monkeypatch.setattr(langid, "train", lambda texts, langs: got.update(t=len(texts)) or langid.Network([], [], [], None, None))
    labels = spark.createDataFrame([(4, 1, 1), (4, 1, 1)], "doc_id bigint, quality int, toxic int")
    toxicity.fit(spark, docs(spark, rows), labels)
    langid.fit(docs(spark, rows))
    ids = {4, *range(100, 160)}
    fold = lambda i, n: zlib.crc32(str(i).encode()) % n
    assert got["p"] == (fold(4, 4) != 2) and got["u"] == sum(fold(i, 4) != 2 for i in ids)
    assert got["t"] == sum(fold(i, 3) != 1 for i in ids)


def test_scores_are_sums_of_weights(spark):
    rows = [(k, t, None) for k, t in enumerate(["Bad bad worse", "fine_day, BAD?", "", None, "é bad1 bad", "none of them"])]
    h = lambda w: zlib.crc32(w.encode())
    scorer = toxicity.Scorer({h("bad"): 2.0, h("worse"): -0.5, h("fine"): -3.0}, -1.0)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs(spark, rows), scorer).collect()}
    logits = [0.5, -2.0, -1.0, -1.0, 1.0, -1.0]
    assert [got[k] for k in range(6)] == pytest.approx([1 / (1 + math.exp(-x)) for x in logits])


def test_no_labels_no_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.toxicity(spark, docs(spark, []), none).count() == 0
    rows = toxicity.toxicity(spark, docs(spark, [(1, "a", None)]), none).collect()
    assert 0 < rows[0]["score"] < 0.3
    assert toxicity.clean(spark, docs(spark, [(1, "a", None)]), none).columns == DOCS.replace(" bigint", "").replace(" string", "").replace(" int", "").split(", ")


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(1)
    net = langid.Network(["a", "b", "c"], [rng.standard_normal((9, 256)).astype(np.float64) for _ in range(2)], [rng.standard_normal((9, 3)) for _ in range(2)], rng.standard_normal((3, 6)), np.zeros((3, 1)))
    x, y = rng.integers(0, 256, (5, 4)).astype(np.uint8), np.array([0, 1, 2, 1])
    valid = np.array([[1, 1, 0, 1], [1, 1, 1, 1], [1, 1, 1, 1], [1, 0, 1, 1], [1, 0, 0, 1]], bool)
    loss = lambda: -np.log(net.positions(x, valid)[:, y, np.arange(4)])[valid].mean()
    params = [*net.table, *net.inner, net.out, net.bias]
    for p, g in zip(params, langid._gradients(net, x, y, valid), strict=True):
        spots = [np.unravel_index(np.abs(g).argmax(), g.shape)]
        for at in spots:
            keep = p[at]
            p[at] = keep + 1e-2
            up = loss()
            p[at] = keep - 1e-2
            down = loss()
            p[at] = keep
            assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.05, abs=1e-4)


def plain_states(net, data, direction):
    """States of one direction over a whole byte string, one position after another."""
    size = net.inner[0].shape[1]
    h, out = np.zeros(size), [None] * len(data)
    logistic = lambda v: 1 / (1 + np.exp(-v))
    for t in range(len(data)) if direction == 0 else range(len(data) - 1, -1, -1):
        x, w = net.table[direction][:, data[t]].astype(float), net.inner[direction].astype(float)
        gates = logistic(w[: 2 * size] @ h + x[: 2 * size])
        r, u = gates[:size], gates[size:]
        c = np.tanh(w[2 * size :] @ (r * h) + x[2 * size :])
        h = out[t] = u * h + (1 - u) * c
    return np.array(out)


def plain_document(net, text):
    """Mean over all positions, each window read from its context on."""
    total, n = np.zeros(len(net.languages)), len(text)
    half = net.inner[0].shape[1]
    for s in range(0, n, langid.WINDOW):
        low, end, high = max(0, s - langid.CONTEXT), min(n, s + langid.WINDOW), min(n, s + langid.WINDOW + langid.CONTEXT)
        hf, hb = plain_states(net, text[low:end], 0)[s - low :], plain_states(net, text[s:high], 1)[: end - s]
        logits = hf @ net.out[:, :half].T + hb @ net.out[:, half:].T + net.bias[:, 0]
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        total += (e / e.sum(axis=1, keepdims=True)).sum(axis=0)
    return total / max(1, n)


def test_documents_match_brute_force():
    rng = np.random.default_rng(5)
    net = langid.Network(["a", "b", "c"], [rng.standard_normal((12, 256)).astype(np.float32) for _ in range(2)], [rng.standard_normal((12, 4)).astype(np.float32) for _ in range(2)], rng.standard_normal((3, 8)).astype(np.float32), rng.standard_normal((3, 1)).astype(np.float32))
    texts = [rng.integers(32, 127, n).astype(np.uint8).tobytes() for n in (0, 1, 5, 63, 64, 65, 79, 80, 81, 128, 129, 400)]
    assert net.documents(texts) == pytest.approx(np.array([plain_document(net, t) for t in texts]), abs=1e-4)


def test_short_texts_of_near_languages():
    """Two languages of one alphabet, told apart by their syllables; texts are cut to few bytes."""
    rng = random.Random(3)
    parts = {"xx": ["ba", "ne", "tor", "li", "san"], "yy": ["ab", "en", "rot", "il", "nas"]}
    make = lambda g, n: " ".join("".join(rng.choices(parts[g], k=rng.randint(1, 3))) for _ in range(n)).encode()
    langs = [g for _ in range(300) for g in parts]
    net = langid.train([make(g, 60) for g in langs], langs)
    asked = [g for _ in range(200) for g in parts]
    for size, least in ((12, 0.9), (20, 0.95), (200, 0.99)):
        best = net.documents([make(g, 60)[:size] for g in asked]).argmax(axis=1)
        assert np.mean([net.languages[b] == g for b, g in zip(best, asked, strict=True)]) >= least


def test_language(spark):
    random.seed(2)
    alphabets = {"xx": "abcde", "yy": "vwxyz", "zz": "αβγδ"}
    rows = [(k, " ".join("".join(random.choices(alphabets[g], k=5)) for _ in range(20)), g) for k in range(240) for g in [("xx", "yy", "zz")[k % 3]]]
    special = [(1000, None, "xx"), (1001, "", None), (1002, "12 34 !", "yy"), (1003, "abcde " * 20000, None), (1004, "\u00b2 \u00bd \u2167", "xx"), (1005, "b" * (3 << 20), None), (None, "wxyz vwx", None), (1001, "", None)]
    got = {r["doc_id"]: r for r in langid.language(spark, docs(spark, rows + special)).collect()}
    held = [r for i, r in got.items() if i is not None and i < 1000 and r["held_out"]]
    assert sum(r["lang_pred"] == ("xx", "yy", "zz")[r["doc_id"] % 3] for r in held) >= 0.97 * len(held)
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003, 1004, 1005)] == ["und", "und", "und", "xx", "und", "xx"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.language(spark, docs(spark, [])).count() == 0
    assert langid.language(spark, docs(spark, [(1, "abc", None)])).first()["lang_pred"] == "und"


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "action"),
    [
        ("http://A.Example.COM/en/7?x#y", "a.example.com", "/en/7", "example.com/en/7", "allow"),
        ("https://com/en/", "com", "/en/", "com/en/", "block"),
        ("https://xcom/en/", "xcom", "/en/", None, None),
        ("x://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "block"),
        ("x://b.net/de/1", "b.net", "/de/1", "net/de/", "allow"),
        ("x://h?a/b", "h", "", None, None),
        ("nothing", "", "", None, None),
        ("", "", "", None, None),
        (None, "", "", None, None),
        ("x://org/es/?q", "org", "/es/", "org/es/", "block"),
    ],
)
def test_url_rules(url, host, path, rule, action):
    assert url_filter.split_url(url) == (host, path)
    assert url_filter.Rules().match(host, path) == (rule, action)


def test_rules_match_brute_force():
    rng = random.Random(8)
    known = url_filter.Rules()
    for _ in range(3000):
        host = ".".join(rng.choices(["a", "example", "com", "net", "org"], k=rng.randint(0, 3)))
        path = "/" + "/".join(rng.choices(["en", "de", "es", "7", "8", "77", ""], k=rng.randint(0, 3)))
        fits = []
        for action, rule in url_filter.RULES:
            h, slash, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
                fits.append((len(rule), rule, action))
        assert known.match(host, path) == (max(fits)[1:] if fits else (None, None))


def plain_value(tree, row, node=0):
    f, cut, left, right, value = tree[node]
    return value if f < 0 else plain_value(tree, row, int(left if row[int(f)] <= cut else right))


def test_trees_match_brute_force():
    rng = random.Random(1)
    urls = [f"http{'s' * rng.randint(0, 1)}://{'x-' * rng.randint(0, 3)}{rng.randint(0, 999)}.{rng.choice(['com', 'org'])}/{'a/' * rng.randint(0, 4)}?p={rng.randint(0, 9)}" for _ in range(300)]
    bad = np.array([u.count("-") > 1 or "com/a/" in u for u in urls])
    model = url_filter.train(urls, bad, trees=6)
    x = np.array([url_filter.features(u, model.suffix_rate, model.usual) for u in urls])
    assert model.logit(x) == pytest.approx([model.base + sum(plain_value(t, row) for t in model.trees) for row in x])
    # the first tree's root is the best of all splits
    p = 1 / (1 + math.exp(-model.base))
    g, h = bad - p, np.full(len(bad), p * (1 - p))
    score = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + 1)
    gains = {}
    for f in range(x.shape[1]):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1], method="lower")):
            gains[f, cut] = score(x[:, f] <= cut) + score(x[:, f] > cut)
    assert gains[int(model.trees[0][0][0]), model.trees[0][0][1]] == pytest.approx(max(gains.values()))


def test_labels_from_rules_and_from_a_table(spark):
    rng = random.Random(2)
    urls = [f"https://{rng.choice(['', 'm.', 'www.'])}h{rng.randint(0, 40)}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randint(1, 9999)}" for _ in range(3000)]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate([*urls, None])], "page_id int, url string")
    found, bad = url_filter.labelled(pages)
    rules = url_filter.Rules()
    assert sorted(found) == sorted(set(urls)) and all(b == (rules.match(*url_filter.split_url(u))[1] == "block") for u, b in zip(found, bad, strict=True))
    held = np.array([zlib.crc32(u.encode()) % 4 == 0 for u in found])
    model = url_filter.train([u for u, h in zip(found, held, strict=True) if not h], bad[~held])
    assert ((model.score([u for u, h in zip(found, held, strict=True) if h]) >= 0.5) == bad[held]).mean() > 0.97
    labels = spark.createDataFrame([("a://x", 0), ("a://x", 1), ("a://y", 0), (None, 1), ("a://z", None)], "url string, bad int")
    assert {(u, bool(b)) for u, b in zip(*url_filter.labelled(pages, labels), strict=True)} == {("a://x", True), ("a://y", False)}
    assert (url_filter.Boosted().score(["a://x"]) < 0.5).all()


def test_trees_learn_from_labels(spark):
    random.seed(4)
    urls = [f"http://{'win-' * (k % 2)}site{random.randint(0, 99)}.org/{random.randint(0, 9)}" for k in range(600)]
    model = url_filter.train(urls[:400], np.arange(400) % 2 == 1)
    assert ((model.score(urls[400:]) >= 0.5) == (np.arange(400, 600) % 2 == 1)).mean() > 0.98
    pages = spark.createDataFrame([(1, None, "a", "b"), (2, "x://org/es/", "a", "b"), (2, "x://org/es/", "a", "b"), (3, "a://" + "b" * 100000, "", "")], "page_id int, url string, host string, id string")
    rows = sorted(url_filter.judge_urls(spark, pages).collect())
    assert [(r["page_id"], r["rule"], r["verdict"]) for r in rows[1:3]] == [(2, "org/es/", "block")] * 2
    assert url_filter.judge_urls(spark, pages.limit(0)).count() == 0


def plain_ppm(train, texts, order):
    trie = [defaultdict(Counter) for _ in range(order + 1)]
    pad = lambda d: bytes([ppm.BEFORE]) * order + d + bytes([ppm.END])
    for d in train:
        s = pad(d)
        for p in range(order, len(s)):
            for k in range(order + 1):
                trie[k][s[p - k : p]][s[p]] += 1
    out = []
    for d in texts:
        s, total = pad(d), 0.0
        for p in range(order, len(s)):
            gone: set[int] = set()
            for k in range(order, -1, -1):
                seen = trie[k].get(s[p - k : p])
                if not seen:
                    continue
                left = {a: n for a, n in seen.items() if a not in gone}
                gone = set(seen)
                if not left:
                    continue
                n, d_ = sum(left.values()), len(left)
                if s[p] in left:
                    total += math.log10(left[s[p]] / (n + d_))
                    break
                total += math.log10(d_ / (n + d_))
            else:
                total -= math.log10(ppm.ALPHABET - len(trie[0].get(b"", ())))
        out.append(total)
    return out


@pytest.mark.parametrize(("leaves", "hot"), [(ppm.LEAVES, ppm.HOT_WORDS), (90, 20)])
def test_scores_match_brute_force(spark, monkeypatch, leaves, hot):
    """With the trie in one part and all words known to every worker, and with many parts and few known words."""
    monkeypatch.setattr(ppm, "HOT_WORDS", hot)
    monkeypatch.setattr(ppm, "COUNTED_WORDS", 50)
    random.seed(6)
    rows = [(k, "".join(random.choices("abcd é", k=random.randint(0, 60))), None) for k in range(80)] + [(500, None, None), (501, "", None), (None, "Abc zz", None), (502, "ab " * 20000, None), (503, "x" * (3 << 20), None), (7, "again", None)]
    got = sorted(ppm.score_texts(spark, docs(spark, rows), most_leaves=leaves).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]))
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, len((r[1] or "").split())))
    low = [(t or "").encode().lower() for _, t, _ in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _, _ in rows]
    counts = Counter(w for d, h in zip(low, held, strict=True) if not h for w in [*d.split(), None])
    total, kinds = sum(counts.values()), len(counts)
    base = [sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in [*d.split(), None]) for d in low]
    assert [r["held_out"] for r in got] == held
    assert [r["train_tokens"] for r in got] == [total] * len(rows)
    assert [r["n_known"] for r in got] == [sum(counts[w] > 0 for w in [*d.split(), None]) for d in low]
    assert [r["base_score"] for r in got] == pytest.approx(base)
    assert [r["score"] for r in got] == pytest.approx(plain_ppm([d for d, h in zip(low, held, strict=True) if not h], low, ppm.ORDER))
    assert ppm.score_texts(spark, docs(spark, [])).count() == 0


def test_a_trie_is_cut_at_whole_pairs():
    assert ppm.cut_trie(np.array([3, 0, 4, 9, 1, 1]), 7).tolist() == [0, 0, 0, 1, 2, 2]
    assert ppm.cut_trie(np.zeros(3, np.int64), 7).tolist() == [0, 0, 0]


def test_probabilities_sum_to_one():
    keys, counts = ppm.counted([b"abracadabra", b"abba", b"cab"])
    trie = ppm.Trie(keys, counts)
    for context in (b"", b"a", b"ab", b"abra", b"zz", b"xyab"):
        total = 0.0
        for s in [*range(0xFE), ppm.END]:
            data = np.frombuffer(bytes([ppm.BEFORE]) * ppm.ORDER + context + bytes([s]), np.uint8)
            total += 10 ** trie.log10(data)[-1]
        assert total == pytest.approx(1)
