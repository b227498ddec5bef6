"""URL filter: explicit rules first, then gradient-boosted trees on lexical features, in numpy.

The trees see only shape: lengths, depth, digit ratio, entropy, parameter counts,
hyphens, and how often training URLs of the same host suffix and first folder were
bad. They are grown on histograms of quantile bins with Newton leaf values of the
logistic loss. They learn from a table of labelled URLs; without one, a rule's block
labels a URL as bad and all else as good, so that the trees carry the rules over to
URLs of the same shape.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (action, rule); a rule is a host and a path prefix.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Documented bound of the training sample.
TRAINING_URLS = 20_000
THRESHOLD = 0.5
_SPLIT = re.compile(r"[/?#]")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path; both empty without ``://``."""
    if not url or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = _SPLIT.search(rest)
    host = rest[: cut.start()] if cut else rest
    path = rest[len(host) :]
    for mark in "?#":
        path = path.partition(mark)[0]
    return host.translate(_LOWER), path


class Rules:
    """The longest rule whose host is the URL's or a parent of it, and whose path starts the URL's."""

    def __init__(self, rules: tuple[tuple[str, str], ...] = RULES) -> None:
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for action, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host.translate(_LOWER), []).append((slash + path, rule, action))

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule, action), or two nulls. Equally long rules: the first by text."""
        best: tuple[int, str, str] | None = None
        tail = host
        while tail:
            for prefix, rule, action in self.by_host.get(tail, ()):
                if path.startswith(prefix) and (best is None or (-len(rule), rule) < best[:2]):
                    best = (-len(rule), rule, action)
            tail = tail.partition(".")[2]
        return (best[1], best[2]) if best else (None, None)


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


FEATURES = ("url_length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio", "host_digits", "hyphens", "host_entropy", "path_entropy", "parameters", "query_length", "longest_label", "other_characters", "suffix_rate")


def suffix(host: str, path: str) -> str:
    """The last label of a host and the first folder of a path."""
    return f"{host.rpartition('.')[2]}/{path[1:].partition('/')[0] if path.count('/') > 1 else ''}"


def features(url: str | None, suffix_rate: dict[str, float], usual: float) -> list[float]:
    """The lexical features of one URL."""
    url = url or ""
    host, path = split_url(url)
    query = url.partition("?")[2].partition("#")[0]
    labels = host.split(".")
    digits = sum(c.isdigit() for c in url)
    return [
        len(url), len(host), len(path), len(labels), path.count("/"), digits / max(1, len(url)), sum(c.isdigit() for c in host),
        host.count("-"), _entropy(host), _entropy(path), query.count("=") , len(query), max(map(len, labels)),
        sum(not (c.isalnum() or c in "-._~:/?#=&%") for c in url), suffix_rate.get(suffix(host, path), usual),
    ]


@dataclass
class Boosted:
    """Trees as arrays of (feature, threshold, left, right, value); a leaf has feature -1."""

    base: float = -2.0
    trees: list[np.ndarray] = field(default_factory=list)
    suffix_rate: dict[str, float] = field(default_factory=dict)
    usual: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for tree in self.trees:
            node = np.zeros(len(x), np.int64)
            while True:
                f = tree[node, 0].astype(np.int64)
                inner = f >= 0
                if not inner.any():
                    break
                left = x[rows, np.maximum(f, 0)] <= tree[node, 1]
                node = np.where(inner, np.where(left, tree[node, 2], tree[node, 3]).astype(np.int64), node)
            total += tree[node, 4]
        return total

    def score(self, urls: list[str | None]) -> np.ndarray:
        """Probability that each URL is bad."""
        if not urls:
            return np.zeros(0)
        x = np.array([features(u, self.suffix_rate, self.usual) for u in urls])
        return 0.5 * (1 + np.tanh(0.5 * self.logit(x)))


def train(urls: list[str | None], bad: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> Boosted:
    """Boost logistic trees on labelled URLs; without any, no URL reaches the threshold."""
    if not len(urls):
        return Boosted()
    y = np.asarray(bad, np.float64)
    usual = float(y.mean())
    suffixes = [suffix(*split_url(u)) for u in urls]
    seen, wrong = Counter(suffixes), Counter(s for s, b in zip(suffixes, y, strict=True) if b)
    model = Boosted(float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), [], {s: (wrong[s] + 20 * usual) / (n + 20) for s, n in seen.items()}, usual)
    x = np.array([features(u, model.suffix_rate, usual) for u in urls], np.float64)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    logit = np.full(len(y), model.base)
    for _ in range(trees):
        p = 0.5 * (1 + np.tanh(0.5 * logit))
        g, h = y - p, p * (1 - p)
        nodes: list[list[float]] = []

        def grow(rows: np.ndarray, left: int, nodes=nodes, g=g, h=h) -> int:
            me = len(nodes)
            total_g, total_h = g[rows].sum(), h[rows].sum()
            nodes.append([-1, 0, 0, 0, rate * total_g / (total_h + ridge)])
            best = (1e-3, -1, -1)
            for f in range(x.shape[1]) if left else ():
                k = len(edges[f]) + 1
                b = binned[rows, f]
                sg, sh = np.cumsum(np.bincount(b, g[rows], minlength=k))[:-1], np.cumsum(np.bincount(b, h[rows], minlength=k))[:-1]
                if not len(sg):
                    continue
                gain = sg**2 / (sh + ridge) + (total_g - sg) ** 2 / (total_h - sh + ridge) - total_g**2 / (total_h + ridge)
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (gain[at], f, at)
            if best[1] >= 0:
                f, at = best[1:]
                to_left = binned[rows, f] <= at
                nodes[me][0], nodes[me][1] = f, edges[f][at]
                nodes[me][2] = grow(rows[to_left], left - 1)
                nodes[me][3] = grow(rows[~to_left], left - 1)
            return me

        grow(np.arange(len(y)), depth)
        model.trees.append(np.array(nodes, np.float64))
        logit = logit + Boosted(0.0, [model.trees[-1]]).logit(x)
    return model


def labelled(pages: DataFrame, labels: DataFrame | None = None, rules: tuple[tuple[str, str], ...] = RULES, url_col: str = "url", label_col: str = "bad", most: int = TRAINING_URLS) -> tuple[list[str], np.ndarray]:
    """A bounded sample of distinct URLs (smallest hashes), and whether each is bad.

    ``labels`` has a URL and a label a row; of several labels of a URL the largest counts, a
    null in either column is not used. Without that table a URL of ``pages`` is bad if the
    rule that fits it blocks.
    """
    given = pages if labels is None else labels.where(F.col(label_col).isNotNull())
    found = given.where(F.col(url_col).isNotNull()).select(F.col(url_col).alias("url"), (F.lit(0) if labels is None else F.col(label_col).cast("int")).alias("bad"))
    rows = found.groupBy("url").agg(F.max("bad").alias("bad")).orderBy(F.xxhash64("url"), "url").limit(most).collect()  # bounded by the limit
    known, urls = Rules(rules), [r["url"] for r in rows]
    bad = [known.match(*split_url(u))[1] == "block" for u in urls] if labels is None else [r["bad"] > 0 for r in rows]
    return urls, np.array(bad, bool)


def judge_urls(spark: SparkSession, pages: DataFrame, model: Boosted | None = None, rules: tuple[tuple[str, str], ...] = RULES, labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score: one row per input row.

    The rule decides where one fits, else the trees do (block from a score of 0.5).
    A null URL, or one without ``://``, has an empty host and path, fits no rule and is
    scored as it is. Without a model one is trained on :func:`labelled` URLs. Repeated rows are judged alike; other columns are not looked at; an
    empty table gives an empty result.
    """
    if model is None:
        model = train(*labelled(pages, labels, rules, url_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Rules(rules)
        for batch in batches:
            urls = batch.column("url").to_pylist()
            cut = [split_url(u) for u in urls]
            fits = [known.match(*c) for c in cut]
            scores = model.score(urls)
            verdicts = [action or ("block" if s >= THRESHOLD else "allow") for (_, action), s in zip(fits, scores.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([c[0] for c in cut], pa.string()), pa.array([c[1] for c in cut], pa.string()), pa.array([r for r, _ in fits], pa.string()), pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())], names=["id", "host", "path", "rule", "verdict", "score"])

    read = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    kind = read.schema["id"].dataType.simpleString()
    return read.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string, score double").withColumnRenamed("id", id_col)
