"""Toxicity by non-negative positive-unlabelled learning, in numpy.

Confirmed toxic documents are the positives; a sample of all documents, toxic ones
among them, is the unlabelled set. With class prior p the risk of a scorer is
p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives)); when the second term
falls below zero the step instead ascends on it, which keeps a flexible model from
over-fitting the positives. The scorer is logistic in the presence of words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrove.llm.common import fold, steps, texts, to_arrow

WORD = re.compile(r"[^\W_]+")
#: Documented bounds of the training sample, of positives and of unlabelled rows.
POSITIVES, UNLABELLED = 3_000, 12_000
#: Words of the model: those whose frequency among positives most surely differs from that among unlabelled rows, either way.
VOCABULARY, LEAST_ROWS, LEAST_Z = 6_000, 3, 3.0
THRESHOLD, HELD_OUT_FOLDS, HELD_OUT = 0.3, 4, 2


def word_hashes(text: bytes) -> list[int]:
    """crc32 of the distinct lower-case words of a text."""
    return [zlib.crc32(w.encode()) for w in set(WORD.findall(text.decode().lower()))]


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, x)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


@dataclass
class Scorer:
    """Weights by word hash, and a bias."""

    weights: dict[int, float]
    bias: float

    def logit(self, hashes: list[int]) -> float:
        get = self.weights.get
        return self.bias + sum([get(h, 0.0) for h in hashes])

    def score(self, text: bytes) -> float:
        return float(sigmoid(np.float64(self.logit(word_hashes(text)))))


def corrected_risk(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(positive part, negative part, step directions) of the risk at logits of positives and unlabelled rows.

    While the negative part is not below zero the directions are the derivatives of the
    whole risk by each logit, else those of minus the negative part alone.
    """
    pos_plus, pos_minus, un_minus = -sigmoid(-gp) / len(gp), sigmoid(gp) / len(gp), sigmoid(gu) / len(gu)
    rest = float(softplus(gu).mean() - prior * softplus(gp).mean())
    if rest >= 0:
        dp, du = prior * (pos_plus - pos_minus), un_minus
    else:  # ascend on the part that went negative
        dp, du = prior * pos_minus, -un_minus
    return float(prior * softplus(-gp).mean()), rest, dp, du


def train_nnpu(positives: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 400, rate: float = 0.05, decay: float = 1e-4) -> Scorer:
    """Fit the scorer; rows are arrays of distinct word hashes.

    Without positives or without unlabelled rows the scorer is the bare prior.
    """
    base = float(np.log(prior / (1 - prior)))
    if not positives or not unlabelled:
        return Scorer({}, base)
    empty = np.empty(0, np.int64)

    def counted(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate([empty, *rows]), return_counts=True)

    (kp, np_), (ku, nu) = counted(positives), counted(unlabelled)
    keys = np.union1d(kp, ku)
    fp, fu = np.zeros(len(keys)), np.zeros(len(keys))
    fp[np.searchsorted(keys, kp)], fu[np.searchsorted(keys, ku)] = np_, nu
    pp, pu = fp / len(positives), fu / len(unlabelled)
    z = (pp - pu) / np.sqrt(pu * (1 - pu) / len(positives) + pp * (1 - pp) / len(positives) + 1e-4 / len(positives))
    z = np.abs(np.where(fp + fu < LEAST_ROWS, 0, z))
    words = np.sort(keys[np.lexsort((keys, -z))[: min(VOCABULARY, int((z >= LEAST_Z).sum()))]])

    def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        key = np.concatenate([empty, *rows])
        at = np.minimum(np.searchsorted(words, key), max(len(words) - 1, 0))
        ok = words[at] == key if len(words) else np.zeros(len(key), bool)
        return row[ok], at[ok]

    (rp, cp), (ru, cu) = flat(positives), flat(unlabelled)
    n, m, k = len(positives), len(unlabelled), len(words)
    w, b = np.zeros(k), base
    mean, var = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, rounds + 1):
        gp = b + np.bincount(rp, w[cp], minlength=n)
        gu = b + np.bincount(ru, w[cu], minlength=m)
        _, _, dp, du = corrected_risk(gp, gu, prior)
        grad = np.append(np.bincount(cp, dp[rp], minlength=k)[:k] + np.bincount(cu, du[ru], minlength=k)[:k] + decay * w, dp.sum() + du.sum())
        mean, var = 0.9 * mean + 0.1 * grad, 0.999 * var + 0.001 * grad**2
        step = rate * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:k], b - step[k]
    return Scorer(dict(zip(words.tolist(), w.tolist(), strict=True)), float(b))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, prior: float | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Scorer:
    """Train on a bounded sample (smallest hashes of distinct ids) of the rows that are not held out.

    The prior is the share of toxic rows among the labelled ones unless given, kept
    within 0.001 and 0.5. Labels of null id or null value are not used; of several
    labels of an id the toxic one counts, and of several texts of an id one does.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(id_col, HELD_OUT_FOLDS) != HELD_OUT)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    if prior is None:
        total = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("y")).first()
        prior = total["y"] / total["n"] if total["n"] else 0.05
    prior = min(0.5, max(0.001, prior))
    lot = F.xxhash64("id")
    ids = docs.where(F.col(id_col).isNotNull() & (fold(id_col, HELD_OUT_FOLDS) != HELD_OUT)).select(F.col(id_col).alias("id"))
    a = known.where("y = 1").select("id", F.lit(True).alias("positive")).orderBy(lot, "id").limit(positives)
    b = ids.distinct().select("id", F.lit(False).alias("positive")).orderBy(lot, "id").limit(unlabelled)
    chosen = F.broadcast(a.unionByName(b))  # bounded by the two limits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text"):
            rows = [np.sort(np.array(word_hashes(t), np.uint32)) for t in texts(part, "text")]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("positive"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["id", "positive", "words"])

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id").select("id", "positive", "text")
    kind = read.schema["id"].dataType.simpleString()
    found = to_arrow(read, run, f"id {kind}, positive boolean, words binary")
    got = found.groupBy("id", "positive").agg(F.min("words").alias("words")).toArrow().sort_by([("id", "ascending"), ("positive", "ascending")])
    rows = [(p, np.frombuffer(w, np.uint32).astype(np.int64)) for p, w in zip(got["positive"].to_pylist(), got["words"].to_pylist(), strict=True)]
    return train_nnpu([w for p, w in rows if p], [w for p, w in rows if not p], prior)


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row; see :func:`toxicity`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text"):
            logits = np.array([scorer.logit(word_hashes(t)) for t in texts(part, "text")], np.float64)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(sigmoid(logits))], names=["id", "held_out", "score"])

    read = docs.select(F.col(id_col).alias("id"), (fold(id_col, HELD_OUT_FOLDS) == HELD_OUT).alias("held_out"), F.col(text_col).alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    scored = to_arrow(read, run, f"id {kind}, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from a score of 0.3): one row per input row.

    A null text is empty; an empty text has the score of the bias. Rows whose
    crc32(doc_id) mod 4 is 2 are held out of training. Repeated rows are scored alike, and
    of the rows of one id at most one is learnt from as such; other columns of either table are not looked at; an empty table gives an empty
    result, and without labels every score is the prior.
    """
    return score(docs, fit(spark, docs, labels, id_col=id_col, text_col=text_col), id_col, text_col)


def clean(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns.

    Null, empty, long and repeated rows fare as in :func:`toxicity`; an empty table gives
    an empty result, and columns of any other name are handed on.
    """
    scorer = fit(spark, docs, labels, id_col=id_col, text_col=text_col)
    edge = float(np.log(THRESHOLD / (1 - THRESHOLD)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, text_col):
            keep = pa.array([scorer.logit(word_hashes(t)) < edge for t in texts(part, text_col)], pa.bool_())
            yield part.filter(keep)

    return to_arrow(docs, run, docs.schema)
