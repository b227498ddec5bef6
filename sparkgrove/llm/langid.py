"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A text is cut into windows; one network reads each window forwards and one backwards,
each from ``CONTEXT`` bytes of the neighbouring window on, so that no position starts
from nothing but at the ends of the text. States beyond the ends are held at zero.
Every position gets a distribution over the languages from both states, and a
document's probabilities are the mean over all its positions. All windows of a batch
advance together, so a long text is as fast a byte as many short ones. Training is
plain backpropagation through time on windows of a bounded sample, many of them cut
short, since short texts are to be told apart too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrove.llm.common import fold, steps, texts, to_arrow

LETTER = regex.compile(r"\p{L}")
#: Bytes of a window, and those of its neighbours that are read before it from either side.
WINDOW, CONTEXT, HIDDEN = 64, 16, 8
#: The share of training windows that are cut short, and the fewest bytes they keep.
SHORT, LEAST_BYTES = 0.4, 4
#: Documented bounds of the training sample: documents, and windows of each.
DOCUMENTS, WINDOWS = 3_000, 8
HELD_OUT_FOLDS, HELD_OUT = 3, 1
UNDETERMINED = "und"
#: Windows that advance together; their state then fits the processor's cache.
LANES = 4096


def windows(docs: list[bytes], size: int = WINDOW, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """((context + size + context) x n bytes, first and end of what is text in each, windows of each document); no text has no window."""
    lengths = np.array([len(d) for d in docs], np.int64)
    counts = -(-lengths // size)
    room = np.where(counts > 0, counts * size + 2 * context, 0)
    flat = np.zeros(int(room.sum()), np.uint8)
    for s, d in zip((np.cumsum(room) - room + context).tolist(), docs, strict=True):
        flat[s : s + len(d)] = np.frombuffer(d, np.uint8)
    doc = np.repeat(np.arange(len(docs)), counts)
    number = np.arange(len(doc)) - (np.cumsum(counts) - counts)[doc]  # of the window in its document
    begin = (np.cumsum(room) - room)[doc] + number * size
    cut = np.lib.stride_tricks.sliding_window_view(flat, size + 2 * context)[begin] if len(doc) else np.zeros((0, size + 2 * context), np.uint8)
    first = np.where(number == 0, context, np.maximum(context - number * size, 0))
    end = np.minimum(lengths[doc] - number * size + context, size + 2 * context)
    return np.ascontiguousarray(cut.T), first, end, counts


@dataclass
class Network:
    """Two gated recurrent units and a softmax. Rows of ``table``: the input's part of the gates, by byte.

    Gates are stacked (reset, update, candidate); the first two are logistic.
    """

    languages: list[str]
    table: list[np.ndarray]  # for each direction 3H x 256, biases included
    inner: list[np.ndarray]  # 3H x H
    out: np.ndarray  # L x 2H
    bias: np.ndarray  # L x 1

    def states(self, bytes_: np.ndarray, direction: int, keep: bool = False, valid: np.ndarray | None = None):
        """States (T x H x n) of one direction, zero where not ``valid``; with ``keep`` also the gates, for training."""
        size, n = bytes_.shape
        table, inner = self.table[direction], self.inner[direction]
        h_size = inner.shape[1]
        gates, cand = inner[: 2 * h_size], inner[2 * h_size :]
        h = np.zeros((h_size, n), np.float32)
        states = np.empty((size, h_size, n), np.float32)
        kept = []
        partly = [False] * size if valid is None else (~valid.all(axis=1)).tolist()
        for t in range(size) if direction == 0 else range(size - 1, -1, -1):
            x = table.take(bytes_[t], axis=1)
            z = gates @ h
            z += x[: 2 * h_size]
            z *= 0.5
            np.tanh(z, out=z)
            z += 1.0
            z *= 0.5  # reset and update, logistic
            r, u = z[:h_size], z[h_size:]
            rh = r * h
            c = cand @ rh
            c += x[2 * h_size :]
            np.tanh(c, out=c)
            if keep:
                kept.append((t, z, c, h, rh))
            c2 = h - c
            c2 *= u
            c2 += c  # u * h + (1 - u) * c
            if partly[t]:
                c2 *= valid[t]
            h = states[t] = c2
        return (states, kept) if keep else states

    def positions(self, bytes_: np.ndarray, valid: np.ndarray | None = None, context: int = 0) -> np.ndarray:
        """Probabilities of each language (T x L x n) at each position but for those of the context on either side."""
        half, size = self.inner[0].shape[1], len(bytes_) - context
        part = (lambda a, b: None) if valid is None else (lambda a, b: valid[a:b])
        logits = np.matmul(self.out[:, :half], self.states(bytes_[:size], 0, valid=part(0, size))[context:])
        logits += np.matmul(self.out[:, half:], self.states(bytes_[context:], 1, valid=part(context, size + context))[: size - context])
        logits += self.bias
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def documents(self, docs: list[bytes]) -> np.ndarray:
        """Mean probabilities (documents x L) over all positions; zero for an empty text."""
        if not self.languages:
            return np.zeros((len(docs), 0))
        cut, first, end, counts = windows(docs)
        sums = np.zeros((cut.shape[1], len(self.languages)), np.float64)
        at = np.arange(len(cut))[:, None]
        for i in range(0, cut.shape[1], LANES):
            valid = (at >= first[i : i + LANES]) & (at < end[i : i + LANES])
            p = self.positions(cut[:, i : i + LANES], valid, CONTEXT)
            inside = valid[CONTEXT:-CONTEXT]
            if not inside.all():
                p *= inside[:, None, :]
            sums[i : i + LANES] = p.sum(axis=0, dtype=np.float64).T
        total = np.zeros((len(docs), len(self.languages)))
        full = np.flatnonzero(counts)
        if len(full):
            total[full] = np.add.reduceat(sums, np.concatenate(([0], np.cumsum(counts[full])[:-1])), axis=0)
            total[full] /= np.array([len(docs[i]) for i in full])[:, None]
        return total


def train(docs: list[bytes], langs: list[str], hidden: int = HIDDEN, rounds: int = 500, lanes: int = 512, rate: float = 0.02, seed: int = 7) -> Network:
    """Fit by backpropagation through time on random windows, every language drawn equally often."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    n_lang = len(names)
    init = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    net = Network(names, [init(3 * hidden, 256, scale=0.3) for _ in range(2)], [init(3 * hidden, hidden, scale=1 / np.sqrt(hidden)) for _ in range(2)], init(n_lang, 2 * hidden, scale=0.3), np.zeros((n_lang, 1), np.float32))
    if not names:
        return net
    cut, sizes, label = [], [], []
    for d, g in zip(docs, langs, strict=True):
        if not d:
            continue
        whole = max(1, len(d) // WINDOW)
        for k in rng.permutation(whole)[:WINDOWS]:
            piece = d[k * WINDOW : (k + 1) * WINDOW]
            cut.append(piece.ljust(WINDOW, b" "))
            sizes.append(len(piece))
            label.append(names.index(g))
    if not cut:
        return net
    data, label = np.frombuffer(b"".join(cut), np.uint8).reshape(-1, WINDOW).T, np.array(label)
    sizes, at = np.array(sizes), np.arange(WINDOW)[:, None]
    groups = [np.flatnonzero(label == k) for k in range(n_lang)]
    groups = [g for g in groups if len(g)]
    params = [*net.table, *net.inner, net.out, net.bias]
    mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        pick = np.concatenate([rng.choice(g, max(1, lanes // len(groups))) for g in groups])
        x, y = np.ascontiguousarray(data[:, pick]), label[pick]
        # some windows start later and end earlier than their text
        end = np.where(rng.random(len(pick)) < SHORT, rng.integers(LEAST_BYTES, WINDOW, len(pick), endpoint=True), WINDOW)
        start = np.where(end < sizes[pick], rng.integers(0, np.maximum(sizes[pick] - end, 0), endpoint=True), 0)
        grads = _gradients(net, x, y, (at >= start) & (at < np.minimum(start + end, sizes[pick])))
        now = rate * min(1.0, 2.0 * (1 - step / (rounds + 1)))
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads))
        scale = min(1.0, 1.0 / max(norm, 1e-9))
        for p, g, m, v in zip(params, grads, mean, var, strict=True):
            g = g * scale
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def _gradients(net: Network, x: np.ndarray, y: np.ndarray, valid: np.ndarray | None = None) -> list[np.ndarray]:
    """Gradients of the mean cross entropy over all valid positions, in the order of the parameters."""
    size, n = x.shape
    half = net.inner[0].shape[1]
    (hf, kf), (hb, kb) = net.states(x, 0, True, valid), net.states(x, 1, True, valid)
    logits = np.matmul(net.out[:, :half], hf) + np.matmul(net.out[:, half:], hb) + net.bias
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    p[:, y, np.arange(n)] -= 1
    if valid is not None:
        p *= valid[:, None, :]
    p /= size * n if valid is None else valid.sum()
    g_out = np.concatenate([np.einsum("tln,thn->lh", p, h, optimize=True) for h in (hf, hb)], axis=1)
    g_bias = p.sum(axis=(0, 2))[:, None]
    tables, inners = [], []
    for direction, kept in enumerate((kf, kb)):
        inner = net.inner[direction]
        cand = inner[2 * half :]
        gates = inner[: 2 * half]
        g_inner, g_table = np.zeros_like(inner), np.zeros((3 * half, 256), np.float32)
        back = np.zeros((half, n), np.float32)
        w = net.out[:, direction * half : (direction + 1) * half].T
        stack = np.empty((3 * half, n), np.float32)
        seen_x, seen_g = [], []
        for t, z, c, h, rh in reversed(kept):
            d = back + w @ p[t]
            if valid is not None:
                d *= valid[t]
            r, u = z[:half], z[half:]
            stack[2 * half :] = d * (1 - u) * (1 - c * c)
            d_rh = cand.T @ stack[2 * half :]
            stack[:half] = d_rh * h * r * (1 - r)
            stack[half : 2 * half] = d * (h - c) * u * (1 - u)
            g_inner[: 2 * half] += stack[: 2 * half] @ h.T
            g_inner[2 * half :] += stack[2 * half :] @ rh.T
            back = d * u + d_rh * r + gates.T @ stack[: 2 * half]
            seen_x.append(x[t])
            seen_g.append(stack.copy())
        flat, grads = np.concatenate(seen_x), np.concatenate(seen_g, axis=1)
        for k in range(3 * half):
            g_table[k] = np.bincount(flat, grads[k], minlength=256)
        tables.append(g_table)
        inners.append(g_inner)
    return [*tables, *inners, g_out.astype(np.float32), g_bias.astype(np.float32)]


def fit(docs: DataFrame, documents: int = DOCUMENTS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network:
    """Train on a bounded sample (smallest hashes of distinct ids) of rows that are not held out and have a language.

    Of each sampled text, evenly spaced windows come to the driver; of the rows of one id, one does.
    """
    span = WINDOW * WINDOWS
    usable = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & (fold(id_col, HELD_OUT_FOLDS) != HELD_OUT))
    ids = F.broadcast(usable.select(F.col(id_col).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(documents))  # bounded by the limit
    read = usable.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).join(ids, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text"):
            picked = []
            for t in texts(part, "text"):
                whole = len(t) // WINDOW
                if whole > WINDOWS:
                    t = b"".join(t[k * WINDOW : (k + 1) * WINDOW] for k in np.linspace(0, whole - 1, WINDOWS).astype(int))
                picked.append(t[:span])
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("lang"), pa.array(picked, pa.binary())], names=["id", "lang", "bytes"])

    kind = read.schema["id"].dataType.simpleString()
    found = to_arrow(read.select("id", "lang", "text"), run, f"id {kind}, lang string, bytes binary")
    one = found.groupBy("id").agg(F.min(F.struct("lang", "bytes")).alias("x")).select("id", "x.lang", "x.bytes")
    got = one.toArrow().sort_by("id")
    return train(got["bytes"].to_pylist(), got["lang"].to_pylist())


def predict(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per input row; see :func:`language`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text", 1 << 20):
            docs_ = texts(part, "text")
            p = net.documents(docs_)
            lettered = [LETTER.search(d.decode()) is not None for d in docs_]
            best = p.argmax(axis=1) if p.shape[1] else np.zeros(len(docs_), int)
            names = [net.languages[b] if ok and net.languages else UNDETERMINED for b, ok in zip(best.tolist(), lettered, strict=True)]
            scores = [float(min(1.0, p[i, b])) if n != UNDETERMINED else 0.0 for i, (b, n) in enumerate(zip(best.tolist(), names, strict=True))]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    read = docs.select(F.col(id_col).alias("id"), (fold(id_col, HELD_OUT_FOLDS) == HELD_OUT).alias("held_out"), F.col(text_col).alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    return to_arrow(read, run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def language(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1): one row per input row.

    A null text, or one without a letter, is ``und`` with score 0; so is everything
    if no row has a language to learn from. Rows whose crc32(doc_id) mod 3 is 1 are
    held out of training. Ties go to the first language by name. Repeated rows are
    judged alike, and of the rows of one id at most one is learnt from; other columns are not looked at; an empty table gives an empty result.
    """
    return predict(docs, fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col), id_col, text_col)
