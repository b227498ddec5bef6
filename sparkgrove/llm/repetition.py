"""Quality rules on repetition, by suffix arrays over words.

All texts of a step form one array of word numbers; numbers differ between texts, so
nothing repeats across them. Prefix doubling sorts the suffixes, re-sorting only those
not yet told apart, and keeps the ranks of each doubling. Longest common prefixes of
neighbours come from these ranks by binary descent. Intervals of suffixes with a longer
common prefix than their surroundings, whose occurrences have different words before
them, are the maximal repeated substrings. The rules limit the fraction of a text that
their spans cover together, and the longest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrove.llm.common import steps, texts, to_arrow

SYMBOLS = b"#*$%&|<>"
#: Repeats of fewer words are ordinary prose.
LEAST_REPEAT = 5
#: Limits: the covered fraction of the characters in words, and the longest repeat in words. Of 10,000 documents
#: (sf0.1) 8,884 pass the base rule; of those none repeats more than 20 words, and the two covered above 0.3 are
#: one labelled as bad and one without a label, while above 0.25 two are labelled as good.
MOST_COVERED, LONGEST = 0.3, 50
LEAST_WORDS, REPEAT_WINDOW, MOST_REPEATED = 50, 3, 50


def suffix_ranks(ids: np.ndarray) -> list[np.ndarray]:
    """Ranks of prefixes of 1, 2, 4, ... words of each suffix; the last ones are all different.

    ``ids`` are word numbers from 0 on. A rank is the place of the first suffix of its
    group in sorted order, so ranks of a later doubling refine those of an earlier one.
    """
    n = len(ids)
    counts = np.bincount(ids)
    rank = (np.cumsum(counts) - counts)[ids]
    levels = [rank.astype(np.int32)]
    active = np.flatnonzero(counts[ids] > 1)
    h = 1
    while len(active):
        ahead = active + h
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[active] * (n + 1) + second
        order = np.argsort(key)
        active, key = active[order], key[order]
        new = np.empty(len(key), bool)
        new[0] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        group = np.empty(len(key), bool)
        group[0] = True
        old = rank[active]
        np.not_equal(old[1:], old[:-1], out=group[1:])
        at = np.arange(len(key))
        first = np.maximum.accumulate(np.where(group, at, 0))
        start = np.maximum.accumulate(np.where(new, at, 0))
        rank[active] = old + (start - first)
        levels.append(rank.astype(np.int32))
        alone = new & np.append(new[1:], True)
        active = active[~alone]
        h *= 2
    return levels


def neighbours(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and the longest common prefix of each suffix with the next one in it."""
    n = len(ids)
    order, common = np.zeros(n, np.int64), np.zeros(max(n - 1, 0), np.int64)
    if n < 2:
        return order, common
    levels = suffix_ranks(ids)
    order[levels[-1]] = np.arange(n)
    same = np.flatnonzero(levels[0][order[:-1]] == levels[0][order[1:]])
    i, j = order[same], order[same + 1]
    for k in range(len(levels) - 1, -1, -1):
        equal = (i < n) & (j < n)
        equal[equal] = levels[k][i[equal]] == levels[k][j[equal]]
        common[same] += equal.astype(np.int64) << k
        i += equal.astype(np.int64) << k
        j += equal.astype(np.int64) << k
    return order, common


def longest_repeats(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each position the length of the longest substring from it that occurs elsewhere too."""
    longest = np.zeros(len(order), np.int64)
    np.maximum.at(longest, order[:-1], common)
    np.maximum.at(longest, order[1:], common)
    return longest


_VARIED = -1


def maximal_repeats(order: np.ndarray, common: np.ndarray, before: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(length of the longest maximal repeat from each position, a place of each maximal repeat).

    A repeat is maximal if its occurrences neither all have the same word before them nor all
    the same after them. The latter holds for every interval of suffixes that share a prefix
    longer than what they share with the suffixes around it; the former is seen from ``before``,
    the number of the word before each position, where no word is a negative number of its own.
    Intervals close innermost first, and a suffix takes the length of its first maximal one.
    """
    reach, places = np.zeros(len(order), np.int64), []
    at = np.flatnonzero(common >= least)
    if not len(at):
        return reach, np.zeros(0, np.int64)
    for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
        suffixes = order[run[0] : run[-1] + 2]
        lefts = before[suffixes].tolist()
        suffixes = suffixes.tolist()
        open_: list[list] = []  # prefix length, word before or _VARIED, suffixes without a maximal repeat yet
        for suffix, left, length in zip(suffixes, lefts, [*common[run].tolist(), 0], strict=True):
            waiting = [suffix]
            while open_ and open_[-1][0] > length:
                closed, other, more = open_.pop()
                left = left if left == other else _VARIED
                if len(more) > len(waiting):
                    waiting, more = more, waiting
                waiting += more
                if left == _VARIED:
                    places.append(suffix)
                    reach[waiting] = closed
                    waiting = []
            if open_ and open_[-1][0] == length:
                top = open_[-1]
                top[1] = left if left == top[1] else _VARIED
                if len(waiting) > len(top[2]):
                    waiting, top[2] = top[2], waiting
                top[2] += waiting
            elif length:
                open_.append([length, left, waiting])
    return reach, np.array(places, np.int64)


def _covered(longest: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions that lie within ``length[p]`` words from some position p with a length."""
    n = len(longest)
    p = np.flatnonzero(length)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, p, 1)
    np.add.at(edge, np.minimum(p + length[p], n), -1)
    return np.cumsum(edge[:-1]) > 0


def measure(docs: list[bytes], least: int = LEAST_REPEAT) -> dict[str, np.ndarray]:
    """All counts of the rules, an array each, one entry a text."""
    m = len(docs)
    n_words, word_chars, n_symbols, n_dup = (np.zeros(m, np.int64) for _ in range(4))
    ids: list[int] = []
    base = 0
    sizes: list[int] = []
    for i, d in enumerate(docs):
        words = d.split()
        n_words[i] = len(words)
        held = list(map(len, words))
        sizes += held
        word_chars[i] = len(d.decode()) - (len(d) - sum(held))
        n_symbols[i] = len(d) - len(d.translate(None, SYMBOLS))
        lines = [x for x in d.split(b"\n") if x.strip()]
        n_dup[i] = len(lines) - len(set(lines))
        number: dict[bytes, int] = {}
        put = number.setdefault
        ids += [put(w, base + len(number)) for w in words]
        base += len(number)
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup}
    full = np.flatnonzero(n_words)
    starts = np.concatenate(([0], np.cumsum(n_words[full])[:-1])).astype(np.int64)
    numbers = np.array(ids, np.int64)
    before = np.concatenate(([0], numbers[:-1])) if len(numbers) else numbers
    before[starts[: len(full)]] = -2 - starts[: len(full)]
    order, common = neighbours(numbers)
    longest = longest_repeats(order, common)
    size = np.array(sizes, np.int64)
    windows = np.where(longest >= REPEAT_WINDOW, REPEAT_WINDOW, 0)
    long, places = maximal_repeats(order, common, before, least)
    spans = _covered(longest, long)

    def per_text(values: np.ndarray, how: np.ufunc = np.add) -> np.ndarray:
        total = np.zeros(m, np.int64)
        if len(full):
            total[full] = how.reduceat(values.astype(np.int64), starts)
        return total

    out["n_repeat_words"] = per_text(_covered(longest, windows))
    out["n_maximal"] = per_text(np.bincount(places, minlength=len(numbers)))
    out["longest_repeat"] = per_text(long, np.maximum)
    total = per_text(size)
    out["covered"] = np.where(total > 0, per_text(size * spans) / np.maximum(total, 1), 0.0)
    out["base_failed"] = (n_words < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED * n_words)
    out["kept"] = ~out["base_failed"] & (out["covered"] <= MOST_COVERED) & (out["longest_repeat"] <= LONGEST)
    return out


_COLUMNS = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "n_maximal": "bigint", "longest_repeat": "bigint", "covered": "double", "base_failed": "boolean", "kept": "boolean"}


def quality(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts of :func:`measure`, base_failed and kept: one row per input row.

    A null or empty text has no words and fails the base rule. ``covered`` is by bytes
    of the words. Repeated rows are judged alike, each text by itself; other columns are
    not looked at; an empty table gives an empty result. A long text is one unit of
    work, whose memory is a multiple of its number of words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text", 1 << 20):
            got = measure(texts(part, "text"))
            yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(got[c]) for c in _COLUMNS]], names=["id", *_COLUMNS])

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    return to_arrow(read, run, f"id {kind}, " + ", ".join(f"{c} {t}" for c, t in _COLUMNS.items())).withColumnRenamed("id", id_col)
