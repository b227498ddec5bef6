"""Language-model scoring by prediction by partial matching over bytes, pretrained on a corpus.

The trie holds every context of up to ``ORDER`` bytes seen in training with the counts
of the symbols that followed. A symbol is coded in its longest seen context, or by an
escape (method C: as many escapes as distinct symbols) to the next shorter one. After
an escape the symbols of the longer context are excluded from the shorter one. All
symbols seen after a context are also seen after its suffixes, so the excluded counts
depend on the longer context alone and are stored with it. A text's code length is
thus a sum of table look-ups, done for all positions of a batch at once.

The trie grows with the corpus, so it is cut into parts of a bounded size by the last two
bytes of the context, which all contexts of a position share; counts of contexts of one
byte or none are few and go with every part. A worker holds one part at a time and adds up
what each gives for the positions that are its own.

A base model of words, with add-0.1 smoothing, stands beside it. Its vocabulary grows
too: the commonest words, a bounded number, are known to every worker, and what a text
has of all others goes to the word's task and comes back to the text as a sum.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrove.llm.common import fold, kept, steps, texts, to_arrow
from sparkgrove.storage import Scratch

#: Bytes of context, two or more. The trie has a leaf for each distinct sequence of ORDER + 1 bytes.
ORDER = 5
#: Leaves of a part of the trie; parts are made of whole groups of contexts that end in the same two bytes.
LEAVES = 1 << 21
#: Symbols that no UTF-8 text holds: before a text and at its end.
BEFORE, END = 0xFE, 0xFF
#: Values of a byte in UTF-8, and the end.
ALPHABET = 255
HELD_OUT_FOLDS, HELD_OUT = 10, 0
SMOOTH = 0.1
#: Bytes of text that meet the parts of a cut trie one after another.
CHUNK = 16 << 20
#: Commonest words that every worker knows, their length and their bytes together; distinct words that a worker counts before it hands them on.
HOT_WORDS, HOT_LENGTH, HOT_BYTES, COUNTED_WORDS = 200_000, 4096, 32 << 20, 100_000
#: Frequency classes to each doubling of a word's count.
GRADES = 16
#: Bytes of text whose positions are held as numbers at a time.
PART = 1 << 18


def symbols(docs: list[bytes], order: int = ORDER) -> np.ndarray:
    """Texts one after another, each with ``order`` marks before it and an end."""
    mark = bytes([BEFORE]) * order
    end = bytes([END])
    return np.frombuffer(b"".join([x for d in docs for x in (mark, d, end)]), np.uint8)


def sequences(data: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` bytes that end at each position as one number; the first ones are partial."""
    out = np.zeros(len(data), np.uint64)
    wide = data.astype(np.uint64)
    for k in range(length):
        out[k:] |= wide[: len(data) - k] << np.uint64(8 * k)
    return out


def counted(docs: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sequences of context and symbol with their counts."""
    data = symbols(docs, order)
    keys = sequences(data, order + 1)[data != BEFORE]
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def parts(docs: list[bytes], most: int = PART) -> Iterator[list[bytes]]:
    """The texts in order, in lists of at most ``most`` bytes or one text."""
    now: list[bytes] = []
    held = 0
    for d in docs:
        if now and held + len(d) > most:
            yield now
            now, held = [], 0
        now.append(d)
        held += len(d)
    if now:
        yield now


def counted_block(docs: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """:func:`counted` of many texts, part by part."""
    found = [counted(p, order) for p in parts(docs)]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, inverse = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([n for _, n in found]), minlength=len(keys)).astype(np.int64)


class Lookup:
    """Places of numbers in an array of distinct ones, by open addressing."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, (len(keys) * 3 // 2).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.append(keys, np.uint64(0))
        waiting, at = np.arange(len(keys), dtype=np.int32), self._hash(keys)
        while len(waiting):
            free = self.slots[at] < 0
            place, first = np.unique(at[free], return_index=True)
            chosen = waiting[free][first]
            self.slots[place] = chosen
            rest = self.slots[at] != waiting
            waiting, at = waiting[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where it is not there."""
        at = self._hash(keys)
        out = self.slots[at]
        open_ = np.flatnonzero((self.keys[out] != keys) & (out >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            now = out[open_] = self.slots[at[open_]]
            open_ = open_[(self.keys[now] != keys[open_]) & (now >= 0)]
        return out


class Trie:
    """Contexts of 0 to ``order`` bytes, from the counts of the longest sequences.

    ``low``: keys and counts of all two-byte sequences, where ``keys`` are those of one part.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int = ORDER, low: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.order = order
        order_ = np.argsort(keys)
        keys, counts = keys[order_], counts[order_].astype(np.float64)
        levels = []
        for k in range(order, -1, -1):
            levels.append((keys, counts))
            if k:
                short = keys & np.uint64((1 << 8 * k) - 1)
                keys, inverse = np.unique(short, return_inverse=True)
                counts = np.bincount(inverse, counts, minlength=len(keys)) if len(keys) else counts
            if k == 2 and low is not None:
                keys, counts = low[0], low[1].astype(np.float64)
        levels.reverse()  # by length of context
        self.grams, self.contexts, self.count, self.n, self.d, self.excluded = [], [], [], [], [], []
        for k, (keys, counts) in enumerate(levels):
            context = keys >> np.uint64(8)
            first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(keys) else np.zeros(0, np.int64)
            self.grams.append(Lookup(keys))
            self.contexts.append(Lookup(context[first]))
            self.count.append(counts)
            self.n.append(np.add.reduceat(counts, first) if len(first) else np.zeros(0))
            self.d.append(np.diff(np.append(first, len(keys))).astype(np.float64))
            if k and len(first):
                shorter, values = levels[k - 1]
                self.excluded.append(np.add.reduceat(values[np.searchsorted(shorter, keys & np.uint64((1 << 8 * k) - 1))], first))
            else:
                self.excluded.append(np.zeros(len(first)))
        top = levels[order][0] >> np.uint64(8)
        at = self.contexts[order].find(top)
        self.first = np.log10(levels[order][1] / (self.n[order][at] + self.d[order][at])) if len(top) else np.zeros(0)

    def log10(self, data: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each symbol after the bytes before it; 0 at marks, and where the last two bytes are not the trie's ``own``."""
        out = np.zeros(len(data))
        wanted = np.flatnonzero(data != BEFORE if own is None else (data != BEFORE) & own[sequences(data, 3) >> np.uint64(8)])
        keys = sequences(data, self.order + 1)[wanted]
        at = self.grams[self.order].find(keys)
        hit = at >= 0
        out[wanted[hit]] = self.first[at[hit]]
        rest, keys = wanted[~hit], keys[~hit]
        gone_n, gone_d = np.zeros(len(rest)), np.zeros(len(rest))
        for k in range(self.order, -1, -1):
            if not len(rest):
                return out
            gram = keys & np.uint64((1 << 8 * (k + 1)) - 1)
            where = self.contexts[k].find(gram >> np.uint64(8))
            seen = where >= 0
            w = np.maximum(where, 0)
            if not len(self.n[k]):
                continue
            n, d = self.n[k][w] - gone_n, self.d[k][w] - gone_d
            usable = seen & (d > 0)  # else nothing is left in this context after the exclusions
            got = self.grams[k].find(gram)
            found = usable & (got >= 0)
            total = np.where(usable, n + d, 1.0)
            out[rest[found]] += np.log10(self.count[k][got[found]] / total[found])
            escape = usable & ~found
            out[rest[escape]] += np.log10(d[escape] / total[escape])
            gone_n, gone_d = np.where(seen, self.excluded[k][w], 0.0), np.where(seen, self.d[k][w], 0.0)
            rest, keys, gone_n, gone_d = rest[~found], keys[~found], gone_n[~found], gone_d[~found]
        known = self.d[0].sum() if len(self.d[0]) else 0.0
        out[rest] -= np.log10(max(ALPHABET - known, 1.0))
        return out

    def score(self, docs: list[bytes], own: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each whole text with its end, over the trie's own positions."""
        return np.concatenate([np.zeros(0), *[self._score(p, own) for p in parts(docs)]])

    def _score(self, docs: list[bytes], own: np.ndarray | None) -> np.ndarray:
        sizes = np.array([len(d) + self.order + 1 for d in docs])
        return np.add.reduceat(self.log10(symbols(docs, self.order), own), np.cumsum(sizes) - sizes)


def cut_trie(leaves: np.ndarray, most: int) -> np.ndarray:
    """The part of each pair of last context bytes, from its number of leaves: runs of pairs of at most ``most`` leaves, or one pair."""
    part, held, number = np.zeros(len(leaves), np.int32), 0, 0
    for pair, n in enumerate(leaves.tolist()):
        if held and held + n > most:
            number, held = number + 1, 0
        part[pair] = number
        held += n
    return part


def _read(path: str, *columns: str) -> pa.Table:
    """A table of the shared folder, in a worker."""
    files, root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return ds.dataset(root, filesystem=files, format="parquet").to_table(columns=list(columns))


def _hold(kind: str, path: str, build: Callable[[], object]):
    """A worker's one object of a kind, built again when another path is asked for."""
    held = kept("ppm")
    if kind not in held or held[kind][0] != path:
        held.pop(kind, None)
        held[kind] = (path, build())
    return held[kind][1]


def _words_of(texts_: Iterator[list[bytes]]) -> Iterator[pa.RecordBatch]:
    """(word, n) of texts, counted for as long as the distinct words are few enough."""
    counts: Counter[bytes] = Counter()
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
    for docs in texts_:
        for d in docs:
            counts.update(d.split())
            if len(counts) > COUNTED_WORDS:
                yield flush()
                counts.clear()
    yield flush()


def score_texts(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_leaves: int = LEAVES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte: one row per input row.

    A null text is empty, that is, its one token is the end. A-Z are lower-cased for both
    models. Rows whose crc32(doc_id) mod 10 is 0 are held out of training; all others
    are counted whole. ``bits_per_byte`` is the model's code length over the bytes and the
    end. Repeated rows count and are scored as often as they come; other columns are not
    looked at. An empty table gives an empty result; if all rows are held out, symbols
    are taken as equally likely. Words are told apart by their bytes, however long. A trie
    of more than ``most_leaves`` leaves is met part by part.
    """
    scratch = Scratch(spark, "ppm")
    read = docs.select(F.col(id_col).alias("id"), (fold(id_col, HELD_OUT_FOLDS) == HELD_OUT).alias("held_out"), F.col(text_col).alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    trained = read.where("not held_out").select("text")

    def lowered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[bytes]]:
        for part in steps(batches, "text", most):
            yield [t.lower() for t in texts(part, "text")]

    # the trie's leaves, and the counts of its shortest contexts
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for low in lowered(batches, 4 << 20):
            keys, n = counted_block(low)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    leaves = scratch.table(to_arrow(trained, count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")), "leaves")
    by_pair = leaves.groupBy(F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF)).cast("int").alias("pair")).agg(F.count("*").alias("n")).collect()  # 65,536 rows at most
    sizes = np.zeros(1 << 16, np.int64)
    sizes[[r["pair"] for r in by_pair]] = [r["n"] for r in by_pair]
    part_of = cut_trie(sizes, most_leaves)
    n_parts = int(part_of[-1]) + 1
    first_pairs = F.array(*[F.lit(int(x)) for x in np.searchsorted(part_of, np.arange(1, n_parts))]).cast("array<int>")
    in_part = F.size(F.filter(first_pairs, lambda x: x <= F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF))))
    scratch.table(leaves.withColumn("part", in_part).select("key", "n", "part"), "trie", partition="part")
    low = leaves.groupBy(F.col("key").bitwiseAND(F.lit(0xFFFF)).alias("key")).agg(F.sum("n").alias("n")).orderBy("key").toArrow()  # 65,536 rows at most
    low_keys, low_counts = low["key"].to_numpy().astype(np.uint64), low["n"].to_numpy()
    root = scratch.root

    def trie(k: int) -> Trie:
        def build() -> Trie:
            got = _read(f"{root}/trie/part={k}", "key", "n")
            return Trie(got["key"].to_numpy().view(np.uint64), got["n"].to_numpy(), low=(low_keys, low_counts))

        return _hold("trie", f"{root}/{k}", build)

    # the base model: counts of all words, the commonest of them for every worker
    counts = scratch.table(to_arrow(trained, lambda batches: _words_of(lowered(batches, 1 << 20)), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    ends = trained.count()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = total["n"] + ends, total["v"] + (ends > 0)
    # all words of a frequency class or none are common: the classes from the highest down that fit the bounds
    size, grade = F.octet_length("word"), F.floor(F.log2("n") * GRADES).cast("int")
    fits = counts.where(size <= HOT_LENGTH)
    grades = fits.groupBy(grade.alias("g")).agg(F.count("*").alias("words"), F.sum(size).alias("bytes")).orderBy(F.desc("g")).collect()  # GRADES a power of two
    words = bytes_ = 0
    least = 1 << 30
    for r in grades:
        words, bytes_ = words + r["words"], bytes_ + r["bytes"]
        if words > HOT_WORDS or bytes_ > HOT_BYTES:
            break
        least = r["g"]
    scratch.table(fits.where(grade >= least).select("word", "n"), "common")

    def log(n: float) -> float:
        return float(np.log10((n + SMOOTH) / (tokens + SMOOTH * (distinct + 1))))

    def known() -> dict[bytes, float]:
        got = _read(f"{root}/common", "word", "n")
        logs = np.log10((got["n"].to_numpy() + SMOOTH) / (tokens + SMOOTH * (distinct + 1)))
        return dict(zip(got["word"].to_pylist(), logs.tolist(), strict=True))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, end = _hold("words", root, known), log(ends)
        for part in steps(batches, "text", (1 << 20) if n_parts == 1 else CHUNK, "ppm"):
            docs_ = [t.lower() for t in texts(part, "text")]
            scores = sum(trie(k).score(docs_, None if n_parts == 1 else part_of == k) for k in range(n_parts))
            rows, rare, times = [], [], []
            for d in docs_:
                words = Counter(d.split())
                others = [w for w in words if w not in hot]
                base = sum(hot[w] * n for w, n in words.items() if w in hot)
                n_words = words.total()
                rows.append((n_words + 1, n_words - sum(words[w] for w in others) + (ends > 0), base + end))
                rare.append(others)
                times.append([words[w] for w in others])
            columns = [
                part.column("id"), part.column("held_out"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64()),
                pa.array(scores, pa.float64()), pa.array(-scores / np.log10(2) / np.array([len(d) + 1 for d in docs_]), pa.float64()), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "held_out", "n_tokens", "hot_known", "hot_score", "score", "bits_per_byte", "rare", "times"])

    packed = to_arrow(read, score, f"id {kind}, held_out boolean, n_tokens bigint, hot_known bigint, hot_score double, score double, bits_per_byte double, rare array<binary>, times array<bigint>")
    rows = scratch.table(packed.withColumn("row", F.monotonically_increasing_id()), "rows")
    asked = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    met = asked.join(counts, "word", "left").select("row", "times", F.coalesce("n", F.lit(0)).alias("n"))
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("known"), F.sum(F.col("times") * F.log10((F.col("n") + SMOOTH) / (tokens + SMOOTH * (distinct + 1)))).alias("base"))
    sums = scratch.table(sums, "sums")
    return rows.join(sums, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("hot_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("hot_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"), "score", "bits_per_byte",
    )
