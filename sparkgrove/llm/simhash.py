"""SimHash near-duplicates with a covering family of bit masks.

Every bit position of a fingerprint gets a vector of r + 1 bits. Each of the
2^(r+1) - 1 non-zero vectors w of that length is a table; its mask keeps the
positions whose vector has an odd product with w. Up to r differing positions span
at most r dimensions, so some w is orthogonal to all of them: that table's mask
hides every difference, and the pair shares its bucket. No pair is missed.

Within the buckets no pair is listed. For r = 2 a fingerprint sends itself and its
one-bit variants (only over bits its table hides) to centres; two fingerprints are
within two bits exactly when they share a centre, and a centre has at most 65
members. Rows thus grow in proportion to fingerprints, however full a bucket is.

A Jaccard similarity of 0.8 lets fingerprints differ in some ten bits, for which masks
would need over a thousand tables. The near-dedup by similarity therefore starts from
the covered pairs and finds the others by prefixes of the shingle sets, which miss none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkgrove.llm.common import steps, texts, to_arrow
from sparkgrove.storage import Scratch, small
from sparkgrove.operators.components import components

BITS, RADIUS, SEED = 64, 2, 42


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The covering masks, as unsigned numbers; position i has the vector 1 + i mod (2^(r+1) - 1)."""
    top = 1 << (radius + 1)
    vector = [1 + i % (top - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & w).bit_count() & 1) for w in range(1, top)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _ones(bits: np.ndarray) -> np.ndarray:
    """Sums of the columns of a matrix of zeros and ones; sums of up to 255 rows fit a byte."""
    total = np.zeros(bits.shape[1], np.int64)
    for k in range(0, len(bits), 255):
        total += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return total


def majority(raw: np.ndarray) -> int:
    """The bits that are set in over half the rows of (n x 8 bytes), as an unsigned number; zero without rows."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(raw), 1 << 14):
        ones += _ones(np.unpackbits(raw[k : k + (1 << 14)], axis=1))
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big")


def fingerprints(docs: list[bytes], width: int = 3, seed: int = SEED) -> np.ndarray:
    """One unsigned 64-bit SimHash a text, over its shingles of ``width`` words, repeats included."""
    digest, join = partial(xxhash.xxh64_digest, seed=seed), b" ".join
    hashes, counts = [], np.zeros(len(docs), np.int64)
    for i, text in enumerate(docs):
        words = text.lower().split()  # of bytes: A-Z only, and white space is \x20 \x09-\x0D
        if not words:
            continue
        shingles = map(join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else [join(words)]
        before = len(hashes)
        hashes.extend(map(digest, shingles))
        counts[i] = len(hashes) - before
    raw = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8)
    ends = np.cumsum(counts).tolist()
    return np.array([majority(raw[end - n : end]) for end, n in zip(ends, counts.tolist(), strict=True)], np.uint64)


def fingerprint_table(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): Arrow batches in, one signed 64-bit number a row out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text"):
            fp = fingerprints(texts(part, "text"), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fp)], names=["id", "fp"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return to_arrow(chosen, run, f"id {chosen.schema['id'].dataType.simpleString()}, fp bigint")


def links(spark: SparkSession, scratch: Scratch, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Star links (a, b) between distinct fingerprints; they join exactly those within ``radius`` bits."""
    if radius not in (1, 2):
        raise ValueError("the centres are exact for a radius of 1 or 2")
    family = masks(radius)
    distinct = scratch.table(prints.select("fp").distinct(), "distinct")
    table = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(signed(m)).alias("mask")) for t, m in enumerate(family)]))
    placed = distinct.select("fp", table.alias("m")).select("fp", F.col("m.t").alias("t"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("key"))
    shared = scratch.table(placed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key"), "shared")
    candidates = placed.join(small(shared), ["t", "key"]).select("fp", "t")
    # the bits each table hides, as one-bit numbers with 0 for the fingerprint itself
    hidden = F.array(*[F.array(*[F.lit(signed(x)).cast("bigint") for x in [0] + [1 << i for i in range(BITS) if not m >> i & 1]]) for m in family])
    centres = candidates.select("fp", F.explode(F.element_at(hidden, F.col("t") + 1)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre")).distinct()
    grouped = centres.groupBy("centre").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("members")).where(F.size("members") > 1)
    if radius == 1:  # members of a centre may be two bits apart
        grouped = grouped.select(F.col("centre").alias("a"), "members").where(F.array_contains("members", F.col("a")))
    return grouped.select("a", F.explode("members").alias("b")).where("a <> b").distinct()


def simhash_components(spark: SparkSession, docs: DataFrame, width: int = 3, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable).

    A null or word-less text has the fingerprint zero and links like any other. Rows
    that repeat an id or text keep their own output row. Null ids get a component but
    name none, unless a component has no other id. Ids may be of any type that has an
    order. Empty tables give empty results; other columns are not looked at.
    """
    scratch = Scratch(spark, "simhash")
    prints = scratch.table(fingerprint_table(docs, width, id_col, text_col), "prints")
    found = links(spark, scratch, prints, radius)
    roots = components(spark, found)
    first = prints.groupBy("fp").agg(F.min("id").alias("first"))
    rooted = scratch.table(first.join(small(roots), F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"), "rooted")
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    # a fingerprint that links to no other is its own component and needs no second join
    classes = scratch.table(rooted.join(small(named.where("n > 1")), "root", "left").select("fp", F.when(F.col("n").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id")), "classes")
    return prints.join(classes, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near-duplicates share this Jaccard similarity of five-word shingles, or more: a whole fraction, so that its bounds are exact.
WIDTH, SIMILARITY = 5, Fraction(4, 5)
#: Texts sampled for the order of shingles, the texts of the sample that make a shingle common, and the common ones that are told apart.
SAMPLED_TEXTS, COMMON_TEXTS, MOST_COMMON = 20_000, 3, 200_000
#: Texts under one shingle that one task compares a text with.
BLOCK_TEXTS = 4_000


def shingle_hashes(text: bytes) -> bytes:
    """64-bit hashes of the shingles of ``WIDTH`` words in order, repeats included; a shorter text is one shingle."""
    digest, join = partial(xxhash.xxh64_digest, seed=SEED), b" ".join
    words = text.lower().split()
    shingles = map(join, zip(*(words[k:] for k in range(WIDTH)), strict=False)) if len(words) >= WIDTH else [join(words)] if words else []
    return b"".join(map(digest, shingles))


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(np.frombuffer(shingle_hashes(text), np.int64))


def set_digest(shingles: np.ndarray) -> bytes | None:
    """Texts of equal sets have equal digests; a word-less text has none."""
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def parities(shingles: np.ndarray) -> np.ndarray:
    """The parity of the number of shingles in each of two to four times as many bins, as signed 64-bit words.

    Where two sets' parities differ, one has a shingle that the other lacks: differing
    bins never outnumber the shingles that are in one set only.
    """
    bins = 1 << max(8, (2 * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles.view(np.uint64) & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def prefix_sizes(n: int) -> tuple[int, int]:
    """Sizes of the prefixes of a set of ``n``: against partners of any size, and against those of its size or more.

    Sets of a and b that are alike have k = s (a + b) / (1 + s) or more in common, so the first
    common shingle in any order has k - 1 of its set behind it. With b of s a or more, k is at
    least s a; with b of a or more, it is at least 2 s a / (1 + s).
    """
    return n - math.ceil(SIMILARITY * n) + 1, n - math.ceil(2 * SIMILARITY * n / (1 + SIMILARITY)) + 1


def prefix(shingles: np.ndarray, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order of all: rare ones by hash, then common ones (sorted, with their ranks)."""
    most = prefix_sizes(len(shingles))[0]
    if not len(common):
        return shingles[:most]
    at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
    known = common[at] == shingles
    rare = shingles[~known][:most]
    return rare if len(rare) == most else np.concatenate((rare, shingles[known][np.argsort(ranks[at[known]])]))[:most]


def _shingle_sets(docs: DataFrame) -> DataFrame:
    """(same, shingles) of every text that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text"):
            sets = [x for t in texts(part, "text") if len(x := shingle_set(t))]
            yield pa.RecordBatch.from_arrays([pa.array(map(set_digest, sets), pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["same", "shingles"])

    return to_arrow(docs.select("text"), run, "same binary, shingles array<bigint>")


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles, sorted, and their ranks from the rarest on, from a sample of texts.

    Only the order of shingles depends on them, no result does.
    """
    share = min(1.0, SAMPLED_TEXTS / max(1, docs.count()))
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    counted = _shingle_sets(sample).select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_TEXTS)
    got = counted.orderBy(F.desc("n"), "s").limit(MOST_COMMON).toArrow()
    found = got.column("s").to_numpy()
    order = np.argsort(found)
    return found[order], (len(found) - order).astype(np.int64)


def _prints(docs: DataFrame, common: np.ndarray, ranks: np.ndarray) -> DataFrame:
    """(id, n, same, fp, parity, keys) of each text that has words: size, digest, SimHash, parities and prefix of its shingles."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text"):
            raw = [np.frombuffer(shingle_hashes(t), np.uint8).reshape(-1, 8) for t in texts(part, "text")]
            sets = [np.unique(x.view(np.int64)) for x in raw]
            worded = pa.array([len(x) > 0 for x in sets], pa.bool_())
            columns = [
                part.column("id"), pa.array(map(len, sets), pa.int32()), pa.array(map(set_digest, sets), pa.binary()), pa.array([signed(majority(x)) for x in raw], pa.int64()),
                pa.array(map(parities, sets), pa.list_(pa.int64())), pa.array([prefix(x, common, ranks) if len(x) else x for x in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "same", "fp", "parity", "keys"]).filter(worded)

    return to_arrow(docs, run, f"id {kind}, n int, same binary, fp bigint, parity array<bigint>, keys array<bigint>")


def _may_be_alike(na: Column, pa_: Column, nb: Column, pb: Column) -> Column:
    """Whether sets of these sizes, first alike at these places of their order, can reach the similarity."""
    num, den = SIMILARITY.numerator, SIMILARITY.denominator
    behind = F.least(na - pa_, nb - pb).cast("bigint")
    return behind * (num + den) >= (na + nb).cast("bigint") * num


def _apart(x: Column, y: Column) -> Column:
    """The number of bins whose parities differ, in the bins of the smaller of the two (half as many at least)."""

    def fitted(a: Column, b: Column) -> Column:
        half = F.size(b)
        return F.when(F.size(a) > half, F.zip_with(F.slice(a, F.lit(1), half), F.slice(a, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(a)

    return F.aggregate(F.zip_with(fitted(x, y), fitted(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, k: s + k)


class _Near:
    """The tables of one search for near-duplicates. Texts of equal sets are one node, numbered by its first row."""

    def __init__(self, spark: SparkSession, docs: DataFrame, id_col: str, text_col: str) -> None:
        self.spark, self.scratch = spark, Scratch(spark, "near")
        self.docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        # rows are numbered as they are written, so that their numbers hold from then on
        self.prints = self.scratch.table(_prints(self.docs, *_common(self.docs)).withColumn("row", F.monotonically_increasing_id()), "prints")
        self.repeated = self.scratch.table(self.prints.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id"), "repeated")
        first = self.prints.groupBy("same").agg(F.min("row").alias("first"), F.count("*").alias("c")).where("c > 1").select("same", "first")
        first = self.scratch.table(first, "first")
        self.twins = self.scratch.table(self.prints.select("row", "same").join(small(first), "same").where("row <> first").select("row", "first"), "twins")
        self.nodes = self.prints.join(small(self.twins.select("row")), "row", "left_anti")

    def alike(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) of nodes whose whole shingle sets reach the similarity."""
        num, den = SIMILARITY.numerator, SIMILARITY.denominator
        pairs = self.scratch.table(pairs.distinct(), f"{name}_pairs")
        facts = self.prints.select("row", "n", "parity")
        seen = pairs.join(facts.toDF("a", "na", "pa"), "a").join(facts.toDF("b", "nb", "pb"), "b")
        total = (F.col("na") + F.col("nb")).cast("bigint")
        # sets with k shingles in one of them only have (na + nb - k) / 2 in common
        close = self.scratch.table(seen.where((total - _apart(F.col("pa"), F.col("pb"))) * (num + den) >= 2 * num * total).select("a", "b"), f"{name}_close")
        self.scratch.drop(f"{name}_pairs")
        wanted = close.select(F.col("a").alias("row")).union(close.select("b")).distinct()
        wanted = self.scratch.table(self.prints.select("row", "id", "same").join(small(self.scratch.table(wanted, f"{name}_rows")), "row"), f"{name}_wanted")
        ids = wanted.select(F.col("id").alias("__id")).distinct()
        sets = _shingle_sets(self.docs.join(small(self.scratch.table(ids, f"{name}_ids")), F.col("id").eqNullSafe(F.col("__id")), "left_semi"))
        sets = sets.join(small(wanted.select("row", "same")), "same").select("row", "shingles")
        if not self.repeated.isEmpty():  # else each row is read once
            sets = sets.dropDuplicates(["row"])
        sets = self.scratch.table(sets, f"{name}_sets")
        both = close.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
        found = both.where(F.size(F.array_intersect("sa", "sb")) * (num + den) >= (F.size("sa") + F.size("sb")) * num).select("a", "b")
        found = self.scratch.table(found, f"{name}_alike")
        for part in ("close", "rows", "wanted", "ids", "sets"):
            self.scratch.drop(f"{name}_{part}")
        return found

    def groups(self, name: str, *parts: DataFrame) -> DataFrame:
        """(node, root) of the components of all links (a, b)."""
        every = parts[0]
        for other in parts[1:]:
            every = every.union(other)
        return self.scratch.table(components(self.spark, every), name)

    def apart_yet(self, pairs: DataFrame, groups: DataFrame) -> DataFrame:
        """The pairs (a, b) that no group holds together."""
        a, b = small(groups.toDF("a", "ra")), small(groups.toDF("b", "rb"))
        return pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")

    def by_fingerprint(self) -> DataFrame:
        """Candidates (a, b) whose SimHashes differ in at most ``RADIUS`` bits: stars that join all of them."""
        least = self.nodes.groupBy("fp").agg(F.min("row").alias("a"), F.count("*").alias("c"))
        least = self.scratch.table(least, "least")
        equal = self.nodes.select("fp", F.col("row").alias("b")).join(small(least.where("c > 1").select("fp", "a")), "fp").where("a <> b").select("a", "b")
        near = links(self.spark, self.scratch, least).toDF("fa", "fb")
        near = near.join(least.select(F.col("fp").alias("fa"), "a"), "fa").join(least.select(F.col("fp").alias("fb"), F.col("a").alias("b")), "fb").select("a", "b")
        return equal.union(near)

    def members(self) -> DataFrame:
        """(row, id, same, root) of every row with near-duplicates; root is the number of its group."""
        found = self.alike(self.by_fingerprint(), "fp")
        groups = self.groups("by_fp", found)

        # rows under shingles that two prefixes share; the smaller set of a pair needs the shorter prefix only
        placed = self.nodes.select(F.col("row").alias("id"), "n", F.posexplode("keys").alias("pos", "key"))
        lesser = F.col("pos") < F.col("n") - F.ceil(F.col("n") * F.lit(2 * SIMILARITY.numerator) / F.lit(SIMILARITY.numerator + SIMILARITY.denominator)) + 1
        by_key = Window.partitionBy("key")
        shared = placed.withColumn("lesser", lesser).withColumn("c", F.count("*").over(by_key)).withColumn("l", F.max("lesser").over(by_key)).where("c > 1 and l").select("key", "id", "n", "pos", "lesser", "c")
        shared = self.scratch.table(shared, "shared")

        # first each text with the central one of its shingles
        central = self.scratch.table(shared.groupBy("id").agg(F.sum("c").alias("weight")), "central")
        order = Window.partitionBy("key").orderBy(F.desc("weight"), "id")
        hub = shared.join(small(central), "id").select("key", "id", "n", "pos", F.struct(*[F.first(c).over(order).alias(c) for c in ("id", "n", "pos")]).alias("o"))
        hub = hub.where((F.col("id") != F.col("o.id")) & _may_be_alike(F.col("n"), F.col("pos"), F.col("o.n"), F.col("o.pos")))
        found = self.alike(self.apart_yet(hub.select(F.least("id", "o.id").alias("a"), F.greatest("id", "o.id").alias("b")).distinct(), groups), "hub")
        star = lambda g: g.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
        groups = self.groups("by_hub", star(groups), found)

        # then all others under a shingle, but for those of one group; crowded shingles are met in blocks
        grouped = shared.join(small(groups), F.col("id") == F.col("node"), "left").select("key", "id", "n", "pos", "lesser", F.coalesce("root", "id").alias("root"), F.ceil(F.col("c") / BLOCK_TEXTS).cast("int").alias("blocks"))
        grouped = self.scratch.table(grouped.withColumn("open", F.min("root").over(by_key) < F.max("root").over(by_key)).where("open").drop("open"), "grouped")
        self.scratch.drop("shared")
        one = grouped.where("lesser").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.struct("n", "id", "pos", "root").alias("x"))
        other = grouped.select("key", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.struct("n", "id", "pos", "root").alias("y"))
        ordered = F.struct("x.n", "x.id") < F.struct("y.n", "y.id")
        met = one.join(other, ["key", "block"]).where(ordered & (F.col("x.root") != F.col("y.root")) & _may_be_alike(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos")))
        rest = self.alike(met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")), "rest")
        groups = self.groups("all", star(groups), rest, self.twins.select(F.col("first").alias("a"), F.col("row").alias("b")))
        self.scratch.drop("grouped")
        return self.scratch.table(self.prints.select("row", "id", "same").join(small(groups.select(F.col("node").alias("row"), "root")), "row"), "members")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, root) of every row that has near-duplicates; root is the smallest id of its group.

    Two texts link at a Jaccard similarity of ``SIMILARITY`` or more of their five-word
    shingles; groups are the connected components. First come the pairs that the covering
    masks bring together, SimHashes within ``RADIUS`` bits. That similarity allows far more
    differing bits than masks can cover, so prefixes find the rest: in an order of all
    shingles, common ones last, two such texts share one of their first (see
    :func:`prefix_sizes`), so no pair is missed. Under each shingle every text is first
    compared with the central one (the one with the fullest shingles, as an original among
    its edited copies), then with every other that is not in its group yet and whose size and
    place allow the similarity. Each candidate is weighed by its parities, which rule out most
    that are not alike, and verified on the whole shingle sets. Word-less and null texts have
    no near-duplicates. Ids of any type may be null or repeat; a null counts as the largest.
    An empty table gives an empty result; other columns are not looked at.
    """
    found = _Near(spark, docs, id_col, text_col).members()
    least = found.groupBy("root").agg(F.min("id").alias("least"))
    return found.join(small(least), "root").select("id", F.col("least").alias("root"))


def one_of_each(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` but for near-duplicates of a row with a smaller id; all columns stay.

    Of a group's rows with the smallest id one stays. Groups are those of
    :func:`near_duplicates`, by text: rows that share an id are decided one by one.
    """
    near = _Near(spark, docs, id_col, text_col)
    found = near.members()
    stays = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("s")).select(F.col("s.row").alias("row"))
    gone = near.scratch.table(found.join(small(stays), "row", "left_anti").select("row", F.col("id").alias("__sg_id"), "same"), "gone")
    here = F.col(id_col).eqNullSafe(F.col("__sg_id"))
    if near.repeated.isEmpty():
        return docs.join(small(gone.select("__sg_id")), here, "left_anti")
    repeated = small(near.repeated.withColumnRenamed("id", "__sg_id"))
    sure = docs.join(repeated, here, "left_anti").join(small(gone.select("__sg_id")), here, "left_anti")

    # rows of a repeated id are told apart by their sets; equal ones are of one group, so at most one of them stays
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, text_col):
            same = pa.array([set_digest(shingle_set(t)) for t in texts(part, text_col)], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, same], names=[*part.schema.names, "__sg_same"])

    unsure = docs.join(repeated, here, "left_semi")
    unsure = to_arrow(unsure, run, T.StructType([*unsure.schema.fields, T.StructField("__sg_same", T.BinaryType())]))
    names = [F.col(f"`{c}`") for c in docs.columns]
    kept = near.prints.join(small(near.repeated), near.prints["id"].eqNullSafe(near.repeated["id"]), "left_semi").join(small(gone.select("row")), "row", "left_anti").select(F.col("id").alias("__sg_id"), F.col("same").alias("__sg_kept"))
    alone = unsure.where("__sg_same is not null").groupBy(F.col(id_col).alias("__sg_own"), "__sg_same").agg(F.first(F.struct(*names)).alias("__sg_row"))
    alone = alone.join(small(kept), F.col("__sg_own").eqNullSafe(F.col("__sg_id")) & (F.col("__sg_same") == F.col("__sg_kept")), "left_semi").select("__sg_row.*")
    return sure.unionByName(unsure.where("__sg_same is null").select(*names)).unionByName(alone)
