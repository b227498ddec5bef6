"""Exact dedup through a log-structured merge index, in DataFrame operations only.

Each input partition is a memtable: it holds (digest, id) entries, sorts them and
flushes one sorted run, a Parquet file with a Bloom filter and min/max statistics on the
digest. Compaction goes level by level: every ``FANOUT`` runs are merged into one sorted
run, in which a digest keeps its number of entries and its smallest (or largest)
identifier, until one run is left. Digests with two entries or more are hits. A filter
over them, a bit array of bounded size, is asked first when the texts are read again, so
that hardly any other text goes on to the join, which verifies the hits byte by byte:
two texts that merely share a digest stay apart. Where a digest has a single text its
identifier is the index's. All groupings combine on the map side, so a text with a third
of all rows sends one row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrove.llm.common import ascii_lower
from sparkgrove.storage import Scratch, small

#: Runs that one compaction merges into a run of the next level.
FANOUT = 128
#: Bits of the filter: 16 a hit, within these bounds (8 MB at most). A fuller filter lets more texts through to the join, nothing else.
LEAST_BITS, MOST_BITS = 1 << 13, 1 << 26
_BLOOM = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


def _digest(norm, bits: int):
    full = F.xxhash64(norm)
    return full if bits >= 64 else F.pmod(full, F.lit(1 << bits)).cast("bigint")


def compact(scratch: Scratch, runs: DataFrame, keep: str, fanout: int = FANOUT) -> DataFrame:
    """(run, digest, n, best) of the one run that is left of ``runs`` (run, digest, id), merged level by level."""
    best = F.max if keep == "largest" else F.min
    level, number = runs.select("run", "digest", F.lit(1).cast("bigint").alias("n"), F.col("id").alias("best")), 0
    last = runs.agg(F.max("run").alias("r")).first()["r"] or 0
    while number == 0 or last > 0:
        merged = level.groupBy(F.floor(F.col("run") / fanout).cast("int").alias("run"), "digest").agg(F.sum("n").alias("n"), best("best").alias("best"))
        level = scratch.table(merged.sortWithinPartitions("run", "digest"), f"level{number + 1}", **_BLOOM)
        scratch.drop(f"level{number}")
        last, number = last // fanout, number + 1
    return level


def _place(digest: Column, bits: int) -> Column:
    return digest.bitwiseAND(F.lit(bits - 1))


def digest_filter(spark: SparkSession, digests: DataFrame, bits: int) -> DataFrame:
    """One row (words): a bit array, 64 bits a word, with the bit of each digest set."""
    at = _place(F.col("digest"), bits)
    words = digests.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    every = spark.range(bits // 64).withColumnRenamed("id", "word").join(words, "word", "left").select("word", F.coalesce("bit", F.lit(0).cast("bigint")).alias("bit"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bit"))), lambda x: x["bit"]).alias("words"))  # at most MOST_BITS / 64 words


def may_hold(words: Column, digest: Column, bits: int) -> Column:
    """Whether the filter has the digest's bit: true for all that entered it, and for few others."""
    at = _place(digest, bits)
    return F.call_function("shiftright", F.element_at(words, (F.shiftright(at, 6) + 1).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def lsm_dedup(spark: SparkSession, docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 64, fanout: int = FANOUT) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Null text counts as empty;
    a null id loses against any other. Of rows that repeat both id and text one stays
    (which one is of no consequence), so each group has exactly one row with ``kept``.
    An empty table gives an empty result; other columns are not looked at, whatever
    their names. ``keep``: smallest or largest identifier. ``digest_bits`` under 64
    forces collisions, for tests of the byte verification.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: smallest or largest, not {keep}")
    scratch = Scratch(spark, "lsm")
    norm = docs.select(F.col(id_col).alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    memtables = norm.select("id", _digest(F.col("norm"), digest_bits).alias("digest"), F.unhex(F.sha2("norm", 256)).alias("sha"), F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("run"))
    runs = scratch.table(memtables.sortWithinPartitions("digest", "id"), "runs", **_BLOOM)
    index = compact(scratch, runs, keep, fanout)
    hits = scratch.table(index.where("n > 1").select("digest", F.col("best").alias("indexed")), "hits")

    # byte verification: texts that the filter and then the hits know are split by the text itself
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * hits.count()).bit_length()))
    words = scratch.table(digest_filter(spark, hits, bits), "filter")
    read_again = norm.withColumn("digest", _digest(F.col("norm"), digest_bits)).join(F.broadcast(words), may_hold(F.col("words"), F.col("digest"), bits)).drop("words")  # one row of bounded size
    read_again = read_again.join(small(hits), "digest")
    best = F.max("id") if keep == "largest" else F.min("id")
    verified = scratch.table(
        read_again.groupBy("digest", "norm").agg(F.count("*").alias("n"), best.alias("best"), F.first("indexed").alias("indexed")).select("digest", F.unhex(F.sha2("norm", 256)).alias("sha"), "n", "best", "indexed"),
        "verified",
    )
    several = scratch.table(verified.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1"), "several")
    verified = verified.join(small(several), "digest", "left").select("digest", "sha", "n", F.when(F.col("texts").isNull(), F.col("indexed")).otherwise(F.col("best")).alias("best"))

    # of rows that repeat id and text, the first row is the one that stays
    verified = scratch.table(verified, "settled")
    first = runs.join(small(verified.select("digest", "sha", "best")), ["digest", "sha"]).where(F.col("id").eqNullSafe(F.col("best"))).groupBy("digest", "sha").agg(F.min("row").alias("first"))
    winners = scratch.table(verified.join(first, ["digest", "sha"]), "winners")
    return runs.join(small(winners), ["digest", "sha"], "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("best")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(F.col("row") == F.col("first"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_decided(spark: SparkSession, docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`lsm_dedup` kept, with all their columns.

    Ids whose rows were all dropped leave by an anti join (broadcast only when few).
    An id with both kept and dropped rows is settled by its text.
    """
    by_id = decisions.groupBy(id_col).agg(F.count("*").alias("_n"), F.count_if(~F.col("kept")).alias("_dropped")).where("_dropped > 0")
    by_id = Scratch(spark, "lsm").table(by_id.withColumnRenamed(id_col, "__sg_id"), "dropped")
    gone, mixed = by_id.where("_n = _dropped").select("__sg_id"), by_id.where("_n > _dropped").select("__sg_id")
    left = docs.join(small(gone), F.col(id_col).eqNullSafe(F.col("__sg_id")), "left_anti")
    if mixed.isEmpty():
        return left
    sure = left.join(small(mixed), F.col(id_col).eqNullSafe(F.col("__sg_id")), "left_anti")
    stays = decisions.where("kept").select(F.col(id_col).alias("__sg_id"), F.col("text_sha256").alias("__sg_sha")).join(mixed.withColumnRenamed("__sg_id", "__sg_m"), F.col("__sg_id").eqNullSafe(F.col("__sg_m")), "left_semi")
    unsure = left.join(small(mixed), F.col(id_col).eqNullSafe(F.col("__sg_id")), "left_semi").withColumn("__sg_s", F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256))
    unsure = unsure.join(stays, F.col(id_col).eqNullSafe(F.col("__sg_id")) & (F.col("__sg_s") == F.col("__sg_sha")), "left_semi")
    one = unsure.groupBy(F.col(id_col).alias("__sg_own"), "__sg_s").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("__sg_row"))  # which one is of no consequence
    return sure.unionByName(one.select("__sg_row.*"))


#: DuckDB SQL for the result over ``documents``.
SQL = """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""
