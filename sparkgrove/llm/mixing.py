"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source with share w of the target gets the repetition rate w * total / size. Each
row inverts a Poisson distribution of that mean at a uniform number hashed from its
id and a seed, is exploded to that many copies, and every copy goes to the place that
a second hash names: copies are spread evenly over the partitions and sorted within
them, so the partitions read in order are one global shuffle. Rows are decided one by
one, so a hot source needs no group; only counts by source are aggregated.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrove.storage import Scratch, small

#: A larger mean is the sum of this or smaller means, each with a uniform number of its own.
PART = 16.0
#: The Poisson distribution of mean 16 has less than 1e-16 beyond this many events.
STEPS = 64
SEED = 20


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 48 bits of md5 over the parts."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def poisson(mean: Column, key: Column, seed: int) -> Column:
    """Inverted Poisson draws; the number of steps at or below a uniform number, summed over parts."""
    parts = F.greatest(F.ceil(mean / PART), F.lit(1)).cast("int")

    def one(part: Column) -> Column:
        m = mean / parts
        u = uniform(F.lit(str(seed)), part.cast("string"), key)
        start = F.struct(F.lit(0).alias("n"), F.exp(-m).alias("p"), F.exp(-m).alias("c"))
        step = lambda a, k: F.when(a["c"] > u, a).otherwise(F.struct((a["n"] + 1).alias("n"), (a["p"] * m / k).alias("p"), (a["c"] + a["p"] * m / k).alias("c")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda a: a["n"])

    return F.when(mean <= 0, F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda a, i: a + one(i)))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, total: float | None = None, source_col: str = "source") -> DataFrame:
    """(source, n, rate): the mean number of copies of each row of a source.

    ``weights`` are target shares by source, taken over the sources there are (others get
    none; a null source goes by the empty name); without them a share is in proportion to size ** ``power``.
    ``total`` is the wanted number of rows, that of the input by default.
    """
    counted = docs.groupBy(F.coalesce(F.col(source_col), F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    if weights is not None:
        if any(not w >= 0 or math.isinf(w) for w in weights.values()):
            raise ValueError("weights must be finite and not negative")
        pairs = F.map_from_arrays(F.array(*[F.lit(str(k)) for k in weights]), F.array(*[F.lit(float(w)) for w in weights.values()])) if weights else F.create_map().cast("map<string,double>")
        counted = counted.withColumn("w", F.coalesce(F.try_element_at(pairs, F.col("source")), F.lit(0.0)))
    else:
        counted = counted.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(power))))
    sums = counted.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    wanted = F.col("all_n").cast("double") if total is None else F.lit(float(total))
    return counted.crossJoin(F.broadcast(sums)).select("source", "n", F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w") * wanted / F.col("n")).otherwise(0.0).alias("rate"))  # sums: one row


def poisson_mix(spark: SparkSession, docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, total: float | None = None, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The columns of ``docs`` and copy_no (from 1), n_copies, mix_key (48 bits), in global shuffle order.

    A null id hashes as empty text and a null source is the source of the empty name.
    Rows that repeat an id draw the same number and have the same keys; their order among
    themselves is open. Texts are only carried along. An
    empty table gives an empty result. Input columns named copy_no, n_copies or mix_key
    are replaced. ``mix_key`` orders the whole result: partition by partition, and
    within each.
    """
    names = [c for c in docs.columns if c not in ("copy_no", "n_copies", "mix_key")]
    rate = Scratch(spark, "mixing").table(rates(docs, weights, power, total, source_col), "rates").select(F.col("source").alias("__sg_source"), F.col("rate").alias("__sg_rate"))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rated = docs.join(small(rate), F.coalesce(F.col(source_col), F.lit("")) == F.col("__sg_source"))
    drawn = rated.withColumn("n_copies", poisson(F.col("__sg_rate"), key, seed)).where("n_copies > 0")
    copies = drawn.select(*[F.col(f"`{c}`") for c in names], F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy_no"), "n_copies")
    placed = copies.withColumn("mix_key", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"place{seed}"), F.col("copy_no").cast("string"), key).cast("binary")), 1, 12), 16, 10).cast("bigint"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # even ranges of the key without sampling: the key is uniform by construction
    spread = placed.repartitionById(width, F.shiftright(F.col("mix_key") * width, 48).cast("int")) if width < 1 << 15 else placed.repartitionByRange(width, "mix_key")
    return spread.sortWithinPartitions("mix_key", "copy_no")


#: DuckDB SQL for the result over ``documents`` with the default parameters.
SQL = f"""
WITH RECURSIVE c AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
t AS (SELECT sum(pow(n::DOUBLE, 0.5)) AS all_w, sum(n)::DOUBLE AS all_n FROM c),
r AS (SELECT s, pow(n::DOUBLE, 0.5) / all_w * all_n / n AS rate FROM c, t),
p AS (SELECT s, rate, greatest(ceil(rate / {PART}), 1)::INT AS parts FROM r),
cdf AS (
  SELECT s, rate, parts, 0 AS k, exp(-(rate / parts)) AS p, exp(-(rate / parts)) AS c FROM p
  UNION ALL SELECT s, rate, parts, k + 1, p * (rate / parts) / (k + 1), c + p * (rate / parts) / (k + 1) FROM cdf WHERE k + 1 < {STEPS}),
steps AS (SELECT s, any_value(parts) AS parts, list(c ORDER BY k) AS cs FROM cdf GROUP BY s),
d AS (
  SELECT documents.*, list_sum(list_transform(range(1, parts + 1), lambda i: len(list_filter(cs, lambda c: c <= (('0x' || substr(md5('{SEED}:' || i || ':' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656))))::INT AS n_copies
  FROM documents JOIN steps ON coalesce(source, '') = s),
e AS (SELECT *, unnest(range(1, n_copies + 1))::INT AS copy_no FROM d WHERE n_copies > 0)
SELECT doc_id, text, lang, source, n_chars, copy_no, n_copies, ('0x' || substr(md5('place{SEED}:' || copy_no || ':' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS mix_key FROM e
"""
