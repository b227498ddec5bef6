"""Tables in the folder that all executors share, and what counts as small enough to broadcast."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast up to this many rows and bytes of its strings; beyond it, it is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20
#: Rows of an Arrow batch where rows hold texts.
ARROW_ROWS = 2_000

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it then gets a temporary folder.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = "file://" + tempfile.mkdtemp(prefix="sparkgrove-")
    return _own[key]


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a folder with all that is in it; whether it was there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Versioned:
    """A table that is replaced as a whole: a new version counts once it is written to its end.

    The version before stays for those who are reading it; older ones go.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v*/_SUCCESS")
        found = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
        return sorted(int(f.getPath().getParent().getName()[1:]) for f in found)

    def exists(self) -> bool:
        return bool(self._versions())

    def folder(self) -> str:
        """The folder of the version that counts."""
        if not (found := self._versions()):
            raise FileNotFoundError(f"no table under {self.path}")
        return f"{self.path}/v{found[-1]}"

    def read(self, schema: T.StructType | str | None = None) -> DataFrame:
        """The table; with a schema an absent table is an empty one, and files that can't be read are left out."""
        if schema is None:
            return self.spark.read.parquet(self.folder())
        if not self.exists():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(self.folder())

    def write(self, df: DataFrame, *partition: str) -> DataFrame:
        """Replace the table."""
        old = self._versions()
        path = f"{self.path}/v{(old[-1] if old else 0) + 1}"
        df.write.mode("overwrite").parquet(path, partitionBy=list(partition) or None)
        for v in old[:-1]:
            delete(self.spark, f"{self.path}/v{v}")
        return self.spark.read.parquet(path)

    def append(self, df: DataFrame) -> None:
        """Add rows to the version that counts."""
        df.write.mode("append").parquet(self.folder() if self.exists() else f"{self.path}/v1")

    def clear(self) -> bool:
        return delete(self.spark, self.path)


def bound_batches(spark: SparkSession) -> None:
    """From here on the session hands rows to Python in Arrow batches of at most ``ARROW_ROWS``: rows hold whole texts, and a task holds a batch outside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


_made: list[Scratch] = []


@atexit.register
def _drop_all() -> None:
    for scratch in _made:
        scratch.drop()


@contextmanager
def releasing() -> Iterator[None]:
    """Scratch tables made inside are deleted at its end: for work whose result is written by then."""
    first = len(_made)
    try:
        yield
    finally:
        for scratch in _made[first:]:
            scratch.drop()
        del _made[first:]


class Scratch:
    """Tables in the shared folder; they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        _made.append(self)

    def table(self, df: DataFrame, name: str, partition: str | None = None, **options: str) -> DataFrame:
        """``df`` written as Parquet, in folders by ``partition`` (the last column) if given, and read again with its own schema."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").options(**options).parquet(path, partitionBy=partition)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str | None = None) -> None:
        """Delete one table, or everything."""
        try:
            delete(self.spark, f"{self.root}/{name}" if name else self.root)
        except Exception:  # the session has ended; what is left is the cluster's to clear
            return


def few(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``limit`` rows, and its strings ``BROADCAST_BYTES``; reads no more rows than that."""
    wide = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    got = df.limit(limit + 1).agg(F.count("*").alias("n"), *[F.sum(w).alias(f"w{k}") for k, w in enumerate(wide)]).first()
    return got["n"] <= limit and sum(got[f"w{k}"] or 0 for k in range(len(wide))) <= BROADCAST_BYTES


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (numbers and strings) marked for broadcast if its measured size allows; else as it is, to be shuffled."""
    return F.broadcast(df) if few(df, limit) else df


def spread(df: DataFrame, key: str, per_task: int, most: int | None = None) -> DataFrame:
    """``df`` with rows of a key together, in tasks of about ``per_task`` rows: the number of tasks grows with the rows counted, not the memory of one.

    ``most`` bounds the number of tasks, for work whose memory doesn't depend on the rows of a task.

    The number is fixed, so that adaptive execution doesn't put tasks together by their compressed bytes.
    """
    return df.repartition(min(-(-df.count() // per_task) or 1, most or 1 << 30), key)


def numbered(spark: SparkSession, df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``df`` with the number of each row, from 1, in this order.

    Ranges of the order are sorted side by side; only their sizes, one row a range, are summed in one place.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = Scratch(spark, "numbered").table(placed, "rows")
    part, at = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).select("__part", "__before")
    return placed.withColumn("__part", part).withColumn("__at", at).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")  # before: one row a range
