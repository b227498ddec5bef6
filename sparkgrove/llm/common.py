"""What the operators share: text expressions, Arrow batches, folds."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkgrove.storage import bound_batches

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Space and the ASCII controls from tab to carriage return separate words.
NON_SPACE = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one step of an Arrow operator takes at once (a longer text goes alone).
STEP_BYTES = 1 << 20


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is. Texts of ASCII alone take the faster built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold(column: str | Column, parts: int) -> Column:
    """crc32 of an id as text, modulo ``parts``; a null id counts as empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % parts


def give_back() -> None:
    """Hand free memory of a worker back to the machine; workers live on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other libraries of C do so by themselves
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What a worker keeps from task to task for one operator. Workers live on and serve others after it, so what those kept goes."""
    others = [k for k in _kept if k != owner]
    for k in others:
        _kept.pop(k).clear()
    if others:
        gc.collect()
        give_back()
    return _kept.setdefault(owner, {}) if owner else {}


def steps(batches: Iterator[pa.RecordBatch], column: str, most: int = STEP_BYTES, owner: str = "") -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most ``most`` bytes of ``column``, or one row; what others than ``owner`` kept goes first."""
    kept(owner)
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if len(sizes) > start:
            yield batch.slice(start)
        del batch
        give_back()


def to_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` in batches of a bounded number of rows."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


