"""Helpers that several operators share: bounded labelled samples and appended prediction columns."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType


def remainder(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; -1 for a null key."""
    return F.coalesce(F.crc32((F.col(key) if isinstance(key, str) else key).cast("string")) % n, F.lit(-1).cast("long"))


def spread(key: str) -> Column:
    """A number in [0, 1) that only the key decides."""
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) / float(1 << 30)


def text_blocks(texts: list, most_rows: int, most_chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows, each with few enough rows and characters; a row longer than that stands alone."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and end - at < most_rows and (end == at or size + len(texts[end]) <= most_chars):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


#: Rows of whole texts that go to a Python worker at once.
BATCH_ROWS = 1000


def small_batches(spark) -> None:
    """Texts are long, so a batch of Spark's usual 10,000 rows may be large; fewer rows bound a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def release() -> None:
    """Give memory that nothing holds back to the system, as a worker stays for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; then release()."""
    yield from batches
    release()


def append_columns(df: DataFrame, text: str, fields: list[StructField], predict: Callable[[list[bytes | None]], list[list]]) -> DataFrame:
    """df with the fields that predict() gives for the whole texts, in UTF-8, of each Arrow batch.

    Columns of df that have a new field's name are replaced.
    """
    new = {f.name for f in fields}
    kept = [c for c in df.columns if c not in new]
    schema = StructType([*df.select(*kept).schema.fields, *fields])
    types = [to_arrow_type(f.dataType) for f in fields]
    names = [*kept, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(batch.num_columns - 1).to_pylist()
            cols = [pa.array(c, type=t) for c, t in zip(predict(raw), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], names=names)

    small_batches(df.sparkSession)
    raw = df.select(*(df[c] for c in kept), df[text].cast("binary").alias("__text_utf8"))
    return raw.mapInArrow(lambda batches: released(run(batches)), schema)
