"""Shared ground of the training-data operators: shared folders, shipping, sizes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from corpuscle.plans import tables
from corpuscle.plans.tables import scratch_path

#: A word is a run of bytes outside this class; it is also what bytes.split() splits on.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ship = tables.ship


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives free memory back: workers live on between tasks, and the allocators would keep their peaks."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def give_back() -> None:
    from corpuscle.llm import hash_table

    hash_table.close()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage by a table in the shared folder."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.parquet(path)
    out._corpuscle_path = path
    return out


def dropped(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Removes tables that written() made and that nothing reads again."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for t in tables:
        path = jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t._corpuscle_path)
        path.getFileSystem(conf).delete(path, True)


def planned_bytes(df: DataFrame) -> int:
    """What the planner takes for the size of df, to choose a number of buckets; 1 GB where it cannot tell."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 1 << 30


def bucket_bits(df: DataFrame, each: int = 8 << 20, least: int = 6, most: int = 16) -> int:
    """Bits of a bucket number, so that a bucket stands for `each` bytes of input or so."""
    return int(np.clip(np.ceil(np.log2(max(1, planned_bytes(df) / each))), least, most))


def texts(column: pa.Array) -> pa.Array:
    """The column as strings without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type) and not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "")


def chunks(column: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, bytes and offsets of runs of texts of about `most` bytes; a longer text is a run of its own."""
    column = texts(column)
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
