"""Sharding by jump consistent hashing of a stable key.

The shard follows from the key and the number of shards alone, with no table of a ring; when a
shard is appended, only the fraction that belongs to it moves, and only into it.

Defined results: a null text has size 1 and crc 0; a null key is a key like any other; rows with
the same key share a shard; ties in the order of slots are rows that are equal in key, checksum
and size; an empty table gives an empty one.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.llm import common

#: Parts of a shard in which slots are numbered; shards times parts bounds the table of offsets.
PARTS = 512


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key."""
    key = keys.copy()
    b, j = np.zeros(len(key), np.int64), np.zeros(len(key), np.float64)
    live = np.arange(len(key))
    while len(live):
        b[live] = j[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        j[live] = np.floor((b[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1)))
        live = live[j[live] < shards]
    return b


def assign(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard, slot and grown_shard (with one shard more) of each row."""
    spark = docs.sparkSession
    common.ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed = batch.column(3).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(jump(hashed, shards).astype(np.int32)), pa.array(jump(hashed, shards + 1).astype(np.int32))], names=[*batch.schema.names[:3], "shard", "grown_shard"])

    body = F.coalesce(F.col(text), F.lit(""))
    facts = docs.select(F.col(key), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(F.col(key)).alias("hashed"))
    kind = docs.schema[key].dataType.simpleString()
    rows = facts.mapInArrow(common.released(run), f"`{key}` {kind}, size long, text_crc32 long, shard int, grown_shard int")
    rows = common.written(spark, rows.withColumn("part", F.pmod(F.xxhash64(key, "text_crc32"), F.lit(PARTS)).cast("int")), "shards")
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    starts = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("start"))
    inner = F.row_number().over(Window.partitionBy("shard", "part").orderBy(F.col(key), "text_crc32", "size")) - 1
    return (
        rows.withColumn("inner", inner)
        .join(F.broadcast(starts), ["shard", "part"])  # at most shards * PARTS rows
        .select(key, "size", "text_crc32", "shard", (F.col("start") + F.col("inner")).alias("slot"), "grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id", files: int = 8) -> None:
    """Writes whole rows into a folder for each shard, each in up to `files` files."""
    common.ship(docs.sparkSession)

    @F.pandas_udf("int")
    def shard_of(hashed: pd.Series) -> pd.Series:
        return pd.Series(jump(hashed.to_numpy().view(np.uint64), shards).astype(np.int32))

    placed = docs.withColumn("shard", shard_of(F.xxhash64(F.col(key))))
    placed.repartition(shards * files, "shard", F.pmod(F.xxhash64(F.col(key), F.lit(3)), F.lit(files))).write.partitionBy("shard").parquet(path)
