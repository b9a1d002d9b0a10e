"""Request analytics: longest stored prefixes, reuse, savings, costs."""

from __future__ import annotations

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def _mixed(x: np.ndarray) -> np.ndarray:
    for m in _MIX:
        x = (x ^ (x >> np.uint64(33))) * m
    return x ^ (x >> np.uint64(33))


def prefix_hashes(ids: bytes) -> np.ndarray:
    """Signed hash of each prefix, of length 1 and up: the sum of mixed (place, byte) pairs."""
    body = np.frombuffer(ids, np.uint8).astype(np.uint64)
    return np.cumsum(_mixed((np.arange(1, len(body) + 1, dtype=np.uint64) << np.uint64(8) | body) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)


def _hashed(rows: DataFrame, key: str, every: bool, least: int) -> DataFrame:
    """key, n, h: of each prefix of `least` ids and more, or of the whole sequence alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, ids in zip(batch.column(0), batch.column(1), strict=True):
                h = prefix_hashes(ids.as_py() or b"")
                n = np.arange(least, len(h) + 1) if every else np.arange(len(h), len(h) + 1)
                if len(h) >= least:
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(n), pa.int64()), pa.array(n, pa.int32()), pa.array(h[n - 1])], names=[key, "n", "h"])

    return rows.select(F.col(key).cast("long"), "ids").mapInArrow(run, f"{key} long, n int, h long")


def longest_prefix(requests: DataFrame, stored: DataFrame, least: int = 4, earlier: bool = False) -> DataFrame:
    """requests: request, ids; stored: entry, ids. request, entry, matched: the deepest stored sequence that begins the request.

    Of equal sequences the least entry counts. earlier: only entries below the request's number.
    The prefixes of a request are told by hashes, a number each, that one pass over it gives; bytes
    are fetched and compared for the deepest match alone.
    """
    kept = _hashed(stored, "entry", False, least).groupBy("n", "h").agg(F.min("entry").alias("entry"))
    tried = _hashed(requests, "request", True, least)
    hits = tried.join(kept, ["n", "h"])
    if earlier:
        hits = hits.filter("entry < request")
    best = hits.groupBy("request").agg(F.max(F.struct("n", "entry")).alias("b")).select("request", "b.n", "b.entry")
    found = requests.join(best, "request", "left").join(stored.select("entry", F.col("ids").alias("_stored")), "entry", "left")
    same = F.substring("ids", F.lit(1), F.col("n")) == F.col("_stored")
    return found.select("request", F.when(same, F.col("entry")).alias("entry"), F.when(same, F.col("n")).otherwise(0).cast("long").alias("matched"), F.octet_length("ids").cast("long").alias("n_ids"))


def reuse(matched: DataFrame) -> DataFrame:
    """One row: lookups, hits, tokens reused and computed, and their rates."""
    s = matched.agg(F.count("*").alias("lookups"), F.count_if(F.col("matched") > 0).alias("hits"), F.sum("matched").alias("reused"), F.sum(F.col("n_ids") - F.col("matched")).alias("computed"))
    return s.select("*", (F.col("hits") / F.greatest(F.lit(1), "lookups")).alias("hit_rate"), F.when(F.col("reused") + F.col("computed") > 0, F.col("reused") / (F.col("reused") + F.col("computed"))).otherwise(0.0).alias("token_reuse_rate"))


def forward_flops(params: Column, tokens: Column) -> Column:
    return 2 * params * tokens


def training_flops(params: Column, tokens: Column) -> Column:
    return 6 * params * tokens


def cost_comparison(params: Column, tokens: Column, flops: Column) -> list[Column]:
    """What continued training on the tokens would cost beside a measured build."""
    reference = training_flops(params, tokens)
    ratio = F.when(flops > 0, reference / flops).otherwise(F.lit(float("inf")))
    return [reference.alias("reference_flops"), ratio.alias("ratio"), F.when(flops > 0, F.log10(ratio)).alias("orders_of_magnitude")]
