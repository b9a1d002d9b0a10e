"""Sorted hash arrays in the shared folder, memory-mapped by the workers that look keys up.

A table is cut into ranges of its (uniform, 64-bit) keys. A file holds the sorted keys of a
range, then one array for each value. Files are written under another name and renamed, so a
task that runs twice does no harm. A folder that is no mounted path is read and written by
pyarrow's filesystems; such files are fetched once by each worker.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def put(uri: str, arrays: list[np.ndarray]) -> None:
    """Writes the arrays one after another."""
    if path := local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(tmp := f"{path}.{uuid.uuid4().hex}", "wb") as f:
            for a in arrays:
                f.write(np.ascontiguousarray(a).data)
        os.replace(tmp, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_output_stream(tmp := f"{path}.{uuid.uuid4().hex}") as f:
        for a in arrays:
            f.write(np.ascontiguousarray(a).data)
    store.move(tmp, path)


_open: dict[str, list[np.ndarray]] = {}


def close() -> None:
    """Drops the maps of a task; what no lookup holds any more goes."""
    _open.clear()


def _map(uri: str) -> np.ndarray:
    if path := local(uri):
        return np.memmap(path, np.uint8, "r")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with tempfile.TemporaryFile() as copy:  # nameless, so it goes with its map
        with store.open_input_stream(path) as f:
            while part := f.read(8 << 20):
                copy.write(part)
        copy.flush()
        return np.memmap(copy, np.uint8, "r")


def mapped(uri: str, n: int, kinds: list[str]) -> list[np.ndarray]:
    if (got := _open.get(uri)) is None:
        if len(_open) > 4096:
            _open.clear()
        whole, at, got = _map(uri), 0, []
        for kind in ["i8", *kinds]:
            size = n * np.dtype(kind).itemsize
            got.append(whole[at : at + size].view(kind))
            at += size
        _open[uri] = got
    return got


@dataclass
class HashTable:
    """parts: first possible key, rows and file of each range that has rows, in order."""

    kinds: list[str]
    parts: list[tuple[int, int, str]] = field(default_factory=list)

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Whether each (signed) key is there, and its values, 0 where not."""
        uniq, back = np.unique(keys, return_inverse=True)
        found = np.zeros(len(uniq), bool)
        values = [np.zeros(len(uniq), kind) for kind in self.kinds]
        firsts = np.array([p[0] for p in self.parts], np.int64)
        edges = [*np.searchsorted(uniq, firsts), len(uniq)]
        for (_, n, uri), lo, hi in zip(self.parts, edges, edges[1:], strict=False):
            if lo < hi:
                own, *rest = mapped(uri, n, self.kinds)
                at = np.minimum(np.searchsorted(own, uniq[lo:hi]), n - 1)
                hit = own[at] == uniq[lo:hi]
                found[lo:hi] = hit
                for v, column in zip(values, rest, strict=True):
                    v[lo:hi] = np.where(hit, column[at], 0)
        return found[back], [v[back] for v in values]


def bucket_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.int64(64 - bits)).astype(np.int64)


def write_table(spark: SparkSession, df: DataFrame, key: str, values: dict[str, str], uri: str, bits: int) -> HashTable:
    """df: unique keys, spread evenly over 64 bits; values: NumPy's kind of each value column."""
    names = list(values)

    def write(key_row: tuple, t: pa.Table) -> pa.Table:
        bucket = key_row[0].as_py()
        keys = t["key"].to_numpy()
        order = np.argsort(keys, kind="stable")
        put(path := f"{uri}/{bucket + (1 << (bits - 1)):06d}", [keys[order], *(t[c].to_numpy()[order].astype(values[c]) for c in names)])
        return pa.table({"first": [bucket << (64 - bits)], "n": [len(keys)], "path": [path]})

    made = (
        df.select(F.col(key).alias("key"), *names)
        .withColumn("bucket", F.shiftright("key", 64 - bits))
        .groupBy("bucket")
        .applyInArrow(write, "first long, n long, path string")
    )
    return HashTable(list(values.values()), sorted((r["first"], r["n"], r["path"]) for r in made.collect()))
