"""How many documents of a host hold each line: the ground of the line rules.

A line is normalised to its words in lower-case A-Z with one space between, and hashed together
with its host. Lines without words count nowhere. The first pass counts; lines that a rule finds
common become a sorted hash array that workers map; the second pass, which reads the texts
again, applies the rule without moving any text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm import common, hash_table
from corpuscle.llm.words import Words, mix, signed, string_hash, value_spans

#: A null id counts as the largest.
NO_ID = (1 << 63) - 1
_HOST = np.uint64(0xE7037ED1A0B428DB)


def host_hashes(hosts: pa.Array) -> np.ndarray:
    """A signed hash of each host; null is a host of its own."""
    coded = hosts.dictionary_encode("encode")
    table = np.array([string_hash(h) for h in coded.dictionary.to_pylist()] or [0], np.int64)
    return table[coded.indices.to_numpy(zero_copy_only=False)]


def lines_of(words: Words, hosts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and end of each line that has words, and its key; hosts: by text of the run."""
    first, last = words.lines()
    key = value_spans(words.hashes(lower=True), first, last)
    if len(first):
        key = mix(key ^ mix(hosts.view(np.uint64)[words.text[first]] ^ _HOST))
    return first, last, signed(key)


def without_lines(words: Words, start: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, str]]:
    """For each text that has lines to drop, its number and what is left of it; start, text: first byte of each such line, and its text."""
    for k, starts in zip(np.unique(text).tolist(), np.split(start, np.flatnonzero(np.diff(text)) + 1), strict=bool(len(start))):
        out, pos, drop = [], int(words.offsets[k]), set(starts.tolist())
        for line in words.data[words.offsets[k] : words.offsets[k + 1]].tobytes().split(b"\n"):
            if pos not in drop:
                out.append(line)
            pos += len(line) + 1
        yield k, b"\n".join(out).decode("utf-8", "replace")


def replaced(column: pa.Array, changed: dict[int, str]) -> pa.Array:
    """The column with some texts put in place of its own."""
    if not changed:
        return column
    mask = np.zeros(len(column), bool)
    mask[list(changed)] = True
    return pc.replace_with_mask(column, pa.array(mask), pa.array(changed.values(), column.type))


def line_rows(docs: DataFrame, doc_id: str, host: str, text: str) -> DataFrame:
    """host, key, doc: a row for each document and distinct line, and one with key = host for the document itself."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pc.fill_null(batch.column(0), NO_ID).to_numpy(zero_copy_only=False)
            hosts = host_hashes(batch.column(1))
            for lo, hi, data, offsets in common.chunks(batch.column(2)):
                words = Words(data, offsets)
                first, _, key = lines_of(words, hosts[lo:hi])
                at = words.text[first]
                order = np.lexsort((key, at))
                key, at = key[order], at[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1])
                key, at = key[new], at[new]
                who = np.concatenate((np.arange(words.n), at))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (hosts[lo:hi][who], np.concatenate((hosts[lo:hi], key)), ids[lo:hi][who])], names=["host", "key", "doc"])

    return docs.select(F.col(doc_id).cast("long"), F.col(host).cast("string"), F.col(text).cast("string")).mapInArrow(common.released(run), "host long, key long, doc long")


def common_lines(counts: DataFrame, least: int, percent: float, name: str) -> hash_table.HashTable:
    """Lines whose n is `least` or more and over `percent` of their host's.

    counts: host, key and n, a row for each line, and for each host with key = host.
    """
    spark = counts.sparkSession
    many = common.written(spark, counts.filter((F.col("key") == F.col("host")) | (F.col("n") >= least)), name)
    total = many.filter("key = host").select("host", F.col("n").alias("total"))
    # few rows: a host has at most 100 / percent times its mean number of lines
    found = many.filter("key <> host").join(total, "host").filter(F.col("n") * 100 > F.col("total") * F.lit(percent)).select("key")
    out = hash_table.write_table(spark, found, "key", {}, common.scratch_path(spark, name), common.bucket_bits(many, 1 << 20))
    common.dropped(spark, many)
    return out
