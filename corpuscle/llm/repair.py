"""Token-id files, compressed by a Re-Pair grammar.

Ids are written in ascending doc_id order, in blocks. In each block, frequent pairs of adjacent
ids are replaced by nonterminals, round by round, until no pair is frequent; all pairs are
counted exactly. A round takes many pairs at once: in
descending count, those whose symbols cannot overlap with the ones taken before (no symbol is
the left part of one and the right part of another), so all replacements of a round are those
that one-at-a-time Re-Pair would make for them. A block holds the rules, the length that each
rule expands to, and the remaining sequence; expansion lengths give random access without
expanding what stands before.

The files are Parquet, a row for each block with the grammar as binary, so that writing is
committed by Spark and works on every store. Columns: shard, block, shard_start (ids of the
shard before the block), n_tokens, doc_ids, doc_tokens, grammar.

Defined results: a null text is empty and yields the end id alone; a null doc_id sorts first;
equal doc_ids sort by a hash of their texts; an empty table yields no file rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.llm import bpe, common

MAGIC = b"REPAIR1\n"
FILE_SCHEMA = "shard int, block int, shard_start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, grammar binary"


def _taken(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which pairs a round takes, in descending count (ties: ascending pair)."""
    role: dict[int, int] = {}  # 1: left part, 2: right part, 3: both parts of one pair
    out = []
    order = np.lexsort((keys, -counts))
    for k, key in zip(order.tolist(), keys[order].tolist(), strict=True):
        a, b = key >> 32, key & 0xFFFFFFFF
        if a == b:
            if a in role:
                continue
            role[a] = 3
        else:
            if role.get(a, 1) != 1 or role.get(b, 2) != 2:
                continue
            role[a], role[b] = 1, 2
        out.append(k)
    return np.array(out, np.int64)


def _alike(seq: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places `at` in the order of the pairs that begin there, where in it each distinct pair is first, and the distinct pairs."""
    bits, low = int(seq.max()).bit_length(), len(seq).bit_length()
    pairs = seq[at].astype(np.uint64)
    if 2 * bits + low <= 64:  # pair and place in one number
        for shift, part in ((bits, seq[at + 1]), (low, at.view(np.uint64))):
            pairs <<= np.uint64(shift)
            pairs |= part
        pairs.sort()
        places = (pairs & np.uint64((1 << low) - 1)).view(np.int64)
        pairs >>= np.uint64(low)
    else:
        bits = 32
        pairs = pairs << np.uint64(32) | seq[at + 1]
        by = np.argsort(pairs)
        places, pairs = at[by], pairs[by]
    new = np.ones(len(at), bool)
    np.not_equal(pairs[1:], pairs[:-1], out=new[1:])
    pairs = pairs[new]
    return places, new, (pairs >> np.uint64(bits)) << np.uint64(32) | pairs & np.uint64((1 << bits) - 1)


def compress(ids: np.ndarray, first_free: int, rounds: int | None = None, share: float = 2e-5, least: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remaining sequence, rules (left, right), expansion lengths; rule k is symbol first_free + k.

    Without `rounds`, until no pair of the sequence left stands `least` times and in `share` of it.

    Each place bears the number of the pair that begins there (0: one that stands less than
    `least` times). A round only makes pairs with its new symbols, and all places of those; so
    pairs are sorted once, at the places that a round has changed, and other counts only sink.
    """
    seq = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    free = first_free
    number = np.zeros(len(seq), np.int32)
    pairs, counts = np.zeros(1, np.uint64), np.zeros(1, np.int64)
    changed = np.arange(len(seq) - 1)
    while len(seq) > 1 and (rounds is None or len(rules) < rounds):
        if len(changed):
            places, new, found = _alike(seq, changed)
            size = np.diff(np.flatnonzero(new), append=len(new))
            often = size >= least
            numbers = np.zeros(len(size) + 1, np.int32)
            numbers[1:][often] = np.arange(len(pairs), len(pairs) + np.count_nonzero(often))
            number[places] = numbers[np.cumsum(new, dtype=np.int32)]
            pairs, counts = np.append(pairs, found[often]), np.append(counts, size[often])
        many = np.flatnonzero(counts >= max(1, least, int(share * len(seq))))
        chosen = many[_taken(pairs[many], counts[many])]
        if not len(chosen):
            break
        name = np.zeros(len(pairs), np.uint32)
        name[chosen] = np.arange(free, free + len(chosen))
        at = np.flatnonzero((name > 0)[number])
        rules.append(np.stack([pairs[chosen] >> np.uint64(32), pairs[chosen] & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        free += len(chosen)
        same = seq[at] == seq[at + 1]
        if same.any():  # in a run of one symbol, every second position, counted from the run's start
            runs = at[same]
            starts = np.concatenate(([True], np.diff(runs) != 1))
            begin = runs[np.maximum.accumulate(np.where(starts, np.arange(len(runs)), 0))]
            use = np.ones(len(at), bool)
            use[same] = (runs - begin) % 2 == 0
            at = at[use]
        seq[at] = name[number[at]]
        # the pairs replaced, and those with their neighbours, each place once
        gone = np.concatenate((at[np.diff(at, prepend=at[0] - 3 * (at[0] > 0)) > 2] - 1, at, at + 1))
        counts -= np.bincount(number[gone], minlength=len(counts))
        counts[0] = number[gone] = 0
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, number = seq[keep], number[keep]
        at -= np.arange(len(at))
        changed = np.concatenate((at[np.diff(at, prepend=at[0] - 2 * (at[0] > 0)) > 1] - 1, at[at < len(seq) - 1]))
    made = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return seq, made, lengths(made, first_free)


def lengths(rules: np.ndarray, first_free: int) -> np.ndarray:
    """Of the expansion of each rule; a rule refers only to ids and to rules before it."""
    out = np.ones(len(rules), np.uint32)
    part = lambda s: int(out[s - first_free]) if s >= first_free else 1
    for k, (a, b) in enumerate(rules.tolist()):
        out[k] = part(a) + part(b)
    return out


def pack(ids: np.ndarray, first_free: int, **how: float) -> bytes:
    seq, rules, sizes = compress(ids, first_free, **how)
    kind = "<u2" if first_free + len(rules) <= 1 << 16 else "<u4"
    head = np.array([first_free, len(rules), len(seq), len(ids)], "<u8")
    return b"".join([MAGIC, head.tobytes(), rules.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), seq.astype(kind).tobytes()])


class Grammar:
    """Reads a packed block."""

    def __init__(self, blob: bytes):
        if blob[:8] != MAGIC:
            raise ValueError("not a grammar block")
        self.first_free, rules, left, self.n_tokens = (int(x) for x in np.frombuffer(blob, "<u8", 4, 8))
        at = 40
        self.rules = np.frombuffer(blob, "<u4", 2 * rules, at).reshape(-1, 2)
        self.sizes = np.frombuffer(blob, "<u4", rules, at := at + 8 * rules)
        self.seq = np.frombuffer(blob, "<u2" if self.first_free + rules <= 1 << 16 else "<u4", left, at + 4 * rules)
        flat: list[np.ndarray] = [np.arange(self.first_free, dtype=np.uint32)]  # ids, then the rules' expansions
        ids, part = flat[0], lambda s: flat[s - self.first_free + 1] if s >= self.first_free else ids[s : s + 1]
        for a, b in self.rules.tolist():
            flat.append(np.concatenate((part(a), part(b))))
        self.flat = np.concatenate(flat)
        self.size_of = np.concatenate((np.ones(self.first_free, np.int32), self.sizes.astype(np.int32)))
        self.start_of = (np.cumsum(self.size_of, dtype=np.int64) - self.size_of).astype(np.int32)
        self.ends: np.ndarray | None = None

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        return bpe.gathered(self.flat, self.start_of, self.size_of, symbols)

    def all(self) -> np.ndarray:
        return self._expand(self.seq)

    def read(self, start: int, count: int) -> np.ndarray:
        """Ids [start, start + count), expanding only the symbols that cover them."""
        if self.ends is None:
            self.ends = np.cumsum(self.size_of[self.seq], dtype=np.int64)
        lo, hi = np.searchsorted(self.ends, [start, start + count - 1], "right")
        before = int(self.ends[lo - 1]) if lo else 0
        return self._expand(self.seq[lo : hi + 1])[start - before : start - before + count]


def write_ids(docs: DataFrame, path: str, tokenizer_path: str | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, block_tokens: int = 1 << 21) -> None:
    """Writes the ids of all texts, each with end_id after it, as files in ascending doc_id order."""
    spark = docs.sparkSession
    common.ship(spark)
    tokenizer_path = tokenizer_path or bpe.default_path()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), common.planned_bytes(rows) // (64 << 20))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = bpe.tokenizer(tokenizer_path), TaskContext.get().partitionId()
        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("shard_start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("grammar", pa.binary())])
        block = before = held = 0
        ids, sizes, parts = [], [], []

        def out() -> pa.RecordBatch:
            whole = np.concatenate(parts)
            return pa.RecordBatch.from_pylist([{"shard": shard, "block": block, "shard_start": before, "n_tokens": held, "doc_ids": ids, "doc_tokens": sizes, "grammar": pack(whole, coder.size)}], schema)

        for batch in batches:
            for lo, hi, data, offsets in common.chunks(batch.column(1), bpe.RUN_BYTES):
                whole, counts = coder.encode_run(data, offsets)
                whole, counts = np.insert(whole, np.cumsum(counts), np.uint32(end_id)), counts + 1
                ids += batch.column(0)[lo:hi].to_pylist()
                sizes += counts.tolist()
                parts.append(whole)
                held += len(whole)
                if held >= block_tokens:
                    yield out()
                    block, before, held = block + 1, before + held, 0
                    ids, sizes, parts = [], [], []
        if ids:
            yield out()

    rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(common.released(run), FILE_SCHEMA).write.parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """A row for each document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32; with_ids: also ids."""
    common.ship(spark)
    files = spark.read.parquet(path)
    # a row for each shard, of which there is one for 64 MB of input: 25 MB of 100 TB
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    before = shards.select("shard", (F.sum("size").over(Window.orderBy("shard")) - F.col("size")).alias("before"))
    out = "shard int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                whole = Grammar(row["grammar"]).all()
                ends = np.cumsum(row["doc_tokens"])
                starts = ends - row["doc_tokens"]
                columns = {
                    "shard": pa.array(np.full(len(ends), row["shard"], np.int32)),
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "start": pa.array(starts + row["shard_start"]),
                    "n_tokens": pa.array(row["doc_tokens"], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(whole[a:b]) for a, b in zip(starts, ends, strict=True)], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([whole[a:b].astype(np.int32) for a, b in zip(starts, ends, strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    docs = files.select("shard", "shard_start", "doc_ids", "doc_tokens", "grammar").mapInArrow(common.released(run), out)
    return docs.join(F.broadcast(before), "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
