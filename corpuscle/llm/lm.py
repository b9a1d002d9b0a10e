"""Interpolated modified Kneser-Ney bigram model, counted in Spark, mapped by the workers that score.

First pass: each task counts the hashed bigrams of some million words and sends them on, sorted
and packed, by key range; a range is summed and written as a sorted hash array. Second pass:
each task looks up the final count n of its bigrams and sums 1 / n by word, which counts distinct
bigrams without moving them: by first word for the discounts of a context, by second word for
continuation counts. Words become a second sorted hash array. Scoring maps both; nothing of the
model passes through the driver but sums. Both arrays grow with the corpus, and no count is cut.

A bigram is 64 bits of two word hashes; the start of a text is a context, its end a token. A token
that training has not seen has the share of one unseen word of the uniform distribution.

Defined results: a null text is empty and has the end token alone; a null doc_id is held out;
repeated rows count as often as they stand there; without training rows every score is 0 for
every token; a very long text is a run of its own; a column of `keep` that has the name of a made
one gives way to it; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm import common, hash_table
from corpuscle.llm.words import Words, mix, signed

END, START = np.uint64(0x5D0C9E8B7A615243), np.uint64(0x1F83D9ABFB41BD6B)
_BIGRAM = np.uint64(0x9FB21C651E98DF25)
#: Bigrams that a task counts together.
BATCH = 1_500_000
BIG = 255
#: Of the tasks that sum, 2 ** so many at most: a shuffle has a place for each task and each task before it.
MOST_TASK_BITS = 15


def held_out(doc_id: Column, parts: int = 10) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == 0


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each token, of the one before it, and the text of each, for a run of texts."""
    words = Words(data, offsets)
    token = np.insert(words.hashes(lower=True), words.first[1:], END)
    text = np.repeat(np.arange(words.n), words.count + 1)
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[words.first[:-1] + np.arange(words.n)] = START
    return token, before, text


def bigram_keys(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return signed(mix(mix(before + _BIGRAM) * np.uint64(0xD6E8FEB86659FD93) + token))


def packed(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys as differences and counts, each by planes of bytes, which compress well."""
    steps = np.diff(keys.view(np.uint64), prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpacked(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps = np.ascontiguousarray(np.frombuffer(keys, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(steps).view(np.int64), np.ascontiguousarray(np.frombuffer(counts, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    uniq, back = np.unique(keys, return_inverse=True)
    return uniq, [np.bincount(back, v, len(uniq)) for v in values]


@dataclass
class Model:
    bigrams: hash_table.HashTable
    large: hash_table.HashTable  # the counts of BIG or more
    words: hash_table.HashTable
    n_tokens: int
    n_words: int
    discounts: tuple[float, float, float]
    low_discounts: tuple[float, float, float]
    continuations: int
    low_types: tuple[int, int, int]  # words with 1, 2, and 3 or more continuations

    def counts(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        return counts_of(self.bigrams, self.large, bigram_keys(before, token))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base score and score of each text of a run."""
        token, before, text = tokens(data, offsets)
        n = len(offsets) - 1
        # what is known of each token is known of the next one's context; the last entry is the start's
        _, (*facts, cont) = self.words.lookup(signed(np.append(token, START)))
        begin = before == START
        context = [np.where(begin, x[-1], np.roll(x[:-1], 1)).astype(np.float64) for x in facts]
        c, cont = facts[0][:-1].astype(np.float64), cont[:-1].astype(np.float64)
        pick = lambda count, d: np.where(count >= 3, d[2], np.where(count >= 2, d[1], np.where(count >= 1, d[0], 0.0)))
        uniform = 1.0 / (self.n_words + 1)
        if self.continuations:
            spare = sum(d * k for d, k in zip(self.low_discounts, self.low_types, strict=True)) / self.continuations
            low = np.maximum(cont - pick(cont, self.low_discounts), 0) / self.continuations + spare * uniform
        else:
            low = np.full(len(token), uniform)
        seen = self.counts(before, token).astype(np.float64)
        total, known = np.maximum(context[0], 1), context[0] > 0
        d1, d2, d3 = self.discounts
        high = np.maximum(seen - pick(seen, self.discounts), 0) / total + (d1 * context[1] + d2 * context[2] + d3 * context[3]) / total * low
        p = np.where(known, high, low)
        base = np.log10((c + 0.1) / (self.n_tokens + 0.1 * (self.n_words + 1)))
        by = lambda x: np.bincount(text, x, n)
        return np.bincount(text, minlength=n), np.bincount(text[c > 0], minlength=n), by(base), by(np.log10(p))


def counts_of(bigrams: hash_table.HashTable, large: hash_table.HashTable, keys: np.ndarray) -> np.ndarray:
    _, (n,) = bigrams.lookup(keys)
    n = n.astype(np.int64)
    if (big := n == BIG).any():
        n[big] = large.lookup(keys[big])[1][0]
    return n


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """For counts 1, 2, and 3 or more, from the numbers of types with counts 1 to 4; 0.5, 1, 1.5 where those say nothing."""
    if not n1 or not n2:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    out = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(float(np.clip(d, 0.05, k + 0.95)) for k, d in enumerate(out))


def count_bigrams(train: DataFrame, bits: int, uri: str) -> tuple[hash_table.HashTable, hash_table.HashTable, tuple[int, ...]]:
    """train: a column of texts. The table of counts up to BIG, that of larger ones, and the numbers of types with counts 1 to 4."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            edges = np.flatnonzero(np.diff(hash_table.bucket_of(keys, bits), prepend=np.int64(-(1 << 62))))
            rows = [(int(hash_table.bucket_of(keys[a : a + 1], bits)[0]), *packed(keys[a:b], counts[a:b])) for a, b in zip(edges, [*edges[1:], len(keys)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "ids", "counts"])

        for batch in batches:
            for _, _, data, offsets in common.chunks(batch.column(0)):
                token, before, _ = tokens(data, offsets)
                held.append(bigram_keys(before, token))
                if sum(map(len, held)) >= BATCH:
                    yield out()
                    held = []
        if held:
            yield out()

    def add(bucket: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, (counts,) = _sums(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        counts = counts.astype(np.int64)
        name, many = f"{bucket + (1 << (bits - 1)):06d}", counts >= BIG
        hash_table.put(f"{uri}/bigrams/{name}", [keys, np.minimum(counts, BIG).astype("u1")])
        if many.any():
            hash_table.put(f"{uri}/large/{name}", [keys[many], counts[many]])
        return pa.RecordBatch.from_pydict({"first": [bucket << (64 - bits)], "n": [len(keys)], "n_large": [int(many.sum())], "name": [name], **{f"n{k}": [int((counts == k).sum())] for k in (1, 2, 3, 4)}})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for bucket, ids, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if bucket != now and parts:
                    yield add(now, parts)
                    parts = []
                now = bucket
                parts.append(unpacked(ids.as_py(), counts.as_py()))
        if parts:
            yield add(now, parts)

    # a task for each range, or for several ranges that follow each other, which it sums one after another
    wide = min(bits, MOST_TASK_BITS)
    task = (F.shiftright("bucket", bits - wide) + (1 << (wide - 1))).cast("int")
    dealt = train.mapInArrow(common.released(count), "bucket long, ids binary, counts binary").repartitionById(1 << wide, task).sortWithinPartitions("bucket")
    made = dealt.mapInArrow(common.released(summed), "first long, n long, n_large long, name string, n1 long, n2 long, n3 long, n4 long").collect()  # a row for each of 2 ** bits ranges
    table = lambda kind, n, which: hash_table.HashTable([kind], sorted((r["first"], r[n], f"{uri}/{which}/{r['name']}") for r in made if r[n]))
    return table("u1", "n", "bigrams"), table("i8", "n_large", "large"), tuple(sum(r[f"n{k}"] for r in made) for k in (1, 2, 3, 4))


def word_facts(train: DataFrame, bigrams: hash_table.HashTable, large: hash_table.HashTable) -> DataFrame:
    """word; c: its count; one, two, more: distinct bigrams it begins with those counts; cont: distinct words before it."""
    names = ["c", "one", "two", "more", "cont_one", "cont_more"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0

        def out() -> pa.RecordBatch:
            # sorted once for all sums
            keys, sums = _sums(np.concatenate([h[0] for h in held]), *(np.concatenate([h[k] for h in held]) for k in range(1, 7)))
            return pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(s.astype(np.int64)) for s in sums[:3]), pa.array(sums[3]), pa.array(sums[4].astype(np.int64)), pa.array(sums[5])], names=["word", *names])

        for batch in batches:
            for _, _, data, offsets in common.chunks(batch.column(0)):
                token, before, _ = tokens(data, offsets)
                n = counts_of(bigrams, large, bigram_keys(before, token))
                share = 1.0 / np.maximum(n, 1)
                first, (c, one, two, more) = _sums(signed(before), (before == START) * 1.0, (n == 1) * 1.0, (n == 2) * 1.0, (n >= 3) * share)
                second, (c2, cont_one, cont_more) = _sums(signed(token), np.ones(len(n)), (n == 1) * 1.0, (n >= 2) * share)
                zero, nil = np.zeros(len(first)), np.zeros(len(second))
                # bigrams of count 2 are summed as occurrences, to stay whole
                held.append((np.concatenate((first, second)), *(np.concatenate(x) for x in ((c, c2), (one, nil), (two, nil), (more, nil), (zero, cont_one), (zero, cont_more)))))
                rows += len(first) + len(second)
                if rows >= BATCH:
                    yield out()
                    held, rows = [], 0
        if held:
            yield out()

    partial = train.mapInArrow(common.released(run), "word long, c long, one long, two long, more double, cont_one long, cont_more double")
    sums = partial.groupBy("word").agg(*[F.sum(c).alias(c) for c in names])
    return sums.select("word", "c", "one", F.expr("two div 2").alias("two"), F.round("more").cast("long").alias("more"), (F.col("cont_one") + F.round("cont_more").cast("long")).alias("cont"))


def train(texts: DataFrame, text: str = "text") -> Model:
    spark = texts.sparkSession
    common.ship(spark)
    rows = texts.select(F.col(text).cast("string"))
    bits = common.bucket_bits(rows, 4 << 20, most=20)
    uri = common.scratch_path(spark, "lm")
    bigrams, large, types = count_bigrams(rows, bits, uri)
    facts = common.written(spark, word_facts(rows, bigrams, large), "words")
    words = hash_table.write_table(spark, facts, "word", {"c": "i8", "one": "i4", "two": "i4", "more": "i4", "cont": "i4"}, f"{uri}/words", max(6, bits - 2))
    at = lambda k: F.count_if(F.col("cont") == k)
    s = facts.filter(F.col("word") != int(signed(np.array([START]))[0])).agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum("cont"), F.lit(0)), at(1), at(2), at(3), at(4), F.count_if(F.col("cont") >= 3)).first()
    common.dropped(spark, facts)
    return Model(bigrams, large, words, s[0], s[1], discounts(*types), discounts(*s[3:7]), s[2], (s[3], s[4], s[7]))


def perplexity(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, then n_tokens, n_known, train_tokens, base_score, score and perplexity."""
    keep = [c for c in keep if c not in ("n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema) + "n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in common.chunks(batch.column(len(keep))):
                n, known, base, score = model.score(data, offsets)
                columns = [pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(n), model.n_tokens, np.int64)), pa.array(base), pa.array(score), pa.array(10 ** (-score / n))]
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in batch.columns[: len(keep)]), *columns], names=[*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return docs.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(common.released(run), schema)


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Trains on the rows that are not held out and scores all rows."""
    out = held_out(F.col(doc_id))
    model = train(docs.filter(~out), text)
    return perplexity(docs.withColumn("held_out", out), model, [doc_id, "held_out"], text)
