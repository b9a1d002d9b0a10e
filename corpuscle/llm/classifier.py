"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

The trees are fitted on a sample of labelled rows, at most MAX_TRAIN of them, those with the
least hashes of their ids; everything else is over all rows. They are complete binary trees in
flat arrays, so a batch of documents descends all trees with a few NumPy steps for each level.

Defined results: a null text is empty and has a score; a null doc_id is held out; null labels
teach nothing, and of several labels of one document the mean counts; without labels the score is
0.5; repeated rows teach once and get equal scores; ties of the sample's order are ties of ids; a
very long text is a run of its own; a column of `keep` that has the name of a made one gives way to
it; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm import common
from corpuscle.llm.lm import held_out
from corpuscle.llm.words import Words, byte_spans, mix, windows

#: Bound of the sample that the trees are fitted on.
MAX_TRAIN = 30_000
THRESHOLD = 0.3

_CLASSES = {
    "upper": range(0x41, 0x5B),
    "lower": range(0x61, 0x7B),
    "digit": range(0x30, 0x3A),
    "end_mark": b".!?",
    "comma": b",;:",
    "exclaim": b"!",
    "pipe": b"|",
    "symbol": b"#*$%&<>{}[]\\^~=+_",
    "quote": b"\"'",
    "slash_at": b"/@",
    "high": range(0x80, 0x100),
    "feed": b"\n",
}
FEATURES = ["log_words", "mean_word", "long_words", "short_words", "log_lines", "words_a_line", "short_lines", "dup_lines", "distinct_words", "repeat_windows", "top_word", *_CLASSES]
_TABLES = {}
for _name, _bytes in _CLASSES.items():
    _TABLES[_name] = np.zeros(256, bool)
    _TABLES[_name][list(_bytes)] = True


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """FEATURES of each text of a run."""
    words = Words(data, offsets)
    n, text, count = words.n, words.text, words.count
    safe = np.maximum(count, 1)
    length = words.end - words.start
    sized = np.maximum(np.diff(offsets), 1)
    by = lambda x, of=text: np.bincount(of, x, n)
    hashes = words.hashes(lower=True)
    salted = mix(hashes + mix(text.astype(np.uint64)))
    _, at, times = np.unique(salted, return_index=True, return_counts=True)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, text[at], times)
    run, first = windows(hashes, text, 3)
    _, back, often = np.unique(mix(run + mix(text[first].astype(np.uint64))), return_inverse=True, return_counts=True)
    line, last = words.lines()
    of_line = text[line]
    lines = np.maximum(np.bincount(of_line, minlength=n), 1)
    start, end = words.line_bytes(line)
    _, one, same = np.unique(mix(byte_spans(data, start, end) + mix(of_line.astype(np.uint64))), return_index=True, return_counts=True)
    columns = [
        np.log1p(count), by(length) / safe, by(length > 12) / safe, by(length <= 2) / safe,
        np.log(lines), count / lines, by((last - line) <= 3, of_line) / lines, by(same - 1, of_line[one]) / lines,
        np.bincount(text[at], minlength=n) / safe, by(often[back] > 1, text[first]) / safe, top / safe,
        *(words.per_text(table[data]) / (safe if name in ("end_mark", "comma", "exclaim", "pipe", "symbol") else sized) for name, table in _TABLES.items()),
    ]
    return np.stack(columns, 1).astype(np.float32)


@dataclass
class Trees:
    """Complete trees: node k has children 2k + 1 and 2k + 2; leaves follow the inner nodes."""

    feature: np.ndarray  # trees x inner nodes
    above: np.ndarray  # go right if the value is greater
    leaf: np.ndarray  # trees x leaves
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        depth = int(np.log2(self.leaf.shape[1]))
        row, total = np.arange(len(x)), np.full(len(x), self.start)
        for feature, above, leaf in zip(self.feature, self.above, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[row, feature[node]] > above[node])
            total += leaf[node - (len(leaf) - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, penalty: float = 2.0, least: float = 5.0) -> Trees:
    """Newton boosting of the logistic loss on binned features."""
    inner, n_features = (1 << depth) - 1, x.shape[1] if x.ndim == 2 else len(FEATURES)
    if not len(y):
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), 0.0)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1]).astype(np.float32)) for f in range(n_features)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(n_features)], 1)
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    total = np.full(len(y), np.log(mean / (1 - mean)))
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1)), float(total[0]))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            begin, wide = (1 << level) - 1, 1 << level
            own = node - begin
            best = np.full(wide, 1e-9)
            choice = np.zeros((wide, 2), np.int64)
            for f in range(n_features):
                slot = own * bins + binned[:, f]
                gs, hs = (np.cumsum(np.bincount(slot, v, wide * bins).reshape(wide, bins), 1) for v in (g, h))
                left = gs**2 / (hs + penalty) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + penalty) - gs[:, -1:] ** 2 / (hs[:, -1:] + penalty)
                left[(hs < least * 0.1) | (hs[:, -1:] - hs < least * 0.1)] = 0
                left[:, len(edges[f]) :] = 0
                top = left.argmax(1)
                better = left[np.arange(wide), top] > best
                best = np.where(better, left[np.arange(wide), top], best)
                choice[better] = np.stack([np.full(wide, f), top], 1)[better]
            split = best > 1e-9
            for k in np.flatnonzero(split):
                out.feature[t, begin + k], out.above[t, begin + k] = choice[k, 0], edges[choice[k, 0]][choice[k, 1]]
            right = split[own] & (binned[np.arange(len(y)), choice[own, 0]] > choice[own, 1])
            node = 2 * node + 1 + right
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        out.leaf[t] = -rate * gs / (hs + penalty)
        total += out.leaf[t][leaf]
    return out


def featured(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The columns `keep` and the features of each row."""
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema) + "features array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in common.chunks(batch.column(len(keep))):
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in batch.columns[: len(keep)]), pa.array(list(features(data, offsets)), pa.list_(pa.float32()))], names=[*keep, "features"])

    return docs.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(common.released(run), schema)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Trees:
    common.ship(docs.sparkSession)
    taught = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("double").alias("_y")).filter(~held_out(F.col("_id"), 5) & F.col("_y").isNotNull())
    sample = taught.groupBy("_id").agg(F.avg("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(MAX_TRAIN)
    # at most MAX_TRAIN rows of two numbers
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_body")).join(F.broadcast(sample), "_id")
    once = featured(rows, ["_id", "_y"], "_body").dropDuplicates(["_id", "features"])  # of repeated rows one teaches
    got = once.orderBy(F.xxhash64("_id"), "_id", "features").limit(MAX_TRAIN).collect()
    got.sort(key=lambda r: (r["_id"], r["features"]))
    return fit(np.array([r["features"] for r in got], np.float32), np.array([r["_y"] for r in got]))


def scored(docs: DataFrame, trees: Trees, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, then score and predicted."""
    common.ship(docs.sparkSession)
    keep = [c for c in keep if c not in ("score", "predicted")]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema) + "score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in common.chunks(batch.column(len(keep))):
                score = trees.score(features(data, offsets))
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in batch.columns[: len(keep)]), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(common.released(run), schema)


def judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    trees = train(docs, labels, doc_id, text)
    return scored(docs.withColumn("held_out", held_out(F.col(doc_id), 5)), trees, [doc_id, "held_out"], text)
