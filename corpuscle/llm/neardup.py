"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Documents with equal shingle sets are one node (64 bits of the set; among a billion sets, two share
them with probability 0.03); copies are never compared. Nodes that agree on a band of their sketch
share a bucket. With 32 bands of 4 coordinates, a pair at similarity 0.75 shares none with
probability 5e-6.

Candidates are checked on full sets in two rounds. First each node of a bucket against the
bucket's least node, which joins most of a large group at linear cost. Then a bucket that still
holds several components is closed inside a task: more stars, each one pass over the sets, as long
as they join much; then every set outside the largest component is looked up by its rarest
shingles, of which a set that reaches the similarity must share one, and what shares one is
compared in full. So no pair that shares a bucket stays unchecked, no pair is ever a row, and a
node is one row for each such bucket. A bucket of more than VOLUME shingles is dealt into blocks
of that size, and each two blocks meet. Texts travel, not hashes: near copies lie beside each other
and compress. Components are found by min-label propagation with pointer jumping over tables in
the shared folder.

Defined results: null and empty texts, and those without words, have an empty set and are linked
with nothing; a null doc_id is never a component's id unless the component has no other; repeated
rows share a node and all rows with the component's doc_id are kept; a very long text is a run and
a block of its own; columns beside the named ones do not matter; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm import common, hash_table
from corpuscle.llm.sketch import band_keys, sketch
from corpuscle.llm.words import Words, mix, signed, value_spans, windows

WIDTH, ROWS, PERCENT = 5, 4, 75
#: Equal shingles of two texts that are counted at once.
MEETINGS = 500_000
#: Shingles of the texts that meet in a task at once: of a star, and of a block of a bucket.
STAR, VOLUME = 200_000, 500_000
#: Stands for a null doc_id, which is the largest.
NO_ID = (1 << 63) - 1


def shingle_sets(words: Words, width: int = WIDTH) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted; a shorter text is one shingle."""
    hashes = words.hashes(lower=True)
    found, at = windows(hashes, words.text, width)
    edge = np.searchsorted(words.text[at], np.arange(words.n + 1))
    out = []
    for k in range(words.n):
        if words.count[k] >= width:
            out.append(np.unique(found[edge[k] : edge[k + 1]]))
        elif words.count[k]:
            out.append(value_spans(hashes, words.first[k : k + 1], words.first[k + 1 : k + 2]))
        else:
            out.append(found[:0])
    return out


def node_of(elements: np.ndarray) -> int:
    """64 bits of a set, signed."""
    return int(signed(mix(np.array([mix(elements).sum() + np.uint64(len(elements))], np.uint64)))[0])


def row_key(doc_id: str, text: str) -> Column:
    """Of rows with the same id and text."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)), F.xxhash64(F.col(text).cast("string")))


def sketched(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, key, n_shingles, node and bands of each row; no bands where there are no shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in common.chunks(batch.column(1)):
                sets = shingle_sets(Words(data, offsets))
                keys = [signed(band_keys(sketch(s), ROWS)) if len(s) else np.zeros(0, np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], batch.column(2)[lo:hi], pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "key", "n_shingles", "node", "bands"],
                )

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string"), row_key(doc_id, text)).mapInArrow(common.released(run), "doc_id long, key long, n_shingles long, node long, bands array<long>")


def texts_of(docs: DataFrame, doc_id: str, text: str, wanted: hash_table.HashTable) -> DataFrame:
    """node and text of the wanted rows; wanted: key of the row that stands for a node, and the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, (node,) = wanted.lookup(batch.column(0).to_numpy())
            use = pa.array(np.flatnonzero(found))
            yield pa.RecordBatch.from_arrays([pa.array(node[found]), batch.column(1).take(use)], names=["node", "text"])

    return docs.select(row_key(doc_id, text), F.col(text).cast("string")).mapInArrow(common.released(run), "node long, text string")


def _links(rows: pa.Table, percent: int) -> pa.RecordBatch:
    """Links between askers (role 1) and asked (role 0) of the same group whose components differ; one for each pair of components and group."""
    group, role, node, comp = (rows.column(c).to_numpy() for c in ("grp", "role", "node", "comp"))
    sets, sizes = [], []
    for _, _, data, offsets in common.chunks(rows.column("text").combine_chunks()):
        sets += shingle_sets(Words(data, offsets))
    sizes = np.array([len(s) for s in sets])
    _, number = np.unique(group, return_inverse=True)
    salt = mix(number.astype(np.uint64) + np.uint64(1))
    flat = np.concatenate(sets) + np.repeat(salt, sizes)  # a group's shingles meet only each other
    owner = np.repeat(np.arange(len(sets)), sizes)
    asked, asker = role[owner] == 0, role[owner] == 1
    order = np.argsort(flat[asked])
    keys, who = flat[asked][order], owner[asked][order]
    out_a, out_b = [], []
    pair_keys, pair_counts = [], []
    mine, by = flat[asker], owner[asker]
    low, high = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
    met = np.cumsum(high - low)
    at = 0
    while at < len(mine):  # about MEETINGS at a time, whatever the groups hold
        to = max(at + 1, int(np.searchsorted(met, (met[at - 1] if at else 0) + MEETINGS, "right")))
        lo, size = low[at:to], (high - low)[at:to]
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        k, c = np.unique(np.repeat(by[at:to], size) * len(sets) + who[np.repeat(lo, size) + inner], return_counts=True)
        pair_keys.append(k)
        pair_counts.append(c)
        at = to
    if pair_keys:
        pair, back = np.unique(np.concatenate(pair_keys), return_inverse=True)
        both = np.bincount(back, np.concatenate(pair_counts)).astype(np.int64)
        a, b = pair // len(sets), pair % len(sets)
        linked = (100 * both >= percent * (sizes[a] + sizes[b] - both)) & (comp[a] != comp[b])
        a, b = a[linked], b[linked]
        low, high = np.minimum(comp[a], comp[b]), np.maximum(comp[a], comp[b])
        _, one = np.unique(np.stack([number[a], low, high], 1), axis=0, return_index=True)
        out_a, out_b = node[a[one]], node[b[one]]
    return pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["u", "v"])


class _Group:
    """The sets of a group of texts, with shingles numbered from the rarest."""

    def __init__(self, sets: list[np.ndarray], comp: np.ndarray, percent: int):
        self.percent, self.n = percent, len(sets)
        self.sizes = np.array([len(s) for s in sets])
        _, self.label = np.unique(comp, return_inverse=True)
        _, back, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(counts), np.int32)
        rank[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.int32)
        self.ids, self.first = rank[back], np.concatenate(([0], np.cumsum(self.sizes)))
        self.mark = np.zeros(len(counts), bool)
        self.links: list[tuple[int, int]] = []

    def like(self, one: int, others: np.ndarray) -> np.ndarray:
        """Those of the others that reach the similarity with the set `one`."""
        size, own = self.sizes[others], self.sizes[one]
        others = others[(100 * size >= self.percent * own) & (100 * own >= self.percent * size)]
        if not len(others):
            return others
        size = self.sizes[others]
        start = np.cumsum(size) - size
        at = np.repeat(self.first[others] - start, size) + np.arange(size.sum())
        mine = self.ids[self.first[one] : self.first[one + 1]]
        self.mark[mine] = True
        both = np.add.reduceat(self.mark[self.ids[at]].astype(np.int64), start)
        self.mark[mine] = False
        return others[100 * both >= self.percent * (size + own - both)]

    def join(self, one: int, others: np.ndarray) -> int:
        """Links `one` with a member of each component of the others."""
        labels, at = np.unique(self.label[others], return_index=True)
        for label, k in zip(labels.tolist(), at.tolist(), strict=True):
            self.links.append((one, int(others[k])))
            self.label[self.label == label] = self.label[one]
        return len(labels)

    def _outside(self) -> np.ndarray:
        """Nodes outside the largest component."""
        return np.flatnonzero(self.label != np.bincount(self.label).argmax())

    def close(self) -> list[tuple[int, int]]:
        """Links that make the components what all pairs would; initial components are given."""
        left = len(np.unique(self.label))
        while left > 1:  # stars, while they join a tenth of the components
            one = int(self._outside()[0])
            joined = self.join(one, self.like(one, np.flatnonzero(self.label != self.label[one])))
            left -= joined
            if joined * 10 < left:
                break
        if left > 1:
            self._by_rarest(self._outside())
        return self.links

    def _by_rarest(self, askers: np.ndarray) -> None:
        """A set that shares none of the rarest shingles of another, all but so many as must be common less one, cannot reach the similarity."""
        owner = np.repeat(np.arange(self.n), self.sizes)
        order = np.lexsort((self.ids, owner))
        ids, place = self.ids[order], np.arange(len(order)) - self.first[owner]
        rare = place < (self.sizes - (self.percent * self.sizes + 99) // 100 + 1)[owner]
        self.ids = ids  # by text, the rarest first
        held, who = ids[rare], owner[rare]
        by = np.argsort(held, kind="stable")
        keys, who = held[by], who[by]
        begin = np.searchsorted(keys, np.arange(len(self.mark) + 1))
        for one in askers.tolist():
            mine = ids[self.first[one] : self.first[one] + self.sizes[one] - (self.percent * self.sizes[one] + 99) // 100 + 1]
            size = begin[mine + 1] - begin[mine]
            start = np.cumsum(size) - size
            met = np.zeros(self.n, bool)
            met[who[np.repeat(begin[mine] - start, size) + np.arange(size.sum())]] = True
            met &= self.label != self.label[one]
            others = np.flatnonzero(met)
            for k in range(0, len(others), 256):  # a bounded volume at once
                some = others[k : k + 256]
                self.join(one, self.like(one, some[self.label[some] != self.label[one]]))


def _closed(rows: pa.Table, percent: int) -> pa.RecordBatch:
    """Links that close each of the groups."""
    group, node, comp = (rows.column(c).to_numpy() for c in ("grp", "node", "comp"))
    sets: list[np.ndarray] = []
    for _, _, data, offsets in common.chunks(rows.column("text").combine_chunks()):
        sets += shingle_sets(Words(data, offsets))
    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    out_a, out_b = [], []
    for lo, hi in zip(edges.tolist(), edges[1:].tolist(), strict=False):
        for a, b in _Group(sets[lo:hi], comp[lo:hi], percent).close():
            out_a.append(node[lo + a])
            out_b.append(node[lo + b])
    return pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["u", "v"])


def verified(routes: DataFrame, texts: DataFrame, n: int, percent: int, close: bool) -> DataFrame:
    """routes: grp, role, node, comp. Groups have bounded sizes and are streamed in order, some hundred at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = size = 0
        work = _closed if close else _links
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                held.append(batch)
                rows, size = rows + len(batch), size + batch.nbytes
                if rows >= 1024 or size >= 4 << 20:
                    t = pa.Table.from_batches(held)
                    group = t.column("grp").to_numpy()
                    cut = int(np.searchsorted(group, group[-1]))  # sorted; the last group may go on
                    if cut:
                        yield work(t.slice(0, cut), percent)
                        t = t.slice(cut).combine_chunks()
                        held, rows, size = t.to_batches(), len(t), t.nbytes
        if rows:
            yield work(pa.Table.from_batches(held), percent)

    return routes.join(texts, "node").select("grp", "role", "node", "comp", "text").repartition(n, "grp").sortWithinPartitions("grp").mapInArrow(common.released(run), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the least node reachable, of all nodes that have an edge; edges: u, v."""
    spark = edges.sparkSession
    both = common.written(spark, edges.select("u", "v").union(edges.select("v", "u")).distinct(), "edges")
    labels = common.written(spark, both.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "comp"), "v").groupBy(F.col("u").alias("node")).agg(F.min("comp").alias("near"))
        down = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        new = common.written(spark, down.join(jump, "comp").select("node", "old", F.least("comp", "further").alias("comp")), "labels")
        common.dropped(spark, labels)
        labels = new
        if labels.filter("comp <> old").isEmpty():
            common.dropped(spark, both)
            return labels.select("node", "comp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, key, n_shingles, component_id and kept of each row of docs."""
    spark = docs.sparkSession
    common.ship(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = common.bucket_bits(docs.select(doc_id), 64 << 10)
    rows = common.written(spark, sketched(docs, doc_id, text), "sketches")
    least = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "key"))
    nodes = rows.filter("node is not null").groupBy("node").agg(least.alias("rep"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"))
    nodes = common.written(spark, nodes.select("node", "size", "bands", F.nullif("rep.id", F.lit(NO_ID)).alias("rep"), "rep.key"), "nodes")
    bands = nodes.select(F.explode("bands").alias("b"), "node", "size")
    # buckets with the same members count once: their members are told by count and two sums without carry
    buckets = (
        bands.groupBy("b")
        .agg(F.min("node").alias("low"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
        .filter("n > 1")
        .groupBy("n", "x", "y", "low")
        .agg(F.min("b").alias("b"))
    )
    members = common.written(spark, bands.join(buckets.select("b", "low", "n"), "b"), "members")

    wanted = nodes.select("key", "node").join(members.select("node").distinct(), "node", "left_semi")
    table = hash_table.write_table(spark, wanted, "key", {"node": "i8"}, reps := common.scratch_path(spark, "wanted"), bits)
    texts = common.written(spark, texts_of(docs, doc_id, text, table).dropDuplicates(["node"]), "texts")
    common.dropped(spark, reps)

    # every node against the least node of each of its buckets
    stars = common.written(spark, members.filter("node <> low").select("low", "node", "size").distinct(), "stars")
    parts = stars.groupBy("low").agg(F.ceil(F.sum("size") / STAR).cast("int").alias("parts"))
    asked = stars.join(parts, "low").select(F.xxhash64("low", F.pmod(F.xxhash64("node", F.lit(7)), "parts").cast("int")).alias("grp"), F.lit(0).alias("role"), "node", F.col("node").alias("comp"))
    asking = parts.select("low", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(F.xxhash64("low", "part").alias("grp"), F.lit(1).alias("role"), F.col("low").alias("node"), F.col("low").alias("comp"))
    first = common.written(spark, verified(asked.unionByName(asking), texts, partitions, percent, close=False), "links")
    labels = components(first)

    # what is left: buckets of several components
    own = members.filter("n > 2").join(labels, "node", "left").select("b", "node", "size", F.coalesce("comp", "node").alias("comp"))
    own = common.written(spark, own, "left")
    mixed = own.groupBy("b").agg(F.min("comp").alias("a"), F.max("comp").alias("z"), F.sum("size").alias("size")).filter("a < z").select("b", F.ceil(F.col("size") / VOLUME).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node", F.lit(1)), "blocks").cast("int")
    meets = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("block")))
    left = own.join(mixed, "b").withColumn("block", block).withColumn("other", F.explode(meets))
    routes = left.select(F.xxhash64("b", F.least("block", "other"), F.greatest("block", "other")).alias("grp"), F.lit(0).alias("role"), "node", "comp")
    second = common.written(spark, verified(routes, texts, partitions, percent, close=True), "links")
    labels = components(first.union(second))

    least = nodes.join(labels, "node").groupBy("comp").agg(F.min("rep").alias("least"))
    answer = nodes.select("node", "rep").join(labels.join(least, "comp").select("node", "least"), "node", "left").select("node", F.coalesce("least", "rep").alias("component"))
    answer = common.written(spark, answer, "answer")
    common.dropped(spark, members, texts, stars, first, own, second, nodes)
    return rows.select("doc_id", "key", "n_shingles", "node").join(answer, "node", "left").select(
        "doc_id", "key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that are not kept, found by a mapped table, so that no text moves."""
    spark = docs.sparkSession
    gone = near_duplicates(docs, doc_id, text).filter("NOT kept").select("key").distinct()
    table = hash_table.write_table(spark, gone.withColumn("one", F.lit(1)), "key", {"one": "u1"}, common.scratch_path(spark, "gone"), common.bucket_bits(docs.select(doc_id), 64 << 10))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, _ = table.lookup(batch.column(batch.num_columns - 1).to_numpy())
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(~found))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.select("*", row_key(doc_id, text).alias("__key")).mapInArrow(common.released(run), schema)
