import collections
import re
import zlib

import numpy as np

import corpus_pipeline
from corpuscle.llm import common, mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_shards(docs, rows, empty, wide, spark, tmp_path):
    got = sharding.assign(docs, 8).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    again = {(str(r.doc_id), r.shard) for r in sharding.assign(wide.repartition(3), 8).collect()}
    assert again == {(str(r.doc_id), r.shard) for r in got}
    assert sharding.assign(empty, 8).collect() == []
    sharding.write_shards(docs, f"{tmp_path}/s", 8)
    assert {(str(r.doc_id), r.shard) for r in spark.read.parquet(f"{tmp_path}/s").select("doc_id", "shard").collect()} == again


def test_jump_moves_only_into_the_new_shard():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 20_000).astype(np.uint64)
    old, new = sharding.jump(keys, 10), sharding.jump(keys, 11)
    moved = old != new
    assert (new[moved] == 10).all() and 0.07 < moved.mean() < 0.11
    assert np.bincount(old).min() > 1700


def test_jump_equals_the_scalar_definition():
    def one(key, shards):
        b, j = -1, 0
        while j < shards:
            b = j
            key = (key * 2862933555777941757 + 1) % (1 << 64)
            j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    keys = [0, 1, (1 << 64) - 1, *np.random.default_rng(1).integers(0, 1 << 63, 500).tolist()]
    for shards in (1, 2, 8, 9, 1000):
        assert sharding.jump(np.array(keys, np.uint64), shards).tolist() == [one(k, shards) for k in keys]


def water(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, out, live = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while live:
        level = left / sum(weight[s] for s in live)
        full = [s for s in live if weight[s] * level > 2 * sizes[s]]
        if not full:
            return out | {s: weight[s] * level for s in live}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            live.discard(s)
    return out


def test_mix(docs, rows, empty, wide, monkeypatch):
    got = mixing.curriculum(docs).collect()
    again = mixing.curriculum(wide.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken, r.position, r.again)
    assert sorted(map(key, got), key=str) == sorted(map(key, again), key=str)
    count = lambda t: len(WORD.findall(t or ""))
    sizes, source = collections.Counter(), {}
    for i, t, _, s, _ in rows:
        sizes[s] += count(t)
        source[i] = s
    want = water(sizes)
    taken = collections.Counter()
    for r in got:
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 and r.source_size == sizes[source[r.doc_id]]
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    monkeypatch.setattr(mixing.common, "bucket_bits", lambda *a, **k: 11)  # more parts, the same order
    assert sorted(map(key, mixing.curriculum(docs).collect()), key=str) == sorted(map(key, got), key=str)
    positions = [r.position for r in got if r.position is not None]
    assert positions == sorted(positions) and positions[0] >= 0 and positions[-1] <= sum(taken.values())
    assert mixing.curriculum(empty).collect() == []


def test_positions_invert_the_demand(docs, rows):
    """Each pass stands where the sources' demand, integrated step by step, has reached its first word."""
    found = mixing.laid_out(docs, ["doc_id", "source"]).collect()
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    goal = {r.source: round(r.target) for r in found}
    slope = {s: mixing.SCHEDULES[k % 3] for k, s in enumerate(names)}
    steps = 20_000
    times = (np.arange(steps) + 0.5) / steps
    rate = {s: goal.get(s, 0) * (a + (b - a) * times) / ((a + b) / 2) / steps for s, (a, b) in slope.items()}
    demand = {s: np.concatenate(([0], np.cumsum(r))) for s, r in rate.items()}
    whole = sum(demand.values())
    by_source = collections.defaultdict(list)
    for r in found:
        for k, p in enumerate(r.passes):
            by_source[r.source].append((k, p.position, p.words, r.doc_id))
    for s, passes in by_source.items():
        at = 0
        for k, position, words, _ in sorted(passes, key=lambda p: (p[0], p[1])):
            due = np.interp(at, demand[s], np.arange(steps + 1))
            assert abs(np.interp(due, np.arange(steps + 1), whole) - position) < 1e-3 * whole[-1] + 1
            at += words
        assert at == goal[s] and len({p[0] for p in passes}) == (2 if goal[s] > sum(r.size for r in found if r.source == s) else 1)


def test_sources_without_words(spark, docs, empty):
    schema = docs.schema
    got = {r.doc_id: r for r in mixing.curriculum(docs).collect()}
    assert all((got[4100 + k].size, got[4100 + k].target, got[4100 + k].taken, got[4100 + k].position) == (0, 0.0, 0, None) for k in range(3))
    for texts in ([None, None], ["", " \n"], [None, ""]):
        bare = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], schema)
        assert [(r.size, r.target, r.taken) for r in mixing.curriculum(bare).collect()] == [(0, 0.0, 0)] * 2
        assert mixing.mixed(bare).collect() == []
    out = bare
    for name, stage in corpus_pipeline.STAGES:
        out = common.written(spark, stage(spark, out, ""), name)
    assert out.count() == 0


def test_mixed_rows(docs, wide, empty, rows):
    out = mixing.mixed(wide)
    assert out.columns == wide.columns
    words = sum(len(WORD.findall(r.text)) for r in out.select("text").collect())
    assert words == sum(r.taken for r in mixing.curriculum(docs).collect())
    whole = {t for _, t, *_ in rows}
    assert sum(r.text not in whole for r in out.collect()) <= 4  # one cut a source
    assert mixing.mixed(empty).collect() == []


def test_pipeline_keeps_columns_and_copies_go(spark, wide, tmp_path):
    docs = wide
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = common.written(spark, stage(spark, docs, ""), name)
        if k < 4:
            assert out.columns == wide.columns
        if name == "near_dedup":
            seen = [r.doc_id for r in out.select("doc_id").collect()]
            assert sum(i in range(2000, 2005) or i == 27 for i in seen) <= 1
        docs = out
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and docs.count() > 0


def test_pipeline_without_rows(spark, empty):
    docs = empty
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(spark, stage(spark, docs, ""), name)
    assert docs.count() == 0
