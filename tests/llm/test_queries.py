"""The opN_ queries over a small directory of tables, each against a plain reading of its contract."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from corpuscle.llm import bpe, queries
from tests.llm.conftest import make_docs
from tests.llm.test_duplicates import brute, jaccard, shingles
from tests.llm.test_mix_and_shards import water

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LIBRARY = Tokenizer.from_file(bpe.default_path())
ROWS = list({r[0]: r for r in make_docs(40, seed=9) if r[0] is not None}.values())
TEXT = {r[0]: r[1] or "" for r in ROWS}


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("small")
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, k % 2, 0) for k, i in enumerate(TEXT)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")

    def run(name, types):
        df = queries.QUERIES[name](spark, str(out))
        kinds = dict(df.dtypes)
        assert {c: kinds[c] for c in types} == types
        rows = df.collect()
        assert sorted(r.doc_id for r in rows) == sorted(TEXT)
        return {r.doc_id: r for r in rows}

    return run


def ids_of(t):
    return np.array(LIBRARY.encode(t, add_special_tokens=False).ids, "<u4")


def test_op2(result):
    for i, r in result("op2_bpe", {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}).items():
        ids = ids_of(TEXT[i])
        back = LIBRARY.decode(ids.tolist(), skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_op3(result):
    got, at = result("op3_repair", {"start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}), 0
    for i in sorted(TEXT):
        ids = np.append(ids_of(TEXT[i]), np.uint32(2)).astype("<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_op4(result):
    got = result("op4_sharding", {"size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"})
    slots = collections.defaultdict(list)
    for i, r in got.items():
        b = TEXT[i].encode()
        assert (r.size, r.text_crc32, r.law) == (len(b) + 1, zlib.crc32(b), "key") and r.grown_shard in (r.shard, 8) and 0 <= r.shard < 8
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op5(result):
    words = {i: [*(w.encode().lower() for w in WORD.findall(t)), None] for i, t in TEXT.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in TEXT}
    c = collections.Counter(w for i, x in words.items() if not held[i] for w in x)
    n, v = sum(c.values()), len(c)
    for i, r in result("op5_lm", {"held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"}).items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(words[i]), sum(c[w] > 0 for w in words[i]), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words[i]))
        assert r.score < 0


def test_op6(result):
    got = result("op6_neardup", {"n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"})
    assert sorted((str(i), r.n_shingles, str(r.component_id)) for i, r in got.items()) == brute(ROWS)
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_op7(result):
    for i, r in result("op7_classifier", {"held_out": "boolean", "score": "double", "predicted": "int"}).items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


def test_op8(result):
    got = result("op8_mixing", {"size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"})
    source = {r[0]: r[3] for r in ROWS}
    sizes = dict.fromkeys(source.values(), 0)
    for i, t in TEXT.items():
        sizes[source[i]] += len(WORD.findall(t))
    want, taken = water(sizes), collections.Counter()
    for i, r in got.items():
        assert r.size == len(WORD.findall(TEXT[i])) and r.source_size == sizes[source[i]] and r.target == pytest.approx(want[source[i]]) and 0 <= r.taken <= 2 * r.size
        taken[source[i]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_op10(result):
    got = result("op10_fingerprint", {"n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"})
    order = sorted(TEXT, reverse=True)
    for k, i in enumerate(order):
        t, after = TEXT[i], TEXT[order[(k + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_next - jaccard(shingles(t, False), shingles(after, False))) < 0.25 and abs(r.near_edited - jaccard(shingles(t, False), shingles(edited, False))) < 0.25
