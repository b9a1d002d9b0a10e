import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.catalog import QUERIES
from corpuscle.plans.build import Plan, build, run_build
from corpuscle.plans.model import Decoder, Shape, compose, drift_of, log_softmax, off_context, output_row, synthesize
from corpuscle.streaming.prefix_cache import Cache, serve

MODEL = Decoder(Shape(vocab=40, d=16, layers=2, heads=2, d_ff=24))


def test_batch_equals_alone():
    prompts, everything = [[1, 2, 3], [4], [5, 6, 7, 8, 9]], np.ones(40, bool)
    odd = np.arange(40) % 2 == 1
    views = [everything, odd, odd]
    together = MODEL.generate(prompts, views, 4)
    assert together == [MODEL.generate([p], [v], 4)[0] for p, v in zip(prompts, views, strict=True)]
    assert all(t % 2 for t in together[1] + together[2])


def test_generation_reads_whole_prompts():
    r = np.random.default_rng(3)
    prompts = [r.integers(0, 40, n).tolist() for n in (1, 130, 300, 129)]
    made = MODEL.generate(prompts, [np.ones(40, bool)] * 4, 3)
    for p, m in zip(prompts, made, strict=True):
        seq = list(p)
        for token in m:  # without a cache
            assert token == MODEL.forward(MODEL.rows(seq)[None])[0][0, -1].argmax()
            seq.append(token)


def test_generate_batch_uses_every_turn_whole(spark, tmp_path):
    rows = [(k, t, "user", f"the same opening {'abc' * (20 * k + t)} {k}{t} end") for k in range(4) for t in range(3)] + [(9, 0, "user", None), (9, 1, "user", "")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.request: r.made for r in QUERIES["generate_batch"](spark, str(tmp_path)).collect()}
    model, may = Decoder(), {0: np.ones(260, bool), 1: np.isin(np.arange(260), np.arange(101, 127))}
    want = {k * 1000 + t: model.generate([[b + 4 for b in text.encode()]], [may[k % 2]], 3)[0] for k, t, _, text in rows if text is not None}
    assert got == {k: ",".join(map(str, m)) for k, m in want.items()}


def test_appending_keeps_rows_and_logits():
    new = MODEL.appended(np.ones((2, 16)), np.ones((2, 16)))
    assert (new.embed[:40] == MODEL.embed).all() and new.shape.vocab == 42 and new.n_params == MODEL.n_params + 64
    x = MODEL.rows([3, 4, 5])[None]
    assert np.allclose(new.forward(x)[0][..., :40], MODEL.forward(x)[0])
    with pytest.raises(ValueError):
        MODEL.appended(np.ones((1, 3)), np.ones((1, 3)))


def test_synthesis_never_raises_the_residual():
    for seed in range(4):
        row, before, after = synthesize(MODEL, [3, 9], [([1, 2], [4, 5]), ([7], [8]), ([11, 12], [2])], seed=seed)
        assert after <= before and row.shape == (16,)
    assert np.linalg.norm(compose(MODEL, [3, 9])) == pytest.approx(np.linalg.norm(MODEL.embed, axis=1).mean())


def test_drift_of_the_run_itself_is_nothing():
    kl, tv, linf = drift_of(MODEL, MODEL.embed[5], [5], [1, 2], [])
    assert kl < 1e-12 and tv < 1e-9 and linf < 1e-9


def test_output_row_stays_near_the_first_id():
    row = output_row(MODEL, [3, 9], [[1, 2], [7], [11, 12], [5]])
    assert 0 < np.linalg.norm(row - MODEL.unembed[3]) <= np.linalg.norm(MODEL.unembed[3]) + 1e-9
    assert (output_row(MODEL, [3, 9], [[1]]) == MODEL.unembed[3]).all()


def test_off_context_mass_equals_the_appended_model(spark):
    w = np.full(16, 0.3)
    probe = spark.createDataFrame([([1, 2, 3], [4, 5]), ([6], [3, 9, 1]), ([7, 8], [3])], "prefix array<int>, following array<int>")
    rows = spark.createDataFrame([("t", [3, 9], w.tolist())], "token string, ids array<int>, out_row array<double>")
    got = sorted(r.mass for r in off_context(probe, rows, MODEL).collect())
    new = MODEL.appended(np.zeros((1, 16)), w[None])
    want = sorted(float(np.exp(log_softmax(new.forward(new.rows(p)[None])[0][0, -1])[40])) for p in ([1, 2, 3], [7, 8]))  # the run follows [6]
    assert got == pytest.approx(want)


def test_build_refuses_tokens_that_fire_out_of_context(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    loose = dict(max_kl=1e9, max_tv=1.0, least_n=1, max_emit=1e9, longest=3)
    got = {m: build(docs, Decoder(), Plan(**loose, max_off=m)).collect() for m in (0.0, 1.0)}
    passed = {r.gram_hex for r in got[1.0] if r.accepted}
    assert passed and {r.gram_hex for r in got[0.0] if r.reason == "offcontext_above"} == passed


def test_build_mines_runs_of_eight_bytes(spark):
    rows = [(k, "fr", f"{k}bonsoir!{k * 7}") for k in range(60)]
    built = run_build(spark.createDataFrame(rows, "doc_id long, lang string, text string"), Decoder())
    assert b"bonsoir!".hex().upper() in {r.gram_hex for r in built.entries.collect()}
    stages = {r.stage: r for r in built.stages.collect()}
    assert set(stages) == {"mine", "fit", "certify", "select"} and stages["fit"].flops > 0 and all(r.seconds > 0 for r in stages.values())
    assert '"acceptance_rate"' in built.manifest()


def test_logprob_sums_to_one():
    assert sum(np.exp(MODEL.logprob([k], open_ids=np.ones(40, bool))) for k in range(40)) == pytest.approx(1)


def test_cache_evicts_fewest_hits_then_oldest():
    cache = Cache(None, 2, 2)
    for entry, ids in enumerate((b"abc", b"abcde", b"xyz")):
        cache.lookup(ids)
        cache.insert(ids, entry)
    assert set(cache.held) == {b"abc", b"xyz"}  # abc was hit once
    assert cache.lookup(b"abcdef") == (0, 3) and cache.insert(b"x", 9) == 0
    assert set(Cache(cache.state(), 2, 2).held) == {b"abc", b"xyz"}


def test_stream_equals_replay(spark, tmp_path):
    r = np.random.default_rng(1)
    rows = [("one", k, bytes(r.integers(97, 99, r.integers(1, 9)).tolist())) for k in range(80)]
    for part in range(4):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], "cache string, request long, ids binary").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("cache string, request long, ids binary").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    job = serve(stream, most=5, least=2).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    got = {x.request: (x.entry, x.matched, x.evicted) for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    cache, want = Cache(None, 5, 2), {}
    for _, k, ids in rows:
        entry, n = cache.lookup(ids)
        want[k] = (entry, n, cache.insert(ids, k))
    assert got == want
    assert spark.read.parquet(f"{tmp_path}/out").filter(F.col("matched") > 0).count() > 5
