"""Rows for new tokens: bases, targets, fits, drift, certificates; and evaluation, sources and cards around them."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.functions.text import language
from corpuscle.operators import bounds, evaluation, selection, serving
from corpuscle.plans import cards, synthesis
from corpuscle.plans.model import Decoder, Shape, log_softmax
from corpuscle.plans.router import load
from corpuscle.sources import packs, resolve

MODEL = Decoder(Shape(vocab=260, d=16, layers=3, heads=2, d_ff=32))
IDS = [100, 101, 102]
CONTEXTS = [([5, 9, 30], [40, 41]), ([7], []), ([60, 61], [62]), ([], [90]), ([80, 20, 33], [34, 35])]


def test_layers_positions_and_weights():
    assert synthesis.picked_layers(6, 3) == [1, 3, 5] and synthesis.picked_layers(3, 9) == [0, 1, 2] and synthesis.picked_layers(4, 1) == [3]
    at, at2, w = synthesis.aligned(3, 2, 2)
    assert (at.tolist(), at2.tolist(), w.tolist()) == ([4, 5, 6], [3, 4, 5], [2.0, 1.0, 1.0])
    counts = {100: 900, 101: 90, 102: 10}
    w = synthesis.weights(IDS, "inverse_frequency", counts)
    assert w.sum() == pytest.approx(1) and w[2] > w[1] > w[0]
    assert synthesis.weights(IDS, "first").tolist() == [1, 0, 0] and synthesis.weights(IDS, "sum").sum() == 3
    assert np.linalg.norm(synthesis.composed(MODEL, IDS)) == pytest.approx(synthesis.mean_norm(MODEL))
    assert np.allclose(synthesis.composed(MODEL, IDS, synthesis.ZERO_SHOT), MODEL.rows(IDS).mean(0))


def test_basis_is_orthonormal_and_holds_the_run():
    b = synthesis.basis(MODEL, IDS, 8)
    assert b.shape == (16, 8) and np.allclose(b.T @ b, np.eye(8))
    rows = MODEL.rows(IDS)
    assert np.allclose(rows @ b @ b.T, rows)
    d = synthesis.directions(MODEL, 3)
    assert np.allclose(d @ d.T, np.eye(3))


def test_traces_do_not_depend_on_padding():
    seqs = [MODEL.rows([1, 2, 3]), MODEL.rows([9, 8, 7, 6, 5])]
    x, mask = MODEL.padded(seqs)
    z, states = MODEL.trace(x, mask)
    assert len(states) == 3
    for k, s in enumerate(seqs):
        z1, s1 = MODEL.trace(s[None])
        assert np.allclose(z[k, : len(s)], z1[0]) and all(np.allclose(a[k, : len(s)], b[0]) for a, b in zip(states, s1, strict=True))
    m = Decoder(Shape(vocab=20, d=8, heads=2))
    m.trace(m.rows([1, 2])[None])
    assert m.forward_tokens == 2 and m.flops() == 4 * m.n_params
    m.reset_cost()
    assert m.forward_tokens == 0


def test_fits_never_raise_the_residual():
    for config in (synthesis.Config(), synthesis.Config(solver="none"), synthesis.Config(refine_steps=3)):
        row, before, after, _ = synthesis.fit_row(MODEL, IDS, CONTEXTS, config)
        assert after <= before and row.shape == (16,)
    _, _, plain, _ = synthesis.fit_row(MODEL, IDS, CONTEXTS)
    _, _, fine, _ = synthesis.fit_row(MODEL, IDS, CONTEXTS, synthesis.Config(refine_steps=5))
    assert fine <= plain
    _, _, exact, _ = synthesis.fit_row(MODEL, [77], CONTEXTS, synthesis.Config(composition="mean", matched=False))
    assert exact == pytest.approx(0, abs=1e-12)  # a run of one token is its own row


def test_output_rows():
    _, _, _, goal = synthesis.fit_row(MODEL, IDS, CONTEXTS)
    assert len(goal.wanted) == 4  # a context without a prefix says nothing of emission
    w = synthesis.fit_output_row(MODEL, IDS, goal)
    anchor = MODEL.unembed[IDS[0]]
    assert np.linalg.norm(w - anchor) <= np.linalg.norm(anchor) * (1 + 1e-9)
    assert ((goal.hidden @ w - goal.wanted) ** 2).sum() < ((goal.hidden @ anchor - goal.wanted) ** 2).sum()
    one = synthesis.targets(MODEL, IDS, CONTEXTS[:1], [2])
    assert np.array_equal(synthesis.fit_output_row(MODEL, IDS, one), anchor)
    # the wanted logit gives the run's probability
    z = MODEL.forward(MODEL.rows([*CONTEXTS[0][0], *IDS])[None])[0][0]
    s = log_softmax(z[2:5])[np.arange(3), IDS].sum()
    wanted, total = goal.wanted[0], np.log(np.exp(z[2]).sum())
    assert wanted - np.logaddexp(total, wanted) == pytest.approx(min(s, -1e-4), abs=1e-9)


def test_drift_covers_what_follows():
    row, *_ = synthesis.fit_row(MODEL, IDS, CONTEXTS)
    got = synthesis.drift(MODEL, row, MODEL.unembed[7], IDS, *CONTEXTS[0])
    assert [r[0] for r in got] == [0, 1, 2] and got[0][5] is not None and got[1][5] is None
    assert all(r[1] <= 2 * r[3] + 1e-9 and 0 <= r[2] <= 1 for r in got)
    assert synthesis.drift(MODEL, row, None, IDS, *CONTEXTS[0])[0][5] is None
    same = synthesis.drift(MODEL, MODEL.embed[77], None, [77], *CONTEXTS[0])
    assert all(max(r[1:5]) < 1e-9 for r in same)


def test_tied_and_untied_models():
    tied = Decoder(Shape(vocab=20, d=8, heads=2), tied=True)
    assert tied.output_matrix is None and tied.row_params(3) == 24 and MODEL.row_params(3) == 96
    row = np.ones(8)
    assert tied.effective_output_row(row, None) is row and MODEL.effective_output_row(row, None) is None
    assert tied.appended(row[None], None).unembed.shape == (21, 8)
    for bad in (lambda: tied.appended(row[None], 2 * row[None]), lambda: MODEL.appended(np.ones((1, 16)), None), lambda: MODEL.appended(np.ones((1, 3)), np.ones((1, 3)))):
        with pytest.raises(ValueError):
            bad()
    assert MODEL.resized(270).shape.vocab == 270 and MODEL.resized(250).embed.shape == (250, 16)
    assert MODEL.row_norm_max == pytest.approx(np.linalg.norm(MODEL.unembed, axis=1).max())


@pytest.fixture(scope="module")
def placed(spark):
    r = np.random.default_rng(1)
    rows = [(t, k, ids, r.integers(4, 260, 1 + k % 4).tolist(), r.integers(4, 260, k % 3).tolist()) for t, ids in (("a", IDS), ("b", [50, 51])) for k in range(30)]
    rows.append(("lonely", 0, [9, 9], [], []))
    return spark.createDataFrame(rows, "token string, context long, ids array<int>, prefix array<int>, suffix array<int>")


def test_certificates(spark, placed):
    rows = synthesis.fitted(placed, MODEL).collect()
    assert {r.token for r in rows} == {"a", "b"} and all(r.after <= r.before and r.n_contexts == 30 for r in rows)
    rows = spark.createDataFrame(rows)
    off = spark.createDataFrame([(t, 0.001 * k) for t in "ab" for k in range(40)], "token string, mass double")
    limits = {"alpha": 0.2, "delta": 0.2, "least_n": 8, "max_kl": 99.0, "max_tv": 1.0, "max_off": 0.05, "max_emit": 99.0}
    got = {r.token: r for r in synthesis.certified(placed, rows, MODEL, off, **limits).collect()}
    assert all(r.accepted and r.n == 60 for r in got.values())
    again = {r.token: r for r in synthesis.certified(placed, rows, MODEL, off, **limits | {"max_off": 0.001}).collect()}
    assert {r.reason for r in again.values()} == {"offcontext_above"} and again["a"].contexts_print == got["a"].contexts_print
    none = synthesis.certified(placed.filter("token = 'a'"), rows, MODEL, off, **limits).filter("token = 'b'").first()
    assert none.reason == "too_few_measurements"
    strict = synthesis.certified(placed, rows, MODEL, off, **limits | {"max_emit": 1e-9})
    assert {r.reason for r in strict.collect()} == {"emission_above"}
    assert synthesis.certified(placed, rows, MODEL, off, **limits | {"max_emit": 1e-9}, input_only=True).filter("accepted").count() == 2


def test_all_bounds(spark, placed):
    found = synthesis.measured(placed, spark.createDataFrame(synthesis.fitted(placed, MODEL).collect()), MODEL)
    got = synthesis.bound_all(found, 0.2, 0.2, MODEL).collect()
    by = {(r.token, r.statistic, r.method): r for r in got}
    assert {m for *_, m in by} == {"conformal", "bernstein", "lipschitz"} and ("a", "emission", "conformal") in by
    assert all(r.value >= r.worst - 1e-9 for r in got if r.method == "lipschitz" and r.statistic == "kl")
    assert by["a", "linf", "lipschitz"].value >= by["a", "linf", "conformal"].worst - 1e-9
    assert all(r.mean <= r.worst and r.clip_rate <= 1 for r in got)
    said = cards.statement_table(spark.createDataFrame(got), 0.2, 0.2).collect()
    assert any("80% of positions" in r.statement for r in said) and any("never exceeds" in r.statement for r in said)


def test_probe(spark):
    lines = spark.createDataFrame([(1, 0, "abcdefgh"), (2, 0, "x"), (3, 0, "yz")], "doc_id long, pos int, text string")
    got = synthesis.strided(lines, 3).collect()
    assert [(len(r.prefix), r.following[0] - 4) for r in got] == [(1, ord("b")), (4, ord("e")), (7, ord("h")), (1, ord("z"))]
    assert synthesis.strided(lines, 1, most=5).count() == 5


def test_selected_and_medians(spark):
    r = np.random.default_rng(5)
    values = {"a": r.normal(size=1001), "b": r.integers(0, 3, 400).astype(float), "c": np.array([4.0])}
    rows = spark.createDataFrame([(k, float(v)) for k, x in values.items() for v in x], "key string, v double")
    got = {x.key: x for x in bounds.medians(rows, "key", "v").collect()}
    assert all(got[k].median == pytest.approx(np.median(v)) and got[k].n == len(v) for k, v in values.items())
    wanted = spark.createDataFrame([("a", 1001, k) for k in (1, 13, 990, 1001)], "key string, n long, k long")
    assert {x.k: x.value for x in bounds.selected(rows, wanted, "key", "v").collect()} == {k: np.sort(values["a"])[k - 1] for k in (1, 13, 990, 1001)}


def test_retrieval(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(40, 8))
    rows = [(k, v[k].tolist(), (v[k] + 0.01 * r.normal(size=8)).tolist()) for k in range(40)]
    df = spark.createDataFrame(rows, "key long, source array<double>, target array<double>")
    assert [x.hit for x in evaluation.retrieval(df, 10).collect()] == [True] * 40
    far = spark.createDataFrame([(k, s, (-np.array(s)).tolist()) for k, s, _ in rows], "key long, source array<double>, target array<double>")
    assert evaluation.retrieval(far, 10).filter("hit").count() == 0


def test_figures_of_merit(spark):
    r = spark.createDataFrame([(1.0, 0.5), (1.0, 2.0), (0.0, 1.0), (1.0, float("nan"))], "before double, after double")
    assert [x[0] for x in r.select(evaluation.residual_reduction(F.col("before"), F.col("after"))).collect()] == [0.5, 0.0, 0.0, 0.0]
    q = spark.createDataFrame([(0.5, 1.0), (2.0, 1.0), (1.0, 0.0)], "a double, b double").select(evaluation.retention(F.col("a"), F.col("b"))).collect()
    assert (q[0][0], q[1][0]) == (0.5, 1.0) and math.isnan(q[2][0])
    b = spark.createDataFrame([(0.0,), (1e8,), (1e9,)], "t double").select(evaluation.bubble(F.col("t"))).collect()
    assert [x[0] for x in b] == [60.0, 40.0, 80.0]
    empty = spark.createDataFrame([], "accepted boolean, before double, after double")
    assert evaluation.build_summary(empty).first().asDict() == {"n_entries": 0, "n_accepted": 0, "acceptance_rate": 0.0, "mean_residual_reduction": 0.0}


def test_eligible(spark):
    c = spark.createDataFrame([("en", b"ab"), ("en", b"cd")], "lang string, gram binary")
    certificates = spark.createDataFrame([("en", b"ab", True), ("en", b"cd", False)], "lang string, gram binary, accepted boolean")
    kept, rejected = selection.eligible(c, certificates)
    assert [bytes(r.gram) for r in kept.collect()] == [b"ab"] and rejected.first()[0] == 1
    assert selection.eligible(c, None)[0].count() == 2


def test_prefixes(spark):
    stored = spark.createDataFrame([(1, b"abcd"), (2, b"abcdef"), (3, b"abcdef"), (9, b"zz")], "entry long, ids binary")
    asked = spark.createDataFrame([(5, b"abcdefgh"), (2, b"abcdef"), (7, b"abc"), (8, b"zzzzz"), (6, None)], "request long, ids binary")
    got = {r.request: (r.entry, r.matched) for r in serving.longest_prefix(asked, stored).collect()}
    assert got == {5: (2, 6), 2: (2, 6), 7: (None, 0), 8: (None, 0), 6: (None, 0)}
    assert {r.request: r.entry for r in serving.longest_prefix(asked, stored, earlier=True).collect()}[2] == 1


def test_unknown_language(spark):
    rows = spark.createDataFrame([("ja",)], "c string")
    assert rows.select(language(F.col("c")).alias("l")).first().l.whitespace_delimited is False
    with pytest.raises(Exception, match="unknown language"):
        spark.createDataFrame([("xx",)], "c string").select(language(F.col("c"))).collect()


def test_parallel_chain(spark, tmp_path, monkeypatch):
    aligned = spark.createDataFrame([(x, k, f"{x} line {k}") for x, n in (("en", 4), ("fr", 3), ("de", 5)) for k in range(n)], "lang string, line_no long, text string")
    name, rows = resolve.parallel(spark, ["fr", "de"], aligned=aligned)
    assert name == "aligned" and rows.groupBy("lang").count().filter("count = 3").count() == 3
    both = resolve.pivot_for(rows)
    assert {(r.lang, r.pivot_text) for r in both.filter("line_no = 1").collect()} == {("fr", "en line 1"), ("de", "en line 1")}
    sample = tmp_path / "sample.json"
    sample.write_text(json.dumps({"sentences": {"en": ["one", "two"], "it": ["uno", "due"]}}))
    assert resolve.parallel(spark, ["it"], aligned=aligned, sample=str(sample))[0] == "sample"
    with pytest.raises(LookupError):
        resolve.parallel(spark, ["sw"], sample=str(sample))
    pairs = tmp_path / "fr.tsv"
    pairs.write_text("".join(f"une phrase assez longue {k}\tone sentence long enough {k}\n" for k in range(5)) + "x\ty\n\tempty\n")
    monkeypatch.setenv("CORPUSCLE_PAIRS_FR", str(pairs))
    name, rows = resolve.parallel(spark, ["fr"])
    assert name == "pairs" and rows.count() == 5
    assert resolve.pivot_for(rows).filter("pivot_text like 'one sentence%'").count() == 5
    assert resolve.languages_of(aligned) == ["de", "en", "fr"] and resolve.negative_lines(aligned, ["de"]).count() == 5


def test_packs_cards_and_checkpoints(spark, tmp_path):
    entries = spark.createDataFrame([("en", 1, "7468", 9, True, {"kl": 0.1}, 260), ("en", 2, "6865", 5, True, {"kl": 0.2}, 261)], packs.ENTRY + ", new_id long")
    assert evaluation.publish_problems(entries).first().problems == []
    bad = spark.createDataFrame([("en", 1, "7468", 9, False, {"kl": float("inf")}), ("en", 2, "7468", 5, True, {})], packs.ENTRY)
    assert len(evaluation.publish_problems(bad).first().problems) == 4
    maps = cards.pack_maps(entries, 260).first()
    assert maps.new_ids == {"7468": 260, "6865": 261} and maps.expansions == {260: "7468", 261: "6865"}
    assert json.loads(cards.manifest_row(entries).first().manifest)["n_entries"] == 2
    built = spark.createDataFrame([(True, 2.0, 1.0), (False, 1.0, 1.0)], "accepted boolean, before double, after double")
    stages = spark.createDataFrame([("fit", 10.0, 1.0), ("fit", 5.0, 1.0), ("certify", 1.0, 2.0)], "stage string, flops double, seconds double")
    m = json.loads(cards.build_manifest(built, stages).first().manifest)
    assert (m["acceptance_rate"], m["mean_residual_reduction"], m["total_flops"], m["total_seconds"], [s["stage"] for s in m["stages"]]) == (0.5, 0.25, 16.0, 4.0, ["certify", "fit"])
    assert cards.publish_card(entries, False).startswith("> **Not certified.**") and "worst bound" in cards.publish_card(entries, True)
    packs.write_surfaces(entries, path := f"{tmp_path}/surfaces")
    assert spark.read.json(path).first().tokens.asDict() == {"th": 260, "he": 261}
    packs.write_assets({"rows": stages}, path := f"{tmp_path}/assets")
    assert len(json.loads(spark.read.text(f"{path}/rows").first()[0])) == 3
    packs.write_rows(stages, path := f"{tmp_path}/rows")
    assert packs.read_rows(spark, path, "stage string, missing int").filter("missing is null").count() == 3
    r = load({"en": [(120, 108)]})
    cards.write_checkpoint(spark, r.model, r.vocabulary, path := f"{tmp_path}/model")
    rows, views = cards.read_checkpoint(spark, path)
    assert rows.count() == 261 and rows.filter("lang = 'en'").first().id == 260
    assert {v.view: v.closed for v in views.collect()} == {"base": [260], "en": [], "en:in": [260]}
    made = synthesis.pack_from_tokens(MODEL, "en", [(120, 108)], spark).first()
    assert made.gram_hex == "7468" and made.bounds["kl"] == float("inf")
    report = evaluation.throughput(spark.createDataFrame([("base", 3, 2, 0.1, 0.1, 1.0)], "view string, prompt_tokens long, made_tokens long, tokenize_seconds double, mask_seconds double, wall_seconds double"), ["view"])
    assert "| base |" in cards.serving_table(report)


def test_saved_models_and_vectors(spark, tmp_path):
    for model in (MODEL, Decoder(Shape(vocab=30, d=8, heads=2), tied=True)):
        model.save(path := f"{tmp_path}/model.npz")
        back = Decoder.load(path)
        x = model.rows([1, 2, 3])[None]
        assert np.array_equal(back.forward(x)[0], model.forward(x)[0]) and (back.tied, back.shape) == (model.tied, model.shape)
    entries = spark.createDataFrame([("en", 1, "7468", 9, True, {"kl": 0.1})], packs.ENTRY)
    vectors = spark.createDataFrame([("7468", [0.5], [0.25])], "token string, row array<double>, out_row array<double>")
    packs.write_pack(entries, f"{tmp_path}/p", vectors=vectors)
    assert packs.read_vectors(spark, f"{tmp_path}/p").first().row == [0.5]


def test_small_operators(spark):
    from corpuscle.operators import corpus, mining

    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "k string, at int, v string")
    assert sorted(r.v for r in corpus.first_of_each(rows, "k", "at").collect()) == ["x", "z"]
    assert sorted(r.v for r in corpus.last_of_each(rows, "k", "at").collect()) == ["y", "z"]
    one = spark.createDataFrame([([5, 0, 7], {"kl": 0.5})], "ids array<int>, bounds map<string,double>")
    got = one.select(mining.key(F.col("ids")).alias("key"), bounds.value_of(F.col("bounds"), "kl").alias("v"), bounds.holds(F.lit(0.5), F.lit(0.5)).alias("h")).first()
    assert (got.key, got.v, got.h) == ("5-0-7", 0.5, True)
    with pytest.raises(Exception, match="no bound of tv"):
        one.select(bounds.value_of(F.col("bounds"), "tv")).collect()


def test_lazy_names():
    import corpuscle

    assert corpuscle.Decoder is Decoder and "load" in corpuscle.__all__
    with pytest.raises(AttributeError):
        corpuscle.nothing
