"""Merging many sequences at once, and its queries: against the trie, and one pass in bounded batches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle import catalog, catalog_views
from corpuscle.operators import corpus, merge, tokenizers
from corpuscle.operators.augmented import Augmented
from corpuscle.plans.router import load
from tests.test_views import PATH


@pytest.mark.parametrize("shift, most", [(0, 256), (0xD7FE, 256), (0, 1), (-2, 256), (0x110000, 256)])
def test_merger_equals_trie(monkeypatch, shift, most):
    monkeypatch.setattr(merge, "REGEX_MOST", most)  # 1: all goes through the trie; so do ids that are no code points
    r = random.Random(3)
    patterns = {tuple(shift + i for i in run): 5000 + k for k, run in enumerate([(1, 2), (1, 2, 3), (2, 2), (2, 2, 2), (3, 1, 2, 4), (10, 42), (46, 42)])}
    rows = [np.array([shift + r.choice([1, 2, 3, 4, 10, 42, 46]) for _ in range(r.randint(0, 30))]) for _ in range(60)] + [None, np.zeros(0, int)]
    trie = merge.Trie(patterns)
    made, ends = merge.Merger(patterns)(*merge.flat(rows))
    want = [trie.merge([] if x is None else x.tolist()) for x in rows]
    assert [made[a:b].tolist() for a, b in zip(ends, ends[1:])] == want
    back, edges = merge.Expander({new: run for run, new in patterns.items()})(made, ends)
    assert [back[a:b].tolist() for a, b in zip(edges, edges[1:])] == [[] if x is None else x.tolist() for x in rows]
    assert merge.changed(*merge.flat(rows), back, edges) == 0 and merge.changed(*merge.flat(rows), made, ends) == sum(len(w) != (0 if x is None else len(x)) for w, x in zip(want, rows))


def test_audit_counts_violations(spark):
    rows = spark.createDataFrame([([1, 2, 3],), ([7, 300, 1],), (None,), ([],)], "ids array<int>")
    assert merge.audit(rows, "ids", {(1, 2): 260}, 260).first().asDict() == {"n_lines": 4, "not_lossless": 0, "longer": 0, "outside_view": 1, "not_appended": 0}
    assert merge.audit(rows, "ids", {(1, 2): 7}, 5).first().asDict() == {"n_lines": 4, "not_lossless": 1, "longer": 0, "outside_view": 1, "not_appended": 0}


def test_isolation_is_one_pass(spark, monkeypatch):
    texts = [("en", "the theme and the thing"), (None, "über the"), ("en", "the theme and the thing"), ("de", "enter\x1f entente"), ("fr", "tou de le"), ("fr", None), ("de", "")]
    rows, vocab = spark.createDataFrame(texts, "lang string, text string"), catalog_views.vocabulary()
    views = {name: vocab.view(*langs) for name, langs in catalog_views.VIEWS.items()}
    made = vocab.isolation(rows, views)
    want = {}
    for name, view in views.items():
        trie, own = merge.Trie(vocab.patterns(view)), set(vocab.patterns(view).values())
        for lang, text in texts:
            if text is not None:
                ids = trie.merge([b + 4 for b in text.encode()])
                n, new, bad = want.get((name, lang), (0, 0, 0))
                want[name, lang] = n + len(ids), new + sum(i in own for i in ids), bad
    assert {(r.view, r.lang): (r.n_tokens, r.n_new, r.not_lossless) for r in made.collect()} == want
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    monkeypatch.setattr(Augmented, "patterns", lambda self, view: {(8 + 97, 8 + 97): 999})  # an id of no pack, which stands for nothing
    lost = vocab.isolation(spark.createDataFrame([("x", "eeee eeee"), ("x", "ee"), ("x", "u")], "lang string, text string").limit(3), {"odd": vocab.view("en")})
    assert lost.first().not_lossless == 2


def test_requests_of_all_views_in_one_stage(spark):
    """One Python step for all views of a router, and counts without ids."""
    router = load({lang: [tuple(b + 4 for b in run) for run in runs] for lang, runs in catalog_views.PACKS.items()})
    rows = spark.createDataFrame([(k, view, t) for k, view in enumerate(router.names) for t in ("the entente of le monde", "", None)], "request int, view string, text string")
    made = rows.select("view", "text", router.encode(F.col("text"), F.col("view")).alias("ids"), router.count(F.col("text"), F.col("view")).alias("n")).withColumn("back", router.decode(F.col("ids")))
    for r in made.collect():
        assert r.back == r.text and (r.ids is None) == (r.n is None) == (r.text is None)
        assert r.text is None or r.ids == (router.ids(r.text, r.view) if r.text else []) and r.n == len(r.ids)
    counts = rows.select(router.count(F.col("text"), F.col("view")).alias("n"))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("run(") == 1


def test_words_have_the_pieces_of_their_text():
    t = tokenizers.Subword(PATH)
    split, words = t._cutters()
    odd = ["plain words here", "two  spaces   three", " lead and trail ", "tab\t x", "nbsp  x y", "sep\x1c x", "it's we 've  'll", "a  b", "x  y", "1 2,3 -- é 日本 語", "", " ", "a b\u0085 c"]
    r = random.Random(1)
    odd += ["".join(r.choice("ab1'  \t.é") for _ in range(40)) for _ in range(300)]
    for text in odd:
        assert [p for w in words(text) for p in split(w)] == split(text) and "".join(words(text)) == text
    assert len(words("plain words here")) == 3


@pytest.mark.parametrize("most", [1, 1 << 19])
def test_totals_by_groups(spark, monkeypatch, most):
    t, texts = tokenizers.Subword(PATH), ["plain words here and here", "two  spaces", None, "", "it's 日本 語"] * 5
    rows = spark.createDataFrame([(k % 3 or None, "xy"[k % 2], x) for k, x in enumerate(texts)], "a int, b string, text string")
    monkeypatch.setattr(tokenizers, "MOST_HELD", most)
    want = {}
    for k, x in enumerate(texts):
        want[k % 3 or None, "xy"[k % 2]] = want.get((k % 3 or None, "xy"[k % 2]), 0) + len(t.handle.encode(x or "", add_special_tokens=False).ids)
    made = t.totals(rows, ["a", "b"])
    assert {(r.a, r.b): r.n_tokens for r in made.collect()} == want
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2  # lines are cut once


def test_trained_counts_are_not_in_hex(spark):
    merges = [("61", "61", 9), ("61", "6161", 8), ("6161", "61", 7), ("C3", "A9", 6), ("616161", "C3A9", 5)]
    rows = spark.createDataFrame([("aaa",), ("aaaaaaaéaaé",), ("",), (None,), ("ÿĀ aaaé",)], "text string")
    made = rows.select(tokenizers.bpe_symbols(F.col("text"), merges).alias("s"), tokenizers.bpe_count(F.col("text"), merges).alias("n"))
    assert [(r.s is None, r.n) for r in made.collect()] == [(r.s is None, None if r.s is None else r.s.count("<")) for r in made.collect()]
    assert "hex" not in rows.select(tokenizers.bpe_count(F.col("text"), merges))._jdf.queryExecution().optimizedPlan().toString()


def test_numbering_spreads_a_language(spark):
    """Six thousand dense documents are more than one span, numbered on."""
    rows = corpus.numbered(spark.range(6000).selectExpr("id AS doc_id", "'x' AS lang", "0 AS pos", "'t' AS text"))
    assert rows.filter("line_no <> doc_id OR n_lines <> 6000").count() == 0
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("4096") >= 1


def test_pairs_do_not_meet_by_language(spark):
    """Lines are joined by their number; no join sends a language's pairs to one task, whatever the planner takes for small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = [("xy"[k % 2], k, "a" * (10 + k % 7), "b" * (10 + k % 5)) for k in range(40)] + [("x", 99, "a" * 400, "b" * 12)]
        kept = corpus.clean_bitext(spark.createDataFrame(pairs, "lang string, line_no long, text string, pivot_text string"))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") >= 2 and kept.count() == 40
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_generation_from_bytes_is_one_step(spark):
    from corpuscle.functions.text import byte_ids
    from corpuscle.plans.model import Decoder, generated

    rows = spark.createDataFrame([(k, "base", t.encode()) for k, t in enumerate(["the", "", "über and über", "a b c"])], "request long, view string, ids binary")
    views = {"base": list(range(260))}
    got = generated(rows, Decoder(), views, 2)
    want = generated(rows.withColumn("ids", byte_ids(F.col("ids"))), Decoder(), views, 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    query = catalog.QUERIES["generate_batch"](spark, "/root/testdata/sf0.001")
    assert "ArrowEvalPython" not in query._jdf.queryExecution().executedPlan().toString()
