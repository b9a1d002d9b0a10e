"""Vocabularies with packs and views, subword tokenizers, trained BPE, the router."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.operators import merge, tokenizers
from corpuscle.operators.augmented import Augmented, View, attach_and_verify
from corpuscle.plans.model import Decoder, Shape
from corpuscle.plans.router import Router, load

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["the theme of the day", "là où tion", "", "日本 the", "thethe the"]
run = lambda t: tuple(b + 4 for b in t.encode())


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate([*TEXTS, None])), "i int, text string")


def vocabulary():
    v = Augmented()
    v.attach("en", [run("the"), run("th"), run(" the")])
    v.attach("fr", [run("ou"), run("tion"), run("the")])
    return v


def test_ids_are_appended_and_views_are_apart():
    v = vocabulary()
    assert v.packs["en"] == {run("the"): 260, run("th"): 261, run(" the"): 262} and v.packs["fr"][run("the")] == 265
    assert (v.total_size, v.n_added, v.langs) == (266, 6, ["en", "fr"])
    assert [x.name for x in v.views()] == ["base", "en", "en:in", "fr", "fr:in"]
    assert View().is_base and not v.view("en").is_base and v.view("fr", "en", input_only=True).name == "en+fr:in"
    assert v.patterns(v.view("en", "fr"))[run("the")] == 265  # the later language wins
    assert v.open_ids(View()).sum() == 260 and v.open_ids(v.view("en")).sum() == 263 and v.open_ids(v.view("en", input_only=True)).sum() == 260
    assert set(np.flatnonzero(np.isinf(v.mask(v.view("fr"))))) == {260, 261, 262}
    assert not any(v.check().values())


def test_attach_refuses():
    v = vocabulary()
    for bad in (lambda: v.attach("en", [run("ab")]), lambda: v.attach("de", [run("ab")], base_size=300), lambda: v.attach("it", [(5,)]), lambda: v.attach("pt", [(5, 260)])):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        Augmented(base_print="a").attach("de", [run("ab")], base_print="b")
    with pytest.raises(KeyError):
        v.view("xx")


def test_tokens_outside_a_pack_and_twice():
    v = vocabulary()
    v.add_tokens("en", [run("th")])
    assert v.total_size == 267 and v.patterns(v.view("en"))[run("th")] == 266 and v.expansion(261) == run("th")
    assert v.surface(266) == "th" and v.surface(70) == "" and v.lang_of(263) == "fr" and v.lang_of(9) == ""
    with pytest.raises(KeyError):
        v.expansion(70)


def test_encoding_under_views_comes_back(texts):
    v = vocabulary()
    for view in (View(), v.view("en"), v.view("fr"), v.view("en", "fr")):
        trie = merge.Trie(v.patterns(view))
        got = texts.select("text", v.encode(F.col("text"), view).alias("ids")).select("text", "ids", v.decode(F.col("ids")).alias("back"), v.to_base(F.col("ids")).alias("base"), v.surfaces_of(F.col("ids")).alias("s"), v.langs_of(F.col("ids")).alias("l"), v.pieces(F.col("ids")).alias("p")).collect()
        for r in got:
            if r.text is None:
                assert r.ids is None
                continue
            assert r.back == r.text and r.base == [b + 4 for b in r.text.encode()]
            assert r.ids == trie.merge([b + 4 for b in r.text.encode()])
            assert r.s == [v.surface(i) for i in r.ids] and r.l == [v.lang_of(i) for i in r.ids]
            assert r.p == [f"[{v.surface(i)}]" if i >= 260 else f"<{i - 4:02x}>" for i in r.ids]
    other = vocabulary()
    assert v.fingerprint(["the"]) == other.fingerprint(["the"])
    other.add_tokens("de", [run("er")])
    assert v.fingerprint(["the"]) != other.fingerprint(["the"])


def test_large_packs_merge_alike(texts):
    rows = texts.select("text", F.encode("text", "utf-8").alias("b"))
    few = [b"the", b"th", b"he", b" the", b"theme"]
    many = [*few, *(bytes([a, b, 200]) for a in range(200, 220) for b in range(200, 220))]
    assert len(many) > merge.REGEX_MOST
    a, b = (rows.select(merge.merged_size(F.col("b"), x).alias("n"), merge.spans(F.col("b"), x).alias("s")).collect() for x in (few, many))
    assert a == b


def test_subword_equals_library(texts):
    t = tokenizers.Subword(PATH)
    got = texts.select("i", "text", t.encode(F.col("text")).alias("ids")).select("*", t.decode(F.col("ids")).alias("back"), t.pieces(F.col("ids")).alias("p"), t.count(F.col("text")).alias("n")).collect()
    for r in got:
        want = t.handle.encode(r.text or "", add_special_tokens=False)
        assert r.ids == want.ids and r.p == want.tokens and r.back == (r.text or "") and r.n == len(want.ids)
    assert t.size == t.handle.get_vocab_size() and t.fingerprint(["a b"]) == tokenizers.Subword(PATH).fingerprint(["a b"]) != t.fingerprint(["a c"])
    totals = t.totals(texts.withColumn("g", F.col("i") % 2), ["g"]).collect()
    assert {r.g: r.n_tokens for r in totals} == {g: sum(r.n for r in got if r.i % 2 == g) for g in (0, 1)}


def test_trained_bpe(spark):
    rows = spark.createDataFrame([("aaab aaab aab",), ("aab ba",)], "text string")
    merges = tokenizers.train_bpe(rows, 3)
    assert merges[0] == ("61", "61", 6)  # pairs of aaab count twice
    plain = rows.select(tokenizers.bpe_symbols(F.col("text"), merges).alias("s"), tokenizers.bpe_count(F.col("text"), merges).alias("n")).collect()
    for r, (t,) in zip(plain, rows.collect(), strict=True):
        parts = r.s[1:-1].split("><")
        assert bytes.fromhex("".join(parts)).decode() == t and r.n == len(parts) < len(t)
    assert tokenizers.train_bpe(rows.limit(0), 3) == []


def test_router():
    r = load({"en": [run("the"), run("ing")], "fr": [run("ou")]})
    assert r.names == ["base", "en", "en:in", "fr", "fr:in"] and r.model.shape.vocab == 263
    requests = [("the thing", "en"), ("the thing", "base"), ("ou bien", "fr"), ("ou", "fr:in"), ("a", "en:in")]
    together = r.batch_generate(requests, 4)
    assert together == [r.generate(t, v, 4) for t, v in requests]
    for (_, v), made in zip(requests, together, strict=True):
        assert all(r.vocabulary.open_ids(r.view(v))[i] for i in made)
    assert np.isinf(r.logits(r.ids("the", "fr"), "fr")[260])
    assert len(r.ids("the thing", "en")) < len(r.ids("the thing", "base")) == 9
    with pytest.raises(KeyError):
        r.view("xx")
    with pytest.raises(ValueError):
        Router(Decoder(), r.vocabulary)
    times = r.timed(requests, 2)
    assert {x["view"] for x in times} == {v for _, v in requests} and all(x["wall_seconds"] >= x["tokenize_seconds"] + x["mask_seconds"] for x in times)


def test_router_columns(spark):
    r = load({"en": [run("the")]})
    rows = spark.createDataFrame([(1, "en", "the x"), (2, "base", "the x")], "request long, view string, text string")
    got = {x.request: x for x in rows.select("request", r.encode(F.col("text"), F.col("view")).alias("ids"), r.count(F.col("text"), F.col("view")).alias("n")).collect()}
    assert got[1].ids == r.ids("the x", "en") and got[2].n == 5
    made = {x.request: x.made for x in r.answered(rows, 3).collect()}
    assert made == {1: r.generate("the x", "en", 3), 2: r.generate("the x", "base", 3)}
    with pytest.raises(Exception, match="no view"):
        rows.select(r.count(F.col("text"), F.lit("xx"))).collect()


def test_growing_a_model():
    v, m = Augmented(), Decoder(Shape(vocab=260))
    rows = np.ones((1, 32))
    big = attach_and_verify(v, m, "en", [run("th")], rows, rows)
    assert big.shape.vocab == v.total_size == 261
    with pytest.raises(ValueError):
        attach_and_verify(Augmented(), m, "en", [run("th"), run("he")], rows, rows)
