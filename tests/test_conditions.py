"""Conditions, panels, kept prefixes and the commands around them."""

import json

import pytest
from pyspark.sql import functions as F

from corpuscle import cli
from corpuscle.operators.augmented import Augmented, View
from corpuscle.plans import conditions
from corpuscle.plans.build import Plan
from corpuscle.plans.model import Decoder
from corpuscle.plans.router import PrefixStore, load
from corpuscle.sources import packs

LOOSE = Plan(lang="fr", budget=2, pool=8, longest=3, least_n=1, max_kl=1e9, max_tv=1.0, max_off=1.0, max_emit=1e9, off_positions=16, contexts_each=8)


def test_conditions(spark):
    docs = spark.createDataFrame([(k, "fr", f"le vent de la mer {k}\nla vie de {k * 3} jours") for k in range(30)], "doc_id long, lang string, text string")
    lines = spark.createDataFrame([("le vent de la vie",), ("la mer",)], "text string")
    got, failed = conditions.sweep(spark, ["fr", "xx"], lambda lang: docs if lang == "fr" else docs.select("text"), lambda lang: lines, Decoder(), LOOSE)
    rows = {r.condition: r for r in got.collect()}
    assert tuple(rows) == conditions.CONDITIONS and set(failed) == {"xx"}
    assert rows["base"].tokens_delta == 0 and rows["base"].n_tokens_added == 0
    assert rows["zero_shot"].n_tokens_added == 2 and rows["zero_shot"].tokens_per_sentence == rows["norm_matched"].tokens_per_sentence < rows["base"].tokens_per_sentence
    assert all(r.bits_per_char > 0 for r in rows.values())


def test_bits_equal_the_log_probability(spark):
    model, text = Decoder(), "abc d"
    s = conditions.scored(spark.createDataFrame([(text,)], "text string"), model, Augmented(), View()).first()
    nats = -model.logprob([b + 4 for b in text.encode()])
    assert s.bits_per_char == pytest.approx(nats / 0.6931471805599453 / 4) and s.tokens_per_sentence == 5


def test_panels(spark):
    v = Augmented()
    v.attach("fr", [(112, 105)])  # le
    texts = spark.createDataFrame([(1, "fr", "le"), (2, "de", "ab"), (3, "fr", "le lac")], "request long, lang string, text string")
    aligned = spark.createDataFrame([("fr", "le", 4)], "lang string, text string, pivot_tokens long")
    totals = spark.createDataFrame([("fr", 30, 10)], "lang string, tokens long, pivot_tokens long")
    got = {r.request: r for r in conditions.analysed(texts, v, aligned, totals).collect()}
    assert (got[1].base_tokens, got[1].pack_tokens, got[1].premium, got[1].exact, got[1].pack_pieces) == (2, 1, 0.5, True, ["[le]"])
    assert (got[3].pivot_tokens, got[3].premium, got[3].saved, got[3].exact) == (2.0, 3.0, 1, False)
    assert got[2].pack_pieces == got[2].base_pieces == ["<61>", "<62>"] and got[2].premium == 1.0


def test_kept_prefixes_change_nothing():
    r, store = load({"en": [(120, 108)]}), PrefixStore(most=3)
    texts = ["the long road", "the long road home", "the", "the long road home again", "xyz and more"]
    for t in texts:
        for view in ("en", "base"):
            assert r.generate(t, view, 3, store) == r.generate(t, view, 3)
    assert store.hits >= 2 and 0 < store.reuse_rate < 1 and 0 < store.hit_rate < 1 and len(store._kept) == 3
    store.clear()
    assert not store._kept and store.lookups == 10


def test_assets_and_requests(spark, tmp_path, capsys):
    (tmp_path / "atlas.json").write_text('{"lang": "fr", "n": 1}\n{"lang": "de", "n": 2}\n')
    (tmp_path / "s.json").write_text('{"sentences": {"ja": ["a", "b"]}}')
    assert cli.main(["assets", f"{tmp_path}/atlas.json", "--sample", f"{tmp_path}/s.json", "--out", f"{tmp_path}/out"]) == 0
    assert [x["lang"] for x in json.loads(spark.read.text(f"{tmp_path}/out/atlas").first()[0])] == ["de", "fr"]
    entries = spark.createDataFrame([("fr", 1, "6C65", 9, True, {"kl": 99.0}), ("fr", 2, "6465", 7, False, {"kl": 9.0})], packs.ENTRY)
    packs.write_pack(entries, f"{tmp_path}/p")
    assert cli.main(["request", f"{tmp_path}/p", "le", "--view", "fr"]) == 0
    assert json.loads(capsys.readouterr().out) == {"ids": [260], "banned": []}
    assert cli.main(["request", f"{tmp_path}/p", "le"]) == 0
    assert json.loads(capsys.readouterr().out) == {"ids": [112, 105], "banned": [260]}
    spark.createDataFrame([(k, "fr", f"le vent {k} le") for k in range(40)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/data/documents.parquet")
    fresh = cli.remeasured(spark, packs.read_pack(spark, f"{tmp_path}/p"), f"{tmp_path}/data")
    assert fresh.filter(F.col("kl") >= 0).count() > 8
    assert cli.main(["verify", f"{tmp_path}/p", f"{tmp_path}/data", "--remeasure"]) == 0
