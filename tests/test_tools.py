import pytest
from pyspark.sql import functions as F

from corpuscle import cli
from corpuscle.operators import vocab
from corpuscle.plans import reports
from corpuscle.sources import packs, resolve


def test_chain_of_sources(spark, tmp_path, monkeypatch):
    (tmp_path / "s.json").write_text('{"sentences": {"ja": ["a", "b"]}}', encoding="utf-8")
    sample = f"{tmp_path}/s.json"
    name, rows = resolve.monolingual(spark, "ja", str(tmp_path), sample)
    assert name == "sample" and rows.count() == 2
    (tmp_path / "ja.txt").write_text("one\n\n  \ntwo\nthree\n", encoding="utf-8")
    assert resolve.monolingual(spark, "ja", str(tmp_path), sample)[1].count() == 3
    (tmp_path / "mine.txt").write_text("only\n", encoding="utf-8")
    monkeypatch.setenv("CORPUSCLE_TEXT_JA", f"{tmp_path}/mine.txt")
    assert resolve.monolingual(spark, "ja", str(tmp_path), sample)[0] == "override"
    with pytest.raises(LookupError):
        resolve.monolingual(spark, "sw", None, sample)
    assert resolve.largest([spark.range(2), spark.range(5), spark.range(5)]).count() == 5


def test_tables(spark):
    rows = spark.createDataFrame([("a|b", 1200, 0.5), (None, 1, float("nan"))], "t string, n long, x double")
    assert reports.markdown(rows).splitlines()[1:] == ["| --- | ---: | ---: |", "| a\\|b | 1,200 | 0.5 |", "| — | 1 | — |"]
    assert "fixture" in reports.report({"One": rows}, fixture=True) and reports.percent(0.123) == "12.3%" and reports.percent(None) == "—"


def test_inspect_and_verify(spark, tmp_path, capsys):
    built = spark.createDataFrame([("fr", 1, "6C65", 9, True, 0.5), ("fr", 2, "6465", 7, False, 9.0)], "lang string, rank int, gram_hex string, n_occurrences long, accepted boolean, kl_bound double")
    packs.write_pack(cli.entries_of(built), f"{tmp_path}/p", {"lang": "fr"})
    assert resolve.pack_dirs(str(tmp_path)) == [f"{tmp_path}/p"]
    assert cli.main(["inspect", f"{tmp_path}/p"]) == 0 and "2 entries, 1 accepted" in capsys.readouterr().out
    spark.createDataFrame([("6C65", 0.1 + k / 200) for k in range(60)], "token string, kl double").write.parquet(f"{tmp_path}/good")
    spark.createDataFrame([("6C65", 5.0)] * 60, "token string, kl double").write.parquet(f"{tmp_path}/bad")
    assert cli.main(["verify", f"{tmp_path}/p", f"{tmp_path}/good", "--alpha", "0.05", "--delta", "0.05"]) == 0
    covered = cli.verify(packs.read_pack(spark, f"{tmp_path}/p"), spark.read.parquet(f"{tmp_path}/bad"), 0.05, 0.05).first()
    assert covered.n_violated == covered.n_checked == 1
    named = packs.read_pack(spark, f"{tmp_path}/p").withColumn("new_id", F.lit(260))
    assert [tuple(r) for r in resolve.surfaces(named).collect()] == [("le", 260)]


def test_requests_and_fragments(spark):
    bytes_of = F.create_map(F.lit(1), F.lit(b"\xc3"), F.lit(2), F.lit(b"ok"))
    rows = spark.createDataFrame([([1, 2, 1],)], "ids array<int>")
    assert rows.select(vocab.byte_fragments(F.col("ids"), bytes_of)).first()[0] == 2
    closed = spark.createDataFrame([("fr", 262, float("-inf")), ("fr", 261, float("-inf")), ("fr", 260, 0.0)], "view string, new_id long, logit double")
    asked = spark.createDataFrame([(1, "fr", [5]), (2, "base", [6])], "request long, view string, ids array<int>")
    got = {r.request: r.body for r in vocab.request_body(asked, closed).collect()}
    assert got == {1: '{"ids":[5],"banned":[261,262]}', 2: '{"ids":[6],"banned":[]}'}
