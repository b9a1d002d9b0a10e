import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuscle.functions import drift
from corpuscle.functions.text import byte_ids, byte_text, byte_tokens, count_chars, count_words, languages, nfc, token_pieces
from corpuscle.operators import bounds, corpus, merge, mining, selection, serving, vocab
from corpuscle.sources import packs


def test_white_space_is_pythons(spark):
    chars = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(i, f"a{c}b") for i, c in enumerate(chars)], "i int, t string")
    got = rows.select("i", count_chars(F.col("t")).alias("n"), count_words(F.col("t")).alias("w")).collect()
    assert all(r.n == sum(not c.isspace() for c in f"a{chars[r.i]}b") and r.w == len(f"a{chars[r.i]}b".split()) for r in got)


def test_nfc_and_bytes(spark):
    rows = spark.createDataFrame([("é",), ("plain",), ("",), (None,), ("日本",)], "t string")
    got = rows.select("t", nfc(F.col("t")).alias("n"), byte_ids(byte_tokens(F.col("t"))).alias("ids")).withColumn("back", byte_text(F.col("ids"))).withColumn("p", token_pieces(F.col("ids"))).collect()
    assert got[0].n == "é" and got[3].n is None
    for r in got:
        if r.t is not None:
            assert list(r.ids) == [b + 4 for b in r.t.encode()] and r.back == r.t
            assert list(r.p) == [f"<{b:02x}>" for b in r.t.encode()]
    assert languages(spark).filter("NOT whitespace_delimited").count() == 4


@pytest.mark.parametrize("n", [1, 7, 8, 9, 41])
def test_splits(spark, n):
    docs = spark.createDataFrame([(i, "x", f"line {i}") for i in range(n)], "doc_id long, lang string, text string")
    rows = corpus.split(corpus.numbered(corpus.lines(docs), span=5)).collect()
    by = {s: sorted(r.line_no for r in rows if r.split == s) for s in corpus.SPLITS}
    if n < 8:
        assert all(v == list(range(n)) for v in by.values())
    else:
        a, b = int(n * 0.4), int(n * 0.2)
        assert by == {"mine": list(range(a)), "fit": list(range(a, a + b)), "certify": list(range(a + b, a + 2 * b)), "eval": list(range(a + 2 * b, n))}
    assert corpus.head(corpus.numbered(corpus.lines(docs)), 3).count() == min(n, 3)


@pytest.mark.parametrize("n", [7, 8, 21])
def test_clean_bitext(spark, n):
    r = random.Random(n)
    pairs = [("x", i, "a" * r.randint(10, 30), "b" * r.randint(10, 30)) for i in range(n - 1)] + [("x", n, "a" * 400, "b" * 12), ("x", n + 1, "short", "b" * 20)]
    full = [p for p in pairs if len(p[2]) >= 10]
    if len(full) >= 8:
        m = sorted(len(p[2]) / len(p[3]) for p in full)[len(full) // 2]
        full = [p for p in full if m / 3 <= len(p[2]) / len(p[3]) <= m * 3]
    got = corpus.clean_bitext(spark.createDataFrame(pairs, "lang string, line_no long, text string, pivot_text string"))
    assert sorted(r.line_no for r in got.collect()) == sorted(p[1] for p in full)


def test_mining_equals_counting(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("abc ") for _ in range(60)) for _ in range(30)]
    docs = spark.createDataFrame([(i, "x", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    got = {bytes(x.gram): (x.n_occurrences, x.n_docs) for x in mining.mine(corpus.lines(docs), 4).collect()}
    want = {}
    for n in (2, 3, 4):
        for g in {t[i : i + n] for t in texts for i in range(len(t) - n + 1)}:
            occ = [sum(t[i : i + n] == g for i in range(len(t))) for t in texts]
            if sum(occ) >= 3 and sum(o > 0 for o in occ) >= 2:
                want[g.encode()] = (sum(occ), sum(o > 0 for o in occ))
    assert got == want
    kept = {bytes(x.gram) for x in mining.without_nested(mining.mine(corpus.lines(docs), 4)).collect()}
    assert kept == {g for g in want if not any(len(h) > len(g) and g in h and want[h][0] >= want[g][0] for h in want)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.dictionaries(st.lists(st.integers(0, 3), min_size=2, max_size=4).map(tuple), st.integers(), max_size=6))
def test_trie_equals_regular_expression(ids, runs):
    patterns = {run: 100 + k for k, run in enumerate(runs)}
    out = merge.Trie(patterns).merge(ids)
    assert len(out) <= len(ids)
    back = {new: run for run, new in patterns.items()}
    assert [i for t in out for i in back.get(t, (t,))] == ids
    if patterns:
        found = merge.compiled([bytes(p) for p in patterns]).sub(b"\xff", bytes(ids))
        assert len(found) == len(out)


def test_merge_columns(spark):
    packs_of = [b"ab", b"abc", b"cab", b"\xc3\xa9"]
    patterns = {tuple(b + 4 for b in e): 260 + k for k, e in enumerate(packs_of)}
    texts = ["abcabcab", "éabé", "", "cabcab", "zzz"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("ids", byte_ids(byte_tokens(F.col("t"))))
    got = rows.select("t", merge.merged_size(byte_tokens(F.col("t")), packs_of).alias("n"), merge.merge_ids(F.col("ids"), patterns).alias("m"), "ids").withColumn("back", merge.expand_ids(F.col("m"), patterns)).collect()
    trie = merge.Trie(patterns)
    for r in got:
        assert list(r.m) == trie.merge(list(r.ids)) and r.n == len(r.m) and list(r.back) == list(r.ids)
    bad = merge.audit(rows, "ids", patterns, 260).first()
    assert (bad.not_lossless, bad.longer, bad.outside_view, bad.not_appended) == (0, 0, 0, 0)
    with pytest.raises(ValueError):
        merge.Trie({(1, 2): 5, (1,): 6})


def test_greedy_and_bound(spark):
    r = random.Random(2)
    docs = spark.createDataFrame([(i, "x", "".join(r.choice("abcd") for _ in range(40))) for i in range(12)], "doc_id long, lang string, text string")
    rows = corpus.lines(docs)
    cands = mining.mine(rows, 3).select("lang", "gram").limit(25).cache()
    covers = selection.coverage(rows, cands).cache()
    slots = {}
    for x in covers.collect():
        slots.setdefault(bytes(x.gram), set()).add((x.line.doc_id, x.line.pos, x.slot))
    done, want = set(), []
    for _ in range(4):
        g = max(slots, key=lambda k: (len(slots[k] - done), [255 - b for b in k]))
        want.append((g, len(slots[g] - done)))
        done |= slots[g]
    got = [(bytes(x.gram), x.gain) for x in selection.greedy(covers, 4).orderBy("step").collect()]
    assert [g for _, g in got] == [g for _, g in want] and got[0] == want[0]
    chosen = spark.createDataFrame([("x", g) for g, _ in got], "lang string, gram binary")
    b = selection.online_bound(covers, chosen, 4).first()
    assert b.covered == sum(g for _, g in got) and b.bound >= b.covered


def test_tolerance_rule():
    assert [bounds.tolerance_index(n, 0.05, 0.05) for n in (0, 28, 58, 59, 100, 200)] == [None, None, None, 59, 99, 196]
    assert [bounds.tolerance_index(n, 0.1, 0.05) for n in (28, 29)] == [None, 29]
    assert bounds.samples_needed(0.05, 0.05) == 59 and bounds.samples_needed(0.1, 0.05) == 29 and bounds.samples_needed(0, 0.5) == 100_000


def test_conformal_is_exact(spark):
    r = random.Random(3)
    data = [(k, r.paretovariate(1.5) if k else float(r.randint(0, 3))) for k in range(3) for _ in range((40, 700, 5000)[k])]
    got = {x.g: x for x in bounds.conformal(spark.createDataFrame(data, "g int, v double"), "g", "v").collect()}
    for g in range(3):
        v = sorted(x for k, x in data if k == g)
        k = bounds.tolerance_index(len(v), 0.05, 0.05)
        assert (got[g].n, got[g].k, got[g].bound) == (len(v), k, v[k - 1] if k else float("inf"))


def test_decision_order(spark):
    inf = float("inf")
    cases = [(5, 0.1, 0.1, 0.0, 0.1, "too_few_measurements"), (50, None, 0.1, 0.0, 0.1, "no_kl_bound"), (50, inf, 9.0, 0.0, 0.1, "no_kl_bound"), (50, 2.0, 9.0, 0.0, 0.1, "kl_above"), (50, 0.1, 0.9, 9.0, 0.1, "tv_above"), (50, 0.1, 0.1, 9.0, 0.1, "offcontext_above"), (50, 0.1, 0.1, 0.0, inf, "no_emission_bound"), (50, 0.1, 0.1, 0.0, 9.0, "emission_above"), (50, 0.1, 0.1, 0.0, 0.1, None)]
    rows = spark.createDataFrame(cases, "n int, kl double, tv double, off double, emit double, want string")
    limits = dict(least_n=10, max_kl=1.0, max_tv=0.5, max_off=1.0, max_emit=1.0)
    of = lambda **k: bounds.decision(F.col("n"), F.col("kl"), F.col("tv"), F.col("off"), F.col("emit"), **limits, **k)
    got = rows.select("want", of().alias("r"), of(input_only=True).alias("i")).collect()
    assert [x.r for x in got] == [x.want for x in got]
    assert all(x.i is None for x in got if x.want in ("no_emission_bound", "emission_above", None))


def test_kl_within_twice_the_sup_norm(spark):
    r = random.Random(4)
    rows = [([r.gauss(0, 2) for _ in range(32)],) for _ in range(100)]
    rows = spark.createDataFrame([(z, [x + r.uniform(-0.5, 0.5) for x in z]) for (z,) in rows], "z array<double>, w array<double>")
    lp, lq = drift.log_softmax(F.col("z")), drift.log_softmax(F.col("w"))
    got = rows.select(drift.kl(lp, lq).alias("kl"), drift.tv(lp, lq).alias("tv"), drift.linf(F.col("z"), F.col("w")).alias("e"), drift.total(F.transform(lp, F.exp)).alias("one")).collect()
    assert all(0 <= x.kl <= 2 * x.e and 0 <= x.tv <= 1 and abs(x.one - 1) < 1e-9 for x in got)


def test_longest_prefix(spark):
    stored = spark.createDataFrame([(1, b"abcd"), (2, b"abcdef"), (3, b"abcd"), (4, b"xy")], "entry long, ids binary")
    asked = spark.createDataFrame([(10, b"abcdefgh"), (11, b"abcde"), (12, b"zz"), (13, b"xyz")], "request long, ids binary")
    got = {r.request: (r.entry, r.matched) for r in serving.longest_prefix(asked, stored).collect()}
    assert got == {10: (2, 6), 11: (1, 4), 12: (None, 0), 13: (None, 0)}


def test_views(spark):
    packs_of = spark.createDataFrame([("fr", 1, b"le"), ("fr", 2, b"de"), ("en", 1, b"th")], "lang string, rank int, gram binary")
    v = vocab.attach(packs_of, 260)
    assert sorted(r.new_id for r in v.collect()) == [260, 261, 262]
    m = vocab.masks(v, vocab.views(v), 260)
    assert {(r.view, r.new_id) for r in m.filter("logit = 0").collect()} == {("en", 260), ("fr", 261), ("fr", 262)}


def test_packs_and_texts(spark, tmp_path):
    rows = spark.createDataFrame([("fr", 1, "6C65", 5, True, {"kl": 0.1}), ("fr", 2, "6465", 4, False, {"kl": 3.0})], packs.ENTRY)
    packs.write_pack(rows, f"{tmp_path}/p", {"base": "bytes"})
    assert packs.read_pack(spark, f"{tmp_path}/p").count() == 1 and packs.read_pack(spark, f"{tmp_path}/p", require_accepted=False).count() == 2
    assert "| kl | 3 |" in packs.card(rows)
    (tmp_path / "pairs.tsv").write_text('bon "jour\thello\tthere\n\tx\nsolo\n', encoding="utf-8")
    got = packs.read_pairs(spark, f"{tmp_path}/pairs.tsv").collect()
    assert [(r.text, r.pivot_text) for r in got] == [('bon "jour', "hello\tthere")]
    (tmp_path / "s.json").write_text('{"_readme": "x", "sentences": {"en": ["a", "b"], "ja": ["c", "d"]}}', encoding="utf-8")
    sample = packs.read_sample(spark, f"{tmp_path}/s.json")
    assert sorted((r.lang, r.i, r.text) for r in sample.collect()) == [("en", 0, "a"), ("en", 1, "b"), ("ja", 0, "c"), ("ja", 1, "d")]
    assert corpus.expanded(sample, 2).count() == 4
    packs.write_lines(sample, f"{tmp_path}/t")
    assert packs.read_lines(spark, f"{tmp_path}/t").count() == 4
    packs.write_rows(sample, f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").count() == 4
    (tmp_path / "bad").mkdir()
    packs.write_rows(spark.createDataFrame([("x", 1)], "format string, n_entries long"), f"{tmp_path}/bad/manifest")
    with pytest.raises(ValueError):
        packs.read_pack(spark, f"{tmp_path}/bad")
