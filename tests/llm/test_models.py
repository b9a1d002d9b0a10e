import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import classifier, lm


def tokens(t):
    return [*(t or "").encode().lower().split(), None]


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


def test_model_against_brute_force(docs, rows):
    got = lm.scored(docs.withColumn("k", F.col("doc_id"))).collect()
    c, b = collections.Counter(), collections.Counter()
    for i, t, *_ in rows:
        if crc(i) % 10:
            before = "<s>"
            for w in tokens(t):
                c[w] += 1
                b[before, w] += 1
                before = w
    n, v = sum(c.values()), len(c)
    total, types, cont = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0]), collections.Counter()
    for (x, w), k in b.items():
        total[x] += k
        types[x][min(k, 3) - 1] += 1
        cont[w] += 1
    of = lambda counts: lm.discounts(*[collections.Counter(counts)[k] for k in (1, 2, 3, 4)])
    d, e = of(b.values()), of(cont.values())
    all_cont, by = sum(cont.values()), collections.Counter(min(k, 3) for k in cont.values())
    spare = sum(e[k] * by[k + 1] for k in range(3)) / all_cont
    pick = lambda k, x: x[min(k, 3) - 1] if k else 0
    low = lambda w: max(cont[w] - pick(cont[w], e), 0) / all_cont + spare / (v + 1)
    assert sum(map(low, c)) + spare / (v + 1) == pytest.approx(1)
    texts = collections.defaultdict(set)
    for i, t, *_ in rows:
        texts[i].add(t)
    for r in got:
        (t,) = texts[r.doc_id]
        before, score, base = "<s>", 0.0, 0.0
        for w in tokens(t):
            p = low(w)
            if total[before]:
                p = max(b[before, w] - pick(b[before, w], d), 0) / total[before] + sum(x * y for x, y in zip(d, types[before], strict=True)) / total[before] * p
            score += math.log10(p)
            base += math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1)))
            before = w
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, crc(r.doc_id) % 10 == 0)
        assert r.score == pytest.approx(score, rel=1e-9) and r.base_score == pytest.approx(base, rel=1e-9)
    assert len(got) == len(rows)


def test_large_counts_and_packing(spark):
    rows = spark.createDataFrame([(k, "the same words again " * 40) for k in range(30)], "doc_id long, text string")
    model = lm.train(rows)
    from corpuscle.llm.words import Words

    token, before, _ = lm.tokens(np.frombuffer(b"same words", np.uint8), np.array([0, 10]))
    assert model.counts(before, token).tolist() == [0, 1200, 0] and len(Words(np.frombuffer(b"a b", np.uint8), np.array([0, 3])).start) == 2
    keys = np.sort(np.random.default_rng(0).integers(-(1 << 63), 1 << 63, 500))
    back = lm.unpacked(*lm.packed(keys, np.arange(500)))
    assert (back[0] == keys).all() and (back[1] == np.arange(500)).all()


def test_model_without_rows(empty, spark):
    assert lm.scored(empty).collect() == []
    held = next(i for i in range(1000) if crc(i) % 10 == 0)
    (only,) = lm.scored(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert only.train_tokens == 0 and only.score == 0.0 and only.base_score == 0.0


def test_trees_learn(spark):
    r = np.random.default_rng(0)
    good = ["The " + " ".join(r.choice(["river", "stone", "of", "light", "and", "walks"], 40)) + "." for _ in range(300)]
    bad = [" | ".join(r.choice(["$$$", "BUY", "##", "click"], 40)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate([*good, *bad])]
    docs = spark.createDataFrame([*rows, (9000, None), (9001, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i, _ in rows] + [(5, None, 0), (7, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = classifier.judged(docs, labels).collect()
    assert len(got) == len(rows) + 3 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got)
    held = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 600]
    assert len(held) > 50 and sum(x.predicted == (x.doc_id < 300) for x in held) / len(held) > 0.97


def test_fit_against_brute_force():
    """Two trees of depth 2 on a small table, each split found by trying all of them with plain sums."""
    r = np.random.default_rng(11)
    x = r.integers(0, 6, size=(60, 3)).astype(np.float32)
    y = (x[:, 1] + r.normal(size=60) > 2.5).astype(float)
    got = classifier.fit(x, y, trees=2, depth=2, bins=64, rate=0.15, penalty=2.0, least=5.0)
    total = [math.log(y.mean() / (1 - y.mean()))] * 60
    for t in range(2):
        p = [1 / (1 + math.exp(-s)) for s in total]
        g, h = [a - b for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p]
        nodes = {0: list(range(60))}
        for k in range(3):
            own = nodes.get(k, [])
            gain = lambda of: sum(g[i] for i in of) ** 2 / (sum(h[i] for i in of) + 2.0)  # noqa: B023, E731
            best, split = 1e-9, None
            for f in range(3):
                for edge in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 64)[1:-1]).astype(np.float32)):
                    low, high = [i for i in own if x[i, f] <= edge], [i for i in own if x[i, f] > edge]
                    if sum(h[i] for i in low) < 0.5 or sum(h[i] for i in high) < 0.5:
                        continue
                    more = gain(low) + gain(high) - gain(own)
                    if more > best + 1e-12:
                        best, split = more, (f, float(edge), low, high)
            if split:
                f, edge, low, high = split
                held = x[own, got.feature[t, k]] > got.above[t, k]
                assert sorted(i for i, up in zip(own, held, strict=True) if up) == high  # an equal gain may name another edge, not other rows
                nodes[2 * k + 1], nodes[2 * k + 2] = low, high
            else:
                assert got.above[t, k] == np.inf
                nodes[2 * k + 1], nodes[2 * k + 2] = own, []
        for k in range(3, 7):
            of = nodes[k]
            value = -0.15 * sum(g[i] for i in of) / (sum(h[i] for i in of) + 2.0)
            assert got.leaf[t, k - 3] == pytest.approx(value)
            for i in of:
                total[i] += value


def test_repeated_rows_teach_once(spark, monkeypatch):
    monkeypatch.setattr(classifier, "MAX_TRAIN", 40)
    seen = []
    whole = classifier.fit
    monkeypatch.setattr(classifier, "fit", lambda x, y, **k: (seen.append(len(y)), whole(x, y, **k))[1])
    docs = spark.createDataFrame([(k % 50, f"text {k % 50} of words") for k in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, quality int")
    assert classifier.judged(docs, labels).count() == 2000
    assert seen == [sum(crc(k) % 5 > 0 for k in range(50))] or seen == [40]


def test_other_columns_and_long_texts(spark, docs, wide):
    key = lambda r: (str(r.doc_id), r.score)
    none = spark.createDataFrame([(3, 1), (6, 0)], "doc_id long, quality int")
    assert sorted(map(key, classifier.judged(wide, none).collect())) == sorted(map(key, classifier.judged(docs, none).collect()))
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in lm.scored(wide).collect()) == sorted((str(r.doc_id), round(r.score, 6)) for r in lm.scored(docs).collect())
    long = spark.createDataFrame([(1, "many words of one text " * 150_000), (2, "a b")], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in lm.scored(long).collect()} == {1: 750_001, 2: 3}
    assert classifier.judged(long, none).count() == 2


def test_trees_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {x.score for x in classifier.judged(docs, none).collect()} == {0.5}
    assert classifier.judged(empty, none).collect() == []


def test_traversal_equals_walking():
    r = np.random.default_rng(2)
    x, y = r.normal(size=(500, len(classifier.FEATURES))).astype(np.float32), (r.random(500) < 0.5).astype(float)
    trees = classifier.fit(x, y, trees=6, depth=3)
    for row, score in zip(x[:40], trees.score(x[:40]), strict=True):
        total = trees.start
        for f, above, leaf in zip(trees.feature, trees.above, trees.leaf, strict=True):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + int(row[f[k]] > above[k])
            total += leaf[k - len(f)]
        assert score == pytest.approx(1 / (1 + math.exp(-total)))
