import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import fingerprint, neardup
from corpuscle.llm.sketch import T, sketch


def shingles(t, low=True):
    b = (t or "").encode()
    w = (b.lower() if low else b).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[find(i)] = min(ids.get(find(i), r[0]), r[0])
    return sorted((str(r[0]), len(sets[i]), str(ids.get(find(i)) if sets[i] else r[0])) for i, r in enumerate(rows))


def test_components_against_all_pairs(docs, rows):
    got = neardup.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_chained_family(spark):
    """A family whose ends are not alike but are linked through its middle, so that the exact round is needed."""
    words = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(f"x{k}-{j}" if j < 2 * k else w for j, w in enumerate(words)), "en", "a", 0) for k in range(24)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)


def test_large_family_is_linear(spark, monkeypatch):
    """2,000 near copies of one text: what is sent to be compared grows as the family, and one component is left."""
    r = random.Random(4)
    words = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(2000):
        own = list(words)
        for k in r.sample(range(150), r.choice((1, 2))):
            own[k] = f"e{i}-{k}"
        rows.append((i, " ".join(own)))
    for i in range(300):  # others share a passage with each other, too short to link them
        rows.append((5000 + i, " ".join([f"o{i}-{k}" for k in range(60)] + [f"p{k}" for k in range(70)])))
    sent = []
    whole = neardup.verified
    monkeypatch.setattr(neardup, "verified", lambda routes, *a, **k: (sent.append(routes.count()), whole(routes, *a, **k))[1])
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    family = collections.Counter(x.component_id for x in got if x.doc_id < 5000)
    sets = [shingles(t) for _, t in rows]
    linked = [i for i in range(2000) if any(100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for j in range(2000) if j != i)]
    assert family[min(linked)] == len(linked) > 1900
    assert all(x.component_id == x.doc_id for x in got if x.doc_id >= 5000)
    assert max(sent) <= 33 * len(rows)


@pytest.mark.parametrize("volume", [neardup.VOLUME, 300])
def test_closing_equals_all_pairs(volume, spark, monkeypatch):
    """Chains, families and strangers in few buckets, whole and in blocks."""
    monkeypatch.setattr(neardup, "VOLUME", volume)
    monkeypatch.setattr(neardup, "ROWS", 1)  # nearly all share buckets
    r = random.Random(volume)
    rows = []
    for chain in range(3):
        words = [f"c{chain}-{k}" for k in range(80)]
        for k in range(14):
            rows.append((len(rows), " ".join(f"x{k}-{j}" if j < 2 * k else w for j, w in enumerate(words)), "en", "a", 0))
    passage = " ".join(f"p{k}" for k in range(40))
    for k in range(20):
        rows.append((len(rows), passage + " " + " ".join(f"s{k}-{j}" for j in range(r.randint(5, 60))), "en", "a", 0))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == brute(rows)


def test_group_closes_as_all_pairs():
    r = np.random.default_rng(7)
    for _ in range(60):
        pool = r.integers(0, 1 << 62, 60).astype(np.uint64)
        sets = [np.unique(r.choice(pool, r.integers(1, 50))) for _ in range(12)]
        sets += [np.unique(np.append(sets[k % 12][: max(1, len(sets[k % 12]) - k % 3)], pool[k])) for k in range(12)]
        comp = np.arange(24)
        comp[5] = comp[3]
        label = list(comp)

        def find(x, label=label):
            return x if label[x] == x else find(label[x])

        for i in range(24):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    label[find(i)] = find(j)
        want = [find(i) for i in range(24)]
        made = neardup._Group(sets, comp, 75).close()
        label[:] = comp
        for a, b in made:
            both = len(np.intersect1d(sets[a], sets[b]))
            assert 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both)
            label[find(a)] = find(b)
        got = [find(i) for i in range(24)]
        assert [[x == y for y in got] for x in got] == [[x == y for y in want] for x in want]
        assert len(made) == len(set(comp)) - len(set(want))


def test_deduplicated(docs, wide, empty, rows):
    kept = {r.doc_id for r in neardup.near_duplicates(docs).filter("kept").select("doc_id").collect()}
    out = neardup.deduplicated(wide)
    assert out.columns == wide.columns
    assert {r.doc_id for r in out.select("doc_id").collect()} == kept
    assert neardup.near_duplicates(empty).collect() == [] and neardup.deduplicated(empty).collect() == []


def test_sketch_estimates_similarity():
    r = np.random.default_rng(1)
    pool = r.integers(0, 1 << 63, 4000).astype(np.uint64)
    for n in (1, 3, 40, 1000):
        errors = []
        for k in range(30):
            a = pool[k * 7 : k * 7 + n]
            b = np.concatenate((a[: max(1, int(n * 0.8))], pool[3000 + k : 3000 + k + n // 5]))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append((sketch(a) == sketch(b)).sum() / T - true)
            assert (sketch(a) == sketch(a[::-1])).all()
        assert abs(np.mean(errors)) < 0.05


def test_fingerprints(docs, rows, empty):
    got = fingerprint.fingerprints(docs).collect()
    assert len(got) == len(rows)
    texts = sorted(((i is None, -(i or 0)), t or "") for i, t, *_ in rows)  # equal ids here have equal texts
    want = []
    for k, (_, t) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        want.append((len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    by_id = {r.doc_id: r for r in got}
    assert by_id[3001].fingerprint == by_id[3002].fingerprint == "" and by_id[3001].near_edited in (0.0, 1.0)
    assert len({r.fingerprint for r in got if r.doc_id in range(2000, 2005)}) == 1
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    for a, b in ((2001, 2000), (1003, 1002)):
        true = jaccard(shingles(rows_text(rows, a), False), shingles(rows_text(rows, b), False))
        assert abs(by_id[a].near_next - true) < 0.2
    assert fingerprint.fingerprints(empty).collect() == []


def bins_of(spark, text):
    """The fingerprint by the definition: bins, densification and packing, with the shingle hashes that Spark gives."""
    words = (text or "").encode().split()
    if not words:
        return ""
    width = min(5, len(words))
    runs = [words[i : i + width] for i in range(len(words) - width + 1)]
    df = spark.createDataFrame([([w.decode() for w in x],) for x in runs], "w array<string>")
    hashed = F.xxhash64(*[F.xxhash64(F.get("w", F.lit(k))) for k in range(width)])
    least = {}
    for (h,) in df.select(hashed).collect():
        k = (h + (1 << 63)) >> 57
        least[k] = min(least.get(k, h), h)
    out = []
    for k in range(128):
        at = k if k in least else next(b for b in fingerprint._probe_order(k) if b in least)
        out.append(least[at] & 255)
    return bytes(out).hex()


def test_fingerprints_equal_the_definition(spark):
    texts = ["one two three", "a b c d e f", "a b c d e f g h", "Größe ça été " * 9, " ".join(f"w{k}" for k in range(40)), " ".join(f"w{k}" for k in range(900)), "", None]
    got = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    bins = {}
    for i, t in enumerate(texts):
        bins[i] = bins_of(spark, t)
        assert got[i].fingerprint == bins[i]
    for i, t in enumerate(texts):
        t, after = t or "", texts[i - 1 if i else -1] or ""
        edited = bins_of(spark, t[: len(t) - len(t) // 2] + after[: len(t) // 2])
        assert got[i].edited_fingerprint == edited
        for near, a, b in ((got[i].near_edited, bins[i], edited), (got[i].near_next, bins[i], bins[i - 1 if i else len(texts) - 1])):
            if not a or not b:
                assert near == float(a == b)
            else:
                same = sum(x == y for x, y in zip(bytes.fromhex(a), bytes.fromhex(b), strict=True)) / 128
                assert near == pytest.approx(max(0.0, (same - 1 / 256) / (1 - 1 / 256)))


def test_probe_orders_are_permutations():
    assert all(sorted(fingerprint._probe_order(k)) == list(range(128)) for k in range(128))


def test_short_texts_are_estimated_well():
    """With few full bins, densified bins err little more than a permutation each would: 8 shingles."""
    r = np.random.default_rng(3)
    errors = []
    for _ in range(300):
        a = r.integers(0, 1 << 63, 12)
        sets = a[:8], a[4:]
        prints = []
        for s in sets:
            full = {}
            for h in s.tolist():
                full[h >> 56] = min(full.get(h >> 56, h), h)
            prints.append([full[k] if k in full else full[next(b for b in fingerprint._probe_order(k) if b in full)] for k in range(128)])
        errors.append(np.mean(np.array(prints[0]) == np.array(prints[1])) - 4 / 12)
    assert np.sqrt(np.mean(np.square(errors))) < 0.06


def test_fingerprints_of_other_columns(docs, wide):
    key = lambda r: (str(r.doc_id), r.fingerprint, r.edited_sha256)
    assert sorted(map(key, fingerprint.fingerprints(wide).collect())) == sorted(map(key, fingerprint.fingerprints(docs).collect()))


def rows_text(rows, i):
    return next(t for k, t, *_ in rows if k == i)
