"""Runs of bytes are counted, covered and found inside tasks: results against plain loops, and plans without a row for each position."""

import random

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import contexts, corpus, mining, selection
from corpuscle.plans.tables import ship


@pytest.fixture(scope="module")
def texts():
    """Lines of two languages with runs that overlap themselves, letters of several bytes, and one line that is longer than all others together."""
    r = random.Random(7)
    words = ["aaaa", "abab", "über", "日本", "the cat", "xyz" * 4]
    out = [(k, lang, "\n".join(" ".join(r.choice(words) for _ in range(r.randint(0, 9))) for _ in range(4))) for k, lang in enumerate(["x", "y"] * 12)]
    return [*out, (90, "x", " ".join(r.choice(words) for _ in range(900))), (91, None, "aaaa aaaa"), (92, "y", None)]


@pytest.fixture(scope="module")
def lines(spark, texts):
    ship(spark)
    return corpus.lines(spark.createDataFrame(texts, "doc_id long, lang string, text string").repartition(3))


def bodies(texts):
    return {lang: [(d, p, t.encode()) for d, k, text in texts if k == lang and text is not None for p, t in enumerate(text.split("\n")) if t.strip(" ")] for lang in ("x", "y")}


def standing(body, run):
    return [i for i in range(len(body) - len(run) + 1) if body[i : i + len(run)] == run]


@pytest.mark.parametrize("longest", [3, 10])
def test_mining_in_tasks(lines, texts, longest):
    want = {}
    for lang, own in bodies(texts).items():
        for n in range(2, longest + 1):
            for run in {b[i : i + n] for _, _, b in own for i in range(len(b) - n + 1)}:
                found = [len(standing(b, run)) for _, _, b in own]
                if sum(found) >= 3 and sum(k > 0 for k in found) >= 2:
                    want[lang, run] = sum(found), sum(k > 0 for k in found)
    got = mining.mine(lines, longest)
    assert {(x.lang, bytes(x.gram)): (x.n_occurrences, x.n_docs) for x in got.collect()} == want
    assert {(x.lang, bytes(x.gram)) for x in mining.mine(lines, longest, shortest=longest).collect()} == {k for k in want if len(k[1]) == longest}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == plan.count("Generate posexplode(split(text") > 0  # lines are made, positions are not
    assert got.filter(F.octet_length("gram") > longest).isEmpty()


def slots_of(texts, runs):
    """For each language and run the boundaries that it covers."""
    return {(lang, run): {(d, p, i + k) for d, p, b in bodies(texts)[lang] for i in standing(b, run) for k in range(len(run) - 1)} for lang, run in runs}


@pytest.fixture(scope="module")
def candidates(spark, texts):
    """Over 64 for x, which overlap themselves and one another and tie; few for y."""
    runs = {("x", b[i : i + n]) for _, _, b in bodies(texts)["x"] for n in (2, 3, 5, 9) for i in range(0, min(len(b) - n, 60))}
    runs |= {("y", r) for r in (b"aa", b"aaa", b"abab", b"at ", b"zzz")} | {("z", b"aa")}
    return sorted(runs), spark.createDataFrame(sorted(runs), "lang string, gram binary").repartition(2)


def picks(slots, lang, budget):
    done, out = set(), []
    while len(out) < budget:
        gain, run = min((-len(s - done), r) for (k, r), s in slots.items() if k == lang)
        if not gain:
            break
        out.append((run, -gain))
        done |= slots[lang, run]
    return out


@pytest.mark.parametrize("together", [1, 3, 64])
def test_greedy_from_lines(lines, texts, candidates, monkeypatch, together):
    monkeypatch.setattr(selection, "TOGETHER", together)
    runs, df = candidates
    slots = slots_of(texts, [r for r in runs if r[0] != "z"])
    assert sum(k == "x" for k, _ in runs) > 64
    got = selection.greedy_of(lines, df, 5).orderBy("step").collect()
    for lang in ("x", "y"):
        assert [(bytes(r.gram), r.gain) for r in got if r.lang == lang] == picks(slots, lang, 5)
        assert [r.step for r in got if r.lang == lang] == list(range(1, 1 + len(picks(slots, lang, 5))))
    assert {r.lang for r in got} == {"x", "y"}


def test_coverage_from_lines(spark, lines, texts, candidates):
    runs, df = candidates
    slots = slots_of(texts, [r for r in runs if r[0] != "z"])
    want = {lang: (len(set().union(*(s for (k, _), s in slots.items() if k == lang))), sum(len(s) for (k, _), s in slots.items() if k == lang)) for lang in ("x", "y")}
    assert {r.lang: (r.covered, r.slots_of_candidates) for r in selection.coverage_of(lines, df).collect()} == want
    best = {lang: picks(slots, lang, 2) for lang in ("x", "y")}
    chosen = spark.createDataFrame([(lang, run) for lang, own in best.items() for run, _ in own], "lang string, gram binary")
    done = {lang: set().union(*(slots[lang, run] for run, _ in own)) for lang, own in best.items()}
    left = {k: len(s - done[k[0]]) for k, s in slots.items() if s - done[k[0]]}
    made = selection.gains_of(lines, df, chosen)
    assert {(r.lang, bytes(r.gram)): r.gain for r in made.collect()} == left
    assert "slot" not in made._jdf.queryExecution().optimizedPlan().toString().replace("slots", "")
    bound = {lang: len(d) + sum(sorted((n for (k, _), n in left.items() if k == lang), reverse=True)[:3]) for lang, d in done.items()}
    assert {r.lang: (r.covered, r.bound) for r in selection.online_bound_of(lines, df, chosen, 3).collect()} == {lang: (len(done[lang]), bound[lang]) for lang in done}


def test_contexts_from_lines(lines, texts, candidates):
    runs, df = candidates
    want = {}
    for lang, run in runs:
        for d, p, b in sorted(bodies(texts).get(lang, [])):
            for i in standing(b, run):
                want.setdefault((lang, run), []).append((d, p, i + 1, b[max(0, i - 12) : i], b[i + len(run) : i + len(run) + 6]))
    got = contexts.occurrences(lines, df)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Generate") == plan.count("Generate posexplode(split(text") > 0
    of = lambda rows: sorted((r.lang, bytes(r.gram), r.doc_id, r.pos, r["at"], bytes(r.prefix), bytes(r.suffix)) for r in rows)
    assert of(got.collect()) == sorted((*k, *o) for k, own in want.items() for o in own)
    for n in (1, 3):
        first = contexts.first_occurrences(lines, df, n).collect()
        assert of(first) == sorted((*k, *o) for k, own in want.items() for o in own[:n])
        assert all((r.doc_id, r.pos, r["at"]) == want[r.lang, bytes(r.gram)][r.k - 1][:3] for r in first)
    share = {r.lang: (r.n_candidates, r.n_with_context) for r in contexts.share_with_context(df, contexts.occurrences(lines, df, first=1)).collect()}
    assert share == {lang: (sum(k == lang for k, _ in runs), sum(k == lang and (k, r) in want for k, r in runs)) for lang in "xyz"}
