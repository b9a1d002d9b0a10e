import collections
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import line_dedup, quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t)


def norm(line):
    return " ".join(lower(w) for w in WORD.findall(line))


def base(t):
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(inside)


def test_quality_against_brute_force(docs, rows, monkeypatch):
    monkeypatch.setattr(quality, "LINE_LEAST", 3)
    got = quality.judge(docs, ["doc_id", "text", "source"], with_text=True).collect()
    assert len(got) == len(rows)
    holders, hosts = collections.defaultdict(set), collections.defaultdict(set)
    for i, t, _, s, _ in rows:
        hosts[s].add(i)
        for line in {norm(x) for x in (t or "").split("\n")} - {""}:
            holders[s, line].add(i)
    depleted = 0
    for r in got:
        t = r.text or ""
        own = base(t)
        assert own == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        gone, left = 0, []
        for line in t.split("\n"):
            e = holders.get((r.source, norm(line)), ())
            if norm(line) and len(e) >= 3 and len(e) * 100 > quality.LINE_PERCENT * len(hosts[r.source]):
                gone += len(WORD.findall(line))
            else:
                left.append(line)
        assert r.new_text == (None if r.text is None else "\n".join(left))
        failed = own[0] < 50 or 100 * own[4] > 50 * own[0]
        assert (r.n_removed_words, r.base_failed) == (gone, failed)
        assert r.kept == (not failed and (own[0] - gone) * 100 >= quality.LEFT_PERCENT * own[0])
        depleted += not failed and not r.kept
    assert depleted  # the near copies hold little but common lines


def test_quality_edges(empty, wide, docs):
    assert quality.judge(empty, ["doc_id"]).collect() == []
    got = quality.judge(wide, wide.columns)
    made = [*quality.STATISTICS, "base_failed", "n_removed_words", "kept"]
    assert got.columns == [c for c in wide.columns if c not in made] + made
    assert got.filter("kept").count() == quality.judge(docs, ["doc_id"]).filter("kept").count()
    assert {r.slot for r in got.select("slot").collect()} == {"slot"}


@pytest.mark.parametrize("percent", [10.0, 40.0])
def test_line_dedup_against_brute_force(docs, rows, percent):
    got = line_dedup.drop_boilerplate(docs, ["doc_id", "source", "text"], "doc_id", "source", "text", percent, 3).collect()
    pages, holders = collections.Counter(r[3] for r in rows), collections.Counter()
    for _, t, _, s, _ in rows:
        for line in {norm(x) for x in (t or "").split("\n")} - {""}:
            holders[s, line] += 1
    assert len(got) == len(rows)
    for r in got:
        out, dropped = [], 0
        for line in (r.text or "").split("\n"):
            h = holders[r.source, norm(line)]
            if norm(line) and h >= 3 and h * 100 > pages[r.source] * percent:
                dropped += 1
            else:
                out.append(line)
        assert r.n_dropped == dropped
        assert r.new_text == (None if r.text is None else "\n".join(out))
    assert sum(r.n_dropped for r in got)


def test_page_text(spark):
    page = "<html><head><script>var a='<p>';</script></head><body><!-- x --><p>One &amp; two</p><div>three<br>four</div></body></html>"
    got = spark.createDataFrame([(page, "https://A.example/x?y"), (None, None)], "html string, url string").select(line_dedup.page_text(F.col("html")).alias("t"), line_dedup.page_host(F.col("url")).alias("h")).collect()
    assert got[0].t == "One & two\nthree\nfour" and got[0].h == "a.example" and got[1].t is None


def test_line_dedup_edges(empty, wide):
    got = line_dedup.drop_boilerplate(wide, wide.columns, "doc_id", "source", "text")
    made = ["n_lines", "n_dropped", "new_text"]
    assert got.columns == [c for c in wide.columns if c not in made] + made and got.count() == wide.count()
    assert line_dedup.drop_boilerplate(empty, ["doc_id"], "doc_id", "source", "text").collect() == []


TABLES = {
    "documents": ("doc_id long, text string, lang string, source string, n_chars long", None),
    "pages": (
        "page_id long, url string, html string",
        [(k, f"https://{'small' if k < 3 else 'Large'}.example/{k}", f"<html><body><nav>Home &amp; news</nav><p>page {k} of many words</p><div>{'Twice told' if k in (4, 9) else 'own ' + str(k)}</div><script>x<p></script></body></html>") for k in range(30)],
    ),
}


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    """A small directory of tables on which the queries' SQL has something to do."""
    out = tmp_path_factory.mktemp("tables")
    for name, (schema, data) in TABLES.items():
        few = list({r[0]: r for r in rows if r[0] is not None}.values())  # the SQL takes an id for one row
        spark.createDataFrame(data or few + [(6000 + k, f"notice of line {k % 2}\n" + " ".join(f"u{k}-{j}" for j in range(60)), "en", "b", 0) for k in range(24)], schema).coalesce(1).write.parquet(f"{out}/{name}.parquet")
    return str(out)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    result = con.execute(queries.SQL[name])
    names = [d[0] for d in result.description]
    want = sorted((tuple(row[names.index(c)] for c in columns) for row in result.fetchall()), key=str)
    assert got == want
    at = columns.index("n_dropped" if name == "op9_line_dedup" else "n_removed_words")
    assert sum(r[at] for r in got) > 20


def test_small_host_loses_repeated_lines(spark, sf_dir):
    got = {r.page_id: r for r in queries.QUERIES["op9_line_dedup"](spark, sf_dir).collect()}
    assert got[0].new_text == "page 0 of many words\nown 0" and got[0].n_dropped == 1
    assert got[4].new_text == "page 4 of many words\nTwice told"  # 2 of 27 pages
