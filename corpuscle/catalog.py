"""Registry of the engine's queries: name -> callable, name -> SQL for DuckDB."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.functions import drift
from corpuscle.functions.text import byte_count, count_chars, count_words, languages, nfc
from corpuscle.operators import bounds, contexts, corpus, fertility, merge, mining, selection, serving, vocab
from corpuscle.plans.tables import scratch_path, ship, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ALPHA, DELTA = 0.05, 0.05
#: Byte runs that the merge queries take as given.
MERGES = [b"the", b"th", b" the ", b"tion", b"ent", b" de ", b"le", b"er", b"en", b"ou", b"ing", b"and"]


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.lines(_table(spark, sf_dir, "documents"))


SPACE = r"[\s\x0B\x{85}\x1C-\x1F\p{Z}]"
LINES = """l0 AS (SELECT doc_id, lang, string_split(text, chr(10)) AS parts FROM documents),
l1 AS (SELECT doc_id, lang, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS pos FROM l0),
lines AS (SELECT * FROM l1 WHERE trim(text) <> '')"""
NUMBERED = LINES + """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, pos) - 1 AS line_no, count(*) OVER (PARTITION BY lang) AS n_lines FROM lines)"""
PAIRS = NUMBERED + """,
pairs AS (SELECT a.lang, a.line_no, a.text, b.text AS pivot_text FROM numbered a JOIN numbered b ON a.line_no = b.line_no AND b.lang = 'en' WHERE a.lang <> 'en')"""
def chars_sql(x: str) -> str:
    return f"CAST(length(regexp_replace(nfc_normalize({x}), '{SPACE}', '', 'g')) AS BIGINT)"


def words_sql(x: str) -> str:
    return f"CAST(len(list_filter(regexp_split_to_array(nfc_normalize({x}), '{SPACE}+'), lambda w: w <> '')) AS BIGINT)"


COST = f"""s AS (SELECT lang, count(*) AS n_sentences, CAST(sum(strlen(text)) AS BIGINT) AS total_tokens, CAST(sum({chars_sql('text')}) AS BIGINT) AS total_chars, CAST(sum({words_sql('text')}) AS BIGINT) AS total_words FROM lines GROUP BY lang),
p AS (SELECT greatest(1, coalesce(sum(total_tokens), 0)) AS pt FROM s WHERE lang = 'en')
SELECT lang, n_sentences, total_tokens, total_chars, total_words, total_tokens / greatest(1, total_chars) AS tokens_per_char,
       CASE WHEN total_words > 0 THEN total_tokens / total_words END AS tokens_per_word,
       CASE WHEN lang <> 'en' THEN total_tokens / pt END AS cost_ratio,
       CASE WHEN lang <> 'en' AND total_tokens > 0 THEN 1 / (total_tokens / pt) END AS effective_context FROM s, p"""


@query(f"WITH {LINES}, {COST}")
def token_cost_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte tokens, characters and words of each language, and the cost against English."""
    rows = _lines(spark, sf_dir)
    text = nfc(F.col("text"))
    rows = rows.select("lang", "text", text.alias("nfc"))
    return fertility.cost(rows, byte_count(F.col("text")), count_chars(F.col("nfc")), count_words(F.col("nfc")))


@query(f"WITH {PAIRS} SELECT lang, count(*) AS n_pairs, quantile_cont(strlen(text) / strlen(pivot_text), 0.5) AS cost_ratio_median FROM pairs WHERE strlen(pivot_text) > 0 GROUP BY lang")
def token_cost_ratio_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.numbered(_lines(spark, sf_dir))
    return fertility.median_ratio(corpus.aligned(rows), byte_count(F.col("text")), byte_count(F.col("pivot_text")))


@query(f"WITH {LINES}, r(lang, d) AS (VALUES ('en', true), ('es', false)) SELECT lines.lang, count(*) AS n_sentences, CASE WHEN count(*) FILTER (coalesce(d, true) = false) = 0 THEN CAST(sum({words_sql('text')}) AS BIGINT) END AS total_words FROM lines LEFT JOIN r ON r.lang = lines.lang GROUP BY lines.lang")
def words_null_poison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language registered as unsegmented has no word total at all."""
    registry = languages(spark).filter("lang = 'en'").select("lang", "whitespace_delimited").unionByName(spark.createDataFrame([("es", False)], "lang string, whitespace_delimited boolean"))
    rows = _lines(spark, sf_dir).join(F.broadcast(registry), "lang", "left")  # a row for each language
    words = count_words(F.col("text"), F.coalesce("whitespace_delimited", F.lit(True)))
    return rows.groupBy("lang").agg(F.count("*").alias("n_sentences"), F.when(F.count_if(words.isNull()) == 0, F.sum(words)).alias("total_words"))


@query(f"""WITH {NUMBERED}, e AS (SELECT *, floor(n_lines * 0.4) AS a, floor(n_lines * 0.2) AS b FROM numbered),
k AS (SELECT lang, line_no, strlen(text) AS t, unnest(CASE WHEN n_lines < 8 THEN ['mine', 'fit', 'certify', 'eval'] WHEN line_no < a THEN ['mine'] WHEN line_no < a + b THEN ['fit'] WHEN line_no < a + 2 * b THEN ['certify'] ELSE ['eval'] END) AS split FROM e)
SELECT lang, split, count(*) AS n_lines, CAST(sum(t) AS BIGINT) AS n_tokens, CAST(min(line_no) AS BIGINT) AS first_line, CAST(max(line_no) AS BIGINT) AS last_line FROM k GROUP BY lang, split""")
def corpus_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.split(corpus.numbered(_lines(spark, sf_dir)))
    return rows.groupBy("lang", "split").agg(F.count("*").alias("n_lines"), F.sum(byte_count(F.col("text"))).alias("n_tokens"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


@query(f"""WITH {NUMBERED}, e AS (SELECT *, floor(n_lines * 0.4) AS a, floor(n_lines * 0.2) AS b FROM numbered),
k AS (SELECT lang, line_no, n_lines, unnest(list_filter(['mine', 'fit', 'certify', 'eval'], lambda s: n_lines < 8 OR (s = 'mine' AND line_no < a) OR (s = 'fit' AND line_no >= a AND line_no < a + b) OR (s = 'certify' AND line_no >= a + b AND line_no < a + 2 * b) OR (s = 'eval' AND line_no >= a + 2 * b))) AS split FROM e),
u AS (SELECT lang, line_no, count(DISTINCT split) AS k, first(n_lines) AS n FROM k GROUP BY lang, line_no)
SELECT lang, count(*) FILTER (k > 1 AND n >= 8) AS n_shared, count(*) AS n_lines FROM u GROUP BY lang""")
def split_disjoint_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand in more than one split of a corpus large enough to be split."""
    rows = corpus.split(corpus.numbered(_lines(spark, sf_dir)))
    each = rows.groupBy("lang", "line_no").agg(F.count_distinct("split").alias("k"), F.first("n_lines").alias("n"))
    return each.groupBy("lang").agg(F.count_if((F.col("k") > 1) & (F.col("n") >= 8)).alias("n_shared"), F.count("*").alias("n_lines"))


@query(f"""WITH {PAIRS}, f AS (SELECT *, {chars_sql('text')} / greatest(1, {chars_sql('pivot_text')}) AS ratio FROM pairs WHERE length(trim(text)) >= 10 AND length(trim(pivot_text)) >= 10),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY ratio) AS k, count(*) OVER (PARTITION BY lang) AS n FROM f),
m AS (SELECT lang, CASE WHEN ratio = 0 THEN 1.0 ELSE ratio END AS median, n FROM o WHERE k = floor(n / 2) + 1)
SELECT f.lang, count(*) AS n_kept, CAST(sum(strlen(text)) AS BIGINT) AS n_tokens, CAST(sum(strlen(pivot_text)) AS BIGINT) AS n_pivot_tokens FROM f JOIN m ON f.lang = m.lang WHERE n < 8 OR (ratio >= median / 3 AND ratio <= median * 3) GROUP BY f.lang""")
def bitext_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = corpus.clean_bitext(corpus.aligned(corpus.numbered(_lines(spark, sf_dir))))
    return kept.groupBy("lang").agg(F.count("*").alias("n_kept"), F.sum(byte_count(F.col("text"))).alias("n_tokens"), F.sum(byte_count(F.col("pivot_text"))).alias("n_pivot_tokens"))


@query(f"WITH {LINES} SELECT doc_id, pos::INT AS pos, {chars_sql('text')} AS n_chars, {words_sql('text')} AS n_words FROM lines")
def char_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select("doc_id", "pos", nfc(F.col("text")).alias("text"))
    return rows.select("doc_id", "pos", count_chars(F.col("text")).alias("n_chars"), count_words(F.col("text")).alias("n_words"))


def _grams_sql(n: int, source: str = "lines") -> str:
    return f"""b{n} AS (SELECT lang, doc_id, pos, hex(encode(text)) AS h, strlen(text) AS n FROM {source} WHERE strlen(text) >= {n}),
g{n} AS (SELECT lang, doc_id, pos, place, substr(h, 2 * place - 1, {2 * n}) AS gram FROM (SELECT lang, doc_id, pos, h, unnest(range(1, n - {n} + 2)) AS place FROM b{n}))"""


LIMITS = "lim AS (SELECT lang, greatest(3, round_even(count(*) / 400, 0)) AS min_count FROM lines WHERE strlen(text) >= 2 GROUP BY lang)"


def _level_sql(n: int) -> str:
    return f"f{n} AS (SELECT lang, gram, count(*) AS n_occurrences, count(DISTINCT (doc_id, pos)) AS n_docs FROM g{n} JOIN lim USING (lang) GROUP BY lang, gram, min_count HAVING count(*) >= min_count AND count(DISTINCT (doc_id, pos)) >= 2)"


def _mined_sql(longest: int) -> str:
    parts = ", ".join(f"{_grams_sql(n)}, {_level_sql(n)}" for n in range(2, longest + 1))
    return f"{LINES}, {LIMITS}, {parts}, mined AS ({' UNION ALL '.join(f'SELECT * FROM f{n}' for n in range(2, longest + 1))})"


#: A candidate is a text with a letter or digit and no line break or tab. (A byte run is valid UTF-8 iff decoding it in place succeeds.)
KEPT = "kept AS (SELECT *, length(gram) // 2 AS len FROM (SELECT *, TRY(decode(unhex(gram))) AS surface FROM mined) WHERE surface IS NOT NULL AND NOT regexp_matches(surface, '[\\n\\r\\t]') AND length(regexp_replace(surface, '[^\\p{L}\\p{N}]', '', 'g')) >= 1)"


@query(f"WITH {LINES}, {_grams_sql(1)} SELECT lang, gram, count(*) AS n FROM g1 GROUP BY lang, gram")
def unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.runs(_lines(spark, sf_dir), 1).groupBy("lang", F.hex("gram").alias("gram")).agg(F.count("*").alias("n"))


def _ngrams(n: int) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = mining.mine(_lines(spark, sf_dir), n, shortest=n)
        return found.select("lang", F.hex("gram").alias("gram"), "n_occurrences", "n_docs")

    run.__name__ = f"ngram_mine_n{n}"
    query(f"WITH {LINES}, {LIMITS}, {_grams_sql(n)}, {_level_sql(n)} SELECT lang, gram, n_occurrences, n_docs FROM f{n}")(run)


for _n in (2, 3, 4):
    _ngrams(_n)


#: Longest run that is mined where nothing else is said.
LONGEST = 8


def _candidates(spark: SparkSession, sf_dir: str, longest: int = LONGEST) -> DataFrame:
    return mining.materialized(mining.mine(_lines(spark, sf_dir), longest, held=written))


def _small(candidates: DataFrame, most: int) -> DataFrame:
    """A short list of candidates: `most` for each language."""
    return mining.ranked(candidates, most)


RANKED = "ranked AS (SELECT *, n_occurrences * (len - 1) AS saving, row_number() OVER (PARTITION BY lang ORDER BY n_occurrences * (len - 1) DESC, n_occurrences DESC, gram) AS rank FROM kept)"


@query()
def mine_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _small(_candidates(spark, sf_dir), 50)
    return ranked.select("lang", "rank", F.hex("gram").alias("gram"), "n_occurrences", "n_docs", "saving")


SQL["mine_ranked"] = f"WITH {_mined_sql(LONGEST)}, {KEPT}, {RANKED} SELECT lang, rank::INT AS rank, gram, n_occurrences, n_docs, saving::BIGINT AS saving FROM ranked WHERE rank <= 50"

NESTED = """sizes AS (SELECT lang, gram, len, n_occurrences, unnest(range(2, len)) AS k FROM kept WHERE len > 2),
parts AS (SELECT lang, substr(gram, 2 * i - 1, 2 * k) AS gram, max(n_occurrences) AS n FROM (SELECT *, unnest(range(1, len - k + 2)) AS i FROM sizes) GROUP BY 1, 2),
single AS (SELECT kept.* FROM kept LEFT JOIN parts ON kept.lang = parts.lang AND kept.gram = parts.gram WHERE parts.n IS NULL OR parts.n < kept.n_occurrences)"""


@query(f"WITH {_mined_sql(LONGEST)}, {KEPT}, {NESTED} SELECT lang, gram, n_occurrences, n_docs FROM single")
def mine_nested_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = mining.without_nested(_candidates(spark, sf_dir))
    return kept.select("lang", F.hex("gram").alias("gram"), "n_occurrences", "n_docs")


@query(f"""WITH {_mined_sql(LONGEST)}, {KEPT}, c AS (SELECT lang, count(*) AS k, sum(n_occurrences * (len - 1)) AS s FROM kept GROUP BY lang), b AS (SELECT lang, count(*) AS n_docs, CAST(sum(strlen(text)) AS BIGINT) AS t FROM lines GROUP BY lang)
SELECT b.lang, n_docs, t AS n_base_tokens, coalesce(k, 0) AS n_candidates, CAST(coalesce(s, 0) AS BIGINT) AS upper_bound_saving, CASE WHEN t > 0 THEN least(1.0, CAST(coalesce(s, 0) AS BIGINT) / t) ELSE 0.0 END AS headroom FROM b LEFT JOIN c USING (lang)""")
def mining_headroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.report(_lines(spark, sf_dir), _candidates(spark, sf_dir))


PATTERN = "|".join(e.decode() for e in sorted(MERGES, key=lambda e: (-len(e), e)))
MERGED = f"strlen(regexp_replace(text, '{PATTERN}', '#', 'g'))"


@query(f"WITH {LINES} SELECT lang, count(*) AS n_lines, CAST(sum(strlen(text)) AS BIGINT) AS base_tokens, CAST(sum({MERGED}) AS BIGINT) AS merged_tokens, CAST(sum(strlen(text) - {MERGED}) AS BIGINT) AS saved FROM lines GROUP BY lang")
def merge_saved_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.encode("text", "utf-8")
    rows = _lines(spark, sf_dir).select("lang", byte_count(F.col("text")).alias("base"), merge.merged_size(body, MERGES).alias("merged"))
    return rows.groupBy("lang").agg(F.count("*").alias("n_lines"), F.sum("base").alias("base_tokens"), F.sum("merged").alias("merged_tokens"), F.sum(F.col("base") - F.col("merged")).alias("saved"))


@query(f"WITH {LINES}, e AS (SELECT lang, unnest(regexp_extract_all(text, '{PATTERN}')) AS surface FROM lines) SELECT lang, surface, count(*) AS n FROM e GROUP BY lang, surface")
def merge_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each merge is made by the leftmost-longest pass."""
    made = _lines(spark, sf_dir).select("lang", F.explode(merge.spans(F.encode("text", "utf-8"), MERGES)).alias("h"))
    return made.groupBy("lang", "h").agg(F.count("*").alias("n")).select("lang", F.decode(F.unhex("h"), "utf-8").alias("surface"), "n")


@query(f"""WITH {LINES}, p AS (SELECT text, regexp_extract_all(text, '(?s){PATTERN}|.') AS pieces FROM lines)
SELECT count(*) AS n_lines, count(*) FILTER (list_aggregate(pieces, 'string_agg', '') <> text) AS not_lossless, count(*) FILTER ({MERGED} > strlen(text)) AS longer,
  count(*) FILTER (len(list_filter(pieces, lambda x: length(x) > 1 AND NOT list_contains({[e.decode() for e in MERGES]}, x))) > 0) AS outside_view, (SELECT count(*) FROM range({len(MERGES)}) r(k) WHERE 260 + k < 260) AS not_appended FROM p""")
def merge_roundtrip_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pack's invariants as counts of violations."""
    from corpuscle.functions.text import N_SPECIAL, byte_ids, byte_tokens

    patterns = {tuple(b + N_SPECIAL for b in e): 256 + N_SPECIAL + k for k, e in enumerate(MERGES)}
    rows = _lines(spark, sf_dir).select(byte_ids(byte_tokens(F.col("text"))).alias("ids"))
    return merge.audit(rows, "ids", patterns, 256 + N_SPECIAL)


@query(f"""WITH {LINES}, s AS (SELECT lang, CAST(sum(strlen(text)) AS BIGINT) AS b, CAST(sum({MERGED}) AS BIGINT) AS a FROM lines GROUP BY lang)
SELECT lang, b AS before_tokens, a AS after_tokens, CASE WHEN b > 0 THEN 1 - a / b ELSE 0.0 END AS token_reduction, CASE WHEN a > 0 THEN b / a ELSE 1.0 END AS context_gain, CASE WHEN b > 0 THEN 1 - a / b ELSE 0.0 END AS cost_reduction, (b - a) / {len(MERGES)} AS tokens_per_new_row FROM s""")
def pack_vs_base_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.encode("text", "utf-8")
    s = _lines(spark, sf_dir).groupBy("lang").agg(F.sum(byte_count(F.col("text"))).alias("before_tokens"), F.sum(merge.merged_size(body, MERGES)).alias("after_tokens"))
    return s.select("lang", "before_tokens", "after_tokens", *fertility.reduction(F.col("before_tokens"), F.col("after_tokens"), F.lit(len(MERGES))))


@query(f"WITH {LINES} SELECT doc_id, pos::INT AS pos, strlen(text)::BIGINT AS base_tokens, {MERGED}::BIGINT AS pack_tokens, CASE WHEN strlen(text) > 0 THEN 1 - {MERGED} / strlen(text) ELSE 0.0 END AS reduction FROM lines")
def tokenization_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select("doc_id", "pos", byte_count(F.col("text")).alias("base_tokens"), merge.merged_size(F.encode("text", "utf-8"), MERGES).alias("pack_tokens"))
    return rows.select("*", F.when(F.col("base_tokens") > 0, 1 - F.col("pack_tokens") / F.col("base_tokens")).otherwise(0.0).alias("reduction"))


@query(f"WITH t AS (SELECT source, unnest(string_split(text, chr(10))) AS text FROM documents) SELECT source, count(*) AS n_lines, CAST(sum(strlen(text)) AS BIGINT) AS base_tokens, CAST(sum({MERGED}) AS BIGINT) AS pack_tokens FROM t WHERE trim(text) <> '' GROUP BY source")
def retokenised_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("source", F.explode(F.split("text", "\n")).alias("text")).filter(F.trim("text") != "")
    return rows.groupBy("source").agg(F.count("*").alias("n_lines"), F.sum(byte_count(F.col("text"))).alias("base_tokens"), F.sum(merge.merged_size(F.encode("text", "utf-8"), MERGES)).alias("pack_tokens"))


#: Candidates of each language in a short list.
SHORT = 12
SHORTLIST = f"{_mined_sql(3)}, {KEPT}, {RANKED}, short AS (SELECT * FROM ranked WHERE rank <= {SHORT})"
#: All candidates: what coverage, gains and bounds are over.
GROUND = f"{_mined_sql(3)}, {KEPT}, short AS (SELECT * FROM kept)"
COVERS = f"""occ AS (SELECT g.lang, g.gram, doc_id, pos, place, len FROM (SELECT lang, doc_id, pos, place, gram FROM g2 UNION ALL SELECT lang, doc_id, pos, place, gram FROM g3) g JOIN short ON short.lang = g.lang AND short.gram = g.gram),
covers AS (SELECT DISTINCT lang, gram, doc_id, pos, slot FROM (SELECT *, unnest(range(place, place + len - 1)) AS slot FROM occ))"""


def _shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(_small(_candidates(spark, sf_dir, 3), SHORT).select("lang", "gram"), "short")  # read more than once


def _ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(_candidates(spark, sf_dir, 3).select("lang", "gram"), "ground")


@query(f"WITH {GROUND}, {COVERS} SELECT lang, count(DISTINCT (doc_id, pos, slot)) AS covered, count(*) AS slots_of_candidates FROM covers GROUP BY lang")
def boundary_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.coverage_of(_lines(spark, sf_dir), _ground(spark, sf_dir))


FIRST = "best AS (SELECT lang, gram FROM (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, gram) AS k FROM covers GROUP BY lang, gram) WHERE k = 1), done AS (SELECT DISTINCT c.lang, doc_id, pos, slot FROM covers c JOIN best b ON c.lang = b.lang AND c.gram = b.gram)"


def _first_pick(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines, all candidates, and the best one of each language."""
    rows, ground = _lines(spark, sf_dir), _ground(spark, sf_dir)
    return rows, ground, selection.greedy_of(rows, ground, 1).select("lang", "gram")


@query(f"WITH {GROUND}, {COVERS}, {FIRST} SELECT c.lang, c.gram, count(*) AS gain FROM covers c ANTI JOIN done d ON c.lang = d.lang AND c.doc_id = d.doc_id AND c.pos = d.pos AND c.slot = d.slot GROUP BY c.lang, c.gram")
def marginal_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains of all candidates once the best of each language is taken."""
    return selection.gains_of(*_first_pick(spark, sf_dir)).select("lang", F.hex("gram").alias("gram"), "gain")


def _greedy_sql(steps: int) -> str:
    out = f"WITH {GROUND}, {COVERS}, left0 AS MATERIALIZED (SELECT * FROM covers)"
    for k in range(1, steps + 1):
        out += f""",
pick{k} AS MATERIALIZED (SELECT lang, gram, gain FROM (SELECT lang, gram, count(*) AS gain, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, gram) AS k FROM left{k - 1} GROUP BY lang, gram) WHERE k = 1),
left{k} AS MATERIALIZED (SELECT l.* FROM left{k - 1} l ANTI JOIN (SELECT c.lang, doc_id, pos, slot FROM left{k - 1} c JOIN pick{k} p ON c.lang = p.lang AND c.gram = p.gram) d ON l.lang = d.lang AND l.doc_id = d.doc_id AND l.pos = d.pos AND l.slot = d.slot)"""
    return out + " " + " UNION ALL ".join(f"SELECT lang, {k} AS step, gram, gain FROM pick{k}" for k in range(1, steps + 1))


@query(_greedy_sql(3))
def greedy_select_b3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.greedy_of(_lines(spark, sf_dir), _ground(spark, sf_dir), 3).select("lang", "step", F.hex("gram").alias("gram"), "gain")


@query(f"""WITH {GROUND}, {COVERS}, {FIRST}, n AS (SELECT lang, count(*) AS covered FROM done GROUP BY lang),
g AS (SELECT c.lang, c.gram, count(*) AS gain FROM covers c ANTI JOIN done d ON c.lang = d.lang AND c.doc_id = d.doc_id AND c.pos = d.pos AND c.slot = d.slot GROUP BY c.lang, c.gram),
t AS (SELECT lang, sum(gain) AS more FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY gain DESC, gram) AS k FROM g) WHERE k <= 3 GROUP BY lang)
SELECT n.lang, covered, CAST(covered + coalesce(more, 0) AS BIGINT) AS bound FROM n LEFT JOIN t USING (lang)""")
def online_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.online_bound_of(*_first_pick(spark, sf_dir), 3)


BUDGETS = [1, 3, 6, 12]


def _curve_sql() -> str:
    saved = lambda b: f"CAST(sum(strlen(text) - strlen(regexp_replace(text, '{'|'.join(e.decode() for e in sorted(MERGES[:b], key=lambda e: (-len(e), e)))}', '#', 'g'))) AS BIGINT)"
    return f"WITH {LINES} " + " UNION ALL ".join(f"SELECT {b} AS budget, {min(b, len(MERGES))} AS n_selected, {saved(b)} AS exact_savings, {saved(b)} / CAST(sum(strlen(text)) AS BIGINT) AS token_reduction FROM lines" for b in BUDGETS)


@query(_curve_sql())
def budget_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.budget_curve(_lines(spark, sf_dir), MERGES, BUDGETS)


@query(f"""WITH {SHORTLIST}, {COVERS}, o AS (SELECT occ.*, row_number() OVER (PARTITION BY occ.lang, occ.gram ORDER BY occ.doc_id, occ.pos, place) AS k FROM occ)
SELECT o.lang, o.gram, o.doc_id, o.pos::INT AS pos, place::INT AS place, k::INT AS k, substr(h, greatest(1, 2 * (place - 12) - 1), 2 * least(12, place - 1)) AS prefix, substr(h, 2 * (place + o.len) - 1, 12) AS suffix
FROM o JOIN b2 ON o.doc_id = b2.doc_id AND o.pos = b2.pos AND o.lang = b2.lang WHERE k <= 4""")
def contexts_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contexts.first_occurrences(_lines(spark, sf_dir), _shortlist(spark, sf_dir), 4)
    return found.select("lang", F.hex("gram").alias("gram"), "doc_id", "pos", F.col("at").alias("place"), "k", F.hex("prefix").alias("prefix"), F.hex("suffix").alias("suffix"))


#: Candidates of all languages, looked for in English lines.
@query(f"""WITH {SHORTLIST}, all_grams AS (SELECT DISTINCT gram, len FROM short), cand AS (SELECT l.lang, gram FROM (SELECT DISTINCT lang FROM lines) l, all_grams),
hit AS (SELECT DISTINCT g.lang, g.gram FROM (SELECT lang, gram FROM g2 UNION SELECT lang, gram FROM g3) g)
SELECT cand.lang, count(*) AS n_candidates, count(hit.gram) AS n_with_context, avg(CASE WHEN hit.gram IS NULL THEN 0.0 ELSE 1.0 END) AS coverage FROM cand LEFT JOIN hit ON cand.lang = hit.lang AND cand.gram = hit.gram GROUP BY cand.lang""")
def context_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates of all languages have a context in each language."""
    rows = _lines(spark, sf_dir)
    grams = _shortlist(spark, sf_dir).select("gram").distinct()
    asked = rows.select("lang").distinct().crossJoin(F.broadcast(grams))  # a short list for each language
    return contexts.share_with_context(asked, contexts.occurrences(rows, asked, first=1))


@query(f"WITH {SHORTLIST} SELECT lang, gram, rank::INT AS rank, CAST(259 + row_number() OVER (ORDER BY lang, rank) AS BIGINT) AS new_id FROM short")
def pack_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    packs = _small(_candidates(spark, sf_dir, 3), SHORT).select("lang", "rank", "gram")
    return vocab.attach(packs, 260).select("lang", F.hex("gram").alias("gram"), "rank", "new_id")


@query(f"""WITH {SHORTLIST}, w AS (SELECT 'base' AS view, NULL AS lang, true AS i UNION ALL SELECT DISTINCT lang, lang, false FROM short UNION ALL SELECT DISTINCT lang || ':in', lang, true FROM short)
SELECT w.view, count(*) FILTER (short.lang = w.lang AND NOT i) AS n_open, count(*) - count(*) FILTER (short.lang = w.lang AND NOT i) AS n_closed FROM short, w GROUP BY w.view""")
def logit_mask_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    packs = vocab.attach(_small(_candidates(spark, sf_dir, 3), SHORT).select("lang", "rank", "gram"), 260)
    masks = vocab.masks(packs, vocab.views(packs), 260)
    return masks.groupBy("view").agg(F.count_if(F.col("logit") == 0).alias("n_open"), F.count_if(F.col("logit") != 0).alias("n_closed"))


# --- drift and bounds -------------------------------------------------------------------------


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector beside the next one, as the logits of one position before and after a change."""
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("z"))
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("z").alias("z2"))
    return e.join(after, "vec_id")


VECTORS = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings),
p AS (SELECT a.vec_id, a.label, a.z, b.z AS z2 FROM e a JOIN e b ON b.vec_id = a.vec_id + 1),
q AS (SELECT *, list_transform(z, lambda v: v - ln(list_sum(list_transform(z, lambda u: exp(u - list_max(z))))) - list_max(z)) AS lp, list_transform(z2, lambda v: v - ln(list_sum(list_transform(z2, lambda u: exp(u - list_max(z2))))) - list_max(z2)) AS lq FROM p),
d AS (SELECT vec_id, label, greatest(0.0, list_sum(list_transform(range(1, len(z) + 1), lambda i: exp(lp[i]) * (lp[i] - lq[i])))) AS kl,
  least(1.0, greatest(0.0, 0.5 * list_sum(list_transform(range(1, len(z) + 1), lambda i: abs(exp(lp[i]) - exp(lq[i])))))) AS tv,
  list_max(list_transform(range(1, len(z) + 1), lambda i: abs(z[i] - z2[i]))) AS linf,
  sqrt(list_sum(list_transform(range(1, len(z) + 1), lambda i: (z[i] - z2[i]) ** 2))) / greatest(sqrt(list_sum(list_transform(z, lambda x: x * x))), 1e-6) AS l2 FROM q)"""


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir).withColumn("lp", drift.log_softmax(F.col("z"))).withColumn("lq", drift.log_softmax(F.col("z2")))
    z, z2 = F.col("z"), F.col("z2")
    return p.select("vec_id", "label", drift.kl(F.col("lp"), F.col("lq")).alias("kl"), drift.tv(F.col("lp"), F.col("lq")).alias("tv"), drift.linf(z, z2).alias("linf"), drift.relative_l2(z, z2).alias("l2"))


@query(f"WITH {VECTORS} SELECT vec_id, label, round(kl, 6) AS kl, round(tv, 6) AS tv, round(linf, 6) AS linf, round(l2, 6) AS l2 FROM d")
def drift_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift(spark, sf_dir).select("vec_id", "label", *[F.round(c, 6).alias(c) for c in ("kl", "tv", "linf", "l2")])


@query(f"WITH {VECTORS} SELECT label, count(*) AS n, round(2 * max(linf), 6) AS kl_limit, round(max(kl), 6) AS worst_kl, count(*) FILTER (kl > 2 * linf + 1e-9) AS n_above FROM d GROUP BY label")
def drift_lipschitz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KL never exceeds twice the sup norm of the logits' difference."""
    d = _drift(spark, sf_dir)
    return d.groupBy("label").agg(F.count("*").alias("n"), F.round(drift.kl_from_linf(F.max("linf")), 6).alias("kl_limit"), F.round(F.max("kl"), 6).alias("worst_kl"), F.count_if(F.col("kl") > 2 * F.col("linf") + 1e-9).alias("n_above"))


K_OF = f"""lg AS (SELECT n, i, lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({1 - ALPHA}) + (n - i) * ln({ALPHA}) AS lm FROM (SELECT n, unnest(range(0, n)) AS i FROM (SELECT DISTINCT n FROM sizes))),
cdf AS (SELECT n, i, sum(exp(lm)) OVER (PARTITION BY n ORDER BY i) AS mass FROM lg),
kt AS (SELECT n, min(i) + 1 AS k FROM cdf WHERE mass >= {1 - DELTA} GROUP BY n)"""


def _conformal_sql(rows: str, key: str, value: str) -> str:
    return f"""sizes AS (SELECT {key}, count({value}) AS n FROM {rows} GROUP BY {key}), {K_OF},
o AS (SELECT {key}, {value} AS v, row_number() OVER (PARTITION BY {key} ORDER BY {value}) AS r FROM {rows}),
bnd AS (SELECT sizes.{key}, sizes.n, kt.k, coalesce(o.v, CAST('Infinity' AS DOUBLE)) AS bound FROM sizes LEFT JOIN kt ON kt.n = sizes.n LEFT JOIN o ON o.{key} = sizes.{key} AND o.r = kt.k)"""


@query(f"WITH {_conformal_sql('events', 'event_type', 'value')} SELECT event_type, n, k, bound FROM bnd")
def drift_bounds_conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds.conformal(_table(spark, sf_dir, "events"), "event_type", "value", ALPHA, DELTA)


@query(f"WITH {VECTORS}, {_conformal_sql('d', 'label', 'kl')} SELECT label, n, k, round(bound, 6) AS bound FROM bnd")
def token_kl_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bounds.conformal(_drift(spark, sf_dir), "label", "kl", ALPHA, DELTA)
    return b.withColumn("bound", F.round("bound", 6))


@query("""WITH r AS (SELECT event_type, least(1.0, greatest(0.0, value / 1000)) AS v FROM events), s AS (SELECT event_type, count(*) AS n, avg(v) AS mean, var_samp(v) AS var FROM r GROUP BY event_type)
SELECT event_type, n, round(mean, 6) AS mean, round(least(1.0, mean + sqrt(2 * var * ln(2 / 0.05) / n) + 7 * ln(2 / 0.05) / (3 * (n - 1))), 6) AS bernstein, round(least(1.0, mean + sqrt(ln(1 / 0.05) / (2 * n))), 6) AS hoeffding FROM s""")
def drift_bounds_bernstein(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = _table(spark, sf_dir, "events").select("event_type", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 1000)).alias("v"))
    b = bounds.mean_bounds(scaled, "event_type", "v", DELTA)
    return b.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "bernstein", "hoeffding")])


@query("SELECT event_type, count(*) AS n, avg(CASE WHEN value > 100 THEN 1.0 ELSE 0.0 END) AS clip_rate, max(value) AS worst FROM events GROUP BY event_type")
def clip_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg((F.col("value") > 100).cast("double")).alias("clip_rate"), F.max("value").alias("worst"))


@query(f"WITH sizes AS (SELECT unnest([10, 28, 29, 58, 59, 100, 200, 1000]) AS n), {K_OF} SELECT CAST(sizes.n AS BIGINT) AS n, kt.k FROM sizes LEFT JOIN kt ON kt.n = sizes.n")
def tolerance_index_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.createDataFrame([(n,) for n in (10, 28, 29, 58, 59, 100, 200, 1000)], "n long")
    return n.select("n", bounds.tolerance_index_of(F.col("n"), ALPHA, DELTA).alias("k"))


@query(f"""WITH {VECTORS}, {_conformal_sql('d', 'label', 'kl')}, t AS (SELECT label, max(tv) AS tv, max(l2) AS l2 FROM d GROUP BY label),
r AS (SELECT bnd.label, CASE WHEN n < 30 THEN 'too_few_measurements' WHEN isinf(bound) THEN 'no_kl_bound' WHEN bound > 2.0 THEN 'kl_above' WHEN tv > 0.9 THEN 'tv_above' WHEN l2 > 5 THEN 'offcontext_above' END AS reason FROM bnd JOIN t USING (label))
SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n_tokens FROM r GROUP BY 1""")
def acceptance_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _drift(spark, sf_dir)
    kl = bounds.conformal(d, "label", "kl", ALPHA, DELTA)
    worst = d.groupBy("label").agg(F.max("tv").alias("tv"), F.max("l2").alias("l2"))
    reason = bounds.decision(F.col("n"), F.col("bound"), F.col("tv"), F.col("l2"), F.lit(0.0), least_n=30, max_kl=2.0, max_tv=0.9, max_off=5.0, max_emit=1.0, input_only=True)
    return kl.join(worst, "label").groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n_tokens"))


HALVES = "old AS (SELECT * FROM events WHERE user_id % 2 = 0), fresh AS (SELECT * FROM events WHERE user_id % 2 = 1)"
COVERED = f"""{HALVES}, {_conformal_sql('old', 'event_type', 'value')},
g AS (SELECT f.event_type, bound, avg(CASE WHEN value <= bound + 1e-12 THEN 1.0 ELSE 0.0 END) AS fraction, count(*) AS n FROM fresh f JOIN bnd USING (event_type) WHERE NOT isinf(bound) GROUP BY f.event_type, bound HAVING count(*) >= 2),
u AS (SELECT *, least(1.0, fraction + 2.326 * sqrt(greatest(0.0, fraction * (1 - fraction)) / n) + 0.5 / n) AS upper_ci FROM g)"""


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds from one half of the users, held against the other half's events."""
    events = _table(spark, sf_dir, "events")
    limits = bounds.conformal(events.filter("user_id % 2 = 0"), "event_type", "value", ALPHA, DELTA)
    return bounds.coverage(limits, events.filter("user_id % 2 = 1"), "event_type", "value", ALPHA, DELTA)


@query(f"WITH {COVERED} SELECT event_type, bound, round(fraction, 6) AS fraction, n, round(upper_ci, 6) AS upper_ci, upper_ci < {1 - ALPHA} AS violated FROM u")
def coverage_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _covered(spark, sf_dir).select("event_type", "bound", F.round("fraction", 6).alias("fraction"), "n", F.round("upper_ci", 6).alias("upper_ci"), "violated")


@query(f"""WITH {COVERED}, s AS (SELECT count(*) AS n, count(*) FILTER (upper_ci < {1 - ALPHA}) AS v, avg(fraction) AS mc, avg(CAST({1 - ALPHA} AS DOUBLE)) AS mt FROM u)
SELECT n AS n_checked, v AS n_violated, v / greatest(1, n) AS violation_rate, round({DELTA} + 2.326 * sqrt(greatest({DELTA} * (1 - {DELTA}), 1e-6) / greatest(1, n)) + 1.0 / greatest(1, n), 6) AS allowance, round(mc, 6) AS mean_coverage, round(mt, 6) AS mean_target,
  v / greatest(1, n) <= {DELTA} + 2.326 * sqrt(greatest({DELTA} * (1 - {DELTA}), 1e-6) / greatest(1, n)) + 1.0 / greatest(1, n) AS ok FROM s""")
def verification_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = bounds.verdict(_covered(spark, sf_dir))
    return v.select("n_checked", "n_violated", "violation_rate", F.round("allowance", 6).alias("allowance"), F.round("mean_coverage", 6).alias("mean_coverage"), F.round("mean_target", 6).alias("mean_target"), "ok")


@query(f"WITH {VECTORS}, {_conformal_sql('d', 'label', 'kl')} SELECT label, n, round(bound, 6) AS bound FROM bnd ORDER BY bound DESC, label LIMIT 10")
def worst_bound_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten worst bounds."""
    return bounds.conformal(_drift(spark, sf_dir), "label", "kl", ALPHA, DELTA).orderBy(F.desc("bound"), "label").limit(10).select("label", "n", F.round("bound", 6).alias("bound"))


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings), w AS (SELECT z AS w FROM e WHERE vec_id = (SELECT min(vec_id) FROM e)),
m AS (SELECT label, 1 / (1 + exp(-(list_dot_product(z, w) - ln(list_sum(list_transform(z, lambda u: exp(u))))))) AS mass FROM e, w) SELECT label, count(*) AS n, round(avg(mass), 6) AS mean_mass, round(max(mass), 6) AS worst_mass FROM m GROUP BY label""")
def offcontext_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that one output row takes at positions where it does not belong."""
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("z"))
    row = e.orderBy("vec_id").limit(1).select(F.col("z").alias("w"))
    log_z = F.log(drift.total(F.transform("z", F.exp)))
    mass = drift.sigmoid(drift.dot(F.col("z"), F.col("w")) - log_z)
    m = e.crossJoin(F.broadcast(row)).select("label", mass.alias("mass"))  # one row
    return m.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("mass"), 6).alias("mean_mass"), F.round(F.max("mass"), 6).alias("worst_mass"))


@query("""WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings), n AS (SELECT avg(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))) AS target FROM embeddings),
c AS (SELECT label, dim, avg(v) AS v FROM x GROUP BY label, dim), l AS (SELECT label, sqrt(sum(v * v)) AS len FROM c GROUP BY label)
SELECT label, dim::INT AS dim, round(v, 6) AS mean_value, round(v * target / len, 6) AS norm_matched FROM c JOIN l USING (label), n""")
def composition_norm_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean row of each label's vectors, plain and scaled to the table's mean norm."""
    e = _table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("z"))
    target = e.agg(F.avg(drift.norm(F.col("z"))).alias("target"))
    c = e.select("label", F.posexplode("z").alias("dim", "v")).groupBy("label", "dim").agg(F.avg("v").alias("v"))
    size = c.groupBy("label").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("len"))
    return c.join(size, "label").crossJoin(F.broadcast(target)).select("label", "dim", F.round("v", 6).alias("mean_value"), F.round(F.col("v") * F.col("target") / F.col("len"), 6).alias("norm_matched"))  # one row


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings),
c AS (SELECT a.vec_id, a.label, b.label AS other, list_cosine_similarity(a.z, b.z) AS s FROM e a JOIN e b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 8),
t AS (SELECT vec_id, label, other, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, other) AS k FROM c)
SELECT label, count(*) AS n, avg(CASE WHEN label = other THEN 1.0 ELSE 0.0 END) AS accuracy FROM t WHERE k = 1 GROUP BY label""")
def retrieval_accuracy_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the most similar of the next eight vectors has the vector's label."""
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("z"))
    ahead = e.select(F.explode(F.sequence(F.col("vec_id") - 8, F.col("vec_id") - 1)).alias("vec_id"), F.col("label").alias("other"), F.col("z").alias("z2"))
    s = drift.dot(F.col("z"), F.col("z2")) / (drift.norm(F.col("z")) * drift.norm(F.col("z2")))
    best = e.join(ahead, "vec_id").groupBy("vec_id", "label").agg(F.max(F.struct(F.round(s, 9).alias("s"), (-F.col("other")).alias("o"))).alias("b"))
    return best.groupBy("label").agg(F.count("*").alias("n"), F.avg((-F.col("b.o") == F.col("label")).cast("double")).alias("accuracy"))


# --- serving and cost -------------------------------------------------------------------------


def _requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each turn with all turns of its conversation before it as a request; every request is stored for the later ones."""
    c = _table(spark, sf_dir, "conversations").filter("text is not null")
    so_far = F.array_join(F.collect_list("text").over(Window.partitionBy("conv_id").orderBy("turn")), "\n")
    requests = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request"), F.encode(so_far, "utf-8").alias("ids"))
    return requests, requests.select(F.col("request").alias("entry"), "ids")


MATCHED = """q AS (SELECT conv_id * 1000 + turn AS request, hex(encode(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn))) AS h FROM conversations WHERE text IS NOT NULL),
st AS (SELECT h, min(request) AS entry FROM q WHERE length(h) >= 8 GROUP BY h),
hits AS (SELECT request, max(struct_pack(n := length(st.h) // 2, entry := entry)) AS b FROM q JOIN st ON substr(st.h, 1, 8) = substr(q.h, 1, 8) AND entry < request AND starts_with(q.h, st.h) GROUP BY request),
mt AS (SELECT q.request, b.entry AS entry, coalesce(b.n, 0)::BIGINT AS matched, (length(h) // 2)::BIGINT AS n_ids FROM q LEFT JOIN hits USING (request))"""


@query(f"WITH {MATCHED} SELECT request, entry, matched, n_ids FROM mt")
def prefix_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.longest_prefix(*_requests(spark, sf_dir), earlier=True)


@query(f"WITH {MATCHED}, s AS (SELECT count(*) AS lookups, count(*) FILTER (matched > 0) AS hits, CAST(sum(matched) AS BIGINT) AS reused, CAST(sum(n_ids - matched) AS BIGINT) AS computed FROM mt) SELECT *, hits / greatest(1, lookups) AS hit_rate, CASE WHEN reused + computed > 0 THEN reused / (reused + computed) ELSE 0.0 END AS token_reuse_rate FROM s")
def cache_reuse_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.reuse(serving.longest_prefix(*_requests(spark, sf_dir), earlier=True))


@query(f"WITH {LINES}, s AS (SELECT lang, CAST(sum(strlen(text)) AS DOUBLE) AS t FROM lines GROUP BY lang) SELECT lang, t AS tokens, 2 * 135e6 * t AS forward_flops, 6 * 135e6 * t AS reference_flops, 6 * 135e6 * t / 3.5e14 AS ratio, round(log10(6 * 135e6 * t / 3.5e14), 6) AS orders_of_magnitude FROM s")
def cost_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build's cost beside continued training on the corpus, for a model of 135 million parameters."""
    s = _lines(spark, sf_dir).groupBy("lang").agg(F.sum(byte_count(F.col("text"))).cast("double").alias("tokens"))
    n, t = F.lit(135e6), F.col("tokens")
    out = s.select("lang", "tokens", serving.forward_flops(n, t).alias("forward_flops"), *serving.cost_comparison(n, t, F.lit(3.5e14)))
    return out.withColumn("orders_of_magnitude", F.round("orders_of_magnitude", 6))


@query(f"""WITH {LINES}, k AS (SELECT 'byte' AS tokenizer, lang, strlen(text) AS t FROM lines UNION ALL SELECT 'pack', lang, {MERGED} FROM lines), s AS (SELECT tokenizer, lang, CAST(sum(t) AS BIGINT) AS total_tokens FROM k GROUP BY ALL)
SELECT a.tokenizer, a.lang, a.total_tokens, CASE WHEN a.lang <> 'en' THEN a.total_tokens / b.total_tokens END AS cost_ratio FROM s a JOIN s b ON a.tokenizer = b.tokenizer AND b.lang = 'en'""")
def atlas_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tokenizer with every language, each against English under the same tokenizer."""
    rows = _lines(spark, sf_dir)
    both = F.explode(F.array(F.struct(F.lit("byte").alias("tokenizer"), byte_count(F.col("text")).alias("t")), F.struct(F.lit("pack").alias("tokenizer"), merge.merged_size(F.encode("text", "utf-8"), MERGES).alias("t")))).alias("k")
    s = rows.select("lang", both).groupBy("k.tokenizer", "lang").agg(F.sum("k.t").alias("total_tokens"))
    pivot = s.filter("lang = 'en'").select("tokenizer", F.col("total_tokens").alias("p"))
    return s.join(F.broadcast(pivot), "tokenizer").select("tokenizer", "lang", "total_tokens", F.when(F.col("lang") != "en", F.col("total_tokens") / F.col("p")).alias("cost_ratio"))  # a row for each tokenizer


@query(f"""WITH {LINES}, s AS (SELECT lang, min_by(text, (strlen(text), hex(encode(text)))) AS probe FROM lines GROUP BY lang),
i AS (SELECT lang, list_transform(range(1, strlen(probe) + 1), lambda k: CAST('0x' || substr(hex(encode(probe)), 2 * k - 1, 2) AS INTEGER) + 4) AS ids FROM s)
SELECT lang, sha256('["260","' || array_to_string(ids, ',') || '"]') AS fingerprint FROM i""")
def fingerprint_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte tokenizer's fingerprint by its size and the ids of each language's shortest line."""
    from corpuscle.functions.text import byte_ids

    body = F.encode("text", "utf-8")
    probe = _lines(spark, sf_dir).groupBy("lang").agg(F.min_by(body, F.struct(F.octet_length("text"), F.hex(body))).alias("probe"))
    return probe.select("lang", vocab.fingerprint([F.lit("260"), F.array_join(byte_ids(F.col("probe")), ",")]).alias("fingerprint"))


@query(f"""WITH {LINES}, {_grams_sql(2)}, n2 AS (SELECT lang, substr(gram, 1, 2) AS a, gram, count(*) AS n FROM g2 GROUP BY 1, 2, 3), n1 AS (SELECT lang, a, sum(n) AS t, count(*) AS k FROM n2 GROUP BY 1, 2),
b AS (SELECT n2.lang, sum(n * -ln((n + 0.5) / (t + 128))) AS nats FROM n2 JOIN n1 USING (lang, a) GROUP BY n2.lang), c AS (SELECT lang, CAST(sum({chars_sql('text')}) AS BIGINT) AS chars FROM lines GROUP BY lang)
SELECT b.lang, chars, round(nats / ln(2) / chars, 6) AS bits_per_char FROM b JOIN c USING (lang)""")
def bigram_bits_per_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits that a smoothed byte-bigram model spends for each character of its own corpus."""
    rows = _lines(spark, sf_dir)
    n2 = mining.runs(rows, 2).groupBy("lang", "gram").agg(F.count("*").alias("n")).withColumn("a", F.substring("gram", F.lit(1), F.lit(1)))
    n1 = n2.groupBy("lang", "a").agg(F.sum("n").alias("t"))
    nats = n2.join(n1, ["lang", "a"]).groupBy("lang").agg(F.sum(F.col("n") * -F.log((F.col("n") + 0.5) / (F.col("t") + 128))).alias("nats"))
    chars = rows.groupBy("lang").agg(F.sum(count_chars(nfc(F.col("text")))).alias("chars"))
    return nats.join(chars, "lang").select("lang", "chars", F.round(F.col("nats") / F.log(F.lit(2.0)) / F.col("chars"), 6).alias("bits_per_char"))


# --- model side: no SQL, since weights come from a generator and floats from matrix products ---


def _model_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuscle.functions.text import byte_ids

    found = contexts.first_occurrences(_lines(spark, sf_dir), _small(_candidates(spark, sf_dir, 3), 3).select("lang", "gram"), 12)
    return found.select(F.concat_ws(":", "lang", F.hex("gram")).alias("token"), byte_ids(F.col("gram")).alias("ids"), byte_ids(F.col("prefix")).alias("prefix"), byte_ids(F.col("suffix")).alias("suffix"))


@query()
def synth_gauss_newton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for the top candidates and how far they lower the residual."""
    from corpuscle.plans.model import Decoder, synthesized

    rows = synthesized(_model_contexts(spark, sf_dir), Decoder())
    return rows.select("token", "n_contexts", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


@query()
def build_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole build for French."""
    from corpuscle.plans.build import build
    from corpuscle.plans.model import Decoder

    return build(_table(spark, sf_dir, "documents"), Decoder())


@query()
def generate_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy continuations of each turn, from its whole text, views mixed."""
    from corpuscle.plans.model import Decoder, generated

    c = _table(spark, sf_dir, "conversations").filter("text is not null")
    view = F.when(F.col("conv_id") % 2 == 0, "base").otherwise("letters")
    requests = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request"), view.alias("view"), F.encode("text", "utf-8").alias("ids"))
    out = generated(requests, Decoder(), {"base": list(range(260)), "letters": list(range(4 + 97, 4 + 123))}, 3)
    return out.select("request", "view", F.array_join("made", ",").alias("made"))


@query()
def stream_prefix_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations' turns served as a stream through one cache."""
    from corpuscle.streaming.prefix_cache import serve

    schema = "conv_id long, turn long, role string, text string"
    path = f"{sf_dir}/conversations.parquet"
    is_file = spark.read.parquet(path).select("_metadata.file_path").first()[0].endswith("/conversations.parquet")
    source = spark.readStream.schema(schema)
    turns = source.option("pathGlobFilter", "conversations.parquet").parquet(sf_dir) if is_file else source.parquet(path)
    requests = turns.filter("text is not null").select(F.lit("one").alias("cache"), (F.col("conv_id") * 1000 + F.col("turn")).alias("request"), F.encode("text", "utf-8").alias("ids"))
    out, at = scratch_path(spark, "prefix-cache-out"), scratch_path(spark, "prefix-cache-state")
    job = serve(requests).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.parquet(out)


from corpuscle import catalog_views as _views  # noqa: E402, F401  registers its queries
