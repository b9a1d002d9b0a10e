"""More of the engine's queries: trained subword tokenizers, views, selection figures, evaluation, cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.catalog import COVERS, GROUND, KEPT, LINES, MERGED, MERGES, PAIRS, SQL, VECTORS, _candidates, _drift, _ground, _lines, _mined_sql, _table, chars_sql, query
from corpuscle.functions import drift
from corpuscle.functions.text import byte_count, count_chars, nfc
from corpuscle.operators import corpus, evaluation, merge, mining, selection, serving, tokenizers
from corpuscle.operators.augmented import Augmented
from corpuscle.plans.tables import scratch_path, written

# --- trained subword tokenizers -----------------------------------------------------------------

#: Merges that the queries learn from English lines.
N_MERGES = 8


def _train_sql(n: int) -> str:
    """Rounds of byte-pair merging, one after another."""
    out = f"""{LINES}, h0 AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, ' ?[^ ]+')) AS word FROM lines WHERE lang = 'en') GROUP BY word ORDER BY n DESC, hex(encode(word)) LIMIT {tokenizers.MOST_WORDS}),
w0 AS MATERIALIZED (SELECT regexp_replace(hex(encode(word)), '(..)', '<\\1>', 'g') AS s, n FROM h0)"""
    for k in range(1, n + 1):
        out += f""",
p{k} AS MATERIALIZED (SELECT pair, CAST(sum(n) AS BIGINT) AS c FROM (SELECT n, unnest(list_transform(range(1, len(l)), lambda i: '<' || l[i] || '><' || l[i + 1] || '>')) AS pair FROM (SELECT n, string_split(s[2:-2], '><') AS l FROM w{k - 1})) GROUP BY pair ORDER BY c DESC, pair LIMIT 1),
w{k} AS MATERIALIZED (SELECT replace(s, pair, replace(pair, '><', '')) AS s, n FROM w{k - 1}, p{k})"""
    return out


def _merges(spark: SparkSession, sf_dir: str) -> list[tuple[str, str, int]]:
    return tokenizers.train_bpe(_lines(spark, sf_dir).filter("lang = 'en'"), N_MERGES)


@query(f"WITH {_train_sql(N_MERGES)} " + " UNION ALL ".join(f"SELECT {k} AS step, pair, c AS n FROM p{k}" for k in range(1, N_MERGES + 1)))
def bpe_train_m8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merges of a byte-level BPE that is trained on English lines."""
    rows = [(k, f"<{a}><{b}>", n) for k, (a, b, n) in enumerate(_merges(spark, sf_dir), 1)]
    return spark.createDataFrame(rows, "step int, pair string, n long")


def _bpe_count_sql() -> str:
    s = "regexp_replace(hex(encode(text)), '(..)', '<\\1>', 'g')"
    for k in range(1, N_MERGES + 1):
        s = f"replace({s}, (SELECT pair FROM p{k}), (SELECT replace(pair, '><', '') FROM p{k}))"
    return f"(length({s}) - length(replace({s}, '<', '')))"


@query(f"""WITH {_train_sql(N_MERGES)}, s AS (SELECT lang, count(*) AS n_sentences, CAST(sum({_bpe_count_sql()}) AS BIGINT) AS total_tokens, CAST(sum({chars_sql('text')}) AS BIGINT) AS total_chars FROM lines GROUP BY lang)
SELECT lang, n_sentences, total_tokens, total_tokens / total_chars AS tokens_per_char, CASE WHEN lang <> 'en' THEN total_tokens / (SELECT total_tokens FROM s WHERE lang = 'en') END AS cost_ratio FROM s""")
def token_cost_subword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a tokenizer that knows only English charges each language."""
    merges = _merges(spark, sf_dir)
    text = nfc(F.col("text"))
    s = _lines(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n_sentences"), F.sum(tokenizers.bpe_count(F.col("text"), merges)).alias("total_tokens"), F.sum(count_chars(text)).alias("total_chars"))
    pivot = s.filter("lang = 'en'").select(F.col("total_tokens").alias("p"))
    return s.crossJoin(F.broadcast(pivot)).select("lang", "n_sentences", "total_tokens", (F.col("total_tokens") / F.col("total_chars")).alias("tokens_per_char"), F.when(F.col("lang") != "en", F.col("total_tokens") / F.col("p")).alias("cost_ratio"))  # one row


def _vocabularies() -> list[str]:
    import public_tokenizers

    return [public_tokenizers.path("byte_bpe_50k.json")]


@query()
def token_cost_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for vocabulary files of the tokenizers library, through the corpus's distinct pieces."""
    rows, out = _lines(spark, sf_dir), None
    for path in _vocabularies():
        made = tokenizers.Subword(path).totals(rows, ["lang"]).withColumn("tokenizer", F.lit(path.rsplit("/", 1)[-1]))
        out = made if out is None else out.unionByName(made)
    pivot = out.filter("lang = 'en'").select("tokenizer", F.col("n_tokens").alias("p"))
    return out.join(F.broadcast(pivot), "tokenizer", "left").select("tokenizer", "lang", F.col("n_tokens").alias("total_tokens"), F.when(F.col("lang") != "en", F.col("n_tokens") / F.col("p")).alias("cost_ratio"))  # a row for each tokenizer


# --- views --------------------------------------------------------------------------------------

#: Packs of the queries: runs for each language.
PACKS = {"en": [b"the", b"th", b" the ", b"ing", b"and"], "fr": [b" de ", b"le", b"ou", b"tion"], "de": [b"ent", b"er", b"en", b"the"]}


def vocabulary() -> Augmented:
    out = Augmented()
    for lang, runs in PACKS.items():
        out.attach(lang, [tuple(b + 4 for b in r) for r in runs])
    return out


def _pattern(*langs: str) -> str:
    return "|".join(e.decode() for e in sorted({r for x in langs for r in PACKS[x]}, key=lambda e: (-len(e), e)))


VIEWS = {"base": (), "de": ("de",), "en": ("en",), "fr": ("fr",), "de+fr": ("de", "fr")}


def _view_size(langs: tuple[str, ...], text: str = "text") -> str:
    return f"strlen(regexp_replace({text}, '{_pattern(*langs)}', '#', 'g'))" if langs else f"strlen({text})"


def _taken(langs: tuple[str, ...]) -> str:
    return f"len(regexp_extract_all(text, '{_pattern(*langs)}'))" if langs else "0"


@query(f"WITH {LINES} " + " UNION ALL ".join(f"SELECT '{v}' AS view, lang, CAST(sum({_view_size(langs)}) AS BIGINT) AS n_tokens, CAST(sum({_taken(langs)}) AS BIGINT) AS n_new, 0::BIGINT + count(*) FILTER (text <> array_to_string(regexp_extract_all(text, '(?s){_pattern(*langs) + '|' if langs else ''}.'), '')) AS not_lossless FROM lines GROUP BY lang" for v, langs in VIEWS.items()))
def view_isolation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each language under each view, those that no base id is, and texts that do not come back. A view never makes another's tokens."""
    vocab = vocabulary()
    return vocab.isolation(_lines(spark, sf_dir), {name: vocab.view(*langs) for name, langs in VIEWS.items()})


@query(f"""WITH p(lang, n) AS (VALUES {', '.join(f"('{k}', {len(v)})" for k, v in PACKS.items())}), t AS (SELECT sum(n) AS added FROM p),
w AS (SELECT 'base' AS view, 0 AS n UNION ALL SELECT lang, n FROM p UNION ALL SELECT lang || ':in', 0 FROM p)
SELECT view, CAST(260 + added AS BIGINT) AS total_size, CAST(added AS BIGINT) AS n_added, CAST(260 + n AS BIGINT) AS n_open, CAST(added - n AS BIGINT) AS n_closed, view = 'base' AS is_base FROM w, t""")
def vocab_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in all, added ones, and how many each view may emit over the whole range."""
    vocab = vocabulary()
    rows = [(v.name, vocab.total_size, vocab.n_added, int(vocab.open_ids(v).sum()), int((vocab.mask(v) < 0).sum()), v.is_base) for v in vocab.views()]
    return spark.createDataFrame(rows, "view string, total_size long, n_added long, n_open long, n_closed long, is_base boolean")


ROUTED = "CASE WHEN conv_id % 4 = 0 THEN 'base' WHEN conv_id % 4 = 1 THEN 'en' WHEN conv_id % 4 = 2 THEN 'fr:in' ELSE 'de' END"
ROUTED_SQL = f"""r AS (SELECT conv_id * 1000 + turn AS request, {ROUTED} AS view, text, strlen(text) AS base FROM conversations WHERE text IS NOT NULL),
c AS (SELECT *, CASE view WHEN 'base' THEN base WHEN 'en' THEN {_view_size(('en',))} WHEN 'fr:in' THEN {_view_size(('fr',))} ELSE {_view_size(('de',))} END AS n FROM r)"""


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").filter("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("request"), F.expr(ROUTED).alias("view"), "conv_id", "turn", "role", "text")


def _router():  # noqa: ANN202
    from corpuscle.plans.router import load

    return load({k: [tuple(b + 4 for b in r) for r in v] for k, v in PACKS.items()})


@query(f"WITH {ROUTED_SQL} SELECT request, view, base::BIGINT AS base_tokens, n::BIGINT AS view_tokens, CAST(base - n AS BIGINT) AS saved, CASE WHEN base > 0 THEN 1 - n / base ELSE 0.0 END AS reduction FROM c")
def request_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each request is charged under its view and under the base view."""
    router = _router()
    counted = _routed(spark, sf_dir).select("request", "view", byte_count(F.col("text")).alias("base_tokens"), router.count(F.col("text"), F.col("view")).alias("view_tokens"))
    return counted.select("*", *evaluation.request_savings(F.col("base_tokens"), F.col("view_tokens")))


@query(f"WITH {ROUTED_SQL} SELECT view, count(*) AS n_requests, CAST(sum(n) AS BIGINT) AS n_tokens, count(*) AS n_back, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM c GROUP BY view")
def router_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests encoded under their views and decoded again without them."""
    router = _router()
    ids = _routed(spark, sf_dir).select("view", "text", router.encode(F.col("text"), F.col("view")).alias("ids"))
    back = ids.select("view", "text", F.size("ids").alias("n"), router.decode(F.col("ids")).alias("back"))
    return back.groupBy("view").agg(F.count("*").alias("n_requests"), F.sum("n").alias("n_tokens"), F.count_if(F.col("back") == F.col("text")).alias("n_back"), F.sum(F.length("back")).alias("n_chars"))


#: An assistant's turn answers the user's turn before it; a token is made in a hundredth of a second, tokenizing and masking take their part.
THROUGHPUT = f"""{ROUTED_SQL}, p AS (SELECT a.view, a.n AS prompt, b.n AS made FROM c a JOIN c b ON b.request = a.request + 1),
s AS (SELECT view, count(*) AS n_requests, sum(prompt + made) AS billed, sum(made) AS made, sum(prompt * 0.001 + made * 0.0005) AS dispatch, sum(prompt * 0.001 + made * 0.01) AS wall FROM p GROUP BY view),
t AS (SELECT view, n_requests, CAST(billed AS BIGINT) AS billed_tokens, CAST(made AS BIGINT) AS made_tokens, CASE WHEN wall > 0 THEN made / wall ELSE 0 END AS tokens_per_second, CASE WHEN wall > 0 THEN dispatch / wall ELSE 0 END AS dispatch_overhead FROM s)
SELECT t.view, t.n_requests, t.billed_tokens, t.made_tokens, round(t.tokens_per_second, 6) AS tokens_per_second, round(t.dispatch_overhead, 6) AS dispatch_overhead, round(t.tokens_per_second / b.tokens_per_second, 6) AS throughput_ratio, round(t.dispatch_overhead - b.dispatch_overhead, 6) AS overhead_delta FROM t, t b WHERE b.view = 'base'"""


@query(f"WITH {THROUGHPUT}")
def throughput_by_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Billed tokens, throughput and dispatch share of each view, beside the base view's."""
    router = _router()
    n = written(_routed(spark, sf_dir).select("request", "view", router.count(F.col("text"), F.col("view")).alias("n")), "counts")
    after = n.select((F.col("request") - 1).alias("request"), F.col("n").alias("made_tokens"))
    made, prompt = F.col("made_tokens"), F.col("n")
    runs = n.join(after, "request").select("view", prompt.alias("prompt_tokens"), "made_tokens", (prompt * 0.001).alias("tokenize_seconds"), (made * 0.0005).alias("mask_seconds"), (prompt * 0.001 + made * 0.01).alias("wall_seconds"))
    out = evaluation.views_against_base(evaluation.throughput(runs, ["view"]))
    return out.select("view", "n_requests", "billed_tokens", "made_tokens", *[F.round(c, 6).alias(c) for c in ("tokens_per_second", "dispatch_overhead", "throughput_ratio", "overhead_delta")])


# --- selection ----------------------------------------------------------------------------------

TOP = 6
NAIVE_SQL = f"""{_mined_sql(3)}, {KEPT}, top AS (SELECT * FROM (SELECT *, n_occurrences * (len - 1) AS saving, row_number() OVER (PARTITION BY lang ORDER BY n_occurrences * (len - 1) DESC, gram) AS rank FROM kept) WHERE rank <= {TOP}),
pat AS (SELECT lang, count(*) AS n_selected, string_agg(regexp_escape(surface), '|' ORDER BY len DESC, gram) AS pat FROM top GROUP BY lang),
sv AS (SELECT lines.lang, coalesce(first(n_selected), 0)::BIGINT AS n_selected, CAST(sum(strlen(text)) AS BIGINT) AS base_tokens, CAST(sum(CASE WHEN pat IS NULL THEN 0 ELSE strlen(text) - strlen(regexp_replace(text, pat, '#', 'g')) END) AS BIGINT) AS exact_savings FROM lines LEFT JOIN pat USING (lang) GROUP BY lines.lang)"""


@query(f"WITH {NAIVE_SQL} SELECT * FROM sv")
def naive_topk_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the candidates of the largest raw savings save together."""
    return selection.savings_by_lang(_lines(spark, sf_dir), selection.naive_topk(_candidates(spark, sf_dir, 3), TOP))


@query(f"""WITH {NAIVE_SQL}, cap AS (SELECT lang, CAST(sum(saving) AS BIGINT) AS bound FROM top GROUP BY lang)
SELECT lang, n_selected, base_tokens, exact_savings, coalesce(bound, 0)::BIGINT AS bound, exact_savings / base_tokens AS token_reduction, CASE WHEN coalesce(bound, 0) > 0 THEN least(1.0, exact_savings / bound) ELSE 1.0 END AS certified_optimality, CASE WHEN n_selected > 0 THEN exact_savings / n_selected ELSE 0.0 END AS savings_per_row FROM sv LEFT JOIN cap USING (lang)""")
def selection_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same beside a bound: no choice of so many candidates saves more than the largest raw savings together."""
    top = written(selection.naive_topk(_candidates(spark, sf_dir, 3), TOP), "top")
    saved = selection.savings_by_lang(_lines(spark, sf_dir), top)
    cap = top.groupBy("lang").agg(F.sum("saving").alias("bound"))
    return selection.ratios(saved.join(cap, "lang", "left").withColumn("bound", F.coalesce("bound", F.lit(0)).cast("long")))


@query()
def greedy_budget_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact savings of nested prefixes of one greedy run over all candidates."""
    rows = _lines(spark, sf_dir)
    return selection.greedy_curve(rows, selection.greedy_of(rows, _ground(spark, sf_dir), 4), [1, 2, 4])


def _greedy_curve_sql() -> str:
    out = f"WITH {GROUND}, {COVERS}, left0 AS MATERIALIZED (SELECT * FROM covers)"
    for k in range(1, 5):
        out += f""",
pick{k} AS MATERIALIZED (SELECT lang, gram FROM (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, gram) AS k FROM left{k - 1} GROUP BY lang, gram) WHERE k = 1),
left{k} AS MATERIALIZED (SELECT l.* FROM left{k - 1} l ANTI JOIN (SELECT c.lang, doc_id, pos, slot FROM left{k - 1} c JOIN pick{k} p ON c.lang = p.lang AND c.gram = p.gram) d ON l.lang = d.lang AND l.doc_id = d.doc_id AND l.pos = d.pos AND l.slot = d.slot)"""
    out += ", picks AS (" + " UNION ALL ".join(f"SELECT lang, gram, {k} AS step FROM pick{k}" for k in range(1, 5)) + ")"
    out += """, pats AS (SELECT p.lang, b.budget, count(*) AS n_selected, string_agg(regexp_escape(surface), '|' ORDER BY len DESC, p.gram) AS pat FROM picks p JOIN kept ON kept.lang = p.lang AND kept.gram = p.gram JOIN (SELECT unnest([1, 2, 4]) AS budget) b ON p.step <= b.budget GROUP BY p.lang, b.budget)
SELECT lines.lang, budget::INT AS budget, first(n_selected)::BIGINT AS n_selected, CAST(sum(strlen(text) - strlen(regexp_replace(text, pat, '#', 'g'))) AS BIGINT) AS exact_savings, CAST(sum(strlen(text) - strlen(regexp_replace(text, pat, '#', 'g'))) AS BIGINT) / CAST(sum(strlen(text)) AS BIGINT) AS token_reduction FROM lines JOIN pats USING (lang) GROUP BY lines.lang, budget"""
    return out


SQL["greedy_budget_curve"] = _greedy_curve_sql()


# --- evaluation ---------------------------------------------------------------------------------


@query("""WITH r AS (SELECT l_returnflag AS reason, l_extendedprice AS b, CASE WHEN l_linenumber = 7 THEN 'NaN'::DOUBLE ELSE l_extendedprice * (1 - 12 * l_discount + l_tax) END AS a FROM lineitem)
SELECT reason, count(*) AS n_entries, avg(CASE WHEN reason = 'N' THEN 1.0 ELSE 0.0 END) AS acceptance_rate, round(avg(CASE WHEN b > 0 AND NOT isnan(1 - a / b) THEN greatest(0.0, 1 - a / b) ELSE 0.0 END), 9) AS mean_residual_reduction FROM r GROUP BY reason""")
def residual_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acceptance and mean reduction of residuals: prices stand for the residuals before, discounted ones for those after."""
    after = F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(F.col("l_extendedprice") * (1 - 12 * F.col("l_discount") + F.col("l_tax")))
    r = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("reason"), F.col("l_extendedprice").alias("before"), after.alias("after"))
    return r.groupBy("reason").agg(F.count("*").alias("n_entries"), F.avg((F.col("reason") == "N").cast("double")).alias("acceptance_rate"), F.round(F.avg(evaluation.residual_reduction(F.col("before"), F.col("after"))), 9).alias("mean_residual_reduction"))


@query("SELECT round(sum(o_totalprice), 2) AS total_flops, CAST(sum(o_custkey) AS DOUBLE) AS total_seconds FROM orders")
def build_stage_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over the stages of builds, for which orders stand."""
    stages = _table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("stage"), F.col("o_totalprice").alias("flops"), F.col("o_custkey").cast("double").alias("seconds"))
    return evaluation.stage_totals(stages).select(F.round("total_flops", 2).alias("total_flops"), "total_seconds")


CONDITIONS = {"base": 0, "half": len(MERGES) // 2, "pack": len(MERGES)}


def _condition_sql() -> str:
    size = lambda n: f"strlen(regexp_replace(text, '{'|'.join(e.decode() for e in sorted(MERGES[:n], key=lambda e: (-len(e), e)))}', '#', 'g'))" if n else "strlen(text)"
    each = " UNION ALL ".join(f"SELECT lang, '{c}' AS condition, avg({size(n)}) AS tokens_per_sentence, avg(CASE WHEN {size(n)} <= 64 THEN 1.0 ELSE 0.0 END) AS accuracy FROM lines GROUP BY lang" for c, n in CONDITIONS.items())
    return f"""WITH {LINES}, s AS ({each}) SELECT s.lang, s.condition, s.tokens_per_sentence, s.accuracy, s.tokens_per_sentence - b.tokens_per_sentence AS tokens_delta, s.accuracy - b.accuracy AS accuracy_delta, CASE WHEN b.accuracy > 0 THEN least(1.0, s.accuracy / b.accuracy) ELSE 'NaN'::DOUBLE END AS quality_retention FROM s JOIN s b ON s.lang = b.lang AND b.condition = 'base'"""


@query(_condition_sql())
def evaluate_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens a sentence and the share of sentences within 64 tokens, without merges, with half of them and with all, against the first."""
    body, out = F.encode("text", "utf-8"), None
    rows = _lines(spark, sf_dir)
    for name, n in CONDITIONS.items():
        size = merge.merged_size(body, MERGES[:n])
        made = rows.select("lang", size.alias("t")).groupBy("lang").agg(evaluation.tokens_per_sentence(F.col("t")).alias("tokens_per_sentence"), F.avg((F.col("t") <= 64).cast("double")).alias("accuracy")).select("lang", F.lit(name).alias("condition"), "tokens_per_sentence", "accuracy")
        out = made if out is None else out.unionByName(made)
    return evaluation.against_baseline(out, ["lang"], "base")


@query("""WITH t AS (SELECT event_type, CAST(count(*) AS DOUBLE) AS tokens, sum(value) AS seconds FROM events GROUP BY event_type)
SELECT event_type, round(2 * 1e6 * tokens) AS forward, round(6 * 1e6 * tokens) AS with_gradient, CAST(tokens * 32 * 2 AS BIGINT) AS untied_params, CAST(tokens * 32 AS BIGINT) AS tied_params, 6 * 1e6 * 1e9 AS flops, round(seconds * (1e9 / tokens), 2) AS seconds, 1e9 > tokens AS extrapolated, round(40 + 40 * greatest(0.0, log10(6e6 * tokens) - 8), 6) AS bubble FROM t""")
def adaptation_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of passes and rows, a training run carried on to 1e9 tokens, and the size of its point in a figure; events stand for tokens."""
    t = _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").cast("double").alias("tokens"), F.sum("value").alias("seconds"))
    n, k = F.lit(1e6), F.col("tokens")
    flops, seconds, extrapolated = evaluation.extrapolated(n, k, F.col("seconds"), F.lit(1e9))
    return t.select(
        "event_type",
        F.round(evaluation.model_flops(n, k, F.lit(False))).alias("forward"),
        F.round(evaluation.model_flops(n, k, F.lit(True))).alias("with_gradient"),
        evaluation.row_params(k, F.lit(32), F.lit(False)).cast("long").alias("untied_params"),
        evaluation.row_params(k, F.lit(32), F.lit(True)).cast("long").alias("tied_params"),
        flops,
        F.round(seconds, 2).alias("seconds"),
        extrapolated,
        F.round(evaluation.bubble(6 * n * k), 6).alias("bubble"),
    )


@query(f"""WITH {PAIRS}, k AS (SELECT lang, text, min(strlen(pivot_text)) AS exact FROM pairs WHERE line_no % 2 = 0 GROUP BY lang, text), r AS (SELECT lang, sum(strlen(text)) / sum(strlen(pivot_text)) AS rate FROM pairs GROUP BY lang),
q AS (SELECT doc_id * 100000 + pos AS request, lang, text, strlen(text) AS t FROM lines WHERE lang <> 'en'),
e AS (SELECT request, q.lang, t, exact IS NOT NULL AS exact, coalesce(CAST(exact AS DOUBLE), greatest(1.0, t / coalesce(rate, 1.0))) AS p FROM q LEFT JOIN k ON k.lang = q.lang AND k.text = q.text LEFT JOIN r ON r.lang = q.lang)
SELECT request::BIGINT AS request, lang, t::BIGINT AS tokens, round(p, 6) AS pivot_tokens, exact, round(CASE WHEN p > 0 THEN t / p ELSE 0 END, 6) AS premium FROM e""")
def language_premium(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each line costs against its translation where one is known (every second pair), else against the corpus's ratio."""
    rows = _lines(spark, sf_dir)
    pairs = corpus.aligned(corpus.numbered(rows)).select("lang", "line_no", "text", byte_count(F.col("text")).alias("tokens"), byte_count(F.col("pivot_text")).alias("pivot_tokens"))
    totals = pairs.groupBy("lang").agg(F.sum("tokens").alias("tokens"), F.sum("pivot_tokens").alias("pivot_tokens"))
    texts = rows.filter("lang <> 'en'").select((F.col("doc_id") * 100000 + F.col("pos")).alias("request"), "lang", "text")
    out = evaluation.premium(texts, pairs.filter("line_no % 2 = 0"), totals, byte_count(F.col("text")))
    return out.select("request", "lang", "tokens", F.round("pivot_tokens", 6).alias("pivot_tokens"), "exact", F.round("premium", 6).alias("premium"))


@query(f"""WITH {LINES}, b AS (SELECT lang, (unnest(range(0, strlen(text))) + 1)::INT AS i, hex(encode(text)) AS h FROM lines), c AS (SELECT substr(h, 2 * i - 1, 2) AS byte, count(*) AS n FROM b GROUP BY 1),
w AS (SELECT byte, 1e-4 / (1e-4 + n / (SELECT sum(n) FROM c)) AS w FROM c), r(run) AS (VALUES {', '.join(f"('{e.hex().upper()}')" for e in MERGES)}),
x AS (SELECT run, unnest(range(1, length(run) // 2 + 1)) AS k FROM r), y AS (SELECT run, k, substr(run, CAST(2 * k - 1 AS INT), 2) AS byte FROM x), z AS (SELECT run, k, w FROM y JOIN w USING (byte))
SELECT run, k::INT AS k, round(w / sum(w) OVER (PARTITION BY run), 9) AS weight FROM z""")
def unigram_inverse_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of a run's tokens in its composed row, by how rare each is in the corpus."""
    counts = mining.runs(_lines(spark, sf_dir), 1).groupBy(F.hex("gram").alias("byte")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    w = counts.crossJoin(F.broadcast(total)).select("byte", (1e-4 / (1e-4 + F.col("n") / F.col("all"))).alias("w"))  # one row
    runs = spark.createDataFrame([(e.hex().upper(), k + 1, f"{b:02X}") for e in MERGES for k, b in enumerate(e)], "run string, k int, byte string")
    return runs.join(w, "byte").select("run", "k", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("run")), 9).alias("weight"))


@query(f"WITH {VECTORS} SELECT label, count(*) AS n, round(max(sqrt(list_sum(list_transform(z, lambda x: x * x)))), 6) AS row_norm_max, round(max(sqrt(list_sum(list_transform(z, lambda x: x * x)))) * max(l2), 6) AS linf_limit, round(min(least(-kl, -0.0001) + ln(list_sum(list_transform(z, lambda u: exp(u)))) - ln(1 - exp(least(-kl, -0.0001)))), 6) AS least_target FROM d JOIN p USING (vec_id, label) GROUP BY label")
def emission_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest row norm, what it lets a hidden change do to a logit, and the least logit that a token of probability exp(-kl) asks for."""
    e = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("z"))
    d = _drift(spark, sf_dir).join(e, "vec_id").select("label", "l2", "kl", drift.norm(F.col("z")).alias("size"), drift.log_total(F.col("z")).alias("log_z"))
    target = drift.emission_target(-F.col("kl"), F.col("log_z"))
    return d.groupBy("label").agg(F.count("*").alias("n"), F.round(F.max("size"), 6).alias("row_norm_max"), F.round(drift.linf_from_hidden(F.max("size"), F.max("l2")), 6).alias("linf_limit"), F.round(F.min(target), 6).alias("least_target"))


@query(f"WITH {LINES}, s AS (SELECT lang, CAST(sum(strlen(text)) AS BIGINT) AS t, CAST(sum({MERGED}) AS BIGINT) AS m FROM lines GROUP BY lang), p AS (SELECT t, m FROM s WHERE lang = 'en') SELECT lang, s.t AS total_tokens, s.m AS pack_tokens, s.t / p.t AS cost_ratio, s.m / p.t AS pack_ratio, CASE WHEN s.t > 0 THEN 1 / (s.t / p.t) END AS effective_context FROM s, p")
def effective_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language beside English, without and with merges, and the share of a context that is left for it."""
    body = F.encode("text", "utf-8")
    s = _lines(spark, sf_dir).groupBy("lang").agg(F.sum(byte_count(F.col("text"))).alias("total_tokens"), F.sum(merge.merged_size(body, MERGES)).alias("pack_tokens"))
    pivot = s.filter("lang = 'en'").select(F.col("total_tokens").alias("p"))
    ratio = F.col("total_tokens") / F.col("p")
    return s.crossJoin(F.broadcast(pivot)).select("lang", "total_tokens", "pack_tokens", ratio.alias("cost_ratio"), (F.col("pack_tokens") / F.col("p")).alias("pack_ratio"), F.when(F.col("total_tokens") > 0, 1 / ratio).alias("effective_context"))  # one row


@query("""SELECT user_id, arg_min(event_id, event_id) AS first_event, arg_max(event_id, event_id) AS last_event, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id""")
def first_and_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events deduplicated by user, the first kept and the last kept."""
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    first = corpus.first_of_each(e, "user_id", "event_id").select("user_id", F.col("event_id").alias("first_event"), F.col("event_type").alias("first_type"))
    last = corpus.last_of_each(e, "user_id", "event_id").select("user_id", F.col("event_id").alias("last_event"), F.col("event_type").alias("last_type"))
    return first.join(last, "user_id")


@query(f"""WITH {LINES}, b AS (SELECT lang, hex(encode(text)) AS h, unnest(range(0, strlen(text))) AS i FROM lines), s AS (SELECT lang, list(DISTINCT substr(h, CAST(2 * i + 1 AS INT), 2)) AS ids FROM b GROUP BY lang), p AS (SELECT ids AS en FROM s WHERE lang = 'en')
SELECT lang, CAST(len(ids) AS INT) AS n_ids, CAST(len(list_distinct(list_concat(ids, en))) AS INT) AS n_union, CAST(len(list_filter(ids, lambda x: NOT list_contains(en, x))) AS INT) AS n_beyond, CAST(len(list_intersect(ids, en)) AS INT) AS n_shared FROM s, p""")
def id_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte ids that each language uses: with English together, beyond English, shared with it."""
    s = mining.runs(_lines(spark, sf_dir), 1).groupBy("lang").agg(F.collect_set(F.hex("gram")).alias("ids"))  # 256 at most
    pivot = s.filter("lang = 'en'").select(F.col("ids").alias("en"))
    return s.crossJoin(F.broadcast(pivot)).select("lang", F.size("ids").alias("n_ids"), F.size(F.array_union("ids", "en")).alias("n_union"), F.size(F.array_except("ids", "en")).alias("n_beyond"), F.size(F.array_intersect("ids", "en")).alias("n_shared"))  # one row


@query(f"""WITH {LINES}, s AS (SELECT lang, CAST(sum(strlen(text)) AS DOUBLE) AS t, CAST(sum({MERGED}) AS DOUBLE) AS m FROM lines GROUP BY lang)
SELECT lang, round(2 * 1e6 * t) AS build_flops, round(6 * 1e6 * t) AS training_flops, round(1 - m / t, 6) AS reduction, round(40 + 40 * greatest(0.0, log10(6e6 * t) - 8), 6) AS bubble, t < 1e5 AS extrapolated FROM s""")
def figure_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the figure of cost against reduction, one for each language."""
    body = F.encode("text", "utf-8")
    s = _lines(spark, sf_dir).groupBy("lang").agg(F.sum(byte_count(F.col("text"))).cast("double").alias("t"), F.sum(merge.merged_size(body, MERGES)).cast("double").alias("m"))
    n, t = F.lit(1e6), F.col("t")
    return s.select("lang", F.round(serving.forward_flops(n, t)).alias("build_flops"), F.round(serving.training_flops(n, t)).alias("training_flops"), F.round(1 - F.col("m") / t, 6).alias("reduction"), F.round(evaluation.bubble(6 * n * t), 6).alias("bubble"), (t < 1e5).alias("extrapolated"))


#: An order of vectors that both engines can compute, spread over 64 bits.
SPREAD = "(vec_id * 2654435761) % 4294967296"


@query(f"""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings), v AS (SELECT a.vec_id, a.label, a.z AS source, b.z AS target FROM e a JOIN e b ON b.vec_id = a.vec_id + 1),
o AS (SELECT *, row_number() OVER (ORDER BY {SPREAD}, vec_id) - 1 AS place, count(*) OVER () AS n FROM v),
c AS (SELECT a.vec_id, a.label, k, round(list_dot_product(a.source, b.target) / greatest(sqrt(list_dot_product(a.source, a.source)) * sqrt(list_dot_product(b.target, b.target)), 1e-12), 9) AS s FROM o a CROSS JOIN range(0, 13) r(k) JOIN o b ON b.place = (a.place + k) % a.n),
t AS (SELECT vec_id, label, k, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, k) AS r FROM c)
SELECT label, count(*) AS n, avg(CASE WHEN k = 0 THEN 1.0 ELSE 0.0 END) AS accuracy FROM t WHERE r = 1 GROUP BY label""")
def retrieval_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a vector is more like its partner, the next one, than like twelve sampled others."""
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("source"))
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("source").alias("target"))
    order = F.shiftleft(F.expr(SPREAD) - F.lit(1 << 31), 32)
    v = e.join(after, "vec_id").select(F.col("vec_id").alias("key"), "label", "source", "target", order.alias("_order"))
    hits = evaluation.retrieval(v.drop("label"), 12, order=F.col("_order"))
    return hits.join(v.select("key", "label"), "key").groupBy("label").agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("accuracy"))


# --- packs --------------------------------------------------------------------------------------

ENTRIES = """en AS (SELECT substr(o_orderstatus, 1, 1) AS lang, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey)::INT AS rank, hex(encode(o_orderkey::VARCHAR)) AS gram_hex, o_custkey AS n_occurrences, o_totalprice > 60000 AS accepted, o_totalprice AS kl FROM orders WHERE o_orderkey % 5 = 0)"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").filter("o_orderkey % 5 = 0")
    order = Window.partitionBy("o_orderstatus").orderBy("o_orderkey")
    return o.select(F.substring("o_orderstatus", 1, 1).alias("lang"), F.row_number().over(order).alias("rank"), F.hex(F.encode(F.col("o_orderkey").cast("string"), "utf-8")).alias("gram_hex"), F.col("o_custkey").alias("n_occurrences"), (F.col("o_totalprice") > 60000).alias("accepted"), F.create_map(F.lit("kl"), F.col("o_totalprice")).alias("bounds"))


@query(f"WITH {ENTRIES} SELECT lang, count(*) AS n_accepted, CAST(sum(n_occurrences) AS BIGINT) AS n_occurrences, max(kl) AS worst_kl, min(rank) AS first_rank FROM en WHERE accepted GROUP BY lang")
def pack_manifest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries written as a pack and read back: the accepted ones, by language."""
    from corpuscle.sources import packs

    packs.write_pack(_entries(spark, sf_dir), path := scratch_path(spark, "pack"), {"from": "orders"})
    back = packs.read_pack(spark, path)
    return back.groupBy("lang").agg(F.count("*").alias("n_accepted"), F.sum("n_occurrences").alias("n_occurrences"), F.max(F.element_at("bounds", "kl")).alias("worst_kl"), F.min("rank").alias("first_rank"))


@query(f"""WITH {ENTRIES}, s AS (SELECT count(*) AS n, count(*) FILTER (NOT accepted) AS refused, count(gram_hex) - count(DISTINCT gram_hex) AS twice FROM en)
SELECT array_to_string(list_filter([CASE WHEN n = 0 THEN 'the pack is empty' END, CASE WHEN refused > 0 THEN refused::VARCHAR || ' entries were not accepted' END, CASE WHEN twice > 0 THEN twice::VARCHAR || ' runs stand twice' END], lambda x: x IS NOT NULL), '; ') AS problems FROM s""")
def publish_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a pack may not go out."""
    return evaluation.publish_problems(_entries(spark, sf_dir)).select(F.array_join("problems", "; ").alias("problems"))


@query("""WITH s AS (SELECT event_type, count(*) AS n, max(value) AS v FROM events GROUP BY event_type)
SELECT event_type, 'at least 95% of positions have kl of ' || printf('%.3f', v) || ' or less, with confidence 95%, from ' || n::VARCHAR || ' measurements' AS statement FROM s""")
def bound_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds told in sentences."""
    s = _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("v"))
    said = evaluation.statement(F.lit("conformal"), F.lit("kl"), F.col("v"), F.lit(0.05), F.lit(0.05), F.col("n"))
    return s.select("event_type", F.regexp_replace(said, "kl of [^ ]+ or", F.concat(F.lit("kl of "), F.format_string("%.3f", "v"), F.lit(" or"))).alias("statement"))


# --- model side ---------------------------------------------------------------------------------


@query()
def certify_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short-listed runs of each language, fitted and certified at the read-out and after it, with emission and off-context mass."""
    from corpuscle.catalog import _small
    from corpuscle.functions.text import byte_ids
    from corpuscle.operators import contexts
    from corpuscle.plans import synthesis
    from corpuscle.plans.model import Decoder, off_context

    model, rows = Decoder(), _lines(spark, sf_dir)
    short = written(_small(_candidates(spark, sf_dir, 3), 3).select("lang", "gram"), "short")
    found = contexts.first_occurrences(rows, short, 24)
    token = F.concat_ws(":", "lang", F.hex("gram"))
    placed = written(found.select(token.alias("token"), F.xxhash64("doc_id", "pos", "at").alias("context"), "k", byte_ids(F.col("gram")).alias("ids"), byte_ids(F.col("prefix")).alias("prefix"), byte_ids(F.col("suffix")).alias("suffix")), "contexts")
    fitted = written(synthesis.fitted(placed.filter("k <= 12"), model), "fitted")
    probe = written(synthesis.strided(rows, 97, most=256), "probe")
    off = written(off_context(probe, fitted.join(placed.select("token", "ids").dropDuplicates(["token"]), "token"), model), "off")
    out = synthesis.certified(placed.filter("k > 12"), fitted, model, off, alpha=0.2, delta=0.2, least_n=8, max_kl=5.0, max_tv=0.95, max_off=0.05, max_emit=8.0)
    return out.select("token", "n", *[F.round(c, 6).alias(c) for c in ("kl", "tv", "off", "emission")], "accepted", "reason")


@query()
def router_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short continuations of the turns that end a conversation, each under its view, views mixed in a batch."""
    routed = _routed(spark, sf_dir)
    last = routed.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return _router().answered(routed.join(last, ["conv_id", "turn"]).select("request", "view", "text"), 2).select("request", "view", F.array_join("made", ",").alias("made"))
