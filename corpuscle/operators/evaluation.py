"""Figures of merit: conditions against a baseline, builds, costs, throughput, what a request is charged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.operators.serving import training_flops

INF, NAN = float("inf"), float("nan")


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(otherwise))


# --- quality of conditions ----------------------------------------------------------------------


def tokens_per_sentence(tokens: Column) -> Column:
    """Mean over sentences, 0 of none."""
    return F.coalesce(F.avg(tokens), F.lit(0.0))


def bits_per_character(nats: Column, chars: Column) -> Column:
    """Of summed nats and characters."""
    return nats / F.log(F.lit(2.0)) / F.greatest(F.lit(1), chars)


def retention(accuracy: Column, baseline: Column) -> Column:
    """Share of the baseline's accuracy that is kept, 1 at most; not a number without one."""
    return F.when(baseline > 0, F.least(F.lit(1.0), accuracy / baseline)).otherwise(F.lit(NAN))


def against_baseline(scores: DataFrame, by: list[str], baseline: str, condition: str = "condition") -> DataFrame:
    """scores: by, condition, tokens_per_sentence, accuracy. Adds what changes against the baseline condition of the same group."""
    base = scores.filter(F.col(condition) == baseline).select(*by, F.col("tokens_per_sentence").alias("_t"), F.col("accuracy").alias("_a"))
    both = scores.join(base, by, "left")
    return both.select(
        *scores.columns,
        (F.col("tokens_per_sentence") - F.col("_t")).alias("tokens_delta"),
        (F.col("accuracy") - F.col("_a")).alias("accuracy_delta"),
        retention(F.col("accuracy"), F.col("_a")).alias("quality_retention"),
    )


def retrieval(vectors: DataFrame, candidates: int, seed: int = 0, order: Column | None = None) -> DataFrame:
    """vectors: key, source (array), target (array). key, hit: whether a source is most like its own target among `candidates` sampled ones.

    The sample of each source is the targets whose keys follow it in an order by hash (or by `order`,
    spread over 64 bits), so each is an equi-join on a place in that order and no pair beside the
    sampled ones is made.
    """
    from corpuscle.functions.drift import dot, norm

    spread = vectors.withColumn("_h", F.xxhash64("key", F.lit(seed)) if order is None else order)
    n = vectors.count()
    # places in ranges of the hash, so that no task orders them all
    parts = spread.withColumn("_part", F.shiftright("_h", 54)).select("key", "_h", "_part")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # 1024 rows at most
    placed = parts.join(F.broadcast(before), "_part").select("key", (F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy("_h", "key")) - 1).alias("place"))
    whole = vectors.join(placed, "key")
    asked = whole.select("key", "source", F.col("place").alias("_at"), F.explode(F.sequence(F.lit(0), F.lit(min(candidates, n - 1)))).alias("_k")).withColumn("place", F.pmod(F.col("_at") + F.col("_k"), F.lit(n)))
    targets = whole.select("place", F.col("key").alias("_other"), "target")
    like = dot(F.col("source"), F.col("target")) / F.greatest(norm(F.col("source")) * norm(F.col("target")), F.lit(1e-12))
    best = asked.join(targets, "place").groupBy("key").agg(F.max(F.struct(F.round(like, 9).alias("s"), (-F.col("_k")).alias("k"))).alias("b"))
    return best.select("key", (F.col("b.k") == 0).alias("hit"))


# --- builds -------------------------------------------------------------------------------------


def residual_reduction(before: Column, after: Column) -> Column:
    """How much of a residual is gone, 0 at least, and 0 where it cannot be told."""
    r = 1 - F.try_divide(after, before)
    return F.when((before > 0) & ~F.isnan(r) & r.isNotNull(), F.greatest(F.lit(0.0), r)).otherwise(0.0)


def build_summary(entries: DataFrame) -> DataFrame:
    """entries: accepted, before, after. One row."""
    return entries.agg(
        F.count("*").alias("n_entries"),
        F.count_if(F.col("accepted")).alias("n_accepted"),
        F.coalesce(F.avg(F.col("accepted").cast("double")), F.lit(0.0)).alias("acceptance_rate"),
        F.coalesce(F.avg(residual_reduction(F.col("before"), F.col("after"))), F.lit(0.0)).alias("mean_residual_reduction"),
    )


def stage_totals(stages: DataFrame) -> DataFrame:
    """stages: stage, flops, seconds. One row of totals."""
    return stages.agg(F.coalesce(F.sum("flops"), F.lit(0.0)).alias("total_flops"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("total_seconds"))


# --- costs --------------------------------------------------------------------------------------


def model_flops(params: Column, tokens: Column, with_gradient: Column) -> Column:
    """Two operations a parameter and token forward, six with gradients."""
    return F.when(with_gradient, 6 * params * tokens).otherwise(2 * params * tokens)


def row_params(rows: Column, width: Column, tied: Column) -> Column:
    """Parameters of new vocabulary rows: one matrix where input and output share it, else two."""
    return rows * width * F.when(tied, 1).otherwise(2)


def extrapolated(params: Column, tokens: Column, seconds: Column, to_tokens: Column) -> list[Column]:
    """A training run's cost carried on to more tokens."""
    return [training_flops(params, to_tokens).alias("flops"), (seconds * ratio(to_tokens, tokens)).alias("seconds"), (to_tokens > tokens).alias("extrapolated")]


# --- requests -----------------------------------------------------------------------------------


def billed(prompt: Column, made: Column) -> Column:
    return prompt + made


def throughput(runs: DataFrame, by: list[str]) -> DataFrame:
    """runs: by, prompt_tokens, made_tokens, tokenize_seconds, mask_seconds, wall_seconds. Sums, tokens a second and the share of the dispatch."""
    s = runs.groupBy(*by).agg(F.count("*").alias("n_requests"), F.sum(billed(F.col("prompt_tokens"), F.col("made_tokens"))).alias("billed_tokens"), F.sum("made_tokens").alias("made_tokens"), F.sum(F.col("tokenize_seconds") + F.col("mask_seconds")).alias("dispatch_seconds"), F.sum("wall_seconds").alias("wall_seconds"))
    return s.select(*by, "n_requests", "billed_tokens", "made_tokens", ratio(F.col("made_tokens"), F.col("wall_seconds")).alias("tokens_per_second"), ratio(F.col("dispatch_seconds"), F.col("wall_seconds")).alias("dispatch_overhead"))


def views_against_base(reports: DataFrame, view: str = "view", base: str = "base") -> DataFrame:
    """Each view's throughput and dispatch share beside the base view's."""
    b = reports.filter(F.col(view) == base).select(F.col("tokens_per_second").alias("_t"), F.col("dispatch_overhead").alias("_d"))
    return reports.crossJoin(F.broadcast(b)).select(*reports.columns, ratio(F.col("tokens_per_second"), F.col("_t"), NAN).alias("throughput_ratio"), (F.col("dispatch_overhead") - F.col("_d")).alias("overhead_delta"))  # one row


def request_savings(base: Column, view: Column) -> list[Column]:
    return [(base - view).alias("saved"), F.when(base > 0, 1 - view / base).otherwise(0.0).alias("reduction")]


def premium(texts: DataFrame, aligned: DataFrame, totals: DataFrame, tokens: Column) -> DataFrame:
    """texts: request, lang, text (NFC); aligned: lang, text, pivot_tokens; totals: lang, tokens, pivot_tokens of a corpus.

    request, tokens, pivot_tokens, exact, premium: tokens against those of the aligned translation, or,
    where there is none, against what the corpus's ratio makes them, 1 at least.
    """
    known = aligned.groupBy("lang", "text").agg(F.min("pivot_tokens").alias("_exact"))
    rate = totals.select("lang", ratio(F.col("tokens"), F.col("pivot_tokens"), 1.0).alias("_rate"))
    both = texts.withColumn("tokens", tokens).join(known, ["lang", "text"], "left").join(F.broadcast(rate), "lang", "left")  # a row for each language
    estimate = F.greatest(F.lit(1.0), F.col("tokens") / F.coalesce("_rate", F.lit(1.0)))
    pivot = F.coalesce(F.col("_exact").cast("double"), estimate)
    return both.select("request", "lang", "tokens", pivot.alias("pivot_tokens"), F.col("_exact").isNotNull().alias("exact"), ratio(F.col("tokens").cast("double"), pivot).alias("premium"))


# --- words for people ---------------------------------------------------------------------------


def statement(method: Column, statistic: Column, value: Column, alpha: Column, delta: Column, n: Column) -> Column:
    """What a bound says, in a sentence."""
    share, sure = F.format_string("%.0f%%", 100 * (1 - alpha)), F.format_string("%.0f%%", 100 * (1 - delta))
    shown = F.when(value == INF, F.lit("no finite value")).otherwise(F.format_string("%.4g", value))
    return (
        F.when(method == "conformal", F.concat(F.lit("at least "), share, F.lit(" of positions have "), statistic, F.lit(" of "), shown, F.lit(" or less, with confidence "), sure, F.lit(", from "), n.cast("string"), F.lit(" measurements")))
        .when(method == "bernstein", F.concat(F.lit("the mean "), statistic, F.lit(" is at most "), shown, F.lit(" with confidence "), sure))
        .when(method == "lipschitz", F.concat(statistic, F.lit(" never exceeds "), shown))
        .otherwise(F.concat(statistic, F.lit(": "), shown))
    )


def bubble(tokens: Column) -> Column:
    """Size of a point in a figure by the tokens that it stands for."""
    return F.when(tokens > 0, 40 + 40 * F.greatest(F.lit(0.0), F.log10(tokens) - 8)).otherwise(60.0)


def publish_problems(pack: DataFrame) -> DataFrame:
    """pack: accepted, bounds, gram_hex. One row: problems, an array, empty where the pack may go out."""
    s = pack.agg(
        F.count("*").alias("n"),
        F.count_if(~F.col("accepted")).alias("refused"),
        F.count_if(F.col("bounds").isNull() | (F.size("bounds") == 0)).alias("bare"),
        F.count_if(F.exists(F.map_values("bounds"), lambda v: v.isNull() | F.isnan(v) | (v == INF))).alias("endless"),
        (F.count("gram_hex") - F.count_distinct("gram_hex")).alias("twice"),
    )
    say = lambda count, what: F.when(F.col(count) > 0, F.concat(F.col(count).cast("string"), F.lit(what)))
    return s.select(F.array_compact(F.array(F.when(F.col("n") == 0, F.lit("the pack is empty")), say("refused", " entries were not accepted"), say("bare", " entries have no bounds"), say("endless", " entries have no finite bound"), say("twice", " runs stand twice"))).alias("problems"))
