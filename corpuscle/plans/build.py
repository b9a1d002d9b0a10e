"""The whole build: mine a language's corpus, shortlist, synthesize, certify, select, assemble."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.text import N_SPECIAL, byte_ids
from corpuscle.operators import bounds, contexts, corpus, mining, selection
from corpuscle.operators.evaluation import residual_reduction
from corpuscle.plans import synthesis
from corpuscle.plans.cards import build_manifest
from corpuscle.plans.model import Decoder, off_context
from corpuscle.plans.tables import written


@dataclass(frozen=True)
class Plan:
    lang: str = "fr"
    budget: int = 6
    #: Candidates that are certified for each one of the budget, out of a pool of the largest raw savings.
    oversample: int = 2
    pool: int = 64
    longest: int = 8
    contexts_each: int = 64
    alpha: float = 0.2
    delta: float = 0.2
    least_n: int = 8
    max_kl: float = 5.0
    max_tv: float = 0.95
    max_off: float = 0.05
    max_emit: float = 12.0
    input_only: bool = False
    off_positions: int = 512
    config: synthesis.Config = synthesis.Config()


def _placed(rows: DataFrame, short: DataFrame, n: int) -> DataFrame:
    found = contexts.first_occurrences(rows, short, n)
    return found.select(F.hex("gram").alias("token"), F.xxhash64("doc_id", "pos", "at").alias("context"), byte_ids(F.col("gram")).alias("ids"), byte_ids(F.col("prefix")).alias("prefix"), byte_ids(F.col("suffix")).alias("suffix"))


def negatives(lines: DataFrame, n: int, before: int = 128, after: int = 8) -> DataFrame:
    """prefix, following: n positions of the lines, each position as likely as any other, by hashes of the lines' places."""
    unit = lambda seed: (F.pmod(F.xxhash64("doc_id", "pos", "text", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    places = F.octet_length("text") - 1
    # the least of -log(u) / weight are a sample by weight, here by the positions of a line
    drawn = lines.filter(places > 0).orderBy(-F.log(unit(1)) / places, "doc_id", "pos").limit(n)
    at = drawn.select(F.encode("text", "utf-8").alias("body"), (F.floor(unit(2) * places) + 1).cast("int").alias("at"))
    start = F.greatest(F.lit(1), F.col("at") - before + 1)
    return at.select(byte_ids(F.substring("body", start, F.col("at") - start + 1)).alias("prefix"), byte_ids(F.substring("body", F.col("at") + 1, F.lit(after))).alias("following"))


@dataclass
class Built:
    """entries: lang, rank, gram_hex, n_occurrences, accepted, reason, kl_bound, before, after, residual_reduction, selected_step; stages: stage, flops, seconds."""

    entries: DataFrame
    stages: DataFrame

    def manifest(self) -> str:
        return build_manifest(self.entries, self.stages).first()["manifest"]


def shortlisted(rows: DataFrame, plan: Plan) -> DataFrame:
    """lang, rank, gram, n_occurrences: of the `pool` best candidates by raw saving, those that a greedy run over their coverage takes first."""
    pool = written(mining.ranked(mining.without_nested(mining.materialized(mining.mine(rows, plan.longest, held=written))), plan.pool), "pool")
    picks = selection.greedy_of(rows, pool, plan.budget * plan.oversample)
    return pool.drop("rank").join(F.broadcast(picks.select("lang", "gram", F.col("step").alias("rank"))), ["lang", "gram"])  # budget times oversample rows


def run_build(docs: DataFrame, model: Decoder, plan: Plan = Plan()) -> Built:
    """Mining, fitting, certification and selection each see their own slice of the corpus.

    A token is certified on every position from its read-out to the end of its contexts, on how well
    it is emitted where its run was, and on what it would take out of context: on positions of the
    other languages' lines and of the certification slice.
    """
    assert model.shape.vocab >= 256 + N_SPECIAL
    spark, stages, began = docs.sparkSession, [], time.perf_counter()
    flops = lambda tokens: float(2 * model.n_params * tokens)

    def ended(stage: str, tokens: int = 0) -> None:
        nonlocal began
        now = time.perf_counter()
        stages.append((stage, flops(tokens), now - began))
        began = now

    length = lambda df: int(df.agg(F.coalesce(F.sum(F.size("prefix") + F.size("ids") + F.size("suffix")), F.lit(0))).first()[0])
    rows = written(corpus.split(corpus.numbered(corpus.lines(docs).filter(F.col("lang") == plan.lang))), "lines")
    part = lambda name: rows.filter(F.col("split") == name).select("doc_id", "lang", "pos", "text")
    short = written(shortlisted(part("mine"), plan), "short")
    ended("mine")
    fit_contexts = written(_placed(part("fit"), short, plan.contexts_each), "fit-contexts")
    fitted = written(synthesis.fitted(fit_contexts, model, plan.config), "rows")
    ended("fit", length(fit_contexts) * (2 + plan.config.rounds * (plan.config.q + 1)))
    others = corpus.lines(docs).filter(F.col("lang") != plan.lang).select("doc_id", "lang", "pos", "text")
    probe = written(negatives(others.unionByName(part("certify")), plan.off_positions, after=max(8, plan.longest)), "negatives")
    token_ids = short.select(F.hex("gram").alias("token"), byte_ids(F.col("gram")).alias("ids"))
    off = written(off_context(probe, fitted.join(token_ids, "token"), model), "off")
    contexts_ = written(_placed(part("certify"), short, plan.contexts_each), "certify-contexts")
    limits = {k: getattr(plan, k) for k in ("alpha", "delta", "least_n", "max_kl", "max_tv", "max_off", "max_emit", "input_only")}
    certified = written(synthesis.certified(contexts_, fitted, model, off, **limits), "certified")
    ended("certify", 2 * length(contexts_) + int(probe.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]))
    judged = short.withColumn("token", F.hex("gram")).join(certified, "token", "left").join(fitted.select("token", "before", "after"), "token", "left")
    judged = written(judged.withColumn("reason", F.when(F.col("accepted").isNull(), F.lit(bounds.REASONS[0])).otherwise(F.col("reason"))), "judged")
    good = judged.filter(F.col("reason").isNull()).select("lang", "gram")
    if good.isEmpty():
        steps = spark.createDataFrame([], "lang string, step int, gram binary, gain long")
    else:
        steps = selection.greedy_of(part("eval"), good, plan.budget)
    ended("select")
    entries = judged.join(F.broadcast(steps.select("gram", F.col("step").alias("selected_step"))), "gram", "left").select(  # a budget's rows
        "lang", "rank", F.col("token").alias("gram_hex"), "n_occurrences", F.col("reason").isNull().alias("accepted"), "reason", F.col("kl").alias("kl_bound"), "before", "after",
        residual_reduction(F.col("before"), F.col("after")).alias("residual_reduction"), "selected_step",
    )
    return Built(entries, spark.createDataFrame(stages, "stage string, flops double, seconds double"))


def build(docs: DataFrame, model: Decoder, plan: Plan = Plan()) -> DataFrame:
    """lang, rank, gram_hex, n_occurrences, accepted, reason, kl_bound, residual_reduction, selected_step of each short-listed candidate."""
    return run_build(docs, model, plan).entries.drop("before", "after")
