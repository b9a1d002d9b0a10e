"""What goes out with a pack: manifests, cards, tables, and the checkpoint of a grown model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators import evaluation
from corpuscle.operators.augmented import Augmented
from corpuscle.plans.model import Decoder
from corpuscle.plans.reports import markdown
from corpuscle.sources.packs import card


def build_manifest(built: DataFrame, stages: DataFrame) -> DataFrame:
    """One row, manifest: JSON of what a build has accepted and what it has cost; built: accepted, before, after; stages: stage, flops, seconds."""
    by_stage = stages.groupBy("stage").agg(F.sum("flops").alias("flops"), F.sum("seconds").alias("seconds"))
    listed = by_stage.agg(F.array_sort(F.collect_list(F.struct("stage", "flops", "seconds"))).alias("stages"))  # a build's stages
    one = evaluation.build_summary(built).crossJoin(F.broadcast(evaluation.stage_totals(stages))).crossJoin(F.broadcast(listed))  # one row each
    return one.select(F.to_json(F.struct(*sorted(one.columns))).alias("manifest"))


def manifest_row(entries: DataFrame) -> DataFrame:
    """lang, manifest: JSON of a pack's entries in order."""
    listed = entries.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "gram_hex", "accepted"))).alias("entries"))
    return listed.select("lang", F.to_json(F.struct("entries", "lang", F.size("entries").alias("n_entries"))).alias("manifest"))


def pack_maps(entries: DataFrame, base_size: int) -> DataFrame:
    """lang, new_ids (hex of a run to its id) and expansions (id to hex)."""
    numbered = entries.select("lang", "gram_hex", (F.col("rank") + base_size - 1).cast("long").alias("new_id"))
    in_order = F.array_sort(F.collect_list(F.struct("new_id", "gram_hex")))
    lists = numbered.groupBy("lang").agg(in_order.alias("e"))
    return lists.select("lang", F.map_from_arrays("e.gram_hex", "e.new_id").alias("new_ids"), F.map_from_arrays("e.new_id", "e.gram_hex").alias("expansions"))


def publish_card(entries: DataFrame, certified: bool) -> str:
    """The pack's card, under a warning where no bound was measured."""
    banner = "" if certified else "> **Not certified.** No drift of these tokens was measured.\n\n"
    return banner + card(entries)


def cost_table(rows: DataFrame) -> str:
    return markdown(rows.select("lang", "tokens", "forward_flops", "reference_flops", "ratio").orderBy("lang"))


def serving_table(rows: DataFrame) -> str:
    return markdown(rows.select("view", "n_requests", "billed_tokens", "tokens_per_second", "dispatch_overhead").orderBy(F.col("view") != "base", "view"))


def coverage_table(rows: DataFrame) -> str:
    """Bounds held against fresh data, the worst first."""
    return markdown(rows.orderBy(F.desc("violated"), "fraction"))


def statement_table(bounds: DataFrame, alpha: float, delta: float) -> DataFrame:
    """token, statement of each bound (token, statistic, method, value, n)."""
    return bounds.select("token", evaluation.statement(F.col("method"), F.col("statistic"), F.col("value"), F.lit(alpha), F.lit(delta), F.col("n")).alias("statement"))


def write_checkpoint(spark: SparkSession, model: Decoder, vocabulary: Augmented, path: str) -> None:
    """The grown model's vocabulary rows and, beside them, which ids each view may emit."""
    rows = [(k, vocabulary.lang_of(k) or None, model.embed[k].tolist(), None if model.tied else model.unembed[k].tolist()) for k in range(model.shape.vocab)]
    spark.createDataFrame(rows, "id int, lang string, row array<double>, out_row array<double>").write.mode("overwrite").parquet(f"{path}/rows")
    views = [(v.name, [int(i) for i in (~vocabulary.open_ids(v)).nonzero()[0]]) for v in vocabulary.views()]
    spark.createDataFrame(views, "view string, closed array<int>").coalesce(1).write.mode("overwrite").json(f"{path}/views")


def read_checkpoint(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/rows"), spark.read.schema("view string, closed array<int>").json(f"{path}/views")
