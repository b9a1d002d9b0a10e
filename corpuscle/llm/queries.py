"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import bpe, classifier, common, fingerprint, line_dedup, lm, mixing, neardup, quality, repair, sharding


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(common.table(spark, sf_dir, "documents"), ["doc_id"])


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(common.table(spark, sf_dir, "documents"))


def op3_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    repair.write_ids(common.table(spark, sf_dir, "documents"), path := common.scratch_path(spark, "repair"))
    return repair.read_ids(spark, path)


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(common.table(spark, sf_dir, "documents"))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(common.table(spark, sf_dir, "documents")).drop("key")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(common.table(spark, sf_dir, "documents"), 8)
    return placed.withColumn("law", F.lit("key"))


def op7_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.judged(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.curriculum(common.table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    read = pages.select("page_id", line_dedup.page_host(F.col("url")).alias("host"), line_dedup.page_text(F.col("html")).alias("text"))
    read = common.written(spark, read, "page-text")  # both passes read the text, and taking it from the markup is most of the work
    return line_dedup.drop_boilerplate(read, ["page_id", "host"], "page_id", "host", "text")


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(common.table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality, op2_bpe, op3_repair, op4_sharding, op5_lm, op6_neardup, op7_classifier, op8_mixing, op9_line_dedup, op10_fingerprint)}
SQL: dict[str, str] = {"op1_quality": quality.sql(), "op9_line_dedup": line_dedup.sql()}
