"""From documents to token digests: five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import bpe, common, line_dedup, mixing, neardup, quality


def _apart(docs: DataFrame) -> DataFrame:
    """Its columns in one, so that their names cannot clash with an operator's, beside those that an operator reads."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "doc_id", "source", "text")


def _together(done: DataFrame, docs: DataFrame, changed: Column) -> DataFrame:
    """The columns of docs, with the new text and, where it has changed, its length."""
    made = {"text": F.col("new_text"), "n_chars": F.when(changed, F.length("new_text").cast("long")).otherwise(F.col("row.n_chars"))}
    return done.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines over the limits leave the texts, and documents that the rules reject go."""
    done = quality.judge(_apart(docs), ["row"], with_text=True).filter("kept")
    return _together(done, docs, F.col("n_removed_words") > 0)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A source is a host and its documents are the pages; boilerplate lines leave the texts."""
    done = line_dedup.drop_boilerplate(_apart(docs), ["row"], "doc_id", "source", "text")
    return _together(done, docs, F.col("n_dropped") > 0)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return neardup.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, in training order."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup), ("mixing", mix), ("bpe", encode)]
#: No SQL for similarity over whole tables; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(spark, docs, name)
    return docs
