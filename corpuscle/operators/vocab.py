"""Append-only vocabularies, views of them, logit masks and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach(packs: DataFrame, base_size: int) -> DataFrame:
    """packs: lang, rank, gram. Adds new_id: contiguous from base_size, languages in order."""
    order = Window.orderBy("lang", "rank")  # a pack's rows, not the corpus
    return packs.withColumn("new_id", (F.row_number().over(order) + base_size - 1).cast("long"))


def views(vocab: DataFrame) -> DataFrame:
    """view, lang, input_only: the base view, and each language with and without leave to emit."""
    langs = vocab.select("lang").distinct()
    spark = vocab.sparkSession
    base = spark.createDataFrame([("base", None, True)], "view string, lang string, input_only boolean")
    both = langs.select(F.col("lang").alias("view"), "lang", F.lit(False).alias("input_only")).unionByName(langs.select(F.concat("lang", F.lit(":in")).alias("view"), "lang", F.lit(True).alias("input_only")))
    return base.unionByName(both)


def masks(vocab: DataFrame, named: DataFrame, base_size: int) -> DataFrame:
    """view, new_id, logit: 0 where a view may emit the id, minus infinity where not; base ids are open to all."""
    may = (F.col("v.lang") == F.col("n.lang")) & ~F.col("n.input_only")
    return vocab.alias("v").crossJoin(F.broadcast(named.alias("n"))).select("n.view", "v.new_id", F.when(may, 0.0).otherwise(F.lit(float("-inf"))).alias("logit"))  # views: two for each language


def fingerprint(parts: list[Column]) -> Column:
    """SHA-256 of a canonical JSON array."""
    return F.sha2(F.to_json(F.array(*parts)), 256)


def byte_fragments(ids: Column, expansions: Column) -> Column:
    """How many tokens of a sequence are no text by themselves; expansions: a map from id to its bytes."""
    return F.size(F.filter(ids, lambda i: ~F.is_valid_utf8(F.try_element_at(expansions, i).cast("string"))))


def request_body(requests: DataFrame, closed: DataFrame) -> DataFrame:
    """request, body: the JSON that an engine is sent, ids and the ids that the view closes."""
    banned = closed.filter(F.col("logit") != 0).groupBy("view").agg(F.sort_array(F.collect_list("new_id")).alias("banned"))  # a pack's ids
    return requests.join(banned, "view", "left").select("request", F.to_json(F.struct("ids", F.coalesce("banned", F.array().cast("array<bigint>")).alias("banned"))).alias("body"))
