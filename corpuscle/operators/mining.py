"""Frequent contiguous runs of byte tokens, and how good they are as merges.

A run is a slice of the text's bytes, counted by tasks before anything moves; as in every level-wise
search, a run can only be frequent if its parts are, so from the fifth length on only positions all
of whose parts are frequent are counted, two lengths in a pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.text import byte_tokens, count_alnum
from corpuscle.operators import grams


def _bodies(rows: DataFrame, n: int) -> DataFrame:
    return rows.select("lang", byte_tokens(F.col("text")).alias("body")).filter(F.octet_length("body") >= n)


def runs(rows: DataFrame, n: int) -> DataFrame:
    """lang, gram: each run of n byte tokens inside a line."""
    at = F.explode(F.sequence(F.lit(1), F.octet_length("body") - n + 1))
    return _bodies(rows, n).select("lang", "body", at.alias("at")).select("lang", F.substring("body", F.col("at"), F.lit(n)).alias("gram"))


def threshold(rows: DataFrame, least: int = 3, shortest: int = 2) -> DataFrame:
    """lang, min_count: the least count, or one in 400 lines, rounded half to even."""
    return rows.filter(F.octet_length("text") >= shortest).groupBy("lang").agg(F.greatest(F.lit(least), F.bround(F.count("*") / 400)).cast("long").alias("min_count"))


def level(counts: DataFrame, limits: DataFrame, docs_least: int = 2) -> DataFrame:
    """The frequent runs among counted ones."""
    return counts.join(F.broadcast(limits), "lang").filter((F.col("n_occurrences") >= F.col("min_count")) & (F.col("n_docs") >= docs_least)).drop("min_count")  # a row for each language


#: Runs up to this length are counted at once, without a level before.
AT_ONCE = 4


def passes(longest: int) -> list[list[int]]:
    """Lengths that are counted in one pass over the lines, each after the first pruned by the longest frequent runs of the one before."""
    return [list(range(2, min(longest, AT_ONCE) + 1)), *[list(range(n, min(longest, n + 1) + 1)) for n in range(AT_ONCE + 1, longest + 1, 2)]]


def mine(rows: DataFrame, longest: int, least: int = 3, held: Callable[[DataFrame, str], DataFrame] = lambda level, name: level, shortest: int = 2) -> DataFrame:
    """Frequent runs of `shortest` to `longest` tokens; held: makes a table of a pass, else what is collected to prune the next one is counted again for the result."""
    spark, steps = rows.sparkSession, passes(longest)
    limits = spark.createDataFrame(threshold(rows, least).filter("lang IS NOT NULL").collect(), "lang string, min_count long")  # a row for each language
    out, known = None, None
    for k, lengths in enumerate(steps):
        wanted = [n for n in lengths if n >= shortest or (k + 1 < len(steps) and n == lengths[-1])]
        if not wanted:
            continue
        found = held(grams.spelled(level(grams.counts(rows, wanted, known), limits), known), "level")
        out = found if out is None else out.unionByName(found)
        if k + 1 < len(steps):
            known = {lang: own[0] for lang, own in grams.collected(found.filter(F.octet_length("gram") == lengths[-1])).items()}
            if not known:
                break
    return out.filter(F.octet_length("gram") >= shortest)


def materialized(candidates: DataFrame) -> DataFrame:
    """Candidates whose bytes are a text without line breaks or tabs and with a letter or digit."""
    surface = candidates.filter(F.is_valid_utf8("gram")).withColumn("surface", F.decode("gram", "utf-8"))
    return surface.filter(~F.col("surface").rlike("[\n\r\t]") & (count_alnum(F.col("surface")) >= 1))


def key(ids: Column) -> Column:
    """A candidate's key: its ids with hyphens between."""
    return F.array_join(ids, "-")


def raw_saving(n: Column, length: Column) -> Column:
    return n * (length - 1)


def ranked(candidates: DataFrame, most: int = 200_000) -> DataFrame:
    """Adds the raw saving and the rank in the language: saving and count descending, then the bytes."""
    saving = candidates.withColumn("saving", raw_saving(F.col("n_occurrences"), F.octet_length("gram")).cast("long"))
    order = Window.partitionBy("lang").orderBy(F.desc("saving"), F.desc("n_occurrences"), F.hex("gram"))
    return saving.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def without_nested(candidates: DataFrame) -> DataFrame:
    """Drops a candidate that a longer one with at least its count contains: an equi-join on the longer ones' parts."""
    sub = F.explode(F.expr("flatten(transform(sequence(2, octet_length(gram) - 1), n -> transform(sequence(1, octet_length(gram) - n + 1), i -> substring(gram, i, n))))"))
    parts = candidates.filter(F.octet_length("gram") > 2).select("lang", sub.alias("gram"), F.col("n_occurrences").alias("_n")).groupBy("lang", "gram").agg(F.max("_n").alias("_n"))
    return candidates.join(parts, ["lang", "gram"], "left").filter(F.col("_n").isNull() | (F.col("_n") < F.col("n_occurrences"))).drop("_n")


def report(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Lines, tokens, candidates, the sum of savings and the headroom of each language."""
    base = rows.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.octet_length("text")).cast("long").alias("n_base_tokens"))
    sums = candidates.groupBy("lang").agg(F.count("*").alias("n_candidates"), F.sum(raw_saving(F.col("n_occurrences"), F.octet_length("gram"))).cast("long").alias("upper_bound_saving"))
    filled = base.join(sums, "lang", "left").fillna(0, ["n_candidates", "upper_bound_saving"])
    return filled.withColumn("headroom", F.when(F.col("n_base_tokens") > 0, F.least(F.lit(1.0), F.col("upper_bound_saving") / F.col("n_base_tokens"))).otherwise(0.0))
