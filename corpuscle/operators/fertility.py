"""What a tokenizer charges each language, against a pivot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.operators import bounds


def cost(rows: DataFrame, tokens: Column, chars: Column, words: Column, pivot: str = "en") -> DataFrame:
    """One row for each language. A word count that any line lacks is lacking in the sum."""
    sums = rows.groupBy("lang").agg(
        F.count("*").alias("n_sentences"),
        F.sum(tokens).alias("total_tokens"),
        F.sum(chars).alias("total_chars"),
        F.when(F.count_if(words.isNull()) == 0, F.sum(words)).alias("total_words"),
    )
    of_pivot = sums.filter(F.col("lang") == pivot).agg(F.greatest(F.lit(1), F.coalesce(F.sum("total_tokens"), F.lit(0))).alias("pivot_tokens"))
    ratio = F.when(F.col("lang") != pivot, F.col("total_tokens") / F.col("pivot_tokens"))
    return sums.join(F.broadcast(of_pivot)).select(  # one row
        "lang",
        "n_sentences",
        "total_tokens",
        "total_chars",
        "total_words",
        (F.col("total_tokens") / F.greatest(F.lit(1), "total_chars")).alias("tokens_per_char"),
        F.when(F.col("total_words") > 0, F.col("total_tokens") / F.col("total_words")).alias("tokens_per_word"),
        ratio.alias("cost_ratio"),
        F.when(ratio > 0, 1 / ratio).alias("effective_context"),
    )


def median_ratio(pairs: DataFrame, tokens: Column, pivot_tokens: Column) -> DataFrame:
    """The exact median of the ratios of aligned lines whose pivot has tokens."""
    both = pairs.select("lang", tokens.alias("t"), pivot_tokens.alias("p")).filter(F.col("p") > 0).select("lang", (F.col("t") / F.col("p")).alias("ratio"))
    return bounds.medians(both, "lang", "ratio").select("lang", F.col("n").alias("n_pairs"), F.col("median").alias("cost_ratio_median"))


def reduction(before: Column, after: Column, new_rows: Column) -> list[Column]:
    """Summary of two token counts of one corpus."""
    return [
        F.when(before > 0, 1 - after / before).otherwise(0.0).alias("token_reduction"),
        F.when(after > 0, before / after).otherwise(1.0).alias("context_gain"),
        F.when(before > 0, 1 - after / before).otherwise(0.0).alias("cost_reduction"),
        F.when(new_rows > 0, (before - after) / new_rows).otherwise(0.0).alias("tokens_per_new_row"),
    ]
