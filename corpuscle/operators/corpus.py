"""Corpora as rows: lines, numbering, splits, aligned pairs, cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.text import count_chars
from corpuscle.operators import bounds

#: Documents whose lines are numbered together; a task has several such spans, so that the largest task is near the mean one.
SPAN = 4_096


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, lang, pos, text of each line that is not blank."""
    return docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "text")).filter(F.trim("text") != "")


def numbered(rows: DataFrame, group: str = "lang", by: str = "doc_id", then: str = "pos", to: str = "line_no", span: int = SPAN) -> DataFrame:
    """Adds the place of each row in its group, from 0, and the group's size.

    Ids are cut into ordered spans; rows are numbered inside a span and the spans' offsets come
    from a small table, so a large group is many tasks.
    """
    spanned = rows.withColumn("_span", F.floor(F.col(by) / span))
    sizes = spanned.groupBy(F.col(group).alias("_g"), F.col("_span").alias("_s")).agg(F.count("*").alias("_n"))
    in_group = Window.partitionBy("_g")
    starts = sizes.select("_g", "_s", (F.sum("_n").over(in_group.orderBy("_s")) - F.col("_n")).alias("_start"), F.sum("_n").over(in_group).alias("n_lines"))
    inner = F.row_number().over(Window.partitionBy(group, "_span").orderBy(by, then)) - 1
    placed = spanned.withColumn("_inner", inner).join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_span") == F.col("_s")))
    return placed.select(*rows.columns, (F.col("_start") + F.col("_inner")).alias(to), "n_lines")


def head(rows: DataFrame, n: int) -> DataFrame:
    return rows.filter(F.col("line_no") < n)


def between(rows: DataFrame, start: int, stop: int) -> DataFrame:
    return rows.filter((F.col("line_no") >= start) & (F.col("line_no") < stop))


SPLITS = ("mine", "fit", "certify", "eval")


def split_of(line_no: Column, n: Column, fractions: tuple[float, float, float] = (0.4, 0.2, 0.2)) -> Column:
    """Contiguous slices by floors of the fractions; the last takes the rest."""
    edge, out = F.lit(0), F.lit(SPLITS[3])
    edges = []
    for f in fractions:
        edge = edge + F.floor(n * F.lit(f))
        edges.append(edge)
    for name, e in reversed(list(zip(SPLITS, edges, strict=False))):
        out = F.when(line_no < e, F.lit(name)).otherwise(out)
    return out


def split(rows: DataFrame, least: int = 8) -> DataFrame:
    """Adds the split; a group of fewer than `least` lines is whole in every split."""
    return rows.withColumn("split", F.explode(F.when(F.col("n_lines") < least, F.array(*map(F.lit, SPLITS))).otherwise(F.array(split_of(F.col("line_no"), F.col("n_lines"))))))


def aligned(rows: DataFrame, pivot: str = "en") -> DataFrame:
    """lang, line_no, text, pivot_text: the k-th line of each language beside the k-th of the pivot's."""
    other = rows.filter(F.col("lang") == pivot).select("line_no", F.col("text").alias("pivot_text"))
    return rows.filter(F.col("lang") != pivot).select("lang", "line_no", "text").join(other, "line_no")


def clean_bitext(pairs: DataFrame, least: int = 10, tolerance: float = 3.0) -> DataFrame:
    """Keeps pairs with content on both sides and a length ratio near the language's upper median.

    A language of fewer than 8 pairs with content keeps them all.
    """
    full = pairs.filter((F.length(F.trim("text")) >= least) & (F.length(F.trim("pivot_text")) >= least))
    rated = full.withColumn("ratio", count_chars(F.col("text")) / F.greatest(F.lit(1), count_chars(F.col("pivot_text"))))
    sizes = rated.groupBy("lang").agg(F.count("*").alias("n")).withColumn("k", F.floor(F.col("n") / 2) + 1)
    middle = bounds.selected(rated, sizes, "lang", "ratio", few=True).join(sizes.select("lang", F.col("n").alias("n_pairs")), "lang").select("lang", "n_pairs", F.col("value").alias("median"))
    median = F.when(F.col("median") == 0, 1.0).otherwise(F.col("median"))
    kept = rated.join(F.broadcast(middle), "lang").filter((F.col("n_pairs") < 8) | F.col("ratio").between(median / tolerance, median * tolerance))  # a row for each language
    return kept.select("lang", "line_no", "text", "pivot_text", "ratio")


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in the order; of rows with equal order one stays, the least."""
    whole = F.struct(F.col(order).alias("_order"), *[c for c in rows.columns if c != order])
    kept = rows.groupBy(F.col(key).alias("_key")).agg(F.min(whole).alias("_row"))
    return kept.select(*[F.col("_row._order" if c == order else f"_row.`{c}`").alias(c) for c in rows.columns])


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in the order, as in a map that is filled row by row."""
    whole = F.struct(F.col(order).alias("_order"), *[c for c in rows.columns if c != order])
    kept = rows.groupBy(F.col(key).alias("_key")).agg(F.max(whole).alias("_row"))
    return kept.select(*[F.col("_row._order" if c == order else f"_row.`{c}`").alias(c) for c in rows.columns])


def expanded(sample: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """A fixture corpus: ordered pairs of different sentences of a small sample (lang, i, text), in an order by hash, the first n of each language."""
    a, b = sample.alias("a"), sample.alias("b")
    both = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.i") != F.col("b.i")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("i", "j", F.lit(seed)))
    pairs = both.select("a.lang", F.col("a.i").alias("i"), F.col("b.i").alias("j"), F.concat_ws(" ", "a.text", "b.text").alias("text"))
    return pairs.withColumn("line_no", F.row_number().over(order) - 1).filter(F.col("line_no") < n)
