"""Which source a corpus comes from: the first of a chain that has lines."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators import corpus
from corpuscle.sources import packs

#: A file named by this variable, with the language in upper case after it, overrides all else.
VARIABLE = "CORPUSCLE_TEXT_"
#: And one for pairs with the pivot language.
VARIABLE_PAIRS = "CORPUSCLE_PAIRS_"


def first_with_lines(sources: list[tuple[str, Callable[[], DataFrame | None]]]) -> tuple[str, DataFrame]:
    """Name and rows of the first source that is there and not empty."""
    for name, load in sources:
        rows = load()
        if rows is not None and not rows.isEmpty():
            return name, rows
    raise LookupError("no source has lines: " + ", ".join(name for name, _ in sources))


def monolingual(spark: SparkSession, lang: str, cache: str | None = None, sample: str | None = None) -> tuple[str, DataFrame]:
    """Lines of a language from the override, the cache folder, or the sample."""
    override = os.environ.get(VARIABLE + lang.upper())
    return first_with_lines(
        [
            ("override", lambda: packs.read_lines(spark, override) if override else None),
            ("cache", lambda: packs.read_lines(spark, f"{cache}/{lang}.txt") if cache and Path(f"{cache}/{lang}.txt").exists() else None),
            ("sample", lambda: packs.read_sample(spark, sample).filter(F.col("lang") == lang).select("text") if sample else None),
        ]
    )


def local_pairs(spark: SparkSession, lang: str) -> DataFrame | None:
    """Cleaned pairs of a language with the pivot from the file that VARIABLE_PAIRS names, if any: lang, line_no, text, pivot_text."""
    path = os.environ.get(VARIABLE_PAIRS + lang.upper())
    if not path:
        return None
    rows = packs.read_pairs(spark, path).withColumn("lang", F.lit(lang)).withColumn("doc_id", F.monotonically_increasing_id()).withColumn("pos", F.lit(0))
    kept = corpus.clean_bitext(corpus.numbered(rows, span=1 << 33))
    order = kept.withColumn("doc_id", F.col("line_no")).withColumn("pos", F.lit(0)).drop("line_no", "ratio")
    return corpus.numbered(order).select("lang", "line_no", "text", "pivot_text")


def parallel(spark: SparkSession, langs: list[str], pivot: str = "en", aligned: DataFrame | None = None, sample: str | None = None, most: int | None = None) -> tuple[str, DataFrame]:
    """Name of the source and lang, line_no, text, pivot_text (the language's own pivot line, null where the pivot is shared).

    In turn: a corpus that is aligned in all languages (lang, line_no, text), or nothing of it; pairs
    from files, each with its own pivot lines; a sample. Languages are cut to the shortest.
    """
    langs = list(dict.fromkeys([pivot, *langs]))
    shared = lambda rows: rows.filter(F.col("lang").isin(langs)).select("lang", "line_no", "text", F.lit(None).cast("string").alias("pivot_text"))
    if aligned is not None and aligned.filter(F.col("lang").isin(langs)).select("lang").distinct().count() == len(langs):
        return "aligned", cut_to_shortest(shared(aligned), most)
    pairs = {x: local_pairs(spark, x) for x in langs if x != pivot}
    if pairs and all(p is not None and not p.isEmpty() for p in pairs.values()):
        out = None
        for p in pairs.values():
            out = p if out is None else out.unionByName(p)
        return "pairs", cut_to_shortest(out, most)
    if sample:
        rows = packs.read_sample(spark, sample).select("lang", F.col("i").cast("long").alias("line_no"), "text")
        if missing := set(langs) - set(languages_of(rows)):
            raise LookupError(f"the sample lacks {', '.join(sorted(missing))}")
        return "sample", cut_to_shortest(shared(rows), most)
    raise LookupError("no parallel source")


def cut_to_shortest(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Lines below the number that every language has."""
    least = rows.groupBy("lang").agg(F.count("*").alias("n")).agg(F.min("n").alias("_least"))
    limit = F.col("_least") if most is None else F.least(F.col("_least"), F.lit(most))
    return rows.crossJoin(F.broadcast(least)).filter(F.col("line_no") < limit).drop("_least")  # one row


def pivot_for(rows: DataFrame, pivot: str = "en") -> DataFrame:
    """lang, line_no, text, pivot_text: a language's own pivot line, else the shared one."""
    common = rows.filter(F.col("lang") == pivot).select("line_no", F.col("text").alias("_shared"))
    others = rows.filter(F.col("lang") != pivot).join(common, "line_no", "left")
    return others.select("lang", "line_no", "text", F.coalesce("pivot_text", "_shared").alias("pivot_text"))


def languages_of(rows: DataFrame) -> list[str]:
    """In order."""
    return [r["lang"] for r in rows.select("lang").distinct().orderBy("lang").collect()]


def negative_lines(rows: DataFrame, protected: list[str]) -> DataFrame:
    """Lines of the languages that a pack must leave alone."""
    return rows.filter(F.col("lang").isin(protected))


def largest(candidates: list[DataFrame]) -> DataFrame:
    """The cleaned pairs with the most rows; the first of equals."""
    return max(enumerate(candidates), key=lambda c: (c[1].count(), -c[0]))[1]


def pack_dirs(root: str) -> list[str]:
    """Folders under root that hold a pack's manifest."""
    return sorted(str(p.parent) for p in Path(root).rglob("manifest") if p.is_dir())


def surfaces(entries: DataFrame) -> DataFrame:
    """surface and id of a pack's entries, for tools that know only added tokens; a surface merges only where its run stands."""
    return entries.select(F.decode(F.unhex("gram_hex"), "utf-8").alias("surface"), F.col("new_id").alias("id"))
