"""Mixing sources to target weights with a time-varying curriculum, in DataFrame functions alone.

Targets are found by one pass over the sources: sorted by the level at which each is full, the
common level is the greatest of the levels left when those before are full. A source's documents
are laid out in a stable random order; the mix takes them from the start until the target is
reached, a second time if it is larger than the source. Each source has a weight schedule, linear
in training time; its integral, scaled to the target, is the source's cumulative demand, and the
inverse of the demand gives the time at which a document's first word is due. Time turns into a
training position by the demand of all sources together, and documents are range-sorted by it.

Prefix sums run over parts of a source, ranges of the order, so a source of any size is many tasks;
there are more parts the larger the table is, and the order does not depend on their number.

Defined results: a null text has size 0 and takes 0 words, and so has a source, or a table, whose
texts hold no words: its target is 0; a null source is the last source; null ids are dealt over the
parts by a hash of their texts; ties in the order have equal ids, sizes and texts' hashes, so reruns
agree; documents of which nothing is taken have no position; other columns are carried, whatever
their names; a very long text is one row like any other; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.llm import common

WEIGHTS = (5, 2, 1)
#: Weight at the start and at the end of training, for each weight in turn: up, level, down.
SCHEDULES = ((0.5, 1.5), (1.0, 1.0), (1.5, 0.5))
SHARE, MOST = 1.5, 2
#: Bytes of the table that a part of all sources together stands for.
PART_BYTES = 32 << 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def _in_turn(rank: Column, values: tuple) -> Column:
    out = F.lit(values[0])
    for k, v in enumerate(values[1:], 1):
        out = F.when((rank - 1) % len(values) == k, F.lit(v)).otherwise(out)
    return out


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> also target, goal (whole words) and the schedule's numbers; a row for each source, so few."""
    every = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighed = ranked.select("source", "source_size", "rank", _in_turn(F.col("rank"), WEIGHTS).alias("weight"), _in_turn(F.col("rank"), tuple(a for a, _ in SCHEDULES)).alias("a"), _in_turn(F.col("rank"), tuple(b for _, b in SCHEDULES)).alias("b"))
    full = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    left = full.rowsBetween(0, Window.unboundedFollowing)
    level = (SHARE * F.sum("source_size").over(every) - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(left)  # weights are positive
    levelled = weighed.withColumn("level", level)
    target = F.least(F.col("source_size") * F.lit(float(MOST)), F.col("weight") * F.max("level").over(every))
    aimed = levelled.withColumn("target", target).withColumn("goal", F.round("target").cast("long"))
    mean = (F.col("a") + F.col("b")) / 2
    return aimed.select(
        "source", "source_size", "target", "goal", "a", "b",
        F.sum(F.col("goal") * F.col("a") / mean).over(every).alias("linear"),
        F.sum(F.col("goal") * (F.col("b") - F.col("a")) / (2 * mean)).over(every).alias("square"),
    )


def _position(at: Column) -> Column:
    """Training position at which word `at` of a source's demand is due."""
    a, b = F.col("a"), F.col("b")
    due = F.try_divide(at, F.col("goal")) * (a + b) / 2  # integral of the schedule until then
    time = F.when(a == b, due / a).otherwise((F.sqrt(a * a + 2 * (b - a) * due) - a) / (b - a))
    return F.col("linear") * time + F.col("square") * time * time


def laid_out(docs: DataFrame, keep: list[str], doc_id: str = "doc_id", source: str = "source", text: str = "text", wide: bool = False) -> DataFrame:
    """The columns `keep`, then size, source_size, target, taken and passes: words taken and position of each time the document is taken.

    wide: `keep` has large columns; sizes are then counted twice instead of writing those columns.
    """
    spark = docs.sparkSession
    bits = common.bucket_bits(docs, PART_BYTES, least=8, most=20)
    order = F.xxhash64(F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(F.col(text))), F.lit(8))
    rows = docs.select(*keep, F.col(source).alias("_source"), F.col(doc_id).alias("_id"), word_count(F.col(text)).alias("_size"), order.alias("_order")).withColumn("_part", F.shiftright("_order", 64 - bits).cast("int"))
    narrow = common.written(spark, rows.select("_source", "_part", "_size") if wide else rows, "sizes")
    parts = common.written(spark, narrow.groupBy("_source", "_part").agg(F.sum("_size").alias("part_size")), "parts")
    goals = targets(parts.groupBy(F.col("_source").alias("source")).agg(F.sum("part_size").alias("source_size")))
    starts = parts.select("_source", "_part", (F.sum("part_size").over(Window.partitionBy("_source").orderBy("_part")) - F.col("part_size")).alias("part_start"))
    plan = common.written(spark, starts.join(goals, starts["_source"].eqNullSafe(goals["source"])).drop("source"), "plan").withColumnsRenamed({"_source": "p_source", "_part": "p_part"})
    if not wide:
        rows = narrow
    inner = F.sum("_size").over(Window.partitionBy("_source", "_part").orderBy("_order", "_id", "_size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    placed = rows.withColumn("_inner", inner).join(plan, F.col("_source").eqNullSafe(F.col("p_source")) & (F.col("_part") == F.col("p_part"))).withColumn("_start", F.col("part_start") + F.col("_inner"))
    passes = F.array(*[F.struct(F.greatest(F.lit(0), F.least("_size", F.col("goal") - F.col("_start") - k * F.col("source_size"))).alias("words"), _position(F.col("_start") + k * F.col("source_size")).alias("position")) for k in range(MOST)])
    found = placed.withColumn("passes", F.filter(passes, lambda p: p["words"] > 0))
    return found.select(*keep, F.col("_size").alias("size"), "source_size", "target", F.aggregate("passes", F.lit(0).cast("long"), lambda s, p: s + p["words"]).alias("taken"), "passes", F.col("_order"))


def curriculum(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, size, source_size, target, taken and the positions, range-sorted by the first position."""
    found = laid_out(docs, [doc_id], doc_id, source, text)
    first = found.withColumn("position", F.get("passes", F.lit(0))["position"]).withColumn("again", F.get("passes", F.lit(1))["position"]).drop("passes")
    order = [F.col("position").asc_nulls_last(), F.col("_order")]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return first.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_order")


def first_words(text: Column, n: Column) -> Column:
    """The text up to and with its n-th word, white space kept."""
    pieces = F.regexp_extract_all(text, F.lit(rf"[{common.SPACE_CLASS}]*[^{common.SPACE_CLASS}]+"), F.lit(0))
    return F.array_join(F.slice(pieces, 1, n), "")


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The training mix with the columns of docs: a row for each time a document is taken, cut where the target is reached, in training order."""
    columns = docs.columns
    whole = docs.select(F.struct(*columns).alias("row"), doc_id, source, text)  # its names cannot clash with the plan's
    found = laid_out(whole, ["row"], doc_id, source, text, wide=True)
    taken = found.select("row", "size", F.explode("passes").alias("pass"), "_order")
    body = F.col(f"row.`{text}`")
    cut = F.when(F.col("pass.words") < F.col("size"), first_words(body, F.col("pass.words").cast("int"))).otherwise(body)
    made = {text: F.col("_cut")}
    if n_chars in columns:
        made[n_chars] = F.length("_cut").cast(docs.schema[n_chars].dataType)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("pass.position"), F.col("_order")]
    rows = taken.withColumn("_cut", cut).repartitionByRange(n, *order).sortWithinPartitions(*order)
    return rows.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])
