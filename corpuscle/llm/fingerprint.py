"""One-permutation MinHash fingerprints, in DataFrame functions alone.

Each run of five words is hashed once; the top bits of the hash name its bin and the least hash
of a bin is kept. An empty bin takes the value of a full one by optimal densification: it probes
all bins in an order of its own, the same for all texts, until it meets a full one. The low 8 bits of
each bin are packed into a string of hex digits. Of two fingerprints, the share of equal bins is
corrected for the 1/256 of bins that agree by chance.

Defined results: a null text counts as empty; an empty text, or one without words, has an empty
fingerprint, likeness 1 to its like and 0 to any other; a shorter text is one shingle; a null
doc_id comes after all others; of equal doc_ids, texts come in the order of their hashes, and
equal rows follow each other; the only document is its own next; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.llm import common

BIN_BITS, WIDTH, LOW_BITS = 7, 5, 8
BINS = 1 << BIN_BITS
#: Probes that are written out one by one; where all of them fail, all bins are asked at once in the same order.
PROBES = 8


def _probe_order(bin_no: int) -> list[int]:
    """All bins in the order in which this one, if empty, asks them."""
    return sorted(range(BINS), key=lambda k: hashlib.blake2b(f"{bin_no}:{k}".encode(), digest_size=8).digest())


def _literal(values: list, kind: str) -> Column:
    """A constant that the optimizer folds; thousands of literals would each be a call into the JVM."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def with_fingerprint(df: DataFrame, text: str, to: str) -> DataFrame:
    """Adds `to`: an array of one small number for each bin, empty for a text without words."""
    w, h, s, m, d = (f"_{to}_{x}" for x in "whsmd")
    columns = df.columns
    words = F.filter(F.split(F.col(text), rf"[{common.SPACE_CLASS}]+"), lambda x: x != "")
    runs = F.when(F.size(h) >= WIDTH, F.transform(F.sequence(F.lit(0), F.size(h) - WIDTH), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WIDTH)]))).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
    # sorted as signed numbers, so that bins ascend from 0
    bin_of = lambda x: (F.shiftright(x, 64 - BIN_BITS) + BINS // 2).cast("int")
    low = lambda x: x.bitwiseAND(F.lit((1 << LOW_BITS) - 1)).cast("int")
    none = lambda n: F.array_repeat(F.lit(None).cast("int"), n)
    least = F.filter(F.col(s), lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1))))
    led = F.flatten(F.transform(m, lambda x, i: F.concat(none(bin_of(x) - F.when(i == 0, 0).otherwise(bin_of(F.get(m, i - 1)) + 1)), F.array(low(x)))))
    dense = F.when(F.size(m) == BINS, F.transform(m, low)).when(F.size(m) > 0, F.concat(led, none(BINS - 1 - bin_of(F.get(m, F.size(m) - 1))))).otherwise(F.array().cast("array<int>"))
    orders = [_probe_order(b) for b in range(BINS)]
    attempts = [_literal([o[t] for o in orders], "array<int>") for t in range(PROBES)]
    every = _literal(orders, "array<array<int>>")
    first_full = lambda i: F.get(d, F.get(F.filter(F.get(every, i), lambda k: F.get(d, k).isNotNull()), F.lit(0)))
    # coalesce stops at the first full bin
    filled = F.when((F.size(d) == 0) | ~F.exists(d, lambda x: x.isNull()), F.col(d)).otherwise(F.transform(F.col(d), lambda x, i: F.coalesce(x, *[F.get(d, F.get(a, i)) for a in attempts], first_full(i))))
    steps = ((w, words), (h, F.transform(w, lambda x: F.xxhash64(x))), (s, F.sort_array(runs)), (m, least), (d, dense), (to, filled))
    for name, value in steps:  # a column of its own for each step, since the next reads it more than once
        df = df.select(*columns, value.alias(name))
    return df


def packed(bins: Column) -> Column:
    digits = F.array(*[F.lit(f"{v:0{LOW_BITS // 4}x}") for v in range(1 << LOW_BITS)])
    return F.array_join(F.transform(bins, lambda x: F.get(digits, x)), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimate of the Jaccard similarity of the shingle sets, from 0 to 1."""
    chance = 1.0 / (1 << LOW_BITS)
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)
    same = (equal / F.lit(BINS) - chance) / (1 - chance)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.greatest(F.lit(0.0), same))


def following(rows: DataFrame) -> DataFrame:
    """id, content, copies -> also next_id and next_content in descending order of (id, content), the first after the last.

    The rows are range-partitioned; the next row of a partition's last one is the first of the
    next partition, of which there are few.
    """
    spark = rows.sparkSession
    order = [F.col("id").desc(), F.col("content").desc()]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = common.written(spark, rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "order")
    ahead = Window.partitionBy("part").orderBy(*order)
    heads = dealt.groupBy("part").agg(F.max(F.struct("id", "content")).alias("head"))
    after = heads.select("part", F.coalesce(F.lead("head").over(Window.orderBy("part")), F.first("head").over(Window.orderBy("part"))).alias("head"))
    led = dealt.withColumn("next", F.lead(F.struct("id", "content")).over(ahead))
    return led.join(F.broadcast(after), "part").withColumn("next", F.coalesce("next", "head")).select(*rows.columns, F.col("next.id").alias("next_id"), F.col("next.content").alias("next_content"))  # a row for each of n partitions


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row."""
    spark = docs.sparkSession
    least = -(1 << 63)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = base.select(F.coalesce("doc_id", F.lit(least)).alias("id"), F.xxhash64("text", F.col("doc_id").isNull()).alias("content"), "doc_id", "text")
    ids = keyed.select("id", "content", F.length("text").cast("long").alias("n_chars"), "doc_id").groupBy("id", "content").agg(F.count("*").alias("copies"), F.first("n_chars").alias("n_chars"), F.first("doc_id").alias("doc_id"))
    chain = following(ids)
    # of equal rows each but the last is followed by its like
    self_next = chain.filter("copies > 1").select("id", "content", "doc_id", "n_chars", F.explode(F.sequence(F.lit(2), F.col("copies"))).alias("_k"), F.col("id").alias("next_id"), F.col("content").alias("next_content")).drop("_k")
    steps = common.written(spark, chain.select("id", "content", "doc_id", "n_chars", "next_id", "next_content").unionByName(self_next), "steps")

    # texts move once, whole; both joins below read the same exchange
    again = F.lag(F.lit(1)).over(Window.partitionBy("id", "content").orderBy("id"))
    texts = keyed.select("id", "content", "text").withColumn("_again", again).filter("_again is null").drop("_again")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    # a row whose next is its like needs no other text, and every other has one next, so id and content are the whole key
    to_self = (F.col("id") == F.col("next_id")) & (F.col("content") == F.col("next_content"))
    wanted = steps.filter(~to_self).select(F.col("id").alias("to_id"), F.col("content").alias("to_content"), "n_chars", F.col("next_id").alias("id"), F.col("next_content").alias("content"))
    heads = texts.join(wanted, ["id", "content"]).select(F.col("to_id").alias("id"), F.col("to_content").alias("content"), F.col("text").substr(F.lit(1), half).alias("head"))
    own = texts.join(steps, ["id", "content"]).join(heads, ["id", "content"], "left")
    head = F.when(to_self, F.col("text").substr(F.lit(1), half)).otherwise(F.col("head"))
    edited = own.select("id", "content", "doc_id", "n_chars", "next_id", "next_content", "text", F.concat(F.col("text").substr(F.lit(1), F.col("n_chars").cast("int") - half), head).alias("edited"))
    both = with_fingerprint(with_fingerprint(edited, "text", "bins").drop("text"), "edited", "edited_bins")
    names = ["id", "content", "doc_id", "n_chars", "next_id", "next_content"]
    made = common.written(
        spark,
        both.select(
            *names,
            F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            packed(F.col("bins")).alias("fingerprint"),
            packed(F.col("edited_bins")).alias("edited_fingerprint"),
            likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"),
        ),
        "fingerprints",
    )
    others = made.select(F.col("id").alias("next_id"), F.col("content").alias("next_content"), F.col("fingerprint").alias("next_print")).dropDuplicates(["next_id", "next_content"])
    near_next = packed_likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next")
    return made.join(others, ["next_id", "next_content"]).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", near_next)


def packed_likeness(a: Column, b: Column) -> Column:
    cells = lambda s: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substr(s, i * 2 + 1, F.lit(2)))
    empty = F.array().cast("array<string>")
    return likeness(F.when(F.length(a) == 0, empty).otherwise(cells(a)), F.when(F.length(b) == 0, empty).otherwise(cells(b)))
