"""Commands: atlas, build, inspect, verify, demo, assets, request."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions.text import N_SPECIAL
from corpuscle.operators import bounds
from corpuscle.operators.augmented import Augmented
from corpuscle.plans.build import Plan, build
from corpuscle.plans.model import Decoder
from corpuscle.plans.reports import markdown
from corpuscle.sources import packs


def entries_of(built: DataFrame) -> DataFrame:
    """A build's rows as the entries of a pack."""
    return built.select("lang", "rank", "gram_hex", "n_occurrences", "accepted", F.create_map(F.lit("kl"), F.col("kl_bound")).alias("bounds"))


def verify(entries: DataFrame, fresh: DataFrame, alpha: float, delta: float) -> DataFrame:
    """Fresh measurements (token, kl) held against the bounds of a pack's accepted entries; one row."""
    limits = entries.filter("accepted").select(F.col("gram_hex").alias("token"), F.element_at("bounds", "kl").alias("bound"))
    return bounds.verdict(bounds.coverage(limits, fresh, "token", "kl", alpha, delta))


def remeasured(spark: SparkSession, entries: DataFrame, data: str, each: int = 64) -> DataFrame:
    """token, kl of a pack's entries at their first occurrences in the evaluation slice of each language, with rows composed anew."""
    from corpuscle.functions.text import byte_ids
    from corpuscle.operators import contexts, corpus
    from corpuscle.plans import synthesis

    lines = corpus.split(corpus.numbered(corpus.lines(spark.read.parquet(f"{data}/documents.parquet")))).filter("split = 'eval'").select("doc_id", "lang", "pos", "text")
    found = contexts.first_occurrences(lines, entries.select("lang", F.unhex("gram_hex").alias("gram")), each)
    placed = found.select(F.hex("gram").alias("token"), F.xxhash64("doc_id", "pos", "at").alias("context"), byte_ids(F.col("gram")).alias("ids"), byte_ids(F.col("prefix")).alias("prefix"), byte_ids(F.col("suffix")).alias("suffix"))
    model = Decoder()
    return synthesis.measured(placed, synthesis.fitted(placed, model), model).select("token", "kl")


def vocabulary_of(entries: DataFrame) -> Augmented:
    """A vocabulary with a pack's entries."""
    out = Augmented()
    for r in entries.orderBy("lang", "rank").select("lang", "gram_hex").collect():  # a pack's rows
        out.add_tokens(r["lang"], [tuple(b + N_SPECIAL for b in bytes.fromhex(r["gram_hex"]))])
    return out


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corpuscle", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, what in (("atlas", "token cost of each language"), ("build", "build a pack"), ("demo", "build on small limits and show it")):
        p = commands.add_parser(name, help=what)
        p.add_argument("data", help="folder of the tables")
        p.add_argument("--lang", default=Plan.lang)
        p.add_argument("--budget", type=int, default=Plan.budget)
        p.add_argument("--out")
    p = commands.add_parser("inspect", help="entries of a pack")
    p.add_argument("pack")
    p = commands.add_parser("assets", help="JSON copies of atlas rows and a sample for static pages")
    p.add_argument("rows", help="JSON lines of the atlas")
    p.add_argument("--sample", help="JSON sample of aligned sentences")
    p.add_argument("--out", required=True)
    p = commands.add_parser("request", help="the body that an engine would be sent; nothing is sent")
    p.add_argument("pack")
    p.add_argument("text")
    p.add_argument("--view", default="base")
    p = commands.add_parser("verify", help="hold fresh measurements against a pack")
    p.add_argument("pack")
    p.add_argument("measurements", help="Parquet of token, kl; or, with --remeasure, the folder of the tables")
    p.add_argument("--remeasure", action="store_true", help="measure the entries anew on fresh lines of the tables")
    p.add_argument("--alpha", type=float, default=Plan.alpha)
    p.add_argument("--delta", type=float, default=Plan.delta)
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("corpuscle").getOrCreate()
    if given.command == "inspect":
        entries = packs.read_pack(spark, given.pack, require_accepted=False)
        print(packs.card(entries))
        print(markdown(entries.orderBy("lang", "rank").withColumn("bounds", F.to_json("bounds"))))
        return 0
    if given.command == "assets":
        atlas = spark.read.json(given.rows)
        tables = {"atlas": atlas} | ({"sample": packs.read_sample(spark, given.sample)} if given.sample else {})
        packs.write_assets(tables, given.out)
        return 0
    if given.command == "request":
        vocabulary = vocabulary_of(packs.read_pack(spark, given.pack))
        view = {v.name: v for v in vocabulary.views()}.get(given.view)
        if view is None:
            parser.error(f"no view {given.view}")
        row = spark.createDataFrame([(given.text,)], "text string").select(vocabulary.encode(F.col("text"), view).alias("ids")).first()
        print(json.dumps({"ids": list(row["ids"]), "banned": [int(i) for i in (~vocabulary.open_ids(view)).nonzero()[0]]}))
        return 0
    if given.command == "verify":
        entries = packs.read_pack(spark, given.pack)
        fresh = remeasured(spark, entries, given.measurements) if given.remeasure else spark.read.parquet(given.measurements)
        result = verify(entries, fresh, given.alpha, given.delta)
        print(markdown(result))
        return 0 if result.first()["ok"] else 1
    if given.command == "atlas":
        from corpuscle import catalog

        rows = catalog.QUERIES["token_cost_by_lang"](spark, given.data).orderBy(F.desc(F.coalesce("cost_ratio", F.lit(0))))
        print(markdown(rows))
        if given.out:
            packs.write_rows(rows, given.out)
        return 0
    built = build(spark.read.parquet(f"{given.data}/documents.parquet"), Decoder(), Plan(lang=given.lang, budget=given.budget))
    if given.out:
        packs.write_pack(entries_of(built), given.out, {"lang": given.lang})
    print(markdown(built.orderBy("rank")))
    print(markdown(built.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).count().orderBy(F.desc("count"))))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
