"""A language under several conditions: as it is, with composed rows, and with fitted and certified ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions.text import N_SPECIAL, byte_ids, count_chars, nfc
from corpuscle.operators import evaluation
from corpuscle.operators.augmented import Augmented, View
from corpuscle.plans import synthesis
from corpuscle.plans.build import Plan, run_build
from corpuscle.plans.model import Decoder

#: Baseline first: no pack; rows as they are composed; scaled to the vocabulary's mean norm; fitted and certified.
CONDITIONS = ("base", "zero_shot", "norm_matched", "certified")
SCORES = "lang string, condition string, n_tokens_added long, tokens_per_sentence double, bits_per_char double, accuracy double, tokens_delta double, accuracy_delta double, quality_retention double"


def grown(model: Decoder, lang: str, runs: list[tuple[int, ...]], rows: np.ndarray, out_rows: np.ndarray | None) -> tuple[Decoder, Augmented, View]:
    vocabulary = Augmented()
    if not runs:
        return model, vocabulary, View()
    vocabulary.attach(lang, runs)
    return model.appended(rows, out_rows), vocabulary, vocabulary.view(lang)


def scored(lines: DataFrame, model: Decoder, vocabulary: Augmented, view: View) -> DataFrame:
    """One row: tokens a sentence, bits a character under the view, and how often the next token is the likeliest."""
    held = lines.sparkSession.sparkContext.broadcast((model, vocabulary.open_ids(view)))

    def run(batches):  # noqa: ANN001, ANN202
        decoder, may = held.value
        for b in batches:
            out = []
            for ids in b["ids"]:
                ids = list(ids)
                z = np.where(may, decoder.forward(decoder.rows([0, *ids])[None])[0][0, :-1], -np.inf)
                lp = z - np.logaddexp.reduce(z, 1, keepdims=True)
                out.append((len(ids), float(-lp[np.arange(len(ids)), ids].sum()), int((lp.argmax(1) == ids).sum())))
            yield pd.DataFrame(out, columns=["n", "nats", "hits"]).assign(chars=b["chars"].to_numpy())

    asked = lines.select(vocabulary.encode(F.col("text"), view).alias("ids"), count_chars(nfc(F.col("text"))).alias("chars"))
    each = asked.filter(F.size("ids") > 0).mapInPandas(run, "n long, nats double, hits long, chars long")
    return each.agg(
        evaluation.tokens_per_sentence(F.col("n")).alias("tokens_per_sentence"),
        evaluation.bits_per_character(F.coalesce(F.sum("nats"), F.lit(0.0)), F.coalesce(F.sum("chars"), F.lit(0))).alias("bits_per_char"),
        evaluation.ratio(F.sum("hits").cast("double"), F.sum("n")).alias("accuracy"),
    )


def run_language(docs: DataFrame, lines: DataFrame, model: Decoder, plan: Plan) -> DataFrame:
    """SCORES of a language's evaluation lines (text) under each condition; docs is what the pack is built from."""
    spark = docs.sparkSession
    entries = run_build(docs, model, plan).entries.orderBy("rank").select("gram_hex", "accepted", "selected_step").collect()  # a short list
    run_of = lambda e: tuple(b + N_SPECIAL for b in bytes.fromhex(e["gram_hex"]))
    everything = [run_of(e) for e in entries][: plan.budget]
    chosen = [run_of(e) for e in entries if e["accepted"] and e["selected_step"]]
    out = []
    for name in CONDITIONS:
        if name == "base":
            runs, config = [], synthesis.ZERO_SHOT
        elif name == "certified":
            runs, config = chosen, plan.config
        else:
            runs, config = everything, synthesis.ZERO_SHOT if name == "zero_shot" else synthesis.NORM_MATCHED
        rows = np.array([synthesis.composed(model, list(r), config) for r in runs]).reshape(-1, model.shape.d)
        outs = None if model.tied else np.array([model.unembed[r[0]] for r in runs]).reshape(-1, model.shape.d)
        m, vocabulary, view = grown(model, plan.lang, runs, rows, outs)
        s = scored(lines, m, vocabulary, view).first()
        out.append((plan.lang, name, len(runs), s["tokens_per_sentence"], s["bits_per_char"], s["accuracy"]))
    table = spark.createDataFrame(out, "lang string, condition string, n_tokens_added long, tokens_per_sentence double, bits_per_char double, accuracy double")
    return evaluation.against_baseline(table, ["lang"], "base")


def sweep(spark: SparkSession, langs: list[str], docs_of: Callable[[str], DataFrame], lines_of: Callable[[str], DataFrame], model: Decoder, plan: Plan = Plan()) -> tuple[DataFrame, dict[str, str]]:
    """All languages' scores, and the errors of those that failed; one does not stop the others."""
    done, failed = [], {}
    for lang in langs:
        try:
            done += [tuple(r) for r in run_language(docs_of(lang), lines_of(lang), model, replace(plan, lang=lang)).collect()]
        except Exception as e:  # noqa: BLE001  told to the caller
            failed[lang] = f"{type(e).__name__}: {str(e)[:300]}"
    return spark.createDataFrame(done, SCORES), failed


def analysed(texts: DataFrame, vocabulary: Augmented, aligned: DataFrame, totals: DataFrame) -> DataFrame:
    """texts: request, lang, text. What a page shows of each: tokens without and with the language's pack, both in pieces, the premium, and the share of a context that is left.

    A language without a pack is shown under the base view.
    """
    with_pack = F.lit(None).cast("array<int>")
    for lang in vocabulary.langs:
        with_pack = F.when(F.col("lang") == lang, vocabulary.encode(F.when(F.col("lang") == lang, F.col("text")), vocabulary.view(lang))).otherwise(with_pack)
    ids = texts.select("request", "lang", "text", byte_ids(F.encode("text", "utf-8")).alias("base_ids"), with_pack.alias("pack_ids")).withColumn("pack_ids", F.coalesce("pack_ids", "base_ids"))
    shown = ids.select("request", "lang", "text", F.size("base_ids").cast("long").alias("base_tokens"), F.size("pack_ids").cast("long").alias("pack_tokens"), vocabulary.pieces(F.col("base_ids")).alias("base_pieces"), vocabulary.pieces(F.col("pack_ids")).alias("pack_pieces"))
    paid = evaluation.premium(shown.select("request", "lang", "text", "base_tokens"), aligned, totals, F.col("base_tokens")).select("request", "pivot_tokens", "exact", "premium")
    return shown.join(paid, "request").select("*", *evaluation.request_savings(F.col("base_tokens"), F.col("pack_tokens")), F.when(F.col("premium") > 0, 1 / F.col("premium")).alias("effective_context"))
