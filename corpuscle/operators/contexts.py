"""Contexts of candidates in a corpus: what stands before and after their occurrences."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from corpuscle.operators import grams

BEFORE, AFTER = 12, 6


def occurrences(rows: DataFrame, candidates: DataFrame, before: int = BEFORE, after: int = AFTER, first: int | None = None) -> DataFrame:
    """lang, gram, doc_id, pos, at, prefix, suffix of each occurrence; both clipped at the line's ends.

    Lines are searched inside tasks for the candidates, which are a list that tasks can hold. first:
    each task gives only the first ones of each candidate in corpus order, so that many, and does
    not search for a candidate in lines that all come after them.
    """
    known = grams.collected(candidates)
    schema = StructType([f for c in ("lang", "doc_id", "pos", "text") for f in rows.schema.fields if f.name == c])
    made = StructType([schema["lang"], StructField("gram", BinaryType()), schema["doc_id"], schema["pos"], StructField("at", IntegerType()), StructField("prefix", BinaryType()), StructField("suffix", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes], list[tuple]] = {}
        for batch in batches:
            ids, places = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("pos").to_numpy(zero_copy_only=False)
            for lang, x in grams.chunks(batch, np.lexsort((places, ids))):
                least = (ids[x.rows[0]], places[x.rows[0]])
                for f in known.get(lang, []):
                    if first is not None:
                        open_ = [r for r in f.runs if len(own := held.get((lang, r), [])) < first or own[-1][:2] >= least]
                        if not open_:
                            continue
                        f = f if len(open_) == len(f.runs) else grams.Finder(open_)
                    found = f.ids(x)
                    at = np.flatnonzero(found >= 0)
                    if first is not None:  # of each candidate the first ones of the chunk
                        order = np.argsort(found[at], kind="stable")
                        own = found[at][order]
                        at = at[order[np.arange(len(own)) - np.searchsorted(own, own) < first]]
                    line = x.line[at].astype(np.int64)
                    start, end = x.start[line], np.append(x.start[1:], len(x.data))[line]
                    lo, hi = np.maximum(start, at - before), np.minimum(end, at + f.n + after)
                    whole, row = x.data.tobytes(), x.rows[line]
                    out = zip((f.runs[k] for k in found[at]), ids[row].tolist(), places[row].tolist(), (at - start + 1).tolist(), (whole[a:b] for a, b in zip(lo.tolist(), at.tolist(), strict=True)), (whole[a:b] for a, b in zip((at + f.n).tolist(), hi.tolist(), strict=True)), strict=True)
                    if first is None:
                        for _ in range(0, len(at), 1 << 14):
                            yield batch_of([(lang, *r) for r in itertools.islice(out, 1 << 14)])
                        continue
                    fresh: dict[bytes, list[tuple]] = {}
                    for gram, *r in out:
                        fresh.setdefault(gram, []).append(tuple(r))
                    for gram, own in fresh.items():
                        held[lang, gram] = sorted([*held.get((lang, gram), []), *own])[:first]
        yield batch_of([(lang, gram, *r) for (lang, gram), own in held.items() for r in own])

    kinds = to_arrow_schema(made)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * len(kinds), kinds, strict=True)], schema=kinds)

    return rows.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "doc_id", "pos", "text").mapInArrow(run, made)


def first_occurrences(rows: DataFrame, candidates: DataFrame, n: int, before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """The first n occurrences of each candidate in corpus order, and their place k among them."""
    return first_n(occurrences(rows, candidates, before, after, first=n), n)


def first_n(found: DataFrame, n: int) -> DataFrame:
    """The first n occurrences of each candidate in corpus order."""
    order = Window.partitionBy("lang", "gram").orderBy("doc_id", "pos", "at")
    return found.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= n)


def share_with_context(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """lang, n_candidates, n_with_context, coverage."""
    hit = found.select("lang", "gram").distinct().withColumn("hit", F.lit(1))
    return candidates.select("lang", "gram").join(hit, ["lang", "gram"], "left").groupBy("lang").agg(F.count("*").alias("n_candidates"), F.count("hit").alias("n_with_context"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("coverage"))
