"""Distribution-free bounds on drift, acceptance by them, and their check on fresh data."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the sketch that narrows an order statistic down before it is selected exactly.
ACCURACY = 10_000


def tolerance_index(n: int, alpha: float, delta: float) -> int | None:
    """Smallest k whose order statistic covers 1 - alpha with confidence 1 - delta; None if the sample is too small."""
    if n <= 0:
        return None
    i = np.arange(n)
    steps = np.log((n - i[:-1]) / (i[:-1] + 1)) + math.log((1 - alpha) / alpha)
    log_mass = n * math.log(alpha) + np.concatenate(([0.0], np.cumsum(steps)))
    enough = np.flatnonzero(np.cumsum(np.exp(log_mass)) >= 1 - delta)
    return int(enough[0]) + 1 if len(enough) else None


def tolerance_index_of(n: Column, alpha: float, delta: float) -> Column:
    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        known = {int(v): tolerance_index(int(v), alpha, delta) for v in s.dropna().unique()}
        return s.map(known).astype("Int64")

    return run(n)


def samples_needed(alpha: float, delta: float, most: int = 100_000) -> int:
    if not (0 < alpha < 1 and 0 < delta < 1):
        return most
    return min(most, math.ceil(math.log(delta) / math.log(1 - alpha)))


def selected(rows: DataFrame, wanted: DataFrame, key: str, value: str, few: bool = False) -> DataFrame:
    """wanted: key, n (values of the key), k. The exact k-th smallest value of each key and k: key, k, value.

    A sketch gives an interval around the order statistic; values below it are only counted and
    the few inside are ranked, so no key is sorted as a whole and none is one task. few: the keys
    are so few that their intervals go to the rows; else the planner may send the rows of a key to one task.
    """
    v = F.col(value)
    quantiles = rows.groupBy(key).agg(F.percentile_approx(v, F.array(*[F.lit(q / 200) for q in range(201)]), F.lit(ACCURACY)).alias("q"), F.min(v).alias("least"), F.max(v).alias("most"))
    place = F.floor(F.col("k") / F.col("n") * 200).cast("int")
    near = wanted.filter("k is not null").join(quantiles, key).select(key, "k", F.when(place <= 1, F.col("least")).otherwise(F.get("q", place - 1)).alias("lo"), F.when(place >= 198, F.col("most")).otherwise(F.get("q", place + 2)).alias("hi"))
    placed = rows.select(key, v.alias("v")).join(F.broadcast(near) if few else near, key)
    below = placed.groupBy(key, "k").agg(F.count_if(F.col("v") < F.col("lo")).alias("below"))
    inside = placed.filter(F.col("v").between(F.col("lo"), F.col("hi"))).groupBy(key, "k", "v").agg(F.count("*").alias("c")).join(below, [key, "k"])
    up_to = F.col("below") + F.sum("c").over(Window.partitionBy(key, "k").orderBy("v"))
    return inside.withColumn("up_to", up_to).filter(F.col("up_to") >= F.col("k")).groupBy(key, "k").agg(F.min("v").alias("value"))


def medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, median: the exact median, of an even number of values the mean of the middle two."""
    sizes = rows.groupBy(key).agg(F.count(value).alias("n"))
    middle = F.explode(F.array_distinct(F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1))).alias("k")
    got = selected(rows, sizes.select(key, "n", middle), key, value)
    return sizes.join(got.groupBy(key).agg(F.avg("value").alias("median")), key, "left")


def conformal(rows: DataFrame, key: str, value: str, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """key, n, k, bound: the exact k-th smallest value of each key, infinite where the sample is too small."""
    sizes = rows.groupBy(key).agg(F.count(value).alias("n")).withColumn("k", tolerance_index_of(F.col("n"), alpha, delta))
    bound = selected(rows, sizes, key, value).select(key, F.col("value").alias("bound"))
    return sizes.join(bound, key, "left").select(key, "n", "k", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))


def mean_bounds(rows: DataFrame, key: str, value: str, delta: float = 0.05, top: float = 1.0) -> DataFrame:
    """key, n, mean, bernstein, hoeffding: upper bounds on the mean of a value between 0 and `top`."""
    log2, log1 = math.log(2 / delta), math.log(1 / delta)
    s = rows.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))
    n, mean, wide = F.col("n"), F.col("mean"), F.lit(float(top))
    bernstein = F.when(n == 0, F.lit(float("inf"))).when(n == 1, F.least(wide, mean + top * math.sqrt(log2 / 2))).otherwise(F.least(wide, mean + F.sqrt(2 * F.col("var") * log2 / n) + 7 * top * log2 / (3 * (n - 1))))
    hoeffding = F.when(n == 0, F.lit(float("inf"))).otherwise(F.least(wide, mean + top * F.sqrt(F.lit(log1) / (2 * n))))
    return s.select(key, "n", "mean", bernstein.alias("bernstein"), hoeffding.alias("hoeffding"))


def value_of(bounds: Column, statistic: str) -> Column:
    """A bound out of a map of them; one that is not there is an error."""
    return F.when(F.map_contains_key(bounds, statistic), F.try_element_at(bounds, F.lit(statistic))).otherwise(F.raise_error(F.lit(f"no bound of {statistic}")))


def holds(measured: Column, bound: Column) -> Column:
    """Whether a measurement is within a bound, but for rounding."""
    return measured <= bound + 1e-9


#: Code of each ground on which a token is refused; the first that holds counts.
REASONS = ("too_few_measurements", "no_kl_bound", "kl_above", "tv_above", "offcontext_above", "no_emission_bound", "emission_above")


def decision(n: Column, kl: Column, tv: Column, off: Column, emit: Column, *, least_n: int, max_kl: float, max_tv: float, max_off: float, max_emit: float, input_only: bool = False, require_emission: bool = True) -> Column:
    """The reason for refusal, null if accepted. Infinite or null bounds are no evidence."""
    inf = F.lit(float("inf"))
    out = F.when(n < least_n, REASONS[0]).when(kl.isNull() | (kl == inf), REASONS[1]).when(kl > max_kl, REASONS[2]).when(tv > max_tv, REASONS[3]).when(off > max_off, REASONS[4])
    if not input_only:
        if require_emission:
            out = out.when(emit == inf, REASONS[5])
        out = out.when((emit != inf) & (emit > max_emit), REASONS[6])
    return out


def coverage(bounds: DataFrame, fresh: DataFrame, key: str, value: str, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """key, bound, fraction, n, upper_ci, violated: the share of fresh values within each finite bound; keys with two values or more."""
    got = fresh.join(bounds.filter(F.col("bound") < float("inf")).select(key, "bound"), key).groupBy(key, "bound").agg(F.avg((F.col(value) <= F.col("bound") + 1e-12).cast("double")).alias("fraction"), F.count("*").alias("n")).filter("n >= 2")
    f, n = F.col("fraction"), F.col("n")
    upper = F.least(F.lit(1.0), f + 2.326 * F.sqrt(F.greatest(F.lit(0.0), f * (1 - f)) / n) + F.lit(0.5) / n)
    return got.withColumn("upper_ci", upper).withColumn("violated", F.col("upper_ci") < 1 - alpha).withColumn("target", F.lit(1 - alpha)).withColumn("delta", F.lit(delta))


def verdict(covered: DataFrame) -> DataFrame:
    """One row: whether the bounds that fail are no more than their confidence allows."""
    s = covered.agg(F.count("*").alias("n_checked"), F.count_if(F.col("violated")).alias("n_violated"), F.coalesce(F.avg("delta"), F.lit(0.0)).alias("allowed"), F.coalesce(F.avg("fraction"), F.lit(float("nan"))).alias("mean_coverage"), F.coalesce(F.avg("target"), F.lit(float("nan"))).alias("mean_target"))
    n, p = F.greatest(F.lit(1), "n_checked"), F.col("allowed")
    allowance = p + 2.326 * F.sqrt(F.greatest(p * (1 - p), F.lit(1e-6)) / n) + F.lit(1.0) / n
    return s.select("n_checked", "n_violated", (F.col("n_violated") / n).alias("violation_rate"), allowance.alias("allowance"), "mean_coverage", "mean_target", (F.col("n_violated") / n <= allowance).alias("ok"))
