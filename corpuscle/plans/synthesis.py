"""Rows for new tokens, fitted to what the model does with their runs, and the drift that they leave.

A token is judged where it can be told from its run: at the read-out (the position after the run) and
at each position of what follows. Fitting, measuring and certifying run in Arrow batches, a group for
each token, over broadcast weights of a fixed shape.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.drift import kl_from_linf, linf_from_hidden
from corpuscle.operators import bounds
from corpuscle.plans.model import Decoder, log_softmax, log_total

#: Weights of the positions that a row is fitted at: the read-out counts twice.
READOUT, SUFFIX = 2.0, 1.0
#: Rows of the vocabulary that its mean norm and its directions are taken from.
NORM_ROWS, DIRECTION_ROWS = 20_000, 8_192
STATISTICS = ("kl", "tv", "linf", "l2")


@dataclass(frozen=True)
class Config:
    composition: str = "inverse_frequency"
    matched: bool = True
    solver: str = "gauss_newton"
    q: int = 8
    rounds: int = 2
    layers: int = 2
    refine_steps: int = 0
    refine_rate: float = 0.02


#: Baselines: the mean row as it is, and scaled to the vocabulary's mean norm.
ZERO_SHOT = Config(composition="mean", matched=False, solver="none")
NORM_MATCHED = Config(composition="mean", matched=True, solver="none")


def weights(ids: list[int], how: str, counts: dict[int, int] | None = None, a: float = 1e-4) -> np.ndarray:
    """Of a run's tokens in its composed row."""
    n = len(ids)
    if how == "sum":
        return np.ones(n)
    if how == "first":
        return np.eye(1, n)[0]
    if how == "inverse_frequency" and counts:
        total = max(1, sum(counts.values()))
        w = np.array([a / (a + counts.get(i, 0) / total) for i in ids])
        return w / w.sum()
    return np.full(n, 1 / n)


def mean_norm(model: Decoder) -> float:
    return float(np.linalg.norm(model.embed[:NORM_ROWS], axis=1).mean())


def composed(model: Decoder, ids: list[int], config: Config = Config(), counts: dict[int, int] | None = None) -> np.ndarray:
    row = weights(ids, config.composition, counts) @ model.rows(ids)
    size = np.linalg.norm(row)
    return row * mean_norm(model) / size if config.matched and size > 0 else row


def directions(model: Decoder, q: int) -> np.ndarray:
    """The first q principal directions of the vocabulary's rows."""
    rows = model.embed[:DIRECTION_ROWS]
    return np.linalg.svd(rows - rows.mean(0), full_matrices=False)[2][:q]


def basis(model: Decoder, ids: list[int], q: int, seed: int = 0) -> np.ndarray:
    """d x q, orthonormal: the run's rows, the mean row, principal directions, then random ones."""
    d = model.shape.d
    q = min(q, d)
    extra = np.random.default_rng(seed).normal(size=(q, d))
    return np.linalg.qr(np.concatenate((model.rows(ids), model.embed.mean(0)[None], directions(model, q), extra)).T)[0][:, :q]


def picked_layers(layers: int, n: int) -> list[int]:
    """n layers, evenly spaced, the last among them."""
    n = max(1, min(n, layers))
    return sorted({layers - 1 - (k * layers) // n for k in range(n)})


def aligned(prefix: int, run: int, suffix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the read-out and the suffix in the sequence with the run and in that with its row, and their weights."""
    after = np.arange(suffix + 1)
    return prefix + run - 1 + after, prefix + after, np.where(after == 0, READOUT, SUFFIX)


def emission(model: Decoder, z: np.ndarray, ids: list[int]) -> float:
    """Logit that gives a token the probability of its run; z: logits at the positions before the run's ids."""
    s = min(float(log_softmax(z)[np.arange(len(ids)), ids].sum()), -1e-4)
    return s + log_total(z[0]) - float(np.log1p(-np.exp(s)))


@dataclass
class Targets:
    states: list[list[np.ndarray]]  # of each context, at each layer: aligned positions x d
    weight: list[np.ndarray]
    hidden: np.ndarray  # states before the run, of the contexts with a prefix
    wanted: np.ndarray  # and the logits that their token should have there


def targets(model: Decoder, ids: list[int], contexts: list[tuple[list[int], list[int]]], layers: list[int]) -> Targets:
    """One pass over the contexts with the whole run."""
    x, mask = model.padded([model.rows([*p, *ids, *s]) for p, s in contexts])
    z, states = model.trace(x, mask)
    out, weight, hidden, wanted = [], [], [], []
    for k, (p, s) in enumerate(contexts):
        at, _, w = aligned(len(p), len(ids), len(s))
        out.append([states[j][k, at] for j in layers])
        weight.append(w)
        if p:
            before = np.arange(len(ids)) + len(p) - 1
            hidden.append(states[-1][k, before[0]])
            wanted.append(emission(model, z[k, before], ids))
    return Targets(out, weight, np.array(hidden).reshape(-1, model.shape.d), np.array(wanted))


def residual(model: Decoder, row: np.ndarray, contexts: list[tuple[list[int], list[int]]], goal: Targets, layers: list[int]) -> np.ndarray:
    """Weighted differences of the states with the row from those with the run."""
    x, mask = model.padded([np.concatenate((model.rows(p), row[None], model.rows(s))) for p, s in contexts])
    _, states = model.trace(x, mask)
    return np.concatenate([((states[j][k, len(p) : len(p) + 1 + len(s)] - goal.states[k][n]) * np.sqrt(goal.weight[k])[:, None]).ravel() for k, (p, s) in enumerate(contexts) for n, j in enumerate(layers)])


def fit_row(model: Decoder, ids: list[int], contexts: list[tuple[list[int], list[int]]], config: Config = Config(), counts: dict[int, int] | None = None) -> tuple[np.ndarray, float, float, Targets]:
    """The row, the squared residual before and after, and the targets; no step that raises the residual is taken."""
    layers = picked_layers(model.shape.layers, config.layers)
    goal = targets(model, ids, contexts, layers)
    row = composed(model, ids, config, counts)
    r = residual(model, row, contexts, goal, layers)
    before = now = float(r @ r)
    if config.solver == "none":
        return row, before, now, goal
    span, eps = basis(model, ids, config.q), 1e-4
    for _ in range(config.rounds):
        slope = np.stack([(residual(model, row + eps * v, contexts, goal, layers) - r) / eps for v in span.T], 1)
        normal = slope.T @ slope
        step = np.linalg.solve(normal + (1e-3 * np.trace(normal) / len(normal) + 1e-12) * np.eye(len(normal)), -slope.T @ r)
        tried = row + span @ step
        r2 = residual(model, tried, contexts, goal, layers)
        if float(r2 @ r2) >= now:
            break
        row, r, now = tried, r2, float(r2 @ r2)
    best, mean, square = row, np.zeros_like(row), np.zeros_like(row)
    for t in range(1, config.refine_steps + 1):  # Adam over all dimensions, gradients by differences
        slope = np.stack([(residual(model, row + eps * e, contexts, goal, layers) - r) / eps for e in np.eye(len(row))], 1)
        g = 2 * slope.T @ r
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        row = row - config.refine_rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
        r = residual(model, row, contexts, goal, layers)
        if float(r @ r) < now:
            best, now = row, float(r @ r)
    return best, before, now, goal


def fit_output_row(model: Decoder, ids: list[int], goal: Targets, ridge: float = 0.1, trust: float = 1.0) -> np.ndarray:
    """Ridge regression of the wanted logits around the row of the run's first id, which is also the answer of fewer than two contexts."""
    anchor = model.unembed[ids[0]]
    h = goal.hidden
    if len(h) < 2:
        return anchor.copy()
    weight = ridge * (h * h).sum(1).mean() * max(1.0, h.shape[1] / len(h))
    delta = np.linalg.solve(h.T @ h + weight * np.eye(h.shape[1]), h.T @ (goal.wanted - h @ anchor))
    return anchor + delta * min(1.0, trust * np.linalg.norm(anchor) / max(np.linalg.norm(delta), 1e-12))


def drift(model: Decoder, row: np.ndarray, out_row: np.ndarray | None, ids: list[int], p: list[int], s: list[int]) -> list[tuple[int, float, float, float, float, float | None]]:
    """offset, kl, tv, linf, l2 at the read-out (offset 0) and each position of what follows; the first has the error of emission too, if something stands before."""
    z, states = model.trace(model.rows([*p, *ids, *s])[None])
    z2, states2 = model.trace(np.concatenate((model.rows(p), row[None], model.rows(s)))[None])
    at, at2, _ = aligned(len(p), len(ids), len(s))
    lp, lq = log_softmax(z[0, at]), log_softmax(z2[0, at2])
    kl = np.maximum(0, (np.exp(lp) * (lp - lq)).sum(1))
    tv = np.clip(0.5 * np.abs(np.exp(lp) - np.exp(lq)).sum(1), 0, 1)
    linf = np.abs(z[0, at] - z2[0, at2]).max(1)
    a, b = states[-1][0, at], states2[-1][0, at2]
    l2 = np.linalg.norm(a - b, axis=1) / np.maximum(np.linalg.norm(a, axis=1), 1e-6)
    off, w = None, model.effective_output_row(row, out_row)
    if p and w is not None:
        before = np.arange(len(ids)) + len(p) - 1
        s_run = min(float(log_softmax(z[0, before])[np.arange(len(ids)), ids].sum()), -1e-4)
        own = float(states[-1][0, before[0]] @ w)
        off = abs(s_run - (own - float(np.logaddexp(log_total(z[0, before[0]]), own))))
    return [(k, float(kl[k]), float(tv[k]), float(linf[k]), float(l2[k]), off if k == 0 else None) for k in range(len(at))]


MEASURED = "token string, context long, offset int, kl double, tv double, linf double, l2 double, emission double"


def measured(contexts: DataFrame, rows: DataFrame, model: Decoder) -> DataFrame:
    """MEASURED at every position of every context; contexts: token, context (a number), ids, prefix, suffix; rows: token, row, out_row."""
    held = contexts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [
                (t, c, *found)
                for t, c, row, out_row, i, p, s in zip(b["token"], b["context"], b["row"], b["out_row"], b["ids"], b["prefix"], b["suffix"], strict=True)
                for found in drift(held.value, np.asarray(row), None if out_row is None else np.asarray(out_row), list(i), list(p), list(s))
            ]
            yield pd.DataFrame(out, columns=["token", "context", "offset", *STATISTICS, "emission"])

    return contexts.join(rows.select("token", "row", "out_row"), "token").select("token", "context", "row", "out_row", "ids", "prefix", "suffix").mapInPandas(run, MEASURED)


FITTED = "token string, row array<double>, out_row array<double>, before double, after double, n_contexts long"


def fitted(contexts: DataFrame, model: Decoder, config: Config = Config(), counts: dict[int, int] | None = None, most: int = 32) -> DataFrame:
    """FITTED for each token that has a context, from at most `most` of them; contexts: token, ids, prefix, suffix."""
    held = contexts.sparkSession.sparkContext.broadcast(model)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["prefix", "suffix"], key=lambda c: c.map(lambda x: tuple(x))).head(most)
        ids = list(rows["ids"].iloc[0])
        found = [(list(p), list(s)) for p, s in zip(rows["prefix"], rows["suffix"], strict=True) if len(p) or len(s)]
        names = ["token", "row", "out_row", "before", "after", "n_contexts"]
        if not found:
            return pd.DataFrame([], columns=names)
        row, before, after, goal = fit_row(held.value, ids, found, config, counts)
        out = None if held.value.tied else fit_output_row(held.value, ids, goal).tolist()
        return pd.DataFrame([(rows["token"].iloc[0], row.tolist(), out, before, after, len(found))], columns=names)

    return contexts.groupBy("token").applyInPandas(run, FITTED)


def bound_all(drifts: DataFrame, alpha: float, delta: float, model: Decoder, clip: float = 50.0) -> DataFrame:
    """token, statistic, method, value, n, mean, worst, clip_rate: the tolerance limit and the bound of the mean of each statistic, and what the sup norm allows the divergence."""
    long = drifts.select("token", F.explode(F.create_map(*[x for c in (*STATISTICS, "emission") for x in (F.lit(c), F.col(c))])).alias("statistic", "value")).filter("value is not null")
    keyed = long.withColumn("key", F.struct("token", "statistic"))
    facts = keyed.groupBy("key").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("worst"), F.avg((F.col("value") > clip).cast("double")).alias("clip_rate"))
    limits = bounds.conformal(keyed, "key", "value", alpha, delta).select("key", F.lit("conformal").alias("method"), F.col("bound").alias("value"))
    scale = keyed.withColumn("value", F.least(F.lit(clip), "value"))
    means = bounds.mean_bounds(scale, "key", "value", delta, clip).select("key", F.lit("bernstein").alias("method"), F.col("bernstein").alias("value"))
    top = facts.filter("key.statistic = 'linf'").select(F.struct(F.col("key.token").alias("token"), F.lit("kl").alias("statistic")).alias("key"), F.lit("lipschitz").alias("method"), kl_from_linf(F.col("worst")).alias("value"))
    hidden = facts.filter("key.statistic = 'l2'").select(F.struct(F.col("key.token").alias("token"), F.lit("linf").alias("statistic")).alias("key"), F.lit("lipschitz").alias("method"), linf_from_hidden(F.lit(model.row_norm_max), F.col("worst") * float(np.sqrt(model.shape.d))).alias("value"))  # a normalised state has length sqrt(d)
    return limits.unionByName(means).unionByName(top).unionByName(hidden).join(facts, "key").select("key.token", "key.statistic", "method", "value", "n", "mean", "worst", "clip_rate")


def certified(contexts: DataFrame, rows: DataFrame, model: Decoder, off: DataFrame, *, alpha: float, delta: float, least_n: int, max_kl: float, max_tv: float, max_off: float, max_emit: float, input_only: bool = False) -> DataFrame:
    """token, n, kl, tv, off, emission (tolerance limits), contexts_print, accepted, reason.

    off: token, mass, measured where the token does not belong. A token without measurements is refused.
    """
    found = measured(contexts, rows, model)
    limit = lambda df, c: bounds.conformal(df, "token", c, alpha, delta)
    kl = limit(found, "kl").select("token", "n", F.col("bound").alias("kl"))
    tv = limit(found, "tv").select("token", F.col("bound").alias("tv"))
    emit = limit(found.filter("emission is not null"), "emission").select("token", F.col("bound").alias("emission"))
    mass = limit(off, "mass").select("token", F.col("bound").alias("off"))
    prints = contexts.groupBy("token").agg(F.hex(F.bit_xor(F.xxhash64("ids", "prefix", "suffix"))).alias("contexts_print"))
    inf = F.lit(float("inf"))
    both = rows.select("token").join(kl, "token", "left").join(tv, "token", "left").join(emit, "token", "left").join(mass, "token", "left").join(prints, "token", "left")
    filled = both.select("token", F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(c, inf).alias(c) for c in ("kl", "tv", "off", "emission")], "contexts_print")
    reason = bounds.decision(F.col("n"), F.col("kl"), F.col("tv"), F.col("off"), F.col("emission"), least_n=least_n, max_kl=max_kl, max_tv=max_tv, max_off=max_off, max_emit=max_emit, input_only=input_only)
    return filled.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def strided(lines: DataFrame, stride: int, longest: int = 128, most: int = 4096, after: int = 8) -> DataFrame:
    """prefix, following: every stride-th position of the first `longest` bytes of each line, at most `most` in corpus order; lines: doc_id, pos, text."""
    from corpuscle.functions.text import byte_ids

    body = lines.select("doc_id", "pos", F.substring(F.encode("text", "utf-8"), F.lit(1), F.lit(longest)).alias("body"))
    at = body.filter(F.octet_length("body") > 1).select("*", F.explode(F.sequence(F.lit(1), F.octet_length("body") - 1, F.lit(stride))).alias("at"))
    few = at.orderBy("doc_id", "pos", "at").limit(most)
    return few.select(byte_ids(F.substring("body", F.lit(1), F.col("at"))).alias("prefix"), byte_ids(F.substring("body", F.col("at") + 1, F.lit(after))).alias("following"))


def pack_from_tokens(model: Decoder, lang: str, runs: list[tuple[int, ...]], spark, config: Config = ZERO_SHOT) -> DataFrame:  # noqa: ANN001
    """Entries of a pack of fixed runs, each with a composed row and a bound that says that nothing was measured."""
    rows = [(lang, k + 1, bytes(i - 4 for i in run).hex().upper(), 0, True, {"kl": float("inf")}, composed(model, list(run), config).tolist()) for k, run in enumerate(runs)]
    return spark.createDataFrame(rows, "lang string, rank int, gram_hex string, n_occurrences long, accepted boolean, bounds map<string,double>, row array<double>")
