"""Drift between two rows of logits, in array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def less(z: Column, x: Column) -> Column:
    """x taken from each element; x stands outside the lambda, so it is evaluated once a row and not once an element."""
    return F.zip_with(z, F.array_repeat(x, F.size(z)), lambda v, y: v - y)


def log_total(z: Column) -> Column:
    """Log of the sum of exponentials."""
    top = F.array_max(z)
    return F.log(total(F.transform(less(z, top), F.exp))) + top


def log_softmax(z: Column) -> Column:
    return less(z, log_total(z))


def kl(lp: Column, lq: Column) -> Column:
    """Of two rows of log probabilities; rounding cannot make it negative."""
    return F.greatest(F.lit(0.0), total(F.zip_with(lp, lq, lambda p, q: F.exp(p) * (p - q))))


def tv(lp: Column, lq: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 * total(F.zip_with(lp, lq, lambda p, q: F.abs(F.exp(p) - F.exp(q))))))


def linf(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def relative_l2(a: Column, b: Column) -> Column:
    return norm(F.zip_with(a, b, lambda x, y: x - y)) / F.greatest(norm(a), F.lit(1e-6))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def emission_target(s: Column, log_z: Column) -> Column:
    """Logit that gives a new token the probability exp(s) beside a vocabulary with the given log sum."""
    least = F.least(s, F.lit(-1e-4))
    return least + log_z - F.log1p(-F.exp(least))


def kl_from_linf(eps: Column) -> Column:
    """KL is at most twice the sup norm of the logits' difference."""
    return 2 * eps


def linf_from_hidden(row_norm: Column, hidden_l2: Column) -> Column:
    return row_norm * hidden_l2
