"""Arithmetic over arrays of doubles, and learning-rate schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def argmax(a: Column | str) -> Column:
    """0-based index of the largest element, the first of equal ones; null for an empty or null array."""
    return F.nullif(F.array_position(col(a), F.array_max(col(a))), F.lit(0)) - 1


def let(value: Column, body) -> Column:
    """body(value) with the (double) value computed once, also where body uses it inside a lambda."""
    return F.aggregate(F.array(value.cast("double")), F.lit(0.0), lambda _, v: v, body)


def softmax(a: Column | str) -> Column:
    a = col(a)
    exps = let(F.array_max(a), lambda m: F.transform(a, lambda x: F.exp(x - m)))
    return let(total(exps), lambda s: F.transform(exps, lambda x: x / s))


def log_sum_exp(a: Column) -> Column:
    return let(F.array_max(a), lambda m: m + F.log(total(F.transform(a, lambda x: F.exp(x - m)))))


def cross_entropy(logits: Column, label: Column) -> Column:
    return log_sum_exp(logits) - F.get(logits, label)


def layer_norm(a: Column | str, eps: float = 1e-12) -> Column:
    """(x - mean) / sqrt(population variance + eps)."""
    a = col(a)
    n = F.size(a)
    centered = let(total(a) / n, lambda mean: F.transform(a, lambda x: x - mean))
    return let(F.sqrt(total(F.transform(centered, lambda x: x * x)) / n + eps), lambda sd: F.transform(centered, lambda x: x / sd))


def warmup(batch: Column, batches: float, start: float) -> Column:
    return F.when(batch >= batches, 1.0).otherwise(start + (1.0 - start) * batch / batches)


def masked_mean(loss: Column, mask: Column) -> Column:
    """The mean loss of the positions whose mask is 1, as an aggregate; null if there is none."""
    return F.sum(F.when(mask == 1, loss)) / F.nullif(F.sum(F.when(mask == 1, 1).otherwise(0)), F.lit(0))


def eden(base: float, batch: Column, epoch: Column, lr_batches: float, lr_epochs: float, warm: float = 500.0, start: float = 0.5) -> Column:
    b = F.pow((batch * batch + lr_batches**2) / lr_batches**2, F.lit(-0.25))
    e = F.pow((epoch * epoch + lr_epochs**2) / lr_epochs**2, F.lit(-0.25))
    return F.lit(base) * b * e * warmup(batch, warm, start)


def eden2(base: float, batch: Column, lr_batches: float, warm: float = 500.0, start: float = 0.5) -> Column:
    return F.lit(base) * F.pow((batch * batch + lr_batches**2) / lr_batches**2, F.lit(-0.5)) * warmup(batch, warm, start)
