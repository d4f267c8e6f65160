"""Formulas of training and its data as Columns: losses, labels, schedules, gates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrays as A
from .text import let


def clamped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def mean(x: Column) -> Column:
    """Mean of an array; null if it is empty."""
    return F.try_divide(A.total(x), F.size(x))


def magnitude_mask(x: Column, density: float) -> Column:
    """1 at the max(1, round(n density)) places of largest magnitude (equal ones: the first), 0 elsewhere; all 0 without density."""
    if density <= 0:
        return F.transform(x, lambda v: F.lit(0.0))
    n = F.least(F.greatest(F.lit(1), F.bround(F.size(x) * F.lit(density)).cast("int")), F.size(x))
    order = F.array_sort(F.transform(x, lambda v, k: F.struct((-F.abs(v)).alias("m"), k.alias("k"))))
    return let(F.transform(F.slice(order, F.lit(1), n), lambda p: p["k"]), lambda kept: F.transform(x, lambda v, k: F.array_contains(kept, k).cast("double")))


def int8_rounded(x: Column) -> Column:
    """The array after a trip through int8 codes."""
    return let(A.int8_scale(x), lambda s: F.transform(A.int8_codes(x, s), lambda c: c * s))


def deliberation_level(confidence: Column, failure: Column, complexity: Column, levels: int, override: Column | None = None) -> Column:
    """How long to think: more with doubt and complexity; a requested level goes before."""
    sure = 1.0 - ((1.0 - clamped(confidence)) + clamped(failure)) / 2.0
    level = clamped(F.bround((levels - 1) * (1.0 - sure) * clamped(complexity)), 0, levels - 1).cast("int")
    return level if override is None else F.coalesce(override, level)


def soft_penalty(logits: Column, score: Column, bias: Column, threshold: float, strength: float) -> Column:
    """Logits less a bias, as far as the score falls short of the threshold."""
    short = F.greatest(F.lit(threshold) - score, F.lit(0.0)) * F.lit(strength)
    return F.zip_with(logits, bias, lambda x, b: x - short * b)


def one_minus_cosine(a: Column, b: Column) -> Column:
    """1 - cosine, whose norms count as 1e-8 at least."""
    return 1.0 - A.cosine(a, b)


def sampling_weights(logits: Column, temperature: float, top_k: int | None = None) -> Column:
    """What a token is drawn by: softmax of the scaled logits, of the ``top_k`` largest only; without temperature all weight is on the first largest."""
    if temperature <= 0:
        return let(F.array_position(logits, F.array_max(logits)), lambda at: F.transform(logits, lambda v, k: (k + 1 == at).cast("double")))
    scaled = F.transform(logits, lambda v: v / F.lit(temperature))
    return let(scaled, lambda x: A.softmax(x) if top_k is None else A.topk_softmax(x, top_k))


def log_sum_exp(x: Column) -> Column:
    return let(F.array_max(x), lambda top: top + F.ln(A.total(F.transform(x, lambda v: F.exp(v - top)))))


def cross_entropy(logits: Column, label: Column) -> Column:
    """-log softmax of the label (from 0)."""
    return log_sum_exp(logits) - F.element_at(logits, label + 1)


def shifted_losses(logits: Column, labels: Column) -> Column:
    """At each place but the last the cross entropy of the next label."""
    places = F.sequence(F.lit(1), F.size(labels) - 1)
    return F.when(F.size(labels) < 2, F.expr("cast(array() as array<double>)")).otherwise(F.transform(places, lambda k: cross_entropy(F.element_at(logits, k), F.element_at(labels, k + 1))))


def binary_cross_entropy(p: Column, target: Column) -> Column:
    """Of one probability; those near 0 and 1 count as 1e-6 from them."""
    q = clamped(p, 1e-6, 1 - 1e-6)
    return -(target * F.ln(q) + (1 - target) * F.ln(1 - q))


def binary_cross_entropy_of_logit(x: Column, target: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) - x * target + F.log1p(F.exp(-F.abs(x)))


def squared_error(a: Column, b: Column) -> Column:
    return mean(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def divergence(p: Column, q: Column) -> Column:
    """Kullback-Leibler divergence of q from p, two arrays of probabilities; places where p is 0 add nothing."""
    return A.total(F.zip_with(p, q, lambda x, y: F.when(x > 0, x * (F.ln(x) - F.ln(y))).otherwise(F.lit(0.0))))


def coefficient_entropy(p: Column) -> Column:
    """-sum p ln p, where p counts as 1e-8 at least."""
    return -A.total(F.transform(p, lambda v: F.greatest(v, F.lit(1e-8)) * F.ln(F.greatest(v, F.lit(1e-8)))))


def warmup_cosine(step: Column, warmup: int, total: int, least: float = 0.1) -> Column:
    """Share of the full learning rate at a step: up in a line, then down along a cosine to ``least``."""
    warmup = max(1, warmup)
    total = max(warmup + 1, total)
    done = (step - warmup) / F.lit(float(max(1, total - warmup)))
    return F.when(step <= warmup, step / F.lit(float(warmup))).otherwise(F.lit(least) + F.lit((1 - least) * 0.5) * (1 + F.cos(F.lit(math.pi) * done)))


def supervised(explicit: Column, hot: Column, teacher: Column, n: Column, least_hot: float = 3.0, most_teacher: float = 1.0, margin: float = 1.0) -> tuple[Column, Column]:
    """(labels, mask) of n tokens by precedence: given labels, clamped, where they are 0 or more; else what both losses say; else null."""
    ok = lambda v: v.isNotNull() & ~F.isnan(v)
    given = A.fit_length(explicit, n, F.lit(-1.0))
    lost = F.lit(float("nan"))
    pairs = F.arrays_zip(A.fit_length(hot, n, lost).alias("h"), A.fit_length(teacher, n, lost).alias("t"))
    needs = F.transform(pairs, lambda p: F.when(ok(p["h"]) & ok(p["t"]), ((p["h"] >= least_hot) & (p["t"] <= most_teacher) & (p["h"] - p["t"] >= margin)).cast("double")).otherwise(F.lit(0.0)))
    known = F.transform(pairs, lambda p: ok(p["h"]) & ok(p["t"]))
    both = hot.isNotNull() & teacher.isNotNull()
    labels = F.when(explicit.isNotNull(), F.transform(given, lambda v: F.when(ok(v), clamped(v)).otherwise(F.lit(0.0)))).when(both, needs)
    mask = F.when(explicit.isNotNull(), F.transform(given, lambda v: ok(v) & (v >= 0))).when(both, known)
    return labels, mask


def expectations(rules: list[tuple[str | Column, Column]]) -> Column:
    """The messages of all rules that a row breaks, in their order: (message, broken)."""
    said = [F.when(broken, F.lit(m) if isinstance(m, str) else m) for m, broken in rules]
    return F.filter(F.array(*said), lambda m: m.isNotNull())
