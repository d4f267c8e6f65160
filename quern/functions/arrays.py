"""Numeric array kernels as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def rounded(x: Column, places: int) -> Column:
    """Rounded half away from zero; what rounds to zero keeps its sign, as in IEEE arithmetic, where Spark's round drops it."""
    return F.round(F.abs(x), places) * F.signum(x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the common length; norms count as 1e-8 at least."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-8)) * F.greatest(norm(b), F.lit(1e-8)))


def int4_scale(x: Column) -> Column:
    return F.greatest(F.array_max(F.transform(x, lambda v: F.abs(v))), F.lit(1e-8)) / 7


def int4_codes(x: Column, scale: Column) -> Column:
    """Codes 0 to 15: rounded half to even, clamped to -8..7, plus 8."""
    return F.transform(x, lambda v: (F.greatest(F.lit(-8.0), F.least(F.lit(7.0), F.bround(v / scale))) + 8).cast("int"))


def pack_nibbles(codes: Column) -> Column:
    """Two codes a byte, the first in the low half; an odd last code gets a 0 above it."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(codes) + 1) / 2).cast("int") - 1)
    return F.transform(pairs, lambda k: F.element_at(codes, k * 2 + 1) + F.coalesce(F.try_element_at(codes, k * 2 + 2), F.lit(0)) * 16)


def unpack_nibbles(packed: Column, n: Column) -> Column:
    return F.slice(F.flatten(F.transform(packed, lambda b: F.array(b % 16, F.floor(b / 16).cast("int")))), F.lit(1), n)


def int8_scale(x: Column) -> Column:
    return F.greatest(F.array_max(F.transform(x, lambda v: F.abs(v))), F.lit(1e-8)) / 127


def int8_codes(x: Column, scale: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.bround(v / scale))).cast("int"))


def softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / total(e))


def topk_softmax(x: Column, k: int) -> Column:
    """Softmax over the k largest, zeros elsewhere."""
    least = F.element_at(F.sort_array(x, False), F.least(F.lit(k), F.size(x)))
    top = F.array_max(x)
    mass = total(F.transform(F.filter(x, lambda v: v >= least), lambda v: F.exp(v - top)))
    return F.transform(x, lambda v: F.when(v >= least, F.exp(v - top) / mass).otherwise(F.lit(0.0)))


def sigmoid(v: Column) -> Column:
    return 1 / (1 + F.exp(-v))


def active_ranks(logits: Column) -> Column:
    return F.greatest(F.size(F.filter(logits, lambda v: sigmoid(v) >= 0.5)), F.lit(1))


def masked_mean(x: Column, mask: Column) -> Column:
    return dot(x, mask) / F.greatest(total(mask), F.lit(1.0))


def normalized_entropy(p: Column) -> Column:
    h = -total(F.transform(p, lambda v: F.when(v > 0, v * F.ln(v)).otherwise(F.lit(0.0))))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), h / F.ln(F.greatest(F.size(p), F.lit(2)))))


def ema_of_evicted(x: Column, window: int, decay: float) -> Column:
    """What a sliding window of the last ``window`` values keeps of those before: s = decay s + (1 - decay) v."""
    old = F.slice(x, F.lit(1), F.greatest(F.size(x) - window, F.lit(0)))
    return F.aggregate(old, F.lit(0.0), lambda s, v: s * decay + v * (1 - decay))


def survival(conf: Column) -> Column:
    """Running product of clamped confidences."""
    step = lambda s, c: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(1.0)) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))))
    return F.aggregate(conf, F.expr("cast(array() as array<double>)"), step)


def verify_length(conf: Column, load: Column, low: float, high: float, least: int = 1) -> Column:
    """How many drafted tokens to verify: survivors above a threshold that rises with the load."""
    bar = F.lit(low) + (F.lit(high) - F.lit(low)) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), load))
    return F.greatest(F.lit(least), F.least(F.size(conf) - 1, F.size(F.filter(survival(conf), lambda s: s >= bar))))


def accepted_prefix(draft: Column, target: Column) -> Column:
    """Length of the common prefix."""
    first = F.array_position(F.zip_with(draft, target, lambda a, b: F.when(a.eqNullSafe(b), 0).otherwise(1)), 1)
    return F.when(first == 0, F.size(draft)).otherwise(first - 1).cast("int")


def fit_length(x: Column, n: Column, fill: Column) -> Column:
    """Cut or pad to n."""
    return F.slice(F.concat(x, F.array_repeat(fill, F.greatest(n - F.size(x), F.lit(0)))), F.lit(1), n)
