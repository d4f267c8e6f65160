"""The k-th row in an order, found by counting: no sort of the table, and no task that holds the first k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A histogram's bins, and the rows among which the k-th is at last looked for by sorting.
BINS, SMALL = 1000, 10_000


def _quoted(k: int) -> str:
    return f"_o{k}"


def boundary(rows: DataFrame, order: list[Column], k: int) -> tuple | None:
    """The values of ``order`` of the k-th row (from 1) in rising order; null if there are fewer.  Nulls come first.

    Each pass counts what is left by bins of the first column that still
    varies (equal parts of its range for numbers, the next character for
    strings) and goes on with the bin that holds the k-th row, until few rows,
    or rows that agree in all columns, are left.
    """
    left = rows.select(*[c.alias(_quoted(i)) for i, c in enumerate(order)])
    kinds = [t for _, t in left.dtypes]
    if k < 1 or left.count() < k:
        return None
    found: list = []
    for i, kind in enumerate(kinds):
        c = F.col(_quoted(i))
        missing = left.where(c.isNull()).count()
        if k <= missing:
            found.append(None)
            left = left.where(c.isNull())
            continue
        k, left = k - missing, left.where(c.isNotNull())
        shown = 1  # characters of a string that are looked at
        while True:
            span = left.agg(F.min(c), F.max(c), F.count("*")).first()
            low, high, n = span
            if n <= SMALL:
                rest = [F.col(_quoted(j)) for j in range(i, len(kinds))]
                return (*found, *left.select(*rest).orderBy(*rest).limit(k).collect()[-1])
            if low == high:
                break
            # a bin's least and largest value bound it, whatever rounding did to its edges
            place = F.substring(c, 1, shown) if kind == "string" else F.least(F.floor((c.cast("double") - F.lit(float(low))) / F.lit(float(high) - float(low)) * BINS), F.lit(BINS - 1))
            bins = sorted(left.groupBy(place.alias("b")).agg(F.min(c).alias("low"), F.max(c).alias("high"), F.count("*").alias("n")).collect(), key=lambda r: r["low"])
            for b in bins:
                if k <= b["n"]:
                    break
                k -= b["n"]
            left, shown = left.where(c.between(b["low"], b["high"])), shown + 1
        found.append(low)
    return tuple(found)


def up_to(order: list[Column], last: tuple) -> Column:
    """Whether a row comes no later than ``last`` (of ``boundary``) in the order."""
    out = F.lit(True)
    for c, v in reversed(list(zip(order, last, strict=True))):
        same, before = (c.isNull(), F.lit(False)) if v is None else (c.eqNullSafe(F.lit(v)), c.isNull() | (c < F.lit(v)))
        out = before | (same & out)
    return F.coalesce(out, F.lit(False))


def first_rows(rows: DataFrame, order: list[Column], k: int) -> Column:
    """Whether a row is one of the first k in the order, or agrees with the k-th in all of it."""
    if k < 1:
        return F.lit(False)
    last = boundary(rows, order, k)
    return F.lit(True) if last is None else up_to(order, last)
