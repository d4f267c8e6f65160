"""Quality classifier: a sparse rule ensemble over document statistics.

Shallow trees are boosted on labelled documents; each path from a root to an
inner or outer node is a conjunctive rule.  A lasso logistic regression keeps
few of the rules, and those compile into one Spark column, so that scoring
runs in the JVM, with no Python and no shuffle.

Defined results: a null text counts as empty; an empty text has the statistics
of one empty word and one empty line and gets the score of that point; a very
long text is scored whole; a score of just THRESHOLD is accepted; without
labels (or with labels of one class only) every score is the smoothed share of
label 1, or 0.5.  An empty table gives no rows.  Repeated rows are scored each,
and fitted on once (the one of least statistics).  Several labels of one
document count as their minimum.  Extra columns, whatever their names, pass
through ``score_documents`` and ``keep_good`` untouched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_fold, text_or_empty

#: At most so many labelled documents are fitted on (those of smallest hash).
MAX_TRAIN_ROWS = 20_000
THRESHOLD = 0.3
_TEXT, _WORDS, _LINES = "__q_text", "__q_words", "__q_lines"


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def _without(chars: str) -> Column:
    """Characters of the text that are in the class ``chars``."""
    return F.length(_TEXT) - F.length(F.regexp_replace(_TEXT, f"[{chars}]++", ""))


def _literal(char: str) -> Column:
    return F.length(_TEXT) - F.length(F.replace(F.col(_TEXT), F.lit(char), F.lit("")))


def statistics() -> dict[str, Column]:
    """The statistics the rules speak of, over the helper columns of ``with_statistics``."""
    n, words, lines = F.length(_TEXT), F.size(_WORDS), F.size(_LINES)  # of an empty text: one empty word, one empty line
    return {
        "n_words": words.cast("double"),
        "word_length": _share(n, words),
        "distinct_words": _share(F.size(F.array_distinct(_WORDS)), words),
        "distinct_lines": _share(F.size(F.array_distinct(_LINES)), lines),
        "line_length": _share(n, lines),
        "upper": _share(_without("\\p{Lu}"), n),
        "letters": _share(_without("\\p{L}"), n),
        "digits": _share(_without("0-9"), n),
        "exclaim": _share(_literal("!"), n),
        "bars": _share(_literal("|"), n),
        "stops": _share(_literal("."), words),
    }


FEATURES = tuple(f"__q_f_{k}" for k in (
    "n_words", "word_length", "distinct_words", "distinct_lines", "line_length",
    "upper", "letters", "digits", "exclaim", "bars", "stops",
))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and its statistics, in columns named by FEATURES."""
    out = docs.withColumn(_TEXT, text_or_empty(text))
    out = out.withColumns({
        _WORDS: F.split(_TEXT, " "),  # by one literal character: no regular expression runs
        _LINES: F.split(_TEXT, "\n"),
    })
    return out.withColumns({f"__q_f_{k}": v for k, v in statistics().items()}).drop(_TEXT, _WORDS, _LINES)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, above?, limit), each true where the value is above (or not above) the limit."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, limit in self.terms:
            out &= (x[:, f] > limit) == above
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for f, above, limit in self.terms:
            c = F.col(FEATURES[f])
            out = out & (c > F.lit(limit) if above else c <= F.lit(limit))
        return out


@dataclass
class RuleModel:
    intercept: float
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for r, w in zip(self.rules, self.weights, strict=True):
            z += w * r.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        """The score as a Spark column over FEATURES."""
        z = F.lit(float(self.intercept))
        for r, w in zip(self.rules, self.weights, strict=True):
            z = z + F.when(r.column(), F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _grow(bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, n_bins: int, least: int, ridge: float):
    """A regression tree on binned features, as a list of (terms, row mask, value) over all its nodes but the root."""
    nodes = []

    def split(mask: np.ndarray, terms: tuple, level: int) -> None:
        g, h = grad[mask], hess[mask]
        best = None
        if level < depth and mask.sum() >= 2 * least:
            total_g, total_h = g.sum(), h.sum()
            for f in range(bins.shape[1]):
                b = bins[mask, f]
                cg = np.cumsum(np.bincount(b, g, n_bins))[:-1]
                ch = np.cumsum(np.bincount(b, h, n_bins))[:-1]
                cn = np.cumsum(np.bincount(b, minlength=n_bins))[:-1]
                ok = (cn >= least) & (len(b) - cn >= least)
                gain = np.where(ok, cg**2 / (ch + ridge) + (total_g - cg) ** 2 / (total_h - ch + ridge), -np.inf)
                k = int(gain.argmax())
                if np.isfinite(gain[k]) and (best is None or gain[k] > best[0] + 1e-12):
                    best = (gain[k], f, k)
            if best and best[0] <= total_g**2 / (total_h + ridge) + 1e-9:
                best = None
        nodes.append((terms, mask, -g.sum() / (h.sum() + ridge), best is None))
        if best:
            _, f, k = best
            low = mask & (bins[:, f] <= k)
            split(low, (*terms, (f, False, k)), level + 1)
            split(mask & ~low, (*terms, (f, True, k)), level + 1)

    split(np.ones(len(grad), bool), (), 0)
    return nodes


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 25, depth: int = 3, rate: float = 0.3, n_bins: int = 64, penalty: float = 5e-4, most_rules: int = 48, steps: int = 400) -> RuleModel:
    """Extract rules from boosted trees and weigh them by a lasso logistic regression (accelerated proximal gradient).

    The penalty grows from ``penalty`` until at most ``most_rules`` have a weight; the weights are the lasso's own.
    """
    n = len(y)
    if n == 0:
        return RuleModel(0.0)
    share = (y.sum() + 0.5) / (n + 1)
    base = math.log(share / (1 - share))
    if y.min() == y.max():
        return RuleModel(base)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, n_bins + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    z, found = np.full(n, base), {}
    least = max(3, n // 2000)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        for terms, mask, value, leaf in _grow(bins, p - y, p * (1 - p), depth, n_bins, least, 1.0):
            if leaf:
                z = z + rate * value * mask
            if terms:
                real = {}  # of several limits on one side of a feature only the tightest matters
                for f, above, k in terms:
                    real[f, above] = edges[f][k] if (f, above) not in real else (max if above else min)(real[f, above], edges[f][k])
                found.setdefault(Rule(tuple((f, above, float(v)) for (f, above), v in sorted(real.items()))), None)
    rules = list(found)
    a = np.stack([r.holds(x) for r in rules], axis=1).astype(float)
    spread = np.maximum(a.std(axis=0), 1e-9)
    keep = spread > 1e-6
    rules, a, spread = [r for r, k in zip(rules, keep, strict=True) if k], a[:, keep], spread[keep]
    a = (a - (mean := a.mean(axis=0))) / spread
    lipschitz = 0.25 * np.linalg.norm(a.T @ a, 2) / n + 0.25
    w, b = np.zeros(a.shape[1]), base
    for level in (penalty * 1.5**k for k in range(9)):
        v, c, t = w.copy(), b, 1.0
        for _ in range(steps):
            r = 1 / (1 + np.exp(-(a @ v + c))) - y
            w2 = v - a.T @ r / n / lipschitz
            w2 = np.sign(w2) * np.maximum(np.abs(w2) - level / lipschitz, 0)
            b2 = c - r.mean() / lipschitz
            t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
            v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
            w, b, t = w2, b2, t2
        if np.count_nonzero(w) <= most_rules:
            break
    kept = np.flatnonzero(w)
    own = w[kept] / spread[kept]
    return RuleModel(float(b - own @ mean[kept]), [rules[k] for k in kept], [float(v) for v in own])


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_TRAIN_ROWS, **options) -> RuleModel:
    """Fit on at most ``max_rows`` labelled documents outside of the held-out fold (crc32 of the id, modulo 5, is 0)."""
    rows = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold("doc_id", 5, 0))
        .groupBy("doc_id").agg(F.min("quality").alias("__q_y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    # max_rows rows of two numbers: small enough to broadcast at any size of the tables
    sample = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
    # one row an id, however often the table repeats it
    one = with_statistics(sample).groupBy("doc_id", "__q_y").agg(F.min(F.struct(*FEATURES)).alias("__q_x"))
    got = one.select("doc_id", "__q_y", "__q_x.*").toPandas().sort_values("doc_id")
    return fit(got[list(FEATURES)].to_numpy(float), (got["__q_y"].to_numpy() != 0).astype(float), **options)


def score_documents(docs: DataFrame, model: RuleModel, *, score: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with the column ``score``; a column of that name is replaced."""
    return with_statistics(docs, text).withColumn(score, model.column()).drop(*FEATURES)


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = train(docs, labels, **options)
    return score_documents(docs.select("doc_id", "text"), model).select(
        "doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the classifier doesn't reject, with their own columns."""
    model = train(docs, labels, **options)
    scored = score_documents(docs, model, score="__q_score")
    # a plain filter would be pushed below the statistics, and then every rule would compute its own; a generator stays above them
    kept = scored.withColumn("__q_kept", F.explode(F.when(F.col("__q_score") >= THRESHOLD, F.array(F.lit(1))).otherwise(F.expr("cast(array() as array<int>)"))))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
