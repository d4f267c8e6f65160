"""Reports: counters of a cleaning run, merged run reports, and their Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean_report(judged: DataFrame) -> DataFrame:
    """(metric, key, cnt): seen, accepted, rejected by reason, and categories of accepted rows, in one pass."""
    n = judged.groupBy("reject_reason", "category").agg(F.count("*").alias("n"))
    ok = F.col("reject_reason").isNull()
    entries = F.array(
        F.struct(F.lit("seen").alias("metric"), F.lit("").alias("key")),
        F.when(ok, F.struct(F.lit("accepted").alias("metric"), F.lit("").alias("key"))).otherwise(F.struct(F.lit("rejected").alias("metric"), F.col("reject_reason").alias("key"))),
        F.when(ok, F.struct(F.lit("category").alias("metric"), F.col("category").alias("key"))),
    )
    return n.select("n", F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).groupBy(F.col("e.metric").alias("metric"), F.col("e.key").alias("key")).agg(F.sum("n").alias("cnt"))


def merge_maps(reports: DataFrame, column: str) -> DataFrame:
    """Key-wise sums of a map column over all rows."""
    return reports.select(F.explode(column).alias("key", "n")).groupBy("key").agg(F.sum("n").alias("n"))


def merge_source_stats(reports: DataFrame, column: str = "source_stats") -> DataFrame:
    """Per source: converted and accepted summed; exhausted if any run says so."""
    rows = reports.select(F.explode(column).alias("source", "s"))
    return rows.groupBy("source").agg(F.sum("s.converted").alias("converted"), F.sum("s.accepted").alias("accepted"), F.bool_or("s.exhausted").alias("exhausted"))


#: What every cleaning run holds its rows to.
GATE = (
    "Licenses must be allowlisted.", "Role order must be user/assistant alternating and end with assistant.",
    "PII and secret-like tokens are rejected instead of redacted into training data.", "Exact normalized duplicates are removed.",
)


def quality_markdown(report: DataFrame, train: int, valid: int) -> str:
    """A cleaning run's counters (metric, key, cnt; a few hundred rows) as Markdown, with the gate that all rows passed."""
    counts: dict[str, dict[str, int]] = {}
    for r in report.collect():
        counts.setdefault(r["metric"], {})[r["key"]] = r["cnt"]
    one = lambda metric: counts.get(metric, {}).get("", 0)
    out = ["# Dialogue Corpus Trial Quality Report", "", f"seen={one('seen')} accepted={one('accepted')} train={train} valid={valid}"]
    for title, metric in (("Accepted Categories", "category"), ("Sources", "source"), ("Rejections", "rejected")):
        held = counts.get(metric) or {"none": 0}
        out += ["", f"## {title}", *[f"- {k}: {held[k]}" for k in sorted(held)]]
    return "\n".join([*out, "", "## Quality Gate", *[f"- {g}" for g in GATE]]) + "\n"


def run_report(settings: dict[str, object], metrics: dict[str, float], steps: list[dict[str, float]]) -> str:
    """A training run as Markdown: its settings, its last metrics, and a table of steps, whose columns are those of the first."""
    out = ["# Training report", "", "## Settings", "", *[f"- {k}: {settings[k]}" for k in sorted(settings)], "", "## Metrics", "", *[f"- {k}: {metrics[k]:.4f}" for k in sorted(metrics)]]
    if steps:
        names = list(steps[0])
        out += ["", "## Steps", "", "| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *["| " + " | ".join(f"{s[n]:g}" for n in names) + " |" for s in steps]]
    return "\n".join(out) + "\n"


def due(written: int, every: int, now: float, last: float, least_seconds: float) -> bool:
    """Whether a running report is due: at every so many records, but not sooner than so many seconds after the last."""
    return every > 0 and written > 0 and written % every == 0 and (least_seconds <= 0 or now - last >= least_seconds)


def markdown(title: str, sections: dict[str, dict[str, int]]) -> str:
    """Sections of sorted counters."""
    out = [f"# {title}"]
    for name, counts in sections.items():
        out += ["", f"## {name}", "", *[f"- {k}: {counts[k]}" for k in sorted(counts)]]
    return "\n".join(out) + "\n"
