"""Tables, fixtures and pieces of SQL shared by the plans."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.lineage import cut
from .derived import Dialect


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that all machines share."""
    base = cut(spark.range(1)).sparkSession.sparkContext.getCheckpointDir()
    return f"{base}/{label}-{uuid.uuid4().hex}"


def literal(x) -> str:
    """A Python value as DuckDB SQL."""
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, float):
        return f"'{x!r}'::DOUBLE"
    if isinstance(x, int):
        return str(x)
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(literal, x)) + "]"
    if isinstance(x, dict):
        return "{" + ", ".join(f"'{k}': {literal(v)}" for k, v in x.items()) + "}"
    return "'" + str(x).replace("'", "''") + "'"


class Fixture:
    """Rows that Spark and the oracle see alike: hand-made ones that reach every branch (nested structs are dicts), and those that ``also`` derives from the given tables."""

    def __init__(self, spark_schema: str, sql_types: list[str], rows: list[tuple], also: Callable[[Dialect], str] | None = None) -> None:
        self.schema, self.types, self.rows, self.also = spark_schema, sql_types, rows, also

    @classmethod
    def over(cls, also: Callable[[Dialect], str], spark_schema: str, sql_types: list[str], rows: list[tuple]) -> Fixture:
        return cls(spark_schema, sql_types, rows, also)

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        made = spark.createDataFrame(self.rows, self.schema)
        if self.also is None:
            return made
        text = self.also(Dialect(True))
        names = sorted(set(re.findall(r"\b(?:FROM|JOIN) (\w+)", text)))
        more = spark.sql(re.sub(r"\b(FROM|JOIN) (\w+)", r"\1 {\2}", text), **{n: table(spark, sf_dir, n) for n in names})
        kinds = [F.col(f"`{f.name}`").cast(f.dataType) for f in made.schema.fields]
        return made.union(more.toDF(*made.columns).select(*kinds))

    def sql(self, name: str) -> str:
        names = [x.split()[0] for x in self._columns()]
        shown = lambda v, t: f"MAP {literal(v)}" if isinstance(v, dict) and t.startswith("MAP") else literal(v)
        body = ", ".join("(" + ", ".join(f"{shown(v, t)}::{t}" for v, t in zip(r, self.types, strict=True)) + ")" for r in self.rows)
        more = "" if self.also is None else f" UNION ALL {self.also(Dialect(False))}"
        return f"{name}({', '.join(names)}) AS (SELECT * FROM (VALUES {body}){more})"

    def _columns(self) -> list[str]:
        out, depth, at = [], 0, 0
        for k, c in enumerate(self.schema + ","):
            depth += (c == "<") - (c == ">")
            if c == "," and depth == 0:
                out.append(self.schema[at:k].strip())
                at = k + 1
        return out


def contains_sql(column: str, terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, {literal(t)})" for t in terms) + ")"


def rlike_sql(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {literal(pattern)})"
