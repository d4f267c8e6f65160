"""Writers: JSON lines with sorted keys, shards by byte budget, resumable file lineage, and the state of an earlier run."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..operators import quota
from .lineage import cut
from .shards import Lock


def sorted_json(rows: DataFrame) -> Column:
    return F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Writes the rows and gives their number, counted while they are written."""
    seen = Observation()
    rows.select(sorted_json(rows).alias("value")).observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).text(path)
    return seen.get["n"]


def write_sharded(rows: DataFrame, path: str, whole: int, budget: dict[str, int], shard_bytes: int, seq: str = "seq", lang: str = "lang") -> DataFrame:
    """Writes what fits both budgets as folders ``shard=0``, ``shard=1`` and so on; gives (lang, verdict, records, bytes).

    Only (seq, lang, bytes) pass through the sequential fold; the texts meet
    their verdicts in a join and are written from all machines.
    """
    lines = rows.select(F.col(seq).alias("seq"), F.col(lang).alias("lang"), sorted_json(rows).alias("value"))
    sizes = lines.select("seq", "lang", (F.octet_length("value") + 1).cast("long").alias("n"))
    verdicts = quota.with_total(sizes, budget, whole, total_first=True)
    placed = quota.shards(verdicts.where("verdict = ''"), shard_bytes)
    lines.join(placed.select("seq", "shard"), "seq").repartition("shard").sortWithinPartitions("shard", "seq").select("shard", "value").write.mode("overwrite").partitionBy("shard").text(path)
    return quota.shard_report(verdicts)


def resume_state(records: DataFrame, samples: int = 25) -> tuple[DataFrame, DataFrame]:
    """Counts of what an earlier run wrote, by language, category and source in one pass, and its first records by ``seq``."""
    entries = F.array(*[F.struct(F.lit(n).alias("part"), F.col(n).alias("key")) for n in ("language", "category", "source")])
    counts = records.select("n_bytes", F.explode(entries).alias("e")).groupBy(F.col("e.part").alias("part"), F.col("e.key").alias("key")).agg(F.count("*").alias("records"), F.sum("n_bytes").alias("bytes"))
    return counts, records.orderBy("seq").limit(samples)


def pending_files(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that no earlier copy, or decision to skip, names."""
    done = manifest.select(F.explode(F.array_union(F.coalesce("copied", F.array().cast("array<string>")), F.coalesce("skipped", F.array().cast("array<string>")))).alias("path")).distinct()
    return found.join(done, "path", "left_anti")


def _path_of(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def copy_pending(found: DataFrame, target: str, manifest: str, first: int = 0, stale: float = 86_400) -> DataFrame:
    """Copy files (path) that no earlier copy into ``target`` names, as shard-00000.jsonl and so on in the order of their runs; gives (source, dest, bytes) of this copy.

    Each file is copied by one task, as it is, and numbered from ``first``.  What
    was copied is appended to the table ``manifest``, so that a second call
    copies nothing; a call that fails before that copies the same again, to
    the same names.  A lock file, which only
    one call can make, keeps two from copying at once; one that was broken off
    is taken over after ``stale`` seconds.  The target is a folder that all
    machines mount.
    """
    spark = found.sparkSession
    folders, root = _path_of(target)
    folders.create_dir(root, recursive=True)
    schema = "source string, dest string, bytes long"
    with Lock(f"{root}/.copying", stale):
        folder, name = _path_of(manifest)
        done = spark.read.schema(schema).parquet(manifest) if folder.get_file_info(name).type.name != "NotFound" else spark.createDataFrame([], schema)
        done = done.select(F.col("source").alias("path"), F.col("dest"))
        number = F.regexp_extract("dest", r"shard-(\d+)\.jsonl$", 1).cast("int")
        last = done.agg(F.max(number)).first()[0]
        start = first if last is None else max(first, last + 1)
        ordered = in_run_order(found.join(done.select("path"), "path", "left_anti")).withColumn("k", F.row_number().over(Window.orderBy("number", "path")))  # names only
        plan = ordered.select(F.col("path").alias("source"), F.concat(F.lit(target.rstrip("/") + "/shard-"), F.lpad((F.col("k") - 1 + start).cast("string"), 5, "0"), F.lit(".jsonl")).alias("dest"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for source, dest in zip(batch["source"], batch["dest"], strict=True):
                    (a, own), (b, to), n = _path_of(source), _path_of(dest), 0
                    with a.open_input_stream(own) as f, b.open_output_stream(to) as g:
                        while piece := f.read(1 << 20):
                            g.write(piece)
                            n += len(piece)
                    yield pd.DataFrame({"source": [source], "dest": [dest], "bytes": [n]})

        copied = cut(plan.repartition(max(1, plan.count()), "source").mapInPandas(run, schema))
        if not copied.isEmpty():
            copied.coalesce(1).write.mode("append").parquet(manifest)
        return copied


def in_run_order(found: DataFrame) -> DataFrame:
    """(path, place): by the number at the end of the run's name, then by name."""
    number = F.coalesce(F.regexp_extract("path", r"(\d+)(?:\.\w+)?$", 1).try_cast("long"), F.lit(-1))
    return found.select("path", number.alias("number")).orderBy("number", "path")


def next_shard(found: DataFrame) -> int:
    """One beyond the largest number of ``shard-00000.jsonl`` names."""
    last = found.agg(F.max(F.regexp_extract("path", r"shard-(\d+)\.jsonl$", 1).try_cast("int")).alias("n")).first()["n"]
    return 0 if last is None else last + 1


def completed(raw: DataFrame, train: DataFrame) -> DataFrame:
    """Ids that both outputs of an earlier run hold."""
    return raw.select("prompt_id").intersect(train.select("prompt_id"))
