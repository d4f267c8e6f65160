"""Readers of text, JSON lines, Parquet lists and the source catalog."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BROKEN = "_corrupt_record"


def jsonl(spark: SparkSession, path, schema: str, strict: bool = True) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, a broken line is an error (``strict``) or skipped."""
    if strict:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    held = T._parse_datatype_string(schema).add(_BROKEN, "string")
    # a filter on the broken line alone would read no other column, so the lines are parsed here
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.select("value", F.from_json("value", held, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}).alias("r"))
    return parsed.where(f"r is not null and r.{_BROKEN} is null").select("r.*").drop(_BROKEN)


def training_records(spark: SparkSession, path, schema: str) -> DataFrame:
    """Records of an earlier run with the bytes of their lines (line end included), their file and whether the line was sound.

    Malformed lines and lines that aren't objects don't count.
    """
    held = T._parse_datatype_string(schema).add(_BROKEN, "string")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("shard"))
    parsed = lines.where("trim(value) like '{%'").select("shard", (F.octet_length("value") + 1).cast("long").alias("n_bytes"), F.from_json("value", held, {"columnNameOfCorruptRecord": _BROKEN}).alias("r"))
    return parsed.where(f"r.{_BROKEN} is null").select("shard", "n_bytes", "r.*").drop(_BROKEN)


def corpus_lines(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("txt", "py", "md", "jsonl")) -> DataFrame:
    """(file, line_text) of all files below a folder with these suffixes.

    A JSON line gives its ``text``, else its ``solution``, else ''; a line that
    isn't JSON gives itself.  Lines keep no order across files: number them by
    a key of their own where order matters.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    held = F.from_json("value", f"text string, solution string, {_BROKEN} string", {"columnNameOfCorruptRecord": _BROKEN})
    inner = F.when(F.col("r").isNull() | F.col(f"r.{_BROKEN}").isNotNull(), F.col("value")).otherwise(F.coalesce(F.nullif("r.text", F.lit("")), F.col("r.solution"), F.lit("")))
    return raw.withColumn("r", held).select("file", F.when(F.col("file").endswith(".jsonl"), inner).otherwise(F.col("value")).alias("line_text"))


def whole_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, record): one JSON object with ``text`` for each file."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.to_json(F.struct(F.col("value").alias("text"))).alias("record"))


def parquet_files(spark: SparkSession, files: list[str], config: str = "", split: str = "", most: int | None = None) -> DataFrame:
    """Rows of a mirror's Parquet files: those of a config and a split if any match, else all, in sorted order."""
    held = sorted(f for f in files if f.endswith(".parquet"))
    for mark in (f"/{config}/" if config else "", f"/{split}-" if split else ""):
        held = [f for f in held if mark in f] or held
    rows = spark.read.parquet(*held)
    return rows if most is None else rows.limit(most)


def prompts(rows: DataFrame) -> DataFrame:
    """(value) lines to prompts; a line without prompt_id, lang or user is an error."""
    r = F.from_json("value", "prompt_id string, lang string, category string, user string")
    need = lambda n: F.coalesce(F.nullif(F.trim(f"r.{n}"), F.lit("")), F.raise_error(F.concat(F.lit(f"a prompt lacks {n}: "), "value"))).alias(n)
    return rows.where("trim(value) <> ''").withColumn("r", r).select(need("prompt_id"), need("lang"), need("user"), F.coalesce("r.category", F.lit("daily_dialogue")).alias("category"))


def dataset_rows(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Rows of a dataset's folder, Parquet or JSON lines by its files' names; the first ``most`` if asked for."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path")
    reader = spark.read.option("recursiveFileLookup", True)
    rows = reader.json(path) if names.limit(1).isEmpty() else reader.option("pathGlobFilter", "*.parquet").parquet(path)
    return rows if most is None else rows.limit(most)


def points(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Knowledge points, a JSON file each, in the order of their file names; files that don't parse are left out."""
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(path, mode="DROPMALFORMED")
    return rows.withColumn("file", F.col("_metadata.file_name")).where(F.coalesce(*[F.col(c).isNotNull() for c in rows.columns[:1]])).orderBy("file")


def ranked_texts(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of lines ``id<TAB>text``; lines without an id are left out, and a text keeps its further tabs."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).select(F.element_at(parts, 1).alias("id"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("text")).where("id <> ''")


@dataclass(frozen=True)
class Source:
    key: str
    license_id: str
    converter: str
    enabled: bool = True
    restricted: bool = False
    dataset: str = ""
    config: str = "default"
    split: str = "train"
    start: int = 0


#: The known public datasets, their licences and converters.
CATALOG = [
    Source("oasst1", "apache-2.0", "openassistant", dataset="OpenAssistant/oasst1"),
    Source("oasst2", "apache-2.0", "openassistant", dataset="OpenAssistant/oasst2"),
    Source("wildchat", "odc-by", "wildchat", dataset="allenai/WildChat-1M"),
    Source("aya_dataset", "apache-2.0", "prompt_target", dataset="CohereLabs/aya_dataset"),
    Source("aya_collection_translated_dolly", "apache-2.0", "prompt_target_en_zh", dataset="CohereLabs/aya_collection", config="translated_dolly", start=1_700_000),
    Source("aya_collection_flan_cot", "apache-2.0", "prompt_target_en_zh", dataset="CohereLabs/aya_collection", config="translated_flan_cot"),
    Source("aya_collection_flan_qa", "apache-2.0", "prompt_target_en_zh", dataset="CohereLabs/aya_collection", config="translated_flan_qa"),
    Source("helpsteer2", "cc-by-4.0", "prompt_target", dataset="nvidia/HelpSteer2"),
    Source("helpsteer3_preference", "cc-by-4.0", "helpsteer3_preference", dataset="nvidia/HelpSteer3", config="preference"),
    Source("hh_rlhf", "mit", "hh_rlhf", enabled=False, dataset="Anthropic/hh-rlhf"),
    Source("databricks_dolly_15k", "cc-by-sa-3.0", "dolly", enabled=False, dataset="databricks/databricks-dolly-15k"),
    Source("stack_exchange_preferences", "cc-by-sa-4.0", "stack_exchange", dataset="HuggingFaceH4/stack-exchange-preferences"),
    Source("pmp_stack_exchange", "cc-by-sa-4.0", "stack_exchange", dataset="HuggingFaceH4/pmp-stack-exchange"),
    Source("openorca", "mit", "openorca", enabled=False, dataset="Open-Orca/OpenOrca"),
    Source("lmsys_chat_1m", "lmsys-chat-1m-agreement", "wildchat", enabled=False, restricted=True, dataset="lmsys/lmsys-chat-1m"),
    Source("ultrachat_200k", "mit", "wildchat", enabled=False, dataset="HuggingFaceH4/ultrachat_200k", split="train_sft"),
]


def load(spark: SparkSession, source: Source, root: str, backend: str = "auto", url: str | None = None, most: int | None = None) -> DataFrame:
    """A source's raw rows from one of the backends ``mirror`` (Parquet below root/dataset), ``datasets`` (any files there) and ``rows-api`` (a paged service).

    ``auto`` takes the first of them that can be read; rows of the service come as JSON in ``record``.
    """
    folder = f"{root.rstrip('/')}/{source.dataset}"

    def mirror() -> DataFrame:
        names = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder).select("path")
        return parquet_files(spark, [r["path"] for r in names.toLocalIterator()], source.config, source.split, most)

    def paged() -> DataFrame:
        if url is None:
            raise ValueError("the rows-api backend needs a url")
        reader = spark.read.format("paged_rows").options(url=url, start=source.start)
        return (reader if most is None else reader.option("rows", most)).load()

    backends = {"mirror": mirror, "datasets": lambda: dataset_rows(spark, folder, most), "rows-api": paged}
    if backend != "auto":
        if backend not in backends:
            raise ValueError(f"unknown backend: {backend}")
        return backends[backend]()
    failures = []
    for name, read in backends.items():
        try:
            return read()
        except (AnalysisException, ValueError) as e:
            failures.append(f"{name}: {str(e).splitlines()[0]}")
    raise ValueError(f"no backend can read {source.key}: " + "; ".join(failures))


def chosen(catalog: list[Source], keys: list[str] | None = None, allow_restricted: bool = False) -> list[Source]:
    """The named sources, or by default the enabled ones without restrictions; a restricted one needs permission."""
    known = {s.key: s for s in catalog}
    if keys is None:
        return [s for s in catalog if s.enabled and not s.restricted]
    if missing := [k for k in keys if k not in known]:
        raise ValueError(f"unknown sources: {', '.join(missing)}")
    if not allow_restricted and (closed := [k for k in keys if known[k].restricted]):
        raise ValueError(f"restricted sources need permission: {', '.join(closed)}")
    return [known[k] for k in keys]


def by_default() -> Column:
    """What ``chosen`` takes without names, of a table of sources."""
    return F.col("enabled") & ~F.col("restricted")


def catalog_frame(spark: SparkSession, catalog: list[Source]) -> DataFrame:
    return spark.createDataFrame([asdict(s) for s in catalog], "key string, license_id string, converter string, enabled boolean, restricted boolean, dataset string, config string, split string, start long")
