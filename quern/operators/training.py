"""Tables of a training run: metrics, annotated records, splits, checks of settings, skeletons of functions."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import learning as L
from ..sources.lineage import cut
from . import dedup, tokens

#: The toy rows (text, skeleton name, its steps).
TOY = (
    ("def add(a, b):\n    return a + b\n", "simple_function", ("parse_input", "emit_output")),
    ("from collections import deque\nq = deque([start])\nwhile q:\n    node = q.popleft()\n", "grid_bfs", ("graph_search", "loop")),
    ("intervals.sort(key=lambda x: x[0])\nfor start, end in intervals:\n    pass\n", "interval_sort", ("sort", "loop")),
)
#: The stages that a run can name.
STAGES = (
    "stage1", "stage2", "stage3", "stage2_5", "stage3_5", "stage4", "stage_sdit", "stage5", "stage_deliberation", "stage_dspark", "stage_tool_calling",
    "stage_tool_schema_following", "stage_tool_retrieval", "stage_agent_rollout", "structural_reconstruction", "hyper_lora", "isg_training", "cognitive_search",
    "self_driven_induction", "knowledge_management", "adaptive_deliberation", "dspark_speculative", "tool_calling",
)
#: Attention backends, and the most parameters that speculative heads may add.
BACKENDS, MOST_EXTRA = ("torch", "int4_reference", "triton_int4"), 20_000_000
#: What the names of stages stand for.
ALIASES = {
    "stage1": "structural_reconstruction", "stage2": "hyper_lora", "stage2_5": "intent_alignment", "stage3": "isg_training", "stage3_5": "cognitive_search", "stage4": "cognitive_search",
    "stage_sdit": "self_driven_induction", "stage5": "knowledge_management", "stage_deliberation": "adaptive_deliberation", "stage_dspark": "dspark_speculative",
    "stage_tool_calling": "tool_calling", "stage_tool_schema_following": "tool_calling", "stage_tool_retrieval": "tool_calling", "stage_agent_rollout": "tool_calling",
}


def stage_steps(stages: list[str], steps: str | None, default: int = 1000) -> list[tuple[str, int]]:
    """(stage, steps) of a plan: one number of steps holds for all stages, or there is one for each."""
    counts = [default] if steps is None else [int(n) for n in steps.split(",") if n.strip()]
    if len(counts) not in (1, len(stages)):
        raise ValueError(f"{len(counts)} numbers of steps for {len(stages)} stages")
    return list(zip([ALIASES.get(s, s) for s in stages], counts * len(stages) if len(counts) == 1 else counts, strict=True))


def evaluation(batches: DataFrame) -> DataFrame:
    """One row from (loss, difficulty) a batch: how many have a loss, its mean and perplexity, the mean difficulty; means of none are 0."""
    m = batches.agg(F.count("loss").alias("eval_batches"), F.coalesce(F.avg("loss"), F.lit(0.0)).alias("loss"), F.coalesce(F.avg("difficulty"), F.lit(0.0)).alias("difficulty_mean"))
    return m.withColumn("perplexity", F.exp(F.least(F.lit(20.0), F.col("loss"))))


def annotated(records: DataFrame, threshold: float, rate: float) -> DataFrame:
    """Records (losses, encoded_len) with the labels of hot tokens and the losses, both fitted to the encoded length, and the counts of valid and positive tokens."""
    ok = lambda v: v.isNotNull() & ~F.isnan(v)
    out = records.withColumn("_y", tokens.hard_labels(F.col("losses"), threshold, rate))
    labels = A.fit_length(F.transform("_y", lambda v: F.coalesce(v, F.lit(0.0))), F.col("encoded_len"), F.lit(0.0))
    losses = A.fit_length(F.col("losses"), F.col("encoded_len"), F.lit(float("nan")))
    out = out.withColumns({
        "external_knowledge_labels": labels, "hot_token_losses": F.transform(losses, lambda v: F.when(ok(v), F.round(v, 6))),
        "valid_tokens": F.size(F.filter("losses", ok)).cast("long"),
    })
    return out.withColumn("positive_tokens", F.size(F.filter("external_knowledge_labels", lambda v: v > 0)).cast("long")).drop("_y")


def annotate_files(records: DataFrame, out: str, threshold: float, rate: float, limit: int = 0) -> DataFrame:
    """Write annotated records (file, seq, record JSON, losses, encoded_len), each input file to a folder of its own, and give the summary.

    Folders are named by the whole path of the input, so that equal names don't
    clash.  With a limit the first so many records, by file and seq, count.
    """
    rows = records.orderBy("file", "seq").limit(limit) if limit > 0 else records
    done = cut(annotated(rows, threshold, rate))
    fields = ("external_knowledge_labels", "hot_token_losses", "valid_tokens", "positive_tokens")
    value = F.to_json(F.struct("record", *fields), {"ignoreNullFields": "false"})
    folder = F.concat(F.regexp_replace(F.regexp_extract("file", r"([^/]*?)(\.\w+)?$", 1), r"\W+", "_"), F.lit("-"), F.substring(F.md5("file"), 1, 8))
    lines = done.select(folder.alias("source"), "seq", value.alias("value"))
    lines.repartition("source").sortWithinPartitions("source", "seq").select("source", "value").write.mode("overwrite").partitionBy("source").text(out)
    return annotation_summary(done)


def annotation_summary(rows: DataFrame) -> DataFrame:
    none = F.lit(0).cast("long")
    return rows.agg(F.count("*").alias("records"), F.coalesce(F.sum("valid_tokens"), none).alias("valid_tokens"), F.coalesce(F.sum("positive_tokens"), none).alias("positive_tokens"))


def supervision_metrics(rows: DataFrame) -> DataFrame:
    """One row from (labels, mask, hot, teacher, p) arrays: over all masked tokens the positive rate, the gate's mean loss and the mean margin of the losses."""
    each = rows.select(F.explode(F.arrays_zip("labels", "mask", "p", "hot", "teacher")).alias("x")).select("x.*").where("mask")
    return each.agg(F.avg("labels").alias("positive_rate"), F.avg(L.binary_cross_entropy(F.col("p"), F.col("labels"))).alias("gate_bce"), F.avg(F.col("hot") - F.col("teacher")).alias("margin"))


def parameter_report(parameters: DataFrame) -> DataFrame:
    """(name, numel, trainable) to (key, numel): sums by the name's first part, and of all and of the trainable ones."""
    groups = F.array(F.substring_index("name", ".", 1), F.lit("total"), F.when(F.col("trainable"), "trainable"))
    return parameters.select(F.explode(F.filter(groups, lambda g: g.isNotNull())).alias("key"), "numel").groupBy("key").agg(F.sum("numel").alias("numel"))


def visits(before: DataFrame, selected: DataFrame) -> DataFrame:
    """(unit, n) of earlier counts with one more for each selection of a unit."""
    return before.select("unit", "n").union(selected.groupBy("unit").agg(F.count("*").alias("n"))).groupBy("unit").agg(F.sum("n").alias("n"))


def snippet_statistics(snippets: DataFrame, key: str) -> DataFrame:
    """Per key mean and largest length, mean number of code marks and the number of snippets, all over the largest of them (or 1)."""
    marks = F.regexp_count("text", F.lit("def |class "))
    s = snippets.groupBy(key).agg(F.avg(F.length("text")).alias("mean_length"), F.max(F.length("text")).cast("double").alias("max_length"), F.avg(marks).alias("mean_marks"), F.count("*").cast("double").alias("snippets"))
    names = ("mean_length", "max_length", "mean_marks", "snippets")
    top = F.greatest(F.lit(1.0), *[F.abs(c) for c in names])
    return s.select(key, *[(F.col(c) / top).alias(c) for c in names])


def overconfident(failed: Column, probabilities: Column, threshold: float = 0.20) -> Column:
    """Whether a failed execution had been expected to succeed."""
    return F.coalesce(failed & (L.mean(probabilities) < threshold), F.lit(False))


def toy_rows(spark: SparkSession, times: DataFrame) -> DataFrame:
    """The toy rows once for each ``i`` of ``times``."""
    rows = spark.createDataFrame([(k, t, n, list(s)) for k, (t, n, s) in enumerate(TOY)], "k long, text string, name string, steps array<string>")
    return times.select("i").crossJoin(F.broadcast(rows)).select((F.col("i") * len(TOY) + F.col("k")).alias("seq"), "text", "name", "steps")


def prepared(lines: DataFrame, key: str, ratio: float, seed: int = 0) -> DataFrame:
    """Adds ``part``: the first max(1, int(n ratio)) lines in a hash order are ``valid``, so a single line leaves nothing to train on."""
    n = lines.count()
    return lines.withColumn("part", F.when(dedup.in_hash_order(lines, key, seed, max(1, int(n * ratio)) if n else 0), "valid").otherwise("train"))


def setting_errors(settings: DataFrame) -> DataFrame:
    """Adds ``errors``: what is wrong with each row of settings, in order; settings of the model are named ``model.``, whatever a project calls that part.

    A setting that is null counts as fine, but for ``train_path`` and the flags that a stage needs.
    """
    c, off = F.col, lambda name: ~F.coalesce(F.col(name), F.lit(False))
    need = lambda stages, name, flag: (f"{name} requires model.{flag}=true", c("train_stage").isin(*stages) & off(flag))
    return settings.withColumn("errors", L.expectations([
        ("data.train_path is required for training", c("train_path").isNull()),
        (F.concat(F.lit("unknown train_stage: "), "train_stage"), ~c("train_stage").isin(*STAGES)),
        need(("stage_sdit", "self_driven_induction"), "stage_sdit", "self_driven_induction_enabled"),
        need(("stage5", "knowledge_management"), "stage5", "permanent_knowledge_enabled"),
        need(("stage_deliberation", "adaptive_deliberation"), "stage_deliberation", "adaptive_deliberation_enabled"),
        need(("stage_dspark", "dspark_speculative"), "stage_dspark", "dspark_enabled"),
        need(("stage_tool_calling", "stage_tool_schema_following", "stage_tool_retrieval", "stage_agent_rollout", "tool_calling"), "stage_tool_calling", "tool_calling_enabled"),
        ("model.dspark_gamma must be at least 2", c("dspark_enabled") & (c("dspark_gamma") < 2)),
        ("model.dspark_max_extra_params must be <= 20M", c("dspark_enabled") & (c("dspark_max_extra_params") > MOST_EXTRA)),
        ("model.tool_action_count must be at least 2", c("tool_calling_enabled") & (c("tool_action_count") < 2)),
        ("model.tool_query_dim must be positive", c("tool_calling_enabled") & (c("tool_query_dim") <= 0)),
        (F.concat(F.lit("unknown attention_backend: "), "attention_backend"), ~c("attention_backend").isin(*BACKENDS)),
        ("train.max_steps must be positive", c("max_steps") <= 0),
        ("train.grad_accum_steps must be positive", c("grad_accum_steps") <= 0),
        ("offload.cold_layer_budget_per_step must be positive", (c("cold_granularity") == "unit") & (c("cold_layer_budget_per_step") <= 0)),
        ("cold unit budgets must be non-negative", (c("cold_granularity") == "unit") & (F.least("cold_attention_heads_per_step", "cold_ffn_blocks_per_step") < 0)),
    ]))


# What a node of a function's syntax tree counts as.
NODES = {
    ast.For: "loop", ast.AsyncFor: "loop", ast.While: "loop", ast.If: "branch", ast.Assign: "assign", ast.AnnAssign: "assign", ast.AugAssign: "assign",
    ast.Call: "call", ast.Return: "return",
}


def skeleton_of(function: ast.FunctionDef | ast.AsyncFunctionDef) -> tuple[str, list[str], list[str]]:
    """(name, parameters, operations in the order first met, breadth first; the return, or else an output, at the end)."""
    parameters = [a.arg for a in function.args.args]
    met = dict.fromkeys([*(["parse_input"] if parameters else []), *filter(None, (NODES.get(type(n)) for n in ast.walk(function)))])
    returns = met.pop("return", 0) is None
    steps = list(met)
    end = "return" if returns else "emit_output"
    return function.name, parameters, steps if steps and steps[-1] == end else [*steps, end]


#: A text without such a line has no top-level function.
_HAS_FUNCTION = "(?m)^(async[ \\t]+)?def[ \\t]"


def function_skeletons(files: DataFrame, sample_rate: float = 1.0, seed: int = 0) -> DataFrame:
    """(path, source) to a row for each top-level Python function: path, name, params, steps and its code.

    Sources that don't parse, or that are too deep for the parser, have none.
    Of all functions a share of ``sample_rate`` stays, chosen by a hash of seed,
    path and place, so that a second run, or another partitioning, chooses the same.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, source in zip(batch["path"], batch["source"], strict=True):
                try:
                    tree = ast.parse(source)
                except (SyntaxError, ValueError, MemoryError, RecursionError):
                    continue
                for place, node in enumerate(tree.body):
                    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        out.append((path, place, *skeleton_of(node), ast.get_source_segment(source, node)))
            yield pd.DataFrame(out, columns=["path", "place", "name", "params", "steps", "code"])

    likely = files.select("path", "source").where(F.col("source").rlike(_HAS_FUNCTION))
    found = likely.mapInPandas(run, "path string, place long, name string, params array<string>, steps array<string>, code string")
    share = F.pmod(F.xxhash64(F.lit(seed).cast("long"), "path", "place"), F.lit(1 << 30)) / (1 << 30)
    return (found if sample_rate >= 1 else found.where(share < sample_rate)).drop("place")


def skeleton_tasks(skeletons: DataFrame) -> DataFrame:
    """(path, name, params, steps, code) to records (text, skeleton, metadata) of the task that asks for a function's skeleton; JSON with sorted keys, a blank after each comma and colon."""
    quoted = lambda c: F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6)
    listed = lambda c, f: F.concat(F.lit("["), F.array_join(F.transform(c, f), ", "), F.lit("]"))
    steps = listed("steps", lambda x: F.concat(F.lit('{"op": '), quoted(x), F.lit("}")))
    skeleton = F.concat(F.lit('{"kind": "python_function", "name": '), quoted(F.col("name")), F.lit(', "params": '), listed("params", quoted), F.lit(', "steps": '), steps, F.lit("}"))
    meta = F.create_map(F.lit("source_path"), F.col("path"), F.lit("function"), F.col("name"), F.lit("task"), F.lit("skeleton_generation"))
    return skeletons.select(F.concat(F.lit("[skeleton]\nCode:\n"), F.trim("code"), F.lit("\nSkeleton JSON:\n"), skeleton).alias("text"), skeleton.alias("skeleton"), meta.alias("metadata"))


def encoded_lines(texts: DataFrame, key: str) -> DataFrame:
    """(key, line, ids): each line's bytes as tokens, an EOS after each, a BOS before the first only; an end of line at the end begins no line."""
    lines = F.split(F.coalesce("text", F.lit("")), "\r?\n", -1)
    kept = F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    each = texts.select(key, F.posexplode(kept).alias("line", "text"))
    ids = tokens.byte_encode(F.col("text"), eos=True)
    return each.select(key, "line", F.when(F.col("line") == 0, F.concat(F.array(F.lit(tokens.BOS)), ids)).otherwise(ids).alias("ids"))


def chunk_sides(lines: DataFrame, seq: str, text: str, length: int) -> DataFrame:
    """(chunk, and the columns of the line that completes it): the line that holds the token after the chunk's last.

    Chunks are those of ``tokens.pack``; those that one line completes share its side columns.
    """
    sized = tokens.line_starts(lines.select(seq, (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).alias("bytes")), seq, F.col("bytes"))
    spans = sized.select(F.col(seq).alias("_seq"), (F.col("start") + F.when(F.col("start") == 0, 0).otherwise(1)).alias("a"), (F.col("start") + 1 + F.col("n")).alias("b"))
    # tokens k length, for k of 1 and up, that lie in [a, b)
    first, last = F.greatest(F.ceil(F.col("a") / length), F.lit(1)), F.ceil(F.col("b") / length) - 1
    done = spans.where(first <= last).select("_seq", F.explode(F.sequence(first - 1, last - 1)).alias("chunk"))
    return done.join(lines, F.col(seq) == F.col("_seq")).drop("_seq")
