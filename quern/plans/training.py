"""Training formulas, run tables, landmarks and the whole cleaner as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import learning as L
from ..operators import cleaner, landmarks, tokens, training
from ..sources import files
from ..sources.lineage import cut
from .cleaning import _JUDGE_SQL, _doc_sql, doc_prefilter, judged_conversations
from . import derived
from .common import Fixture, table
from .numeric import _VEC, _vectors
from .registry import query
from .stores import lexical_memory_search

_half = lambda k: F.slice("e", F.lit(1 + 32 * k), F.lit(32))
_HALVES = f"{_VEC}, h AS (SELECT vec_id, e, e[1:32] AS a, e[33:64] AS b FROM v)"
_r = lambda c, n=6: F.round(c, n)


# ---- formulas over the vectors of ``embeddings``

_MASK = f"""{_VEC}, x AS (SELECT vec_id, e, len(e) AS n, unnest(range(1, len(e) + 1)) AS k FROM v),
m AS (SELECT vec_id, k, e[k] AS x, row_number() OVER (PARTITION BY vec_id ORDER BY abs(e[k]) DESC, k) <= greatest(1, round_even(n * 0.1::DOUBLE, 0)) AS kept FROM x)"""


@query("density_mask", f"WITH {_MASK} SELECT vec_id, count(*) FILTER (kept) AS kept, sum(k) FILTER (kept)::BIGINT AS places FROM m GROUP BY vec_id")
def density_mask(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("vec_id", L.magnitude_mask(F.col("e"), 0.1).alias("m"))
    return v.select("vec_id", A.total(F.col("m")).cast("long").alias("kept"), A.total(F.transform("m", lambda x, k: x * (k + 1))).cast("long").alias("places"))


@query("fake_int8_delta", f"""WITH {_MASK}, s AS (SELECT *, greatest(max(CASE WHEN kept THEN abs(x) ELSE 0 END) OVER (PARTITION BY vec_id), 1e-8::DOUBLE) / 127 AS s FROM m)
SELECT vec_id, round(any_value(s), 9) AS scale, round(sum(k * s * greatest(-127.0::DOUBLE, least(127.0::DOUBLE, round_even(CASE WHEN kept THEN x ELSE 0 END / s, 0)))), 6) AS weighted FROM s GROUP BY vec_id""")
def fake_int8_delta(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("vec_id", F.zip_with("e", L.magnitude_mask(F.col("e"), 0.1), lambda x, m: x * m).alias("d"))
    return v.select("vec_id", _r(A.int8_scale(F.col("d")), 9).alias("scale"), _r(A.total(F.transform(L.int8_rounded(F.col("d")), lambda x, k: x * (k + 1)))).alias("weighted"))


@query("deliberation_level", f"""WITH {_VEC}, s AS (SELECT vec_id, 1 / (1 + exp(-8 * e[1])) AS c, 1 / (1 + exp(-8 * e[2])) AS f, 1.5 / (1 + exp(-8 * e[3])) AS x FROM v)
SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 2 ELSE greatest(0, least(4, round_even(4 * (1 - (1 - ((1 - c) + f) / 2)) * greatest(0, least(1, x)), 0)))::INT END AS level FROM s""")
def deliberation_level(spark, sf_dir):
    s = lambda k: A.sigmoid(8 * F.element_at("e", k))
    level = L.deliberation_level(s(1), s(2), 1.5 * s(3), 5, F.when(F.col("vec_id") % 7 == 0, 2))
    return _vectors(spark, sf_dir).select("vec_id", level.alias("level"))


@query("soft_penalty", f"""WITH {_VEC}, s AS (SELECT vec_id, e, greatest(0.55::DOUBLE - 1 / (1 + exp(-8 * e[1])), 0) * 0.5::DOUBLE AS p FROM v)
SELECT vec_id, list_transform(range(1, 9), lambda k: round(e[k] - p * ((k - 1) / 64), 6)) AS logits FROM s""")
def soft_penalty(spark, sf_dir):
    bias = F.transform("e", lambda v, k: k / F.lit(64.0))
    out = L.soft_penalty(F.col("e"), A.sigmoid(8 * F.get("e", 0)), bias, 0.55, 0.5)
    eight = A.fit_length(F.coalesce(out, F.array().cast("array<double>")), F.lit(8), F.lit(None).cast("double"))
    return _vectors(spark, sf_dir).select("vec_id", F.transform(eight, lambda x: A.rounded(x, 6)).alias("logits"))


_COS = "list_sum(list_transform(range(1, 33), lambda k: a[k] * b[k])) / (greatest(sqrt(list_sum(list_transform(a, lambda x: x * x))), 1e-8::DOUBLE) * greatest(sqrt(list_sum(list_transform(b, lambda x: x * x))), 1e-8::DOUBLE))"


@query("induction_loss", f"WITH {_HALVES}, s AS (SELECT label, 1 - {_COS} AS one, 1 - {_COS.replace('b[k]', 'b[33 - k]')} AS two FROM h JOIN embeddings USING (vec_id)) SELECT label, round(avg(one), 6) AS consistency, round(avg(two), 6) AS transfer, round(0.1::DOUBLE * avg(one) + 0.1::DOUBLE * avg(two), 6) AS total FROM s GROUP BY label")
def induction_loss(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("e"))
    m = rows.groupBy("label").agg(F.avg(L.one_minus_cosine(_half(0), _half(1))).alias("c"), F.avg(L.one_minus_cosine(_half(0), F.reverse(_half(1)))).alias("t"))
    return m.select("label", _r("c").alias("consistency"), _r("t").alias("transfer"), _r(0.1 * F.col("c") + 0.1 * F.col("t")).alias("total"))


@query("sampling_weights", f"""WITH {_VEC}, s AS (SELECT vec_id, e, list_transform(e, lambda x: x / 0.7::DOUBLE) AS z FROM v), q AS (SELECT *, list_sort(z, 'DESC')[5] AS bar, list_max(z) AS top FROM s),
m AS (SELECT *, list_sum(list_transform(list_filter(z, lambda x: x >= bar), lambda x: exp(x - top))) AS mass FROM q)
SELECT vec_id, list_transform(z, lambda x: CASE WHEN x >= bar THEN round(exp(x - top) / mass, 6) ELSE 0.0::DOUBLE END) AS p, list_position(e, list_max(e))::BIGINT AS greedy FROM m""")
def sampling_weights(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return v.select("vec_id", F.transform(L.sampling_weights(F.col("e"), 0.7, 5), lambda x: _r(x)).alias("p"), F.array_position(L.sampling_weights(F.col("e"), 0.0), 1.0).alias("greedy"))


_soft_sql = lambda x: f"list_transform({x}, lambda y: exp(y - list_max({x})) / list_sum(list_transform({x}, lambda z: exp(z - list_max({x})))))"


@query("stage_losses", f"""WITH {_HALVES}, p AS (SELECT label, a, b, {_soft_sql('a')} AS p, {_soft_sql('b')} AS q, ln(list_sum(list_transform(a, lambda x: exp(x)))) - a[1 + (vec_id % 32)::INT] AS ce FROM h JOIN embeddings USING (vec_id))
SELECT label, round(avg(list_sum(list_transform(range(1, 33), lambda k: (a[k] - b[k]) * (a[k] - b[k]))) / 32), 6) AS mse, round(avg(list_sum(list_transform(range(1, 33), lambda k: p[k] * (ln(p[k]) - ln(q[k]))))), 6) AS kl,
  round(avg(ce), 6) AS ce, round(avg(1 - {_COS}), 6) AS cosine, round(avg(-list_sum(list_transform(p, lambda x: x * ln(x)))), 6) AS entropy,
  round(avg(greatest(a[1], 0) - a[1] * (label % 2) + ln(1 + exp(-abs(a[1])))), 6) AS bce FROM p GROUP BY label""")
def stage_losses(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.select("vec_id", "label", _half(0).alias("a"), _half(1).alias("b")).withColumns({"p": A.softmax(F.col("a")), "q": A.softmax(F.col("b"))})
    a, b = F.col("a"), F.col("b")
    each = {
        "mse": L.squared_error(a, b), "kl": L.divergence(F.col("p"), F.col("q")), "ce": L.cross_entropy(a, (F.col("vec_id") % 32).cast("int")), "cosine": L.one_minus_cosine(a, b),
        "entropy": L.coefficient_entropy(F.col("p")), "bce": L.binary_cross_entropy_of_logit(F.element_at("a", 1), F.col("label") % 2),
    }
    return rows.groupBy("label").agg(*[_r(F.avg(v)).alias(k) for k, v in each.items()])


@query("clarification_gate", f"""WITH {_VEC}, z AS (SELECT vec_id, list_transform(e, lambda x: 8 * x) AS zs FROM v), p AS (SELECT vec_id, {_soft_sql('zs')} AS p FROM z)
SELECT vec_id, round(greatest(0, least(1, -list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)) / ln(greatest(len(p), 2)))), 6) >= 0.6::DOUBLE AS ask FROM p""")
def clarification_gate(spark, sf_dir):
    p = _vectors(spark, sf_dir).select("vec_id", A.softmax(F.transform("e", lambda x: 8 * x)).alias("p"))
    return p.select("vec_id", (_r(A.normalized_entropy(F.col("p"))) >= 0.6).alias("ask"))


@query("lr_schedule", "SELECT event_id, step, round(CASE WHEN step <= 20 THEN step / 20 ELSE 0.1::DOUBLE + 0.9::DOUBLE * 0.5::DOUBLE * (1 + cos(pi() * ((step - 20) / 180))) END, 9) AS ratio FROM (SELECT event_id, event_id % 250 + 1 AS step FROM events)")
def lr_schedule(spark, sf_dir):
    """Every event is a step of a run of 250, of which the last 50 are beyond the planned end."""
    steps = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 250 + 1).alias("step"))
    return steps.select("event_id", "step", _r(L.warmup_cosine(F.col("step"), 20, 200), 9).alias("ratio"))


# ---- tables of a run


@query("eval_metrics", f"WITH {_VEC}, b AS (SELECT CASE WHEN vec_id % 9 > 0 THEN list_sum(list_transform(e, lambda x: abs(x))) END AS loss, 1 / (1 + exp(-e[1])) AS d FROM v) SELECT count(loss) AS eval_batches, round(avg(loss), 6) AS loss, round(avg(d), 6) AS difficulty_mean, round(exp(least(20, avg(loss))), 4) AS perplexity FROM b")
def eval_metrics(spark, sf_dir):
    b = _vectors(spark, sf_dir).select(F.when(F.col("vec_id") % 9 > 0, A.total(F.transform("e", lambda x: F.abs(x)))).alias("loss"), A.sigmoid(F.element_at("e", 1)).alias("difficulty"))
    return training.evaluation(b).select("eval_batches", _r("loss").alias("loss"), _r("difficulty_mean").alias("difficulty_mean"), _r("perplexity", 4).alias("perplexity"))


_LABELS = f"""{_HALVES}, l AS (SELECT vec_id, unnest(range(1, 33)) AS k, a, b FROM h), t AS (SELECT vec_id, k, abs(a[k]) * 20 AS hot, abs(b[k]) * 5 AS teacher, 1 / (1 + exp(-a[k] * 4)) AS p FROM l),
y AS (SELECT *, CASE WHEN hot >= 3 AND teacher <= 1 AND hot - teacher >= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM t)"""


@query("supervision_metrics", f"WITH {_LABELS} SELECT round(avg(y), 6) AS positive_rate, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS gate_bce, round(avg(hot - teacher), 6) AS margin FROM y")
def supervision_metrics(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select(F.transform(_half(0), lambda x: F.abs(x) * 20).alias("hot"), F.transform(_half(1), lambda x: F.abs(x) * 5).alias("teacher"), F.transform(_half(0), lambda x: A.sigmoid(x * 4)).alias("p"))
    labels, mask = L.supervised(F.lit(None).cast("array<double>"), F.col("hot"), F.col("teacher"), F.lit(32))
    out = training.supervision_metrics(rows.withColumns({"labels": labels, "mask": mask}))
    return out.select(*[_r(c).alias(c) for c in ("positive_rate", "gate_bce", "margin")])


@query("visit_counts", f"WITH {_VEC}, s AS (SELECT list_position(e, list_max(e)) AS unit, count(*) AS n FROM v GROUP BY 1 UNION ALL SELECT unit, unit % 3 FROM (SELECT unnest(range(1, 65)) AS unit)) SELECT unit::BIGINT AS unit, sum(n)::BIGINT AS n FROM s GROUP BY unit")
def visit_counts(spark, sf_dir):
    before = spark.range(1, 65).select(F.col("id").alias("unit"), (F.col("id") % 3).alias("n"))
    return training.visits(before, _vectors(spark, sf_dir).select(F.array_position("e", F.array_max("e")).alias("unit")))


@query("snippet_statistics", """WITH s AS (SELECT source, avg(length(text)) AS a, max(length(text))::DOUBLE AS b, avg(len(regexp_extract_all(text, 'def |class '))) AS c, count(*)::DOUBLE AS d FROM documents WHERE text IS NOT NULL GROUP BY source)
SELECT source, round(a / greatest(1, a, b, c, d), 6) AS mean_length, round(b / greatest(1, a, b, c, d), 6) AS max_length, round(c / greatest(1, a, b, c, d), 6) AS mean_marks, round(d / greatest(1, a, b, c, d), 6) AS snippets FROM s""")
def snippet_statistics(spark, sf_dir):
    s = training.snippet_statistics(table(spark, sf_dir, "documents").where("text is not null"), "source")
    return s.select("source", *[_r(c).alias(c) for c in s.columns[1:]])


_PARAMS = Fixture.over(derived.parameters, "name string, numel long, trainable boolean", ["VARCHAR", "BIGINT", "BOOLEAN"], [("hot.0.q", 64, True), ("hot.0.k", 64, False), ("cold.9.ffn.w", 640, False), ("embed", 1000, True), ("cold.1.b", 3, True)])


@query("parameter_report", f"WITH {_PARAMS.sql('fx')} SELECT split_part(name, '.', 1) AS key, sum(numel)::BIGINT AS numel FROM fx GROUP BY 1 UNION ALL SELECT 'total', sum(numel)::BIGINT FROM fx UNION ALL SELECT 'trainable', sum(numel)::BIGINT FROM fx WHERE trainable")
def parameter_report(spark, sf_dir):
    return training.parameter_report(_PARAMS.frame(spark, sf_dir))


_nan = float("nan")
_RECORDS = Fixture.over(derived.records, "id long, losses array<double>, encoded_len int", ["BIGINT", "DOUBLE[]", "INTEGER"], [
    (1, [3.5, 2.0, 4.0, 3.1234567, _nan], 5), (2, [0.1, 0.2, _nan], 2), (3, [9.0], 4), (4, [5.0, 5.0, 5.0, 5.0, 1.0, 1.0, 1.0, 1.0], 8), (5, [_nan], 3),
])
_OK = "list_filter(losses, lambda x: NOT isnan(x))"
_ANNOTATED = f"""fx_y AS (SELECT *, greatest(2.0::DOUBLE, coalesce(list_sort({_OK}, 'DESC')[greatest(1, floor(len({_OK}) * 0.5::DOUBLE))::INT], 2.0::DOUBLE)) AS bar FROM fx),
an AS (SELECT id, (list_transform(losses, lambda x: CASE WHEN NOT isnan(x) AND x >= bar THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) || list_transform(range(0, 8), lambda k: 0.0::DOUBLE))[1:encoded_len] AS y,
  (list_transform(losses, lambda x: CASE WHEN NOT isnan(x) THEN round(x, 6) END) || list_transform(range(0, 8), lambda k: NULL::DOUBLE))[1:encoded_len] AS l, len({_OK}) AS valid FROM fx_y)"""


def _annotated(spark, sf_dir):
    return training.annotated(_RECORDS.frame(spark, sf_dir), 2.0, 0.5)


@query("annotate_losses", f"WITH {_RECORDS.sql('fx')}, {_ANNOTATED} SELECT id, y AS external_knowledge_labels, l AS hot_token_losses, valid AS valid_tokens, list_sum(y)::BIGINT AS positive_tokens FROM an")
def annotate_losses(spark, sf_dir):
    return _annotated(spark, sf_dir).select("id", "external_knowledge_labels", "hot_token_losses", "valid_tokens", "positive_tokens")


@query("annotation_summary", f"WITH {_RECORDS.sql('fx')}, {_ANNOTATED} SELECT count(*) AS records, sum(valid)::BIGINT AS valid_tokens, sum(list_sum(y))::BIGINT AS positive_tokens FROM an")
def annotation_summary(spark, sf_dir):
    return training.annotation_summary(_annotated(spark, sf_dir))


_SUPER = Fixture.over(derived.supervision, "id long, explicit array<double>, hot array<double>, teacher array<double>", ["BIGINT", "DOUBLE[]", "DOUBLE[]", "DOUBLE[]"], [
    (1, [1.0, -1.0, 0.5, 7.0], [9.0, 9.0], [0.0, 0.0]), (2, None, [4.0, 4.0, 2.0], [0.5, 3.5, 0.1]), (3, None, [4.0, _nan, 4.0, 4.0, 4.0], [0.5, 0.1]), (4, None, None, [1.0]), (5, None, None, None), (6, [_nan, 0.0], None, None),
])
_pad = lambda c, v: f"({c} || [{v}, {v}, {v}, {v}])[1:4]"
_NAN = "'nan'::DOUBLE"


@query("supervision_precedence", f"""WITH {_SUPER.sql('fx')}, p AS (SELECT id, explicit, hot IS NOT NULL AND teacher IS NOT NULL AS two, {_pad('explicit', '-1.0::DOUBLE')} AS g, {_pad('hot', _NAN)} AS h, {_pad('teacher', _NAN)} AS t FROM fx)
SELECT id, CASE WHEN explicit IS NOT NULL THEN list_transform(g, lambda x: CASE WHEN isnan(x) THEN 0.0::DOUBLE ELSE greatest(0, least(1, x)) END) WHEN two THEN list_transform(range(1, 5), lambda k: CASE WHEN NOT isnan(h[k]) AND NOT isnan(t[k]) AND h[k] >= 3 AND t[k] <= 1 AND h[k] - t[k] >= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) END AS labels,
  CASE WHEN explicit IS NOT NULL THEN list_transform(g, lambda x: NOT isnan(x) AND x >= 0) WHEN two THEN list_transform(range(1, 5), lambda k: NOT isnan(h[k]) AND NOT isnan(t[k])) END AS mask FROM p""")
def supervision_precedence(spark, sf_dir):
    labels, mask = L.supervised(F.col("explicit"), F.col("hot"), F.col("teacher"), F.lit(4))
    return _SUPER.frame(spark, sf_dir).select("id", labels.alias("labels"), mask.alias("mask"))


_LOGITS = Fixture.over(derived.logits, "id long, logits array<array<double>>, labels array<int>", ["BIGINT", "DOUBLE[][]", "INTEGER[]"], [
    (1, [[0.1, 2.0, -1.0], [1.0, 1.0, 1.0], [5.0, 0.0, 0.0]], [0, 1, 2]), (2, [[0.0, 0.0, 1.5]], [2]), (3, [[-3.0, 100.0, 2.0], [7.0, 7.0, 700.0]], [1, 1]),
])


@query("shifted_token_losses", f"""WITH {_LOGITS.sql('fx')} SELECT id, list_transform(range(1, len(labels)), lambda k: round(list_max(logits[k]) + ln(list_sum(list_transform(logits[k], lambda x: exp(x - list_max(logits[k]))))) - logits[k][labels[k + 1] + 1], 6)) AS losses FROM fx""")
def shifted_token_losses(spark, sf_dir):
    return _LOGITS.frame(spark, sf_dir).select("id", F.transform(L.shifted_losses(F.col("logits"), F.col("labels")), lambda x: _r(x)).alias("losses"))


_RUNS = Fixture.over(derived.executions, "run long, failed boolean, p array<double>", ["BIGINT", "BOOLEAN", "DOUBLE[]"], [(1, True, [0.1, 0.2]), (2, True, [0.1, 0.5]), (3, False, [0.0]), (4, True, [0.2]), (5, None, [0.1]), (6, True, [])])


@query("posthoc_learning", f"WITH {_RUNS.sql('fx')} SELECT run, coalesce(failed AND list_avg(p) < 0.2::DOUBLE, FALSE) AS learn FROM fx")
def posthoc_learning(spark, sf_dir):
    return _RUNS.frame(spark, sf_dir).select("run", training.overconfident(F.col("failed"), F.col("p")).alias("learn"))


_SETTINGS = Fixture.over(derived.settings, 
    "id long, train_path string, train_stage string, self_driven_induction_enabled boolean, permanent_knowledge_enabled boolean, adaptive_deliberation_enabled boolean, dspark_enabled boolean, dspark_gamma int, tool_calling_enabled boolean, tool_action_count int, max_steps int, grad_accum_steps int, dspark_max_extra_params long, tool_query_dim int, attention_backend string, cold_granularity string, cold_layer_budget_per_step int, cold_attention_heads_per_step int, cold_ffn_blocks_per_step int",
    ["BIGINT", "VARCHAR", "VARCHAR", *["BOOLEAN"] * 4, "INTEGER", "BOOLEAN", "INTEGER", "INTEGER", "INTEGER", "BIGINT", "INTEGER", "VARCHAR", "VARCHAR", *["INTEGER"] * 3],
    [(1, "a", "stage1", False, False, False, False, 4, False, 8, 10, 1, 10**9, 0, "torch", "layer", 0, -1, -1), (2, None, "stage9", False, False, False, True, 1, True, 1, 0, 0, 20_000_001, 0, "other", "unit", 0, 1, -1), (3, "a", "stage_sdit", False, True, True, False, 4, False, 8, 5, 1, None, None, None, None, None, None, None), (4, "a", "tool_calling", True, True, True, True, 2, False, 8, 5, 1, 20_000_000, 0, "triton_int4", "unit", 1, 0, 0), (5, "a", "stage5", True, None, False, False, 4, False, 8, -1, 2, 5, 1, "int4_reference", "unit", -1, -1, 1)],
)
_need = lambda stages, name, flag: f"CASE WHEN train_stage IN {stages} AND NOT coalesce({flag}, FALSE) THEN '{name} requires model.{flag}=true' END"


@query("setting_errors", f"""WITH {_SETTINGS.sql('fx')} SELECT id, list_filter([CASE WHEN train_path IS NULL THEN 'data.train_path is required for training' END, CASE WHEN train_stage NOT IN {training.STAGES} THEN 'unknown train_stage: ' || train_stage END,
  {_need("('stage_sdit', 'self_driven_induction')", 'stage_sdit', 'self_driven_induction_enabled')}, {_need("('stage5', 'knowledge_management')", 'stage5', 'permanent_knowledge_enabled')},
  {_need("('stage_deliberation', 'adaptive_deliberation')", 'stage_deliberation', 'adaptive_deliberation_enabled')}, {_need("('stage_dspark', 'dspark_speculative')", 'stage_dspark', 'dspark_enabled')},
  {_need("('stage_tool_calling', 'stage_tool_schema_following', 'stage_tool_retrieval', 'stage_agent_rollout', 'tool_calling')", 'stage_tool_calling', 'tool_calling_enabled')},
  CASE WHEN dspark_enabled AND dspark_gamma < 2 THEN 'model.dspark_gamma must be at least 2' END, CASE WHEN dspark_enabled AND dspark_max_extra_params > 20000000 THEN 'model.dspark_max_extra_params must be <= 20M' END, CASE WHEN tool_calling_enabled AND tool_action_count < 2 THEN 'model.tool_action_count must be at least 2' END,
  CASE WHEN tool_calling_enabled AND tool_query_dim <= 0 THEN 'model.tool_query_dim must be positive' END, CASE WHEN attention_backend NOT IN {training.BACKENDS} THEN 'unknown attention_backend: ' || attention_backend END,
  CASE WHEN max_steps <= 0 THEN 'train.max_steps must be positive' END, CASE WHEN grad_accum_steps <= 0 THEN 'train.grad_accum_steps must be positive' END,
  CASE WHEN cold_granularity = 'unit' AND cold_layer_budget_per_step <= 0 THEN 'offload.cold_layer_budget_per_step must be positive' END, CASE WHEN cold_granularity = 'unit' AND (cold_attention_heads_per_step < 0 OR cold_ffn_blocks_per_step < 0) THEN 'cold unit budgets must be non-negative' END], lambda m: m IS NOT NULL) AS errors FROM fx""")
def setting_errors(spark, sf_dir):
    return training.setting_errors(_SETTINGS.frame(spark, sf_dir)).select("id", "errors")


_quoted = lambda t: "'" + t.replace("'", "''") + "'"


@query("toy_rows", "WITH t AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {_quoted(t)}, '{n}', {list(s)})" for k, (t, n, s) in enumerate(training.TOY)) + ") v(k, text, name, steps)) SELECT (i * 3 + k)::BIGINT AS seq, text, name, steps FROM t, (SELECT doc_id AS i FROM documents)")
def toy_rows(spark, sf_dir):
    """The toy rows, once for each document."""
    return training.toy_rows(spark, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i")))


@query("prepared_split", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '|7'), doc_id) <= greatest(1, floor((SELECT count(*) FROM documents) * 0.02::DOUBLE)) THEN 'valid' ELSE 'train' END AS part FROM documents")
def prepared_split(spark, sf_dir):
    return training.prepared(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.02, 7)


@query("function_skeletons")
def function_skeletons(spark, sf_dir):
    """Documents as sources, and the code of the toy rows, which has functions; parsing Python is beyond SQL, and tests compare hand-made sources."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), "doc_id").alias("path"), F.col("text").alias("source"))
    return training.function_skeletons(docs.union(training.toy_rows(spark, spark.range(1).toDF("i")).select(F.concat(F.lit("toy/"), "seq"), "text")))


_LINES_OF = "SELECT doc_id, line - 1 AS line, strlen(l) AS n FROM (SELECT doc_id, generate_subscripts(ls, 1) AS line, unnest(ls) AS l FROM (SELECT doc_id, CASE WHEN ls[-1] = '' THEN ls[1:-2] ELSE ls END AS ls FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\\r?\\n') AS ls FROM documents)))"


@query("byte_encode_lines", f"SELECT doc_id, line::BIGINT AS line, n + CASE WHEN line = 0 THEN 2 ELSE 1 END AS n, CASE WHEN line = 0 THEN 1 ELSE 0 END AS bos FROM ({_LINES_OF})")
def byte_encode_lines(spark, sf_dir):
    lines = training.encoded_lines(table(spark, sf_dir, "documents"), "doc_id")
    return lines.select("doc_id", F.col("line").cast("long").alias("line"), F.size("ids").cast("long").alias("n"), (F.element_at("ids", 1) == tokens.BOS).cast("int").alias("bos"))


@query("pack_sides", """WITH s AS (SELECT doc_id, lang, 1 + coalesce(sum(strlen(coalesce(text, '')) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, 1 + sum(strlen(coalesce(text, '')) + 1) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS b FROM documents),
n AS (SELECT max(b) AS n FROM s), c AS (SELECT unnest(range(0, ((n - 1) // 4096)::BIGINT)) AS chunk FROM n)
SELECT chunk::BIGINT AS chunk, doc_id, lang FROM c JOIN s ON (chunk + 1) * 4096 >= a AND (chunk + 1) * 4096 < b""")
def pack_sides(spark, sf_dir):
    sides = training.chunk_sides(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id", "text", 4096)
    return sides.select("chunk", "doc_id", "lang")


# ---- landmarks, branches, caches, retrieval


@query("landmarks", """WITH r AS (SELECT source, doc_id, (doc_id * 37 % 100) / 100 AS importance, text, row_number() OVER (PARTITION BY source ORDER BY doc_id * 37 % 100 DESC, doc_id DESC) AS k FROM documents)
SELECT source, doc_id AS seq, importance, array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '')[1:50], ' ') AS text FROM r WHERE k <= 10""")
def landmarks_(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("seq"), (F.col("doc_id") * 37 % 100 / 100).alias("importance"), "text")
    return landmarks.landmarks(rows, "source")


@query("best_branch", "SELECT source, doc_id AS plan, n_chars AS score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k = 1")
def best_branch(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("seq"), F.col("doc_id").alias("plan"), F.col("n_chars").alias("score"))
    return landmarks.best_branch(rows, "source")


@query("recently_used", "SELECT event_type, unit, last FROM (SELECT event_type, user_id AS unit, max(event_id) AS last, row_number() OVER (PARTITION BY event_type ORDER BY max(event_id) DESC) AS k FROM events GROUP BY event_type, user_id) WHERE k <= 8")
def recently_used(spark, sf_dir):
    touches = table(spark, sf_dir, "events").select("event_type", F.col("user_id").alias("unit"), F.col("event_id").alias("seq"))
    return landmarks.recently_used(touches, "event_type", 8)


@query("hra_retrieve", f"""WITH {_VEC}, c AS (SELECT label AS session, vec_id AS chunk_id, e FROM v JOIN embeddings USING (vec_id)), q AS (SELECT session, arg_min(e, chunk_id) AS qv FROM c GROUP BY session),
s AS (SELECT session, chunk_id, list_cosine_similarity(qv, e) AS s FROM c JOIN q USING (session)), r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY s DESC, chunk_id) AS rank FROM s)
SELECT session, rank, chunk_id, round(s, 4) AS score, round(count(*) OVER (PARTITION BY session) * (512 * 64 * 2 / 1048576)::DOUBLE, 4) AS kv_mb FROM r WHERE rank <= 4""")
def hra_retrieve(spark, sf_dir):
    chunks = table(spark, sf_dir, "embeddings").select(F.col("label").alias("session"), F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("v"))
    asked = chunks.groupBy("session").agg(F.min_by("v", "chunk_id").alias("qv"))
    return landmarks.retrieved(chunks, asked, 4, 64)


_MEMORY_SQL = """q AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '')) AS q FROM benchmark),
a AS (SELECT query_id, len(q) AS size, unnest(q) AS tok FROM q),
h AS (SELECT doc_id, unnest(list_distinct(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda t: regexp_replace(t, '^[.,:;()\\[\\]{}]+|[.,:;()\\[\\]{}]+$', '', 'g')))) AS tok FROM documents),
s AS (SELECT query_id, doc_id, round(count(*)::DOUBLE / size, 4) AS score FROM a JOIN h USING (tok) GROUP BY query_id, doc_id, size),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


@query("ranked_memories", f"WITH {_MEMORY_SQL} SELECT query_id, rank::INTEGER AS rank, md5(text) AS content FROM r JOIN documents USING (doc_id) WHERE rank <= 3")
def ranked_memories(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("content"))
    return landmarks.in_rank_order(lexical_memory_search(spark, sf_dir), rows).select("query_id", "rank", "content")


@query("cognitive_search", f"""WITH {_MEMORY_SQL}, asked AS (SELECT item_id AS query_id FROM benchmark WHERE (item_id * 31 % 100) / 100 < 0.5::DOUBLE),
i AS (SELECT query_id, 'memory' AS provider, rank FROM r WHERE rank <= 3 UNION ALL SELECT item_id, 'web', page_id FROM benchmark JOIN pages ON page_id // 3 = item_id),
f AS (SELECT query_id, provider, row_number() OVER (PARTITION BY query_id, provider ORDER BY rank) AS k FROM i), g AS (SELECT query_id, bool_or(provider = 'web') AS w, bool_or(provider = 'memory') AS m, count(*) AS n FROM f WHERE k <= 3 GROUP BY query_id)
SELECT query_id, CASE WHEN w AND m THEN 'retrieve_web,retrieve_memory' WHEN w THEN 'retrieve_web' WHEN m THEN 'retrieve_memory' ELSE 'retrieve' END AS ops, coalesce(n, 0) AS found FROM asked LEFT JOIN g USING (query_id)""")
def cognitive_search(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    asked = items.select(F.col("item_id").alias("query_id"), (F.col("item_id") * 31 % 100 / 100).alias("confidence"))
    memory = lexical_memory_search(spark, sf_dir).select("query_id", F.lit("memory").alias("provider"), F.col("rank").cast("long").alias("rank"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.floor(F.col("page_id") / 3).alias("item_id"))  # a page belongs to one item, so that all pages count
    web = items.join(pages, "item_id").select(F.col("item_id").alias("query_id"), F.lit("web").alias("provider"), F.col("page_id").alias("rank"))
    return landmarks.searched(asked, memory.union(web), 0.5).select("query_id", F.array_join("ops", ",").alias("ops"), "found")


_SOURCES = Fixture.over(derived.sources, "key string, license_id string, converter string, dataset string, config string, split string, start long, enabled boolean, restricted boolean", ["VARCHAR"] * 6 + ["BIGINT", "BOOLEAN", "BOOLEAN"], [
    (s.key, s.license_id, s.converter, s.dataset, s.config, s.split, s.start, s.enabled, s.restricted) for s in files.CATALOG
])


@query("source_catalog", f"WITH {_SOURCES.sql('v')} SELECT key, license_id, converter, dataset, config, split, start, enabled AND NOT restricted AS chosen FROM v")
def source_catalog(spark, sf_dir):
    """The known datasets, and the sources of the documents by language."""
    return _SOURCES.frame(spark, sf_dir).select("key", "license_id", "converter", "dataset", "config", "split", "start", files.by_default().alias("chosen"))


# ---- the cleaner over real conversations


def _threads(spark, sf_dir):
    """Judged conversations, two of five trees with several conversations, one of five without a tree; in a policy that keeps short ones."""
    tree = F.when(F.col("conv_id") % 5 > 0, F.floor(F.col("conv_id") / 3).cast("string")).otherwise("")
    return judged_conversations(spark, sf_dir).withColumns({"source": F.lit("conversations"), "thread": cleaner.thread_key(F.lit("conversations"), tree)})


_TWO_KEYS = f"""{_JUDGE_SQL}, t AS (SELECT conv_id, reject_reason, category, score, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS fp, CASE WHEN conv_id % 5 > 0 THEN 'conversations:' || (conv_id // 3) END AS thread FROM judged),
o AS (SELECT *, row_number() OVER (ORDER BY conv_id) AS k FROM t WHERE reject_reason IS NULL),
f AS (SELECT 0::BIGINT AS k, 0::BIGINT AS conv_id, ''::VARCHAR AS reason, []::VARCHAR[] AS fps, []::VARCHAR[] AS threads
  UNION ALL SELECT o.k, o.conv_id, CASE WHEN o.thread IS NOT NULL AND list_contains(f.threads, o.thread) THEN 'duplicate_thread' WHEN list_contains(f.fps, o.fp) THEN 'duplicate' ELSE '' END,
    CASE WHEN (o.thread IS NOT NULL AND list_contains(f.threads, o.thread)) OR list_contains(f.fps, o.fp) THEN f.fps ELSE f.fps || [o.fp] END,
    CASE WHEN o.thread IS NULL OR list_contains(f.threads, o.thread) OR list_contains(f.fps, o.fp) THEN f.threads ELSE f.threads || [o.thread] END FROM f JOIN o ON o.k = f.k + 1),
done AS (SELECT t.*, coalesce(t.reject_reason, nullif(f.reason, '')) AS reason FROM t LEFT JOIN f ON f.conv_id = t.conv_id AND f.k > 0)"""
_RECURSIVE = "WITH RECURSIVE "


@query("two_key_clean", f"{_RECURSIVE}{_TWO_KEYS} SELECT conv_id, thread, coalesce(reason, 'accepted') AS reason FROM done")
def two_key_clean(spark, sf_dir):
    out = cleaner.by_two_keys(_threads(spark, sf_dir), "conv_id", cut)
    return out.select("conv_id", "thread", F.coalesce("reject_reason", F.lit("accepted")).alias("reason"))


_TOP = f"{_TWO_KEYS}, top AS (SELECT *, row_number() OVER (ORDER BY score DESC, conv_id::VARCHAR) AS place FROM done WHERE reason IS NULL)"


def _top(spark, sf_dir):
    judged = cut(cleaner.by_two_keys(_threads(spark, sf_dir), "conv_id", cut).withColumn("source_id", F.col("conv_id").cast("string")).select("conv_id", "source", "source_id", "score", "category", "reject_reason"))
    return judged, cleaner.top_cleaned(judged.where("reject_reason is null"), 40)


@query("top_cleaned", f"{_RECURSIVE}{_TOP} SELECT conv_id, round(score, 6) AS score FROM top WHERE place <= 40")
def top_cleaned(spark, sf_dir):
    return _top(spark, sf_dir)[1].select("conv_id", F.round("score", 6).alias("score"))


@query("truncated_report", f"""{_RECURSIVE}{_TOP} SELECT 'seen' AS metric, '' AS key, count(*) AS cnt FROM done UNION ALL SELECT 'rejected', reason, count(*) FROM done WHERE reason IS NOT NULL GROUP BY reason
UNION ALL SELECT 'accepted', '', count(*) FROM top WHERE place <= 40 UNION ALL SELECT 'category', category, count(*) FROM top WHERE place <= 40 GROUP BY category UNION ALL SELECT 'source', 'conversations', count(*) FROM top WHERE place <= 40""")
def truncated_report(spark, sf_dir):
    judged, kept = _top(spark, sf_dir)
    return cleaner.truncated_report(judged, cut(kept))


@query("prefilter_verdicts", f"SELECT doc_id, CASE WHEN doc_id % 3 > 0 AND reason IS NOT NULL THEN 'reject' ELSE 'accept' END AS action, CASE WHEN doc_id % 3 > 0 THEN coalesce(reason, 'accepted') ELSE 'accepted' END AS reason FROM ({_doc_sql('prefilter')})")
def prefilter_verdicts(spark, sf_dir):
    verdicts = doc_prefilter(spark, sf_dir).where("doc_id % 3 > 0").select("doc_id", F.when(F.col("reason").isNull(), "accept").otherwise("reject").alias("action"), "reason")
    return cleaner.with_verdicts(table(spark, sf_dir, "documents").select("doc_id"), verdicts, "doc_id").select("doc_id", "action", "reason")


_CLEAN = "text"
for _p, _to in [("\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e]", "\n"), ("[ \t]+", " "), ("\\s*\\n\\s*", "\n"), ("^\\s+|\\s+$", "")]:
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '{_to}', 'g')"


@query("clean_messages", f"SELECT conv_id, turn, md5({_CLEAN}) AS content, {_CLEAN} <> text AS changed FROM conversations WHERE text IS NOT NULL")
def clean_messages(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    one = cleaner.cleaned_messages(F.array(F.struct("role", F.col("text").alias("content"))))
    return rows.select("conv_id", "turn", "text", F.element_at(one, 1)["content"].alias("c")).select("conv_id", "turn", F.md5("c").alias("content"), (F.col("c") != F.col("text")).alias("changed"))


@query("concat_sources", "SELECT doc_id, source, CASE source WHEN s.b THEN 0 ELSE 1 END AS ordinal FROM documents, (SELECT min(source) AS a, max(source) AS b FROM documents) s WHERE source IN (s.a, s.b)")
def concat_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    ends = docs.agg(F.max("source").alias("b"), F.min("source").alias("a")).first()
    return cleaner.in_order([docs.where(F.col("source") == ends["b"]), docs.where(F.col("source") == ends["a"])])

