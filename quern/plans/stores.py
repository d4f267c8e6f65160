"""Stores and runs: knowledge, memories, generators, lineage of runs, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, generators, knowledge, reports
from ..sources import sinks
from ..sources.lineage import cut
from ..streaming import cleaning as stream
from . import cleaning as C
from . import derived
from .common import Fixture, shared_folder, table
from .registry import query

# ---- knowledge

_LIST = "VARCHAR[]"
POINTS = Fixture.over(derived.points, "id string, rule string, domain string, importance double, positive_examples array<string>, negative_examples array<string>, dependencies array<string>", ["VARCHAR"] * 3 + ["DOUBLE"] + [_LIST] * 3, [
    ("k1", "use a vector", "C++", 0.5, ["a"], [], ["d1"]), ("k2", "reserve first", "C++", 0.9, ["b"], ["n"], ["d1", "d2"]), ("k3", "use a with block", "Python", 0.4, [], [], []), ("k4", "use", "Python", 0.1, [], ["m"], ["k3"]),
    ("k5", "alone", "general", 0.3, ["z"], [], []),
])
PAIRS = Fixture.over(derived.merges, "kept string, absorbed string", ["VARCHAR"] * 2, [("k1", "k2"), ("k3", "k4")])


@query("knowledge_merge", f"""WITH {POINTS.sql('fx')}, {PAIRS.sql('pr')}
SELECT p.id, CASE WHEN a.id IS NULL OR contains(p.rule, a.rule) THEN p.rule ELSE p.rule || ' Related rule: ' || a.rule END AS rule, greatest(p.importance, coalesce(a.importance, 0)) AS importance,
array_to_string(p.positive_examples || coalesce(a.positive_examples, []), ',') AS good, array_to_string(p.negative_examples || coalesce(a.negative_examples, []), ',') AS bad,
array_to_string(CASE WHEN a.id IS NULL THEN p.dependencies ELSE list_append(p.dependencies, a.id) || list_filter(a.dependencies, lambda x: NOT list_contains(list_append(p.dependencies, a.id), x)) END, ',') AS deps
FROM fx p LEFT JOIN pr ON pr.kept = p.id LEFT JOIN fx a ON a.id = pr.absorbed WHERE p.id NOT IN (SELECT absorbed FROM pr)""")
def knowledge_merge(spark, sf_dir):
    out = knowledge.merged(POINTS.frame(spark, sf_dir), PAIRS.frame(spark, sf_dir))
    return out.select("id", "rule", "importance", F.array_join("positive_examples", ",").alias("good"), F.array_join("negative_examples", ",").alias("bad"), F.array_join("dependencies", ",").alias("deps"))


FAILURES = Fixture.over(derived.failures, "id string, requirement string, failed string, corrected string", ["VARCHAR"] * 4, [
    ("f1", "sort it in C++", " bad ", " std::sort "), ("f2", "a python loop", "x", "y"), ("f3", "in Rust please", "x", "y"), ("f4", "tell me", "x", "a vector"), ("f5", "tell me", "x", "y"),
])


@query("knowledge_learn", f"""WITH {FAILURES.sql('fx')}, t AS (SELECT *, lower(requirement || ' ' || corrected) AS t FROM fx)
SELECT id, 'When a similar requirement appears, prefer the corrected pattern: ' || trim(corrected) || '. Avoid the failed pattern: ' || trim(failed) || '.' AS rule,
CASE WHEN contains(t, 'c++') OR contains(t, 'std::') OR contains(t, 'vector') THEN 'C++' WHEN contains(t, 'python') THEN 'Python' WHEN contains(t, 'rust') THEN 'Rust' ELSE 'general' END AS domain, 0.85::DOUBLE AS importance FROM t""")
def knowledge_learn(spark, sf_dir):
    return knowledge.learned(FAILURES.frame(spark, sf_dir)).select("id", "rule", "domain", "importance")


@query("knowledge_query")
def knowledge_query(spark, sf_dir):
    """The items of ``benchmark`` as queries against all documents as points; tests compare a fixture with brute force."""
    docs = table(spark, sf_dir, "documents")
    points = docs.select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("domain"), F.coalesce("text", F.lit("")).alias("rule"), F.lit(0.5).alias("importance"), F.array().cast("array<string>").alias("positive_examples"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return knowledge.search(points, asked)


@query("lexical_memory_search", """WITH q AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '')) AS q FROM benchmark),
a AS (SELECT query_id, len(q) AS size, unnest(q) AS tok FROM q),
h AS (SELECT doc_id, unnest(list_distinct(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda t: regexp_replace(t, '^[.,:;()\\[\\]{}]+|[.,:;()\\[\\]{}]+$', '', 'g')))) AS tok FROM documents),
s AS (SELECT query_id, doc_id, round(count(*)::DOUBLE / size, 4) AS score FROM a JOIN h USING (tok) GROUP BY query_id, doc_id, size)
SELECT query_id, rank::INTEGER AS rank, doc_id AS id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 3""")
def lexical_memory_search(spark, sf_dir):
    """Every item of ``benchmark`` as a query against all documents as memories."""
    memories = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), "text")
    return knowledge.memory_search(memories, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 3)


OPS = Fixture.over(derived.operations, "session string, seq long, ops array<string>", ["VARCHAR", "BIGINT", _LIST], [("a", 2, ["loop", "read"]), ("a", 1, ["read", "filter"]), ("a", 3, ["write"]), ("b", 1, ["emit"])])


@query("skeleton_induction", f"""WITH {OPS.sql('fx')}, u AS (SELECT session, seq, unnest(ops) AS op, generate_subscripts(ops, 1) AS k FROM fx), f AS (SELECT session, op, min(seq * 1000 + k) AS place FROM u GROUP BY session, op)
SELECT session, string_agg(op, ',' ORDER BY place) AS ops, array_to_string(list(op ORDER BY place)[1:3], '_') AS name FROM f GROUP BY session""")
def skeleton_induction(spark, sf_dir):
    return knowledge.skeleton(OPS.frame(spark, sf_dir)).select("session", F.array_join("ops", ",").alias("ops"), "name")


# ---- generators

TOPICS = {"zh": ("天气", "交通", "读书"), "en": ("weather", "travel")}


@query("selfplay_tasks", "SELECT format('selfplay_{}_{:06d}', CASE WHEN i % 2 = 0 THEN 'zh' ELSE 'en' END, i) AS prompt_id, CASE WHEN i % 2 = 0 THEN 'zh' ELSE 'en' END AS lang, ['language_understanding', 'rewrite', 'summarization', 'translation', 'tone_control', 'ambiguity_clarification'][(i // 2) % 6 + 1] AS category FROM (SELECT event_id + 5 AS i FROM events)")
def selfplay_tasks(spark, sf_dir):
    """A task for each event, from index 5."""
    return generators.tasks_of(table(spark, sf_dir, "events").select((F.col("event_id") + 5).alias("id")), TOPICS).select("prompt_id", "lang", "category")


LEVELS = Fixture.over(derived.levels, "id int, text string, failed boolean", ["INTEGER", "VARCHAR", "BOOLEAN"], [
    (1, "go X-Open now", False), (2, "ULTRA deep", True), (3, "仔细想", None), (4, "medium, low", True), (5, "Fast!", False), (6, "plain", True), (7, None, None), (8, "无限制", True), (9, "please think deep-ly", False),
])


@query("deliberation_levels", f"""WITH {LEVELS.sql('fx')}, t AS (SELECT *, regexp_replace(lower(text), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', ' ', 'g') AS t FROM fx),
l AS (SELECT *, CASE WHEN regexp_matches(t, '\\bx\\s*open\\b|xopen|开放|無限制|无限制') THEN 4 WHEN regexp_matches(t, 'ultra|超高|全面调研') THEN 3 WHEN regexp_matches(t, 'deep|high|深思|仔细') THEN 2 WHEN regexp_matches(t, 'medium|中等|自检') THEN 1 WHEN regexp_matches(t, 'low|fast|快速|简短') THEN 0 END AS level FROM t)
SELECT id, level, CASE WHEN coalesce(failed, false) THEN least(level + 1, 4) ELSE level END AS raised FROM l WHERE true""")
def deliberation_levels(spark, sf_dir):
    rows = LEVELS.frame(spark, sf_dir).withColumn("level", generators.requested_level(F.col("text")))
    # least() skips nulls in both engines, so a null level that fails becomes the cap
    return rows.select("id", "level", generators.escalated(F.col("level"), F.col("failed"), F.lit(False)).alias("raised"))


# ---- runs

RUNS = Fixture.over(derived.runs, "run string, rejected map<string,long>, source_stats map<string,struct<converted:long,accepted:long,exhausted:boolean>>", ["VARCHAR", "MAP(VARCHAR, BIGINT)", "MAP(VARCHAR, STRUCT(converted BIGINT, accepted BIGINT, exhausted BOOLEAN))"], [
    ("r1", {"too_short": 3, "duplicate": 1}, {"a": {"converted": 5, "accepted": 4, "exhausted": False}, "b": {"converted": 2, "accepted": 2, "exhausted": True}}), ("r2", {"duplicate": 2}, {"a": {"converted": 7, "accepted": 1, "exhausted": True}}), ("r3", {}, None),
])


_STATS = "SELECT unnest(map_entries(source_stats)) AS e FROM fx"


@query("report_merge", f"""WITH {RUNS.sql('fx')}, r AS (SELECT unnest(map_entries(rejected)) AS e FROM fx), s AS ({_STATS})
SELECT 'rejected' AS part, e.key AS key, sum(e.value)::BIGINT AS n, NULL::BIGINT AS accepted, NULL::BOOLEAN AS exhausted FROM r GROUP BY 2
UNION ALL SELECT 'source', e.key, sum(e.value.converted)::BIGINT, sum(e.value.accepted)::BIGINT, bool_or(e.value.exhausted) FROM s GROUP BY 2""")
def report_merge(spark, sf_dir):
    rows = RUNS.frame(spark, sf_dir)
    counts = reports.merge_maps(rows, "rejected").select(F.lit("rejected").alias("part"), "key", "n", F.lit(None).cast("long").alias("accepted"), F.lit(None).cast("boolean").alias("exhausted"))
    return counts.unionByName(reports.merge_source_stats(rows).select(F.lit("source").alias("part"), F.col("source").alias("key"), F.col("converted").alias("n"), "accepted", "exhausted"))


@query("resume_scan", """WITH r AS (SELECT coalesce(lang, '') AS language, coalesce(source, '') AS source, strlen(coalesce(text, '')) + 1 AS n FROM documents)
SELECT 'language' AS part, language AS key, count(*) AS records, sum(n)::BIGINT AS bytes FROM r GROUP BY 2 UNION ALL SELECT 'source', source, count(*), sum(n)::BIGINT FROM r GROUP BY 2 UNION ALL SELECT 'category', 'general', count(*), sum(n)::BIGINT FROM r""")
def resume_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    records = docs.select(F.col("doc_id").alias("seq"), F.coalesce("lang", F.lit("")).alias("language"), F.lit("general").alias("category"), F.coalesce("source", F.lit("")).alias("source"), (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("n_bytes"))
    return sinks.resume_state(records)[0]


FOUND = Fixture.over(derived.found, "path string", ["VARCHAR"], [("run-1/shard-00000.jsonl",), ("run-2/shard-00001.jsonl",), ("run-10/shard-00002.jsonl",), ("run-2/shard-00003.jsonl",)])
MANIFEST = Fixture.over(derived.manifest, "run string, copied array<string>, skipped array<string>", ["VARCHAR", _LIST, _LIST], [("m1", ["run-1/shard-00000.jsonl"], None), ("m2", [], ["run-2/shard-00001.jsonl"])])


@query("shard_lineage", f"WITH {FOUND.sql('fx')}, {MANIFEST.sql('mf')} SELECT path FROM fx WHERE path NOT IN (SELECT unnest(coalesce(copied, []) || coalesce(skipped, [])) FROM mf)")
def shard_lineage(spark, sf_dir):
    return sinks.pending_files(FOUND.frame(spark, sf_dir), MANIFEST.frame(spark, sf_dir))


RAW = Fixture.over(derived.raw, "prompt_id string", ["VARCHAR"], [("p1",), ("p2",), ("p2",), ("p3",)])
TRAIN = Fixture.over(derived.trained, "prompt_id string", ["VARCHAR"], [("p2",), ("p3",), ("p9",)])


@query("completed_prompts", f"WITH {RAW.sql('fx')}, {TRAIN.sql('tr')} SELECT prompt_id FROM fx INTERSECT SELECT prompt_id FROM tr")
def completed_prompts(spark, sf_dir):
    return sinks.completed(RAW.frame(spark, sf_dir), TRAIN.frame(spark, sf_dir))


@query("pending_prompts", f"WITH {RAW.sql('fx')}, {TRAIN.sql('tr')} SELECT prompt_id FROM fx WHERE prompt_id NOT IN (SELECT prompt_id FROM tr)")
def pending_prompts(spark, sf_dir):
    raw = RAW.frame(spark, sf_dir)
    return raw.join(sinks.completed(raw, TRAIN.frame(spark, sf_dir)), "prompt_id", "left_anti")


_FP = "trim(regexp_replace(lower(coalesce({0}, '')), '\\s+', ' ', 'g'))"


@query("seed_dedup_antijoin", f"SELECT doc_id FROM documents d WHERE {_FP.format('d.text')} NOT IN (SELECT {_FP.format('text')} FROM documents WHERE source = (SELECT min(source) FROM documents))")
def seed_dedup_antijoin(spark, sf_dir):
    """Documents whose text the first source doesn't hold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", dedup.fingerprint(F.coalesce("text", F.lit(""))).alias("fp"))
    least = docs.agg(F.min("source").alias("source"))
    return dedup.seeded(docs, docs.join(F.broadcast(least), "source", "left_semi"), "fp").select("doc_id")


KEYS = Fixture.over(derived.keys, "seq long, fp string, thread string", ["BIGINT", "VARCHAR", "VARCHAR"], [(1, "a", "t"), (2, "b", "t"), (3, "b", None), (4, "a", "u"), (5, "c", "u"), (6, "c", None), (7, "b", "v"), (8, "d", "v")])


@query("dual_key_dedup", f"""WITH RECURSIVE {KEYS.sql('fx')}, w AS (SELECT 0::BIGINT AS seq, NULL::VARCHAR AS reason, []::VARCHAR[] AS fps, []::VARCHAR[] AS threads UNION ALL SELECT seq, reason,
CASE WHEN reason IS NULL THEN list_append(fps, fp) ELSE fps END, CASE WHEN reason IS NULL AND thread IS NOT NULL THEN list_append(threads, thread) ELSE threads END
FROM (SELECT f.*, w.fps, w.threads, CASE WHEN list_contains(w.threads, f.thread) THEN 'duplicate_thread' WHEN list_contains(w.fps, f.fp) THEN 'duplicate' END AS reason FROM w JOIN fx f ON f.seq = w.seq + 1))
SELECT seq, reason FROM w WHERE seq > 0""")
def dual_key_dedup(spark, sf_dir):
    return dedup.first_wins(KEYS.frame(spark, sf_dir), cut)


# ---- streams


@query("stream_clean", f"""WITH {C._DOC}, {C.repetition_sql('d', 'doc_id', 'text')} SELECT DISTINCT sha256({_FP.format('text')}) AS fp FROM d LEFT JOIN rep USING (doc_id)
WHERE {C.case_sql(C.strict_sql('text', 'lower(text)', 'coalesce(ratio, 0)'))} IS NULL""")
def stream_clean(spark, sf_dir):
    """Texts that one run of the stream keeps; the file source ends when it has read what is there.  Which of several equal documents comes first is open, so texts are counted by their fingerprint."""
    docs = table(spark, sf_dir, "documents")
    base = shared_folder(spark, "clean")
    rows = stream.table_source(docs, f"{sf_dir}/documents.parquet")
    stream.run(stream.unseen(stream.cleaned(rows.select("text"), F.col("text"))).select("fp"), f"{base}/out", f"{base}/state")
    return spark.read.schema("fp string").parquet(f"{base}/out")
