"""Converters and message trees over small fixtures that reach every branch, and over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import converters as V
from ..operators import trees
from . import derived
from .common import Fixture, literal, table
from .registry import query

_SHOW = "array_join(transform(messages, m -> concat(m.role, '=', m.content)), '~')"


def shown(records):
    """Records in columns that compare easily."""
    keys = F.array_sort(F.map_keys("metadata"))
    return records.select("source", "license_id", "source_id", F.expr(_SHOW).alias("turns"), F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit("="), F.col("metadata")[k])), ";").alias("meta"))


def _pair_sql(ask: str, answer: str) -> str:
    return f"'user=' || {ask} || '~assistant=' || {answer}"


def _id_sql(given: str, text: str) -> str:
    return f"coalesce(nullif(trim({given}), ''), substr(sha256({text}), 1, 16))"


_TIDY = "trim(regexp_replace(regexp_replace(coalesce({0}, ''), '[ \\t]+', ' ', 'g'), '\\s*\\n\\s*', chr(10), 'g'), ' ' || chr(10) || chr(9))"
tidy_sql = _TIDY.format

# ---- prompt and answer in columns

PROMPTS = Fixture.over(derived.prompts, "id string, lang string, domain string, prompt string, response string", ["VARCHAR"] * 5, [
    ("a1", "EN", "mills", "How does  a mill\tgrind?", "Stones turn."), (None, "zh", "", "Line one \n\n  line two", " ok then "), ("  ", None, None, "", "lost"), ("a4", "en", None, None, "lost"),
    ("a5", "en", "x", "Why?", "   "), ("", "", "y", "Same", "Same"),
])


@query("conv_from_prompt_target", f"""WITH {PROMPTS.sql('fx')}, t AS (SELECT *, {tidy_sql('prompt')} AS p, {tidy_sql('response')} AS r FROM fx)
SELECT 'demo' AS source, 'mit' AS license_id, {_id_sql('id', "p || chr(10) || r")} AS source_id, {_pair_sql('p', 'r')} AS turns,
concat_ws(';', 'domain=' || nullif(domain, ''), 'language=' || nullif(lower(lang), '')) AS meta FROM t WHERE p <> '' AND r <> ''""")
def conv_from_prompt_target(spark, sf_dir):
    return shown(V.convert(PROMPTS.frame(spark, sf_dir), "prompt_target", "demo", "MIT"))


# ---- chats of turns

_TURN = "STRUCT(\"from\" VARCHAR, role VARCHAR, content VARCHAR)[]"
CHATS = Fixture.over(derived.chats, "id string, model string, language string, conversation array<struct<from:string,role:string,content:string>>", ["VARCHAR", "VARCHAR", "VARCHAR", _TURN], [
    ("c1", "m", "English", [{"from": None, "role": "User", "content": "hi"}, {"from": None, "role": "user", "content": "there"}, {"from": "gpt", "role": None, "content": "yes"}]),
    (None, "", "EN", [{"from": "human", "role": "", "content": "q"}, {"from": "system", "role": None, "content": "no"}, {"from": "bot", "role": None, "content": "a"}]),
    ("c3", "m", "en", [{"from": "system", "role": None, "content": "alone"}]), ("c4", "m", "en", []), ("c5", "m", "en", [{"from": "human", "role": None, "content": " "}]),
])


@query("conv_from_wildchat", f"""WITH {CHATS.sql('fx')}, t AS (SELECT row_number() OVER () AS n, * FROM fx), u AS (SELECT n, unnest(conversation) AS m, generate_subscripts(conversation, 1) AS k FROM t),
r AS (SELECT n, k, lower(trim(coalesce(nullif(m.role, ''), m."from"))) AS raw, trim(m.content) AS content FROM u),
v AS (SELECT *, CASE WHEN raw IN ('user', 'human', 'prompter') THEN 'user' WHEN raw IN ('assistant', 'gpt', 'chatbot', 'bot') THEN 'assistant' END AS role FROM r WHERE content <> ''),
w AS (SELECT *, sum(new) OVER (PARTITION BY n ORDER BY k) AS i FROM (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY n ORDER BY k) = role THEN 0 ELSE 1 END AS new FROM v WHERE role IS NOT NULL)),
x AS (SELECT n, i, first(role) AS role, string_agg(content, chr(10) ORDER BY k) AS content FROM w GROUP BY n, i),
y AS (SELECT n, string_agg(role || '=' || content, '~' ORDER BY i) AS turns, string_agg(content, chr(10) ORDER BY i) AS body FROM x GROUP BY n)
SELECT 'chat' AS source, 'odc-by' AS license_id, {_id_sql('id', 'body')} AS source_id, turns, concat_ws(';', 'language=' || lower(language), 'model=' || nullif(model, ''), 'redacted=false') AS meta FROM t JOIN y USING (n)""")
def conv_from_wildchat(spark, sf_dir):
    return shown(V.convert(CHATS.frame(spark, sf_dir), "wildchat", "chat", "ODC-BY"))


# ---- preferences

PREFERENCES = Fixture.over(derived.preferences, "id string, overall_preference int, prompt string, response1 string, response2 string, context array<struct<role:string,content:string>>", ["VARCHAR", "INTEGER", "VARCHAR", "VARCHAR", "VARCHAR", "STRUCT(role VARCHAR, content VARCHAR)[]"], [
    ("p1", 2, None, "one", "two", [{"role": "user", "content": "q"}]), ("p2", -1, None, "one", "two", [{"role": "user", "content": "q"}, {"role": "assistant", "content": "old"}]),
    ("p3", 0, None, "one", "two", [{"role": "user", "content": "q"}]), ("p4", None, None, "one", "two", [{"role": "user", "content": "q"}]), ("p5", 1, "ask", "one", "two", []),
    ("p6", 1, "", "one", "two", []), ("p7", 1, "ask", "one", "", []), ("p8", 3, None, "one", "two", [{"role": "assistant", "content": "first"}]),
])


@query("conv_from_helpsteer3", f"""WITH {PREFERENCES.sql('fx')}, t AS (SELECT *, CASE WHEN overall_preference > 0 THEN response2 ELSE response1 END AS c, len(context) AS n FROM fx WHERE overall_preference <> 0)
SELECT 'pref' AS source, 'cc-by-4.0' AS license_id, id AS source_id, CASE WHEN n = 0 THEN 'user=' || prompt ELSE 'user=' || context[1].content END || '~assistant=' || c AS turns,
'chosen_response=' || CASE WHEN overall_preference > 0 THEN 'response2' ELSE 'response1' END || ';preference=' || overall_preference AS meta
FROM t WHERE c <> '' AND CASE WHEN n = 0 THEN prompt <> '' ELSE context[1].role = 'user' END""")
def conv_from_helpsteer3(spark, sf_dir):
    return shown(V.convert(PREFERENCES.frame(spark, sf_dir), "preference", "pref", "CC-BY-4.0"))


# ---- transcripts

TRANSCRIPTS = Fixture.over(derived.transcripts, "id string, chosen string", ["VARCHAR", "VARCHAR"], [
    ("t1", "\n\nHuman: hello\n\nAssistant: well met"), ("t2", "Human: a\nHuman: b\nAssistant: c\nmore"), ("t3", "Assistant: first"), ("t4", "no roles"), ("t5", None), (None, "Human: q\n\nAssistant: r"),
    ("t7", "Human: q\n\nAssistant:   "),
])


@query("conv_from_hh_rlhf", f"""WITH {TRANSCRIPTS.sql('fx')}, t AS (SELECT row_number() OVER () AS n, id, chosen FROM fx),
u AS (SELECT n, generate_subscripts(roles, 1) AS k, unnest(roles) AS who, unnest(parts[2:]) AS content FROM (SELECT n, regexp_extract_all(chosen, '(?m)^\\s*(Human|Assistant):\\s*', 1) AS roles, regexp_split_to_array(chosen, '(?m)^\\s*(Human|Assistant):\\s*') AS parts FROM t)),
v AS (SELECT n, k, CASE who WHEN 'Human' THEN 'user' ELSE 'assistant' END AS role, {tidy_sql('content')} AS content FROM u WHERE {tidy_sql('content')} <> ''),
w AS (SELECT *, sum(new) OVER (PARTITION BY n ORDER BY k) AS i FROM (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY n ORDER BY k) = role THEN 0 ELSE 1 END AS new FROM v)),
x AS (SELECT n, i, first(role) AS role, string_agg(content, chr(10) ORDER BY k) AS content FROM w GROUP BY n, i),
y AS (SELECT n, string_agg(role || '=' || content, '~' ORDER BY i) AS turns, string_agg(content, chr(10) ORDER BY i) AS body FROM x GROUP BY n HAVING count(*) % 2 = 0 AND arg_min(role, i) = 'user')
SELECT 'hh' AS source, 'mit' AS license_id, {_id_sql('id', 'body')} AS source_id, turns, 'language=en' AS meta FROM t JOIN y USING (n)""")
def conv_from_hh_rlhf(spark, sf_dir):
    return shown(V.convert(TRANSCRIPTS.frame(spark, sf_dir), "transcript", "hh", "mit"))


# ---- instructions, with and without context

INSTRUCTIONS = Fixture.over(derived.instructions, "id string, category string, instruction string, context string, response string", ["VARCHAR"] * 5, [
    ("d1", "qa", " Say why ", "Some  context", "Because"), ("d2", None, "Say how", " ", "So"), (None, "x", "a", None, "b"), ("d4", "x", "", "c", "b"), ("d5", "x", "a", "c", None),
])
_DOLLY = "trim(instruction) || CASE WHEN trim(coalesce(context, '')) = '' THEN '' ELSE chr(10) || chr(10) || 'Context:' || chr(10) || trim(context) END"


@query("conv_from_dolly", f"""WITH {INSTRUCTIONS.sql('fx')}, t AS (SELECT *, {_DOLLY} AS p, trim(response) AS r FROM fx)
SELECT 'dolly' AS source, 'cc-by-sa-3.0' AS license_id, {_id_sql('id', 'p || chr(10) || r')} AS source_id, {_pair_sql('p', 'r')} AS turns, concat_ws(';', 'category=' || category, 'language=en') AS meta FROM t WHERE trim(instruction) <> '' AND r <> ''""")
def conv_from_dolly(spark, sf_dir):
    return shown(V.convert(INSTRUCTIONS.frame(spark, sf_dir), "instruction", "dolly", "cc-by-sa-3.0"))


# ---- questions with several answers

QUESTIONS = Fixture.over(derived.questions, "qid string, title string, body string, tags string, answers array<struct<text:string,score:string,is_accepted:string>>, answer string", ["VARCHAR"] * 4 + ["STRUCT(\"text\" VARCHAR, score VARCHAR, is_accepted VARCHAR)[]", "VARCHAR"], [
    ("q1", "Why", "Because of rain", "a, b;c", [{"text": "low", "score": "1", "is_accepted": "false"}, {"text": "high", "score": "7", "is_accepted": "no"}], None),
    ("q2", "RAIN", "why rain falls", None, [{"text": "liked", "score": "9", "is_accepted": None}, {"text": "taken", "score": None, "is_accepted": "Yes"}], None),
    ("q3", "", "tied", "", [{"text": "one", "score": "2", "is_accepted": None}, {"text": "two", "score": "2", "is_accepted": None}], "plain"), ("q4", "none", "none", "x", [], None),
    ("q5", "only", None, "x|y", [], "alone"), (None, "no id", None, "z", [{"text": "2.5 it is", "score": "2.5", "is_accepted": None}], None), ("q7", None, None, None, [], "no question"),
])


@query("conv_from_stack_exchange", f"""WITH {QUESTIONS.sql('fx')}, t AS (SELECT row_number() OVER () AS n, * FROM fx),
c AS (SELECT n, generate_subscripts(answers, 1) AS k, unnest(answers) AS a FROM t), d AS (SELECT n, k, a."text" AS body, try_cast(a.score AS DOUBLE) AS score, coalesce(lower(a.is_accepted) IN ('1', 'true', 'yes', 'y', 'accepted', 'chosen', 'preferred'), false) AS ok, 'answers[' || (k - 1) || ']' AS origin FROM c
  UNION ALL SELECT n, 100, answer, NULL, false, 'answer' FROM t WHERE coalesce(answer, '') <> ''),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY ok DESC, coalesce(score, -1000000) DESC, length(body) DESC, k) AS place FROM d) WHERE place = 1),
q AS (SELECT t.n, qid, tags, CASE WHEN coalesce(title, '') <> '' AND coalesce(t.body, '') <> '' AND NOT contains(lower(t.body), lower(title)) THEN title || chr(10) || chr(10) || t.body WHEN coalesce(t.body, '') <> '' THEN t.body ELSE title END AS p, b.body AS r, score, ok, origin FROM t JOIN b ON t.n = b.n)
SELECT 'stack' AS source, 'cc-by-sa-4.0' AS license_id, {_id_sql('qid', 'p || chr(10) || r')} AS source_id, {_pair_sql('p', 'r')} AS turns,
concat_ws(';', 'answer_accepted=' || ok, 'answer_score=' || CASE WHEN score = floor(score) THEN score::BIGINT::VARCHAR ELSE score::VARCHAR END, 'language=en', 'preference_source=' || origin, 'tags=' || nullif(array_to_string(list_filter(regexp_split_to_array(tags, '[,;| ]+'), lambda x: x <> ''), ','), '')) AS meta FROM q WHERE p <> ''""")
def conv_from_stack_exchange(spark, sf_dir):
    return shown(V.convert(QUESTIONS.frame(spark, sf_dir), "question_answers", "stack", "cc-by-sa-4.0"))


SYSTEMS = Fixture.over(derived.systems, "id string, system_prompt string, question string, response string", ["VARCHAR"] * 4, [
    ("o1", "Be brief.", "What is rye?", "A grain."), ("o2", "", "What is oat?", "A grain too."), ("o3", "x", None, "lost"), ("o4", "x", "lost", " "), (None, None, "bare", "answer"),
])
_ORCA = "CASE WHEN coalesce(system_prompt, '') = '' THEN question ELSE 'System:' || chr(10) || system_prompt || chr(10) || chr(10) || 'User:' || chr(10) || question END"


@query("conv_from_openorca", f"""WITH {SYSTEMS.sql('fx')}, t AS (SELECT *, {_ORCA} AS p FROM fx WHERE coalesce(question, '') <> '' AND trim(coalesce(response, '')) <> '')
SELECT 'orca' AS source, 'mit' AS license_id, {_id_sql('id', 'p || chr(10) || response')} AS source_id, {_pair_sql('p', 'response')} AS turns, 'has_system_prompt=' || (coalesce(system_prompt, '') <> '') || ';language=en;synthetic=true' AS meta FROM t""")
def conv_from_openorca(spark, sf_dir):
    return shown(V.convert(SYSTEMS.frame(spark, sf_dir), "system_question", "orca", "mit"))


TAUGHT = Fixture.over(derived.taught, "prompt_id string, lang string, category string, user string, answer string", ["VARCHAR"] * 5, [("k1", "en", "rewrite", "Make it short", " Short. "), ("k2", "zh", "rewrite", "改写", "好")])


@query("conv_from_distilled", f"""WITH {TAUGHT.sql('fx')} SELECT 'distill:own:teacher' AS source, 'mit' AS license_id, prompt_id AS source_id, {_pair_sql('"user"', 'trim(answer)')} AS turns,
'distill_source=api;language=' || lang || ';prompt_id=' || prompt_id || ';provider=own;teacher_model=teacher' AS meta FROM fx""")
def conv_from_distilled(spark, sf_dir):
    return shown(V.distilled(TAUGHT.frame(spark, sf_dir), "own", "teacher", "MIT"))


SPOKEN = Fixture.over(derived.spoken, "prompt_id string, lang string, topic string, user string, answer string", ["VARCHAR"] * 5, [
    ("s1", "en", "mills", '"User: how do mills work?"', "Assistant: stones turn"), ("s2", "en", "mills", "assistant: I speak", "fine"), ("s3", "en", "mills", "fine", "my password is x"),
    ("s4", "en", "mills", "u" * 1201, "fine"), ("s5", "zh", "磨", "用户：磨怎么转？", "“石头转”"), ("s6", "en", "x", "one Ã two Ã", "fine"), ("s7", "en", "x", "gap\n\n\n\nend", "fine"),
])


@query("conv_from_selfplay", f"""WITH {SPOKEN.sql('fx')}, t AS (SELECT *, CASE prompt_id WHEN 's1' THEN 'how do mills work?' WHEN 's5' THEN '磨怎么转？' WHEN 's7' THEN 'gap' || chr(10) || chr(10) || 'end' ELSE CASE WHEN starts_with(prompt_id, 'v') THEN "user" END END AS p, CASE prompt_id WHEN 's1' THEN 'stones turn' WHEN 's5' THEN '石头转' ELSE answer END AS r FROM fx)
SELECT 'selfplay:a:m->b:n' AS source, 'mit' AS license_id, prompt_id AS source_id, {_pair_sql('p', 'r')} AS turns, 'language=' || lang || ';prompt_id=' || prompt_id || ';topic=' || topic AS meta FROM t WHERE p IS NOT NULL""")
def conv_from_selfplay(spark, sf_dir):
    return shown(V.selfplay(SPOKEN.frame(spark, sf_dir), ("a", "m"), ("b", "n"), "mit"))


_MARKS = ", ".join(map(literal, V.EN_ZH))


@query("row_language", f"""SELECT doc_id, CASE WHEN lower(trim(lang)) IN ({_MARKS}) THEN true WHEN lang IS NOT NULL THEN false
ELSE regexp_matches(coalesce(text, ''), '[\\x{{4e00}}-\\x{{9fff}}]') OR (len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]')) >= 40 AND len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]')) >= greatest(length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')), 1) * 0.35::DOUBLE) END AS kept FROM documents""")
def row_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return docs.select("doc_id", V.english_or_chinese(docs, "none", "text").alias("kept"))


# ---- trees

NODES = Fixture.over(derived.nodes, "seq long, message_id string, parent_id string, tree_id string, role string, text string, rank int, lang string, deleted boolean, names array<string>, vals array<double>", ["BIGINT"] + ["VARCHAR"] * 5 + ["INTEGER", "VARCHAR", "BOOLEAN", "VARCHAR[]", "DOUBLE[]"], [
    (1, "r", None, "T", "prompter", "ask", None, "en", False, ["quality"], [0.9]), (2, "a", "r", "T", "assistant", "one", 1, "en", False, [], []), (3, "b", "r", "T", "assistant", "two", 0, "en", False, ["spam"], [0.35]),
    (4, "c", "a", "T", "prompter", "more", None, "en", False, [], []), (5, "d", "c", "T", "assistant", "last", 0, "en", False, ["toxicity"], [0.5]), (6, "e", "c", "T", "assistant", "last", 1, "en", False, [], []),
    (7, "f", "gone", "U", "assistant", "orphan", 0, "en", False, [], []), (8, "g", "gone", "U", "prompter", "mid", 0, "en", False, [], []), (9, "h", "g", "U", "assistant", "reply", 0, "zh", None, None, None),
    (10, "i", None, "V", "prompter", "fr", 0, "fr", False, [], []), (11, "j", "i", "V", "assistant", "x", 0, "en", False, [], []), (12, "k", "r", "T", "assistant", "away", 0, "en", True, [], []),
    (13, "l", "r", "T", "assistant", "poor", 0, "en", False, ["quality", "quality"], [0.9, 0.2]), (14, "m", "r", "T", "assistant", "fine", 2, "en", False, ["quality", "quality"], [0.2, 0.9]),
])
_LABEL = lambda n: f"list_last(list_filter(list_zip(names, vals), lambda x: x[1] = '{n}'))[2]"
_OUT = (f"(coalesce(deleted, false) OR coalesce({_LABEL('quality')}, 1) < 0.35 OR coalesce({_LABEL('toxicity')}, 0) >= 0.55 OR " + " OR ".join(f"coalesce({_LABEL(n)}, 0) >= 0.35" for n in trees.BAD_LABELS)
        + " OR lang NOT IN ('en', 'eng', 'english', 'zh', 'zh-cn', 'chinese'))")


def _rejected():
    return trees.rejected(F.col("deleted"), F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), F.col("names"), F.col("vals"), F.col("lang"))


@query("oasst_label_gate", f"WITH {NODES.sql('fx')} SELECT message_id, {_OUT} AS rejected FROM fx")
def oasst_label_gate(spark, sf_dir):
    return NODES.frame(spark, sf_dir).select("message_id", _rejected().alias("rejected"))


@query("oasst_tree_paths", f"""WITH RECURSIVE {NODES.sql('fx')}, kept AS (SELECT *, CASE role WHEN 'prompter' THEN 'user' ELSE role END AS who FROM fx WHERE NOT {_OUT}),
walk AS (SELECT message_id AS leaf, tree_id, rank, seq, lang, parent_id, who || '=' || text AS turns, 1 AS n, who AS top FROM kept k WHERE who = 'assistant' AND NOT EXISTS (SELECT 1 FROM kept c WHERE c.parent_id = k.message_id)
  UNION ALL SELECT leaf, walk.tree_id, walk.rank, walk.seq, walk.lang, kept.parent_id, kept.who || '=' || text || '~' || turns, n + 1, kept.who FROM walk JOIN kept ON kept.message_id = walk.parent_id),
whole AS (SELECT * FROM walk WHERE top = 'user' AND n % 2 = 0 AND NOT EXISTS (SELECT 1 FROM kept WHERE kept.message_id = walk.parent_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY turns ORDER BY tree_id, coalesce(rank, 999), seq) AS place FROM whole)
SELECT 'trees' AS source, 'apache-2.0' AS license_id, tree_id || ':' || leaf AS source_id, turns, 'language=' || lang || ';message_tree_id=' || tree_id AS meta FROM ranked WHERE place = 1""")
def oasst_tree_paths(spark, sf_dir):
    return shown(trees.conversations(NODES.frame(spark, sf_dir).where(~_rejected()), "trees", "Apache-2.0"))


@query("conv_linear_tree_paths", """WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS depth FROM conversations)
SELECT conv_id || ':' || turn AS id, depth, conv_id || ':' || first_value(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS root FROM n""")
def conv_linear_tree_paths(spark, sf_dir):
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    nodes = turns.select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.when(before.isNotNull(), F.concat_ws(":", "conv_id", before)).alias("parent"))
    return trees.ancestor_paths(nodes).select("id", F.size("path").cast("long").alias("depth"), F.element_at("path", 1).alias("root"))
