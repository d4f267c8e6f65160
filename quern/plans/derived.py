"""Rows that Spark derives from the given tables for operators whose own kind of input no table holds.

Each is one SELECT that Spark and the oracle both run; a ``Dialect`` writes what
the two spell differently.
"""

from __future__ import annotations


class Dialect:
    def __init__(self, spark: bool) -> None:
        self.spark = spark

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def struct(self, **fields: str) -> str:
        return f"named_struct({', '.join(f"'{k.rstrip('_')}', {v}" for k, v in fields.items())})" if self.spark else "{" + ", ".join(f"'{k.rstrip('_')}': {v}" for k, v in fields.items()) + "}"

    def map(self, key: str, value: str) -> str:
        return f"map({key}, {value})" if self.spark else f"MAP {{{key}: {value}}}"

    def doubles(self, of: str) -> str:
        return f"CAST({of} AS array<double>)" if self.spark else f"{of}::DOUBLE[]"

    def flat(self, text: str) -> str:
        """A text in ASCII letters, digits and single blanks."""
        return f"trim(regexp_replace({text}, '[^A-Za-z0-9.,?]+', ' '{'' if self.spark else ", 'g'"}))"

    @property
    def none(self) -> str:
        return "CAST(array() AS array<string>)" if self.spark else "[]::VARCHAR[]"


_PAIRS = "conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"
_TEXT = "CAST({} AS STRING)".format
_ID = f"{_TEXT('a.conv_id')} || ':' || {_TEXT('a.turn')}"
_DOC = f"'doc' || {_TEXT('doc_id')}"
_NULL = "CAST(NULL AS STRING)"
_share = lambda c, n: f"CAST({c} % {n} AS DOUBLE) / {n}"
_vec = "FROM embeddings WHERE embedding IS NOT NULL"


def branches(d: Dialect) -> str:
    return "SELECT doc_id + 1000, 'mit', lang, CAST(2 AS INT), coalesce(text, '') FROM documents"


def prompts(d: Dialect) -> str:
    return f"SELECT 'v' || {_ID}, CASE a.conv_id % 3 WHEN 0 THEN 'EN' WHEN 1 THEN 'zh' END, CASE WHEN a.turn % 2 = 0 THEN 'talk' END, {d.flat('a.text')}, {d.flat('b.text')} FROM {_PAIRS}"


def chats(d: Dialect) -> str:
    turns = d.array(d.struct(from_=_NULL, role="a.role", content=d.flat("a.text")), d.struct(from_="'bot'", role=_NULL, content=d.flat("b.text")))
    return f"SELECT 'v' || {_ID}, 'm', 'en', {turns} FROM {_PAIRS}"


def preferences(d: Dialect) -> str:
    context = d.array(d.struct(role="CASE WHEN a.turn % 3 < 2 THEN 'user' ELSE 'assistant' END", content=d.flat("a.text")))
    return f"SELECT 'v' || {_ID}, CAST(a.conv_id % 4 - 1 AS INT), {_NULL}, {d.flat('b.text')}, {d.flat('a.text')}, {context} FROM {_PAIRS} WHERE a.text <> ''"


def transcripts(d: Dialect) -> str:
    return f"SELECT 'v' || {_ID}, 'Human: ' || {d.flat('a.text')} || chr(10) || chr(10) || 'Assistant: ' || {d.flat('b.text')} FROM {_PAIRS}"


def instructions(d: Dialect) -> str:
    return f"SELECT {_DOC}, source, 'Say more about ' || coalesce(source, 'it'), CASE WHEN doc_id % 3 = 0 THEN lang END, {d.flat('text')} FROM documents"


def questions(d: Dialect) -> str:
    answers = d.array(d.struct(text=d.flat("b.text"), score=_TEXT("b.turn"), is_accepted="CASE WHEN a.conv_id % 2 = 0 THEN 'yes' ELSE 'no' END"), d.struct(text="'short'", score="'3'", is_accepted=_NULL))
    return f"SELECT 'v' || {_ID}, 'About ' || a.role, {d.flat('a.text')}, a.role || ', x', {answers}, {_NULL} FROM {_PAIRS} WHERE {d.flat('b.text')} <> ''"


def systems(d: Dialect) -> str:
    return f"SELECT 'v' || {_ID}, CASE WHEN a.turn % 2 = 0 THEN 'Be brief.' ELSE '' END, {d.flat('a.text')}, {d.flat('b.text')} FROM {_PAIRS}"


def taught(d: Dialect) -> str:
    return f"SELECT 'v' || {_ID}, 'en', 'rewrite', {d.flat('a.text')}, {d.flat('b.text')} FROM {_PAIRS} WHERE {d.flat('a.text')} <> '' AND {d.flat('b.text')} <> ''"


def spoken(d: Dialect) -> str:
    return f"SELECT 'v' || {_ID}, 'en', a.role, 'Who spoke in turn ' || {_TEXT('a.turn')} || '?', 'It was the ' || a.role || ', with ' || {_TEXT('length(a.text)')} || ' letters.' FROM {_PAIRS}"


def nodes(d: Dialect) -> str:
    good = f"CASE WHEN conv_id % 5 = 0 AND turn % 4 = 3 THEN {d.doubles(d.array('0.2'))} ELSE {d.doubles(d.array('0.9'))} END"
    parent = f"CASE WHEN turn > 0 THEN 'v' || {_TEXT('conv_id')} || ':' || {_TEXT('turn - 1')} END"
    return f"""SELECT 100 + conv_id * 1000 + turn, 'v' || {_TEXT('conv_id')} || ':' || {_TEXT('turn')}, {parent}, 'V' || {_TEXT('conv_id')},
      CASE WHEN turn % 2 = 0 THEN 'prompter' ELSE 'assistant' END, lower({d.flat('text')}), CAST(turn % 3 AS INT), 'en', conv_id % 11 = 0 AND turn = 2, {d.array("'quality'")}, {good} FROM conversations WHERE {d.flat('text')} <> ''"""


def writes(d: Dialect) -> str:
    return f"SELECT {_DOC}, coalesce(source, ''), {d.flat("coalesce(text, '')")}, {_share('doc_id', 100)}, {d.map("'lang'", "coalesce(lang, '')")} FROM documents"


def confidences(d: Dialect) -> str:
    return f"SELECT vec_id + 1000, {d.doubles('embedding')}, {_share('vec_id', 5)} {_vec}"


def drafts(d: Dialect) -> str:
    three = lambda k: d.array("CAST(label AS INT)", "CAST(vec_id % 3 AS INT)", f"CAST(vec_id % {k} AS INT)")
    return f"SELECT vec_id + 1000, {three(4)}, {three(6)} {_vec} AND label IS NOT NULL"


def losses(d: Dialect) -> str:
    some = lambda *n: d.doubles(d.array(*[f"CAST(vec_id % {k} AS DOUBLE)" for k in n]))
    return f"SELECT vec_id + 1000, {some(7, 5, 11, 3)}, {some(3, 4, 2, 13)} {_vec}"


def units(d: Dialect) -> str:
    """A layer for each user; logits are multiples of 1/256, so that any order of adding gives the same mean."""
    return "SELECT CAST(user_id + 10 AS INT), CASE WHEN event_id % 3 = 0 THEN 'head' ELSE 'ffn' END, CAST(event_id % 1000000 AS INT), CAST(event_id * 7 % 1021 AS DOUBLE) / 256, event_id % 4 > 0 FROM events"


def batches(d: Dialect) -> str:
    return f"SELECT label + 100, vec_id, CASE WHEN label % 2 = 0 OR vec_id % 2 = 0 THEN {d.array('CAST(label AS INT)', 'CAST(vec_id % 9 AS INT)')} END, CASE WHEN vec_id % 3 = 0 THEN {d.doubles(d.array('CAST(vec_id % 4 AS DOUBLE)'))} END {_vec} AND label IS NOT NULL"


def memories(d: Dialect) -> str:
    return f"SELECT 'e' || {_TEXT('event_id')}, {_share('event_id', 97)}, CAST(event_id % 5 AS BIGINT), CAST(event_id AS DOUBLE) * 10, CAST(100 + event_id % 50 AS BIGINT) FROM events"


def points(d: Dialect) -> str:
    return f"SELECT {_DOC}, 'rule ' || {_TEXT('doc_id')}, coalesce(source, 'general'), {_share('doc_id', 10)}, {d.array("coalesce(lang, '')")}, {d.none}, {d.none} FROM documents"


def merges(d: Dialect) -> str:
    return f"SELECT 'doc' || {_TEXT('a.doc_id')}, 'doc' || {_TEXT('b.doc_id')} FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 4 = 0"


def failures(d: Dialect) -> str:
    return f"SELECT {_DOC}, coalesce(lang, '') || ' loop', coalesce(source, ''), {d.flat("coalesce(text, '')")} FROM documents"


def operations(d: Dialect) -> str:
    return f"SELECT 'u' || {_TEXT('user_id')}, CAST(event_id AS BIGINT), {d.array('event_type')} FROM events"


def levels(d: Dialect) -> str:
    return f"SELECT CAST(item_id + 1000 AS INT), {d.flat('text')}, item_id % 2 = 0 FROM benchmark"


def runs(d: Dialect) -> str:
    stats = d.struct(converted="CAST(n_chars AS BIGINT)", accepted="CAST(n_chars % 7 AS BIGINT)", exhausted="doc_id % 50 = 0")
    return f"SELECT {_DOC}, {d.map("coalesce(lang, 'none')", 'CAST(doc_id % 7 AS BIGINT)')}, {d.map("coalesce(source, 'none')", stats)} FROM documents WHERE n_chars IS NOT NULL"


_path = lambda c: f"'docs-' || {_TEXT(c)} || '/shard-' || {_TEXT(c)} || '.jsonl'"


def found(d: Dialect) -> str:
    return f"SELECT {_path('doc_id')} FROM documents"


def manifest(d: Dialect) -> str:
    return f"SELECT {_DOC}, {d.array(_path('doc_id'))}, CASE WHEN quality = 0 THEN {d.array(_path('doc_id + 1'))} END FROM labels"


def sources(d: Dialect) -> str:
    return """SELECT 'docs:' || coalesce(source, '') || ':' || coalesce(lang, ''), 'mit', 'instruction', 'documents', coalesce(lang, 'default'), 'train', CAST(min(doc_id) AS BIGINT), count(*) > 1, coalesce(max(n_chars) > 15000, false)
      FROM documents GROUP BY source, lang"""


def raw(d: Dialect) -> str:
    return f"SELECT {_DOC} FROM documents"


def trained(d: Dialect) -> str:
    return f"SELECT {_DOC} FROM labels WHERE quality = 1"


def keys(d: Dialect) -> str:
    return "SELECT 8 + row_number() OVER (ORDER BY event_id), 'f' || CAST(event_id % 61 AS STRING), CASE WHEN event_id % 3 > 0 THEN 't' || CAST(user_id % 53 AS STRING) END FROM events WHERE event_type = (SELECT min(event_type) FROM events)"


def parameters(d: Dialect) -> str:
    return f"SELECT coalesce(source, 'none') || '.' || {_TEXT('doc_id')}, CAST(coalesce(n_chars, 0) AS BIGINT), doc_id % 2 = 0 FROM documents"


def supervision(d: Dialect) -> str:
    some = lambda *n: d.doubles(d.array(*[f"CAST(vec_id % {k} AS DOUBLE)" for k in n]))
    return f"SELECT vec_id + 1000, CASE WHEN vec_id % 3 = 0 THEN {some(4, 5, 2)} END, {some(7, 5, 11, 3)}, CASE WHEN vec_id % 5 > 0 THEN {some(3, 4)} END {_vec}"


def logits(d: Dialect) -> str:
    return f"SELECT vec_id + 1000, {d.array(d.doubles('embedding'), d.doubles('embedding'), d.doubles('embedding'))}, {d.array(*[f'CAST(vec_id % {k} AS INT)' for k in (5, 7, 9)])} {_vec}"


def executions(d: Dialect) -> str:
    return f"SELECT vec_id + 1000, vec_id % 2 = 0, {d.doubles('embedding')} {_vec}"


def settings(d: Dialect) -> str:
    stage = "CASE doc_id % 4 WHEN 0 THEN 'stage1' WHEN 1 THEN 'stage_sdit' WHEN 2 THEN 'tool_calling' ELSE source END"
    return f"""SELECT doc_id + 1000, source, {stage}, doc_id % 2 = 0, doc_id % 3 = 0, doc_id % 5 = 0, doc_id % 2 = 1, CAST(doc_id % 4 AS INT), doc_id % 7 = 0, CAST(doc_id % 3 AS INT), CAST(doc_id % 6 AS INT), CAST(doc_id % 2 AS INT),
      CAST(n_chars AS BIGINT) * 5000, CAST(doc_id % 4 - 1 AS INT), CASE WHEN doc_id % 3 = 0 THEN 'torch' ELSE lang END, CASE WHEN doc_id % 2 = 0 THEN 'unit' ELSE 'layer' END, CAST(doc_id % 5 - 1 AS INT), CAST(doc_id % 7 - 1 AS INT), CAST(doc_id % 9 - 1 AS INT)
      FROM documents WHERE source IS NOT NULL"""


def records(d: Dialect) -> str:
    some = d.doubles(d.array(*[f"CAST(vec_id % {k} AS DOUBLE) / 2" for k in (7, 5, 11, 3, 13)]))
    return f"SELECT vec_id + 1000, {some}, CAST(3 + vec_id % 4 AS INT) {_vec}"


def changes(d: Dialect) -> str:
    op = "CASE WHEN quality = 0 THEN 'delete' WHEN toxic = 1 THEN 'create' ELSE 'update' END"
    return f"SELECT doc_id AS seq, 'doc' || {_TEXT('doc_id * 2')} AS id, {op} AS op, CASE WHEN doc_id % 3 = 0 THEN 'changed ' || {_TEXT('doc_id')} END AS rule, {_NULL} AS domain, {_share('doc_id', 8)} AS importance, CASE WHEN doc_id % 5 = 0 THEN 'seen' END AS add_positive, {_NULL} AS add_negative FROM labels"
