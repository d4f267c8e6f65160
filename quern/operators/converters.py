"""Rows of public dialogue formats to one record: source, license_id, source_id, messages, metadata.

Each converter takes a DataFrame with whichever of the known columns it has,
and gives one row for each input row that holds a usable conversation.  Nulls
and blank texts count as missing; a missing id becomes the first 16 hex digits
of the SHA-256 of the text.  All of it is one projection and one filter.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import signals as S
from ..functions import text as X
from .conversations import MESSAGES, alternates, merged

# Field names of the formats, in order of preference, and markers.
LANGUAGE_FIELDS = ("language_code", "language", "lang", "locale")
ACCEPTED_WORDS = ("1", "true", "yes", "y", "accepted", "chosen", "preferred")
ANSWER_FIELDS = ("chosen", "accepted", "accepted_answer", "best_answer", "answer", "response", "output", "completion")
ACCEPTED_FIELDS = ("chosen", "accepted", "accepted_answer", "best_answer")
PAIR_FIELDS = (("response_j", "score_j"), ("response_k", "score_k"), ("answer_j", "score_j"), ("answer_k", "score_k"))
EN_ZH = ("en", "eng", "english", "zh", "zho", "cmn", "chinese", "zh-cn", "zh-hans", "zh-hant", "simplified chinese", "traditional chinese", "yue")
GENERATED_MOJIBAKE = ("�", "Ã", "â€", "鈥", "鎴", "鐭", "涔", "轰", "粈", "繖", "娆", "椤圭", "洰", "寤", "舵", "湡", "鍥", "炵", "瓟", "锛", "銆", "俓")
BANNED = ("api key", "password", "sk-", "-----begin", "bomb", "malware")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _compose_all(x: pd.Series) -> pd.Series:
    return x.map(lambda a: None if a is None else [t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in a])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _unescape_all(x: pd.Series) -> pd.Series:
    return x.map(lambda a: None if a is None else [None if t is None else html.unescape(t) for t in a])


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _text(rows: DataFrame, name: str) -> Column:
    """A column of any type as text; null where it is absent."""
    if name not in rows.columns:
        return F.lit(None).cast("string")
    kind = rows.schema[name].dataType
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)):
        return F.array_join(F.col(name).cast("array<string>"), "\n")
    return F.to_json(name) if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)) else F.col(name).cast("string")


def first(rows: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of the columns that isn't blank, stripped; '' if none."""
    return F.coalesce(*[F.nullif(strip(_text(rows, n)), F.lit("")) for n in names], F.lit(""))


def _source(rows: DataFrame, names: tuple[str, ...]) -> Column:
    return X.clean_html(first(rows, names)) if set(names) & set(rows.columns) else F.lit("")


def turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _pair(prompt: Column, answer: Column) -> Column:
    return F.array(turn("user", prompt), turn("assistant", answer))


def _contents(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: m["content"]), "\n")


def _once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that are computed once a row, however often later ones speak of them: no expression is merged across a generator."""
    made = rows.withColumns(columns)
    return made.select(*[c for c in made.columns if c not in columns], F.inline(F.array(F.struct(*columns))))


def messages_of(rows: DataFrame, name: str) -> Column:
    """An array column of turns, whatever its fields are called, as merged messages of composed, tidy text."""
    if name not in rows.columns:
        return F.expr(f"cast(array() as {MESSAGES})")
    fields = rows.schema[name].dataType.elementType.names
    pick = lambda m, names: F.coalesce(*[F.nullif(m[n].cast("string"), F.lit("")) for n in names if n in fields], F.lit(""))
    roles = F.transform(name, lambda m: pick(m, ("role", "from")))
    texts = _compose_all(F.transform(name, lambda m: pick(m, ("content", "value", "text"))))
    turns = F.zip_with(roles, texts, lambda r, t: F.struct(r.alias("role"), X.tidy(t).alias("content")))
    return F.coalesce(merged(turns), F.expr(f"cast(array() as {MESSAGES})"))


def _record(rows: DataFrame, source: str, license_id: str, messages: Column, ids: tuple[str, ...], meta: dict[str, Column], usable=None, text: Column | None = None) -> DataFrame:
    """``usable`` and ``text`` (what a missing id is made of) refer to the column ``messages``."""
    out = rows.withColumn("messages", messages).where(F.size("messages") > 0)
    out = out if usable is None else out.where(usable)
    made = F.substring(F.sha2(_contents(F.col("messages")) if text is None else text, 256), 1, 16)
    flat = F.create_map(*[x for k, v in meta.items() for x in (F.lit(k), v.cast("string"))])
    return out.select(
        F.lit(source).alias("source"), F.lit(license_id.lower()).alias("license_id"), F.coalesce(F.nullif(first(rows, ids), F.lit("")), made).alias("source_id"), "messages",
        F.map_filter(flat, lambda k, v: v.isNotNull() & (v != "")).alias("metadata"),
    )


def _filled() -> Column:
    return F.forall("messages", lambda m: m["content"] != "")


def wildchat(rows: DataFrame, source: str, license_id: str) -> DataFrame:
    """Chats with a model: turns in ``conversation``, else in ``messages``."""
    a, b = messages_of(rows, "conversation"), messages_of(rows, "messages")
    held = rows.withColumns({"_a": a, "_b": b})
    meta = {"model": first(rows, ("model", "model_name")), "language": F.lower(first(rows, ("language", "lang"))), "redacted": F.coalesce(_text(rows, "redacted").cast("boolean"), F.lit(False))}
    return _record(held, source, license_id, F.when(F.size("_a") > 0, F.col("_a")).otherwise(F.col("_b")), ("conversation_hash", "id", "conversation_id"), meta)


def prompt_target(rows: DataFrame, source: str, license_id: str, prompt: str = "prompt", target: str = "response") -> DataFrame:
    """One prompt and one answer in named columns."""
    ask, answer = (X.clean_text(F.coalesce(_text(rows, n), F.lit(""))) for n in (prompt, target))
    meta = {"language": F.lower(first(rows, LANGUAGE_FIELDS)), "domain": first(rows, ("domain", "task_type", "subdomain")), "annotation_type": _text(rows, "annotation_type")}
    return _record(rows, source, license_id, _pair(ask, answer), ("id", "example_id", "sample_id", "question_id"), meta, _filled())


def preference(rows: DataFrame, source: str, license_id: str) -> DataFrame:
    """A context and two responses with a signed preference: above zero the second is chosen, below the first, zero or none drops the row."""
    p = F.expr("try_cast(overall_preference as int)")
    chosen = X.clean_text(F.coalesce(F.when(p > 0, _text(rows, "response2")).otherwise(_text(rows, "response1")), F.lit("")))
    held = rows.where(p != 0).withColumns({"_base": messages_of(rows, "context"), "_chosen": chosen, "_prompt": X.clean_text(first(rows, ("prompt", "question", "instruction")))}).where("_chosen <> ''")
    base, answer = F.col("_base"), turn("assistant", F.col("_chosen"))
    none = F.size(base) == 0
    said = F.try_element_at(base, F.lit(-1))["role"] == "user"
    messages = F.when(none, F.array(turn("user", F.col("_prompt")), answer)).when(said, F.concat(base, F.array(answer))).otherwise(F.concat(F.slice(base, F.lit(1), F.greatest(F.size(base) - 1, F.lit(0))), F.array(answer)))
    meta = {"domain": _text(rows, "domain"), "language": F.lower(first(rows, ("language", "language_code", "locale"))), "preference": p, "chosen_response": F.when(p > 0, "response2").otherwise("response1")}
    return _record(held, source, license_id, messages, ("id", "sample_id", "conversation_id"), meta, _filled() & alternates(F.col("messages")))


def transcript(rows: DataFrame, source: str, license_id: str) -> DataFrame:
    """``Human:`` and ``Assistant:`` lines in one text, ``chosen``."""
    mark = r"(?mdU)^\s*(Human|Assistant):\s*"
    whole = F.coalesce(_text(rows, "chosen"), F.lit(""))
    parts = F.split(whole, mark)
    roles, texts = F.regexp_extract_all(whole, F.lit(mark), F.lit(1)), _compose_all(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))))
    turns = F.zip_with(roles, texts, lambda r, t: F.struct(r.alias("role"), X.tidy(t).alias("content")))
    return _record(rows, source, license_id, merged(turns), ("id", "sample_id"), {"language": F.lit("en")}, alternates(F.col("messages")))


def instruction(rows: DataFrame, source: str, license_id: str) -> DataFrame:
    """Instruction, optional context, response; texts are stripped and otherwise kept."""
    context = first(rows, ("context",))
    ask = F.concat(first(rows, ("instruction",)), F.when(context != "", F.concat(F.lit("\n\nContext:\n"), context)).otherwise(""))
    meta = {"category": first(rows, ("category",)), "language": F.lit("en")}
    return _record(rows.where(first(rows, ("instruction",)) != ""), source, license_id, _pair(ask, first(rows, ("response",))), ("id", "index"), meta, _filled())


def _answers(rows: DataFrame) -> Column:
    """All answers of a row as structs of raw text, score, accepted and where they are from, in their order."""
    kind = "array<struct<raw:string,score:double,accepted:boolean,origin:string>>"
    number = lambda c: c.try_cast("double")
    item = lambda raw, score, ok, origin: F.struct(raw.alias("raw"), score.alias("score"), ok.alias("accepted"), origin.alias("origin"))
    groups = []
    if "answers" in rows.columns:
        inner = rows.schema["answers"].dataType.elementType
        if isinstance(inner, T.StructType):
            pick = lambda m, names: F.coalesce(*[F.nullif(strip(m[n].cast("string")), F.lit("")) for n in names if n in inner.names], F.lit(""))
            one = lambda m, k: item(pick(m, ("text", "body", "answer", "response", "content")), number(pick(m, ("score", "upvotes", "pm_score", "rank"))), F.lower(pick(m, ("is_accepted", "accepted", "chosen", "selected"))).isin(*ACCEPTED_WORDS), F.format_string("answers[%d]", k))
        else:
            one = lambda m, k: item(m.cast("string"), F.lit(None).cast("double"), F.lit(False), F.format_string("answers[%d]", k))
        groups.append(F.coalesce(F.transform("answers", one), F.expr(f"cast(array() as {kind})")))
    singles = [item(first(rows, (k,)), number(first(rows, (f"{k}_score", "score", "pm_score"))), F.lit(k in ACCEPTED_FIELDS), F.lit(k)) for k in ANSWER_FIELDS if k in rows.columns]
    singles += [item(first(rows, (k,)), number(first(rows, (s,))), F.lit(False), F.lit(k)) for k, s in PAIR_FIELDS if k in rows.columns]
    groups += [F.array(*singles)] if singles else []
    return F.concat(*[g.cast(kind) for g in groups]) if groups else F.expr(f"cast(array() as {kind})")


def question_answers(rows: DataFrame, source: str, license_id: str) -> DataFrame:
    """A question with several answers: accepted before others, then the higher score, then the longer text, then the earlier."""
    held = _once(rows, {"_answers": _answers(rows), "_title": _source(rows, ("title", "question_title")), "_body": _source(rows, ("question", "body", "prompt", "instruction", "input"))})
    texts = F.transform(_unescape_all(F.transform("_answers", lambda a: a["raw"])), lambda t: X.clean_html(t, entities=False))
    held = _once(held, {"_texts": texts})
    ranked = F.transform("_answers", lambda a, k: F.struct(a["accepted"].alias("ok"), F.coalesce(a["score"], F.lit(-1e6)).alias("order"), F.length(F.get(F.col("_texts"), k)).alias("size"), (-k).alias("place"), F.get(F.col("_texts"), k).alias("text"), a["score"].alias("score"), a["origin"].alias("origin")))
    held = _once(held, {"_best": F.array_max(F.filter(ranked, lambda a: a["text"] != ""))})
    title, body = F.col("_title"), F.col("_body")
    ask = F.when((title != "") & (body != "") & ~F.contains(F.lower(body), F.lower(title)), F.concat(title, F.lit("\n\n"), body)).when(body != "", body).otherwise(title)
    score = F.col("_best.score")
    shown = F.when(score == F.floor(score), score.cast("long").cast("string")).otherwise(score.cast("string"))
    tags = [F.array_join(F.filter(F.transform(F.col(n), lambda t: strip(t.cast("string"))), lambda t: t != ""), ",") if isinstance(rows.schema[n].dataType, T.ArrayType) else F.array_join(F.filter(F.split(F.col(n).cast("string"), "[,;| ]+"), lambda t: t != ""), ",") for n in ("tags", "tag", "categories") if n in rows.columns]
    meta = {"language": F.lower(F.coalesce(F.nullif(_source(rows, ("language", "lang", "locale")), F.lit("")), F.lit("en"))), "site": _source(rows, ("site", "site_name", "subreddit")),
            "tags": F.coalesce(*[F.nullif(t, F.lit("")) for t in tags], F.lit("")), "answer_score": shown, "answer_accepted": F.col("_best.ok"), "preference_source": F.col("_best.origin")}
    held = _once(held.where("_best is not null"), {"_ask": ask})
    return _record(held, source, license_id, _pair(F.col("_ask"), F.col("_best.text")), ("qid", "question_id", "post_id", "id", "prompt_id", "sample_id"), meta, _filled())


def system_question(rows: DataFrame, source: str, license_id: str) -> DataFrame:
    """Question and answer under an optional system prompt; answers are synthetic."""
    system, question = _source(rows, ("system_prompt", "system", "system_instruction")), _source(rows, ("question", "prompt", "instruction", "input"))
    held = rows.withColumns({"_system": system, "_question": question, "_answer": _source(rows, ("response", "answer", "output", "completion"))}).where("_question <> ''")
    ask = F.when(F.col("_system") == "", F.col("_question")).otherwise(F.concat(F.lit("System:\n"), F.col("_system"), F.lit("\n\nUser:\n"), F.col("_question")))
    meta = {"language": F.lower(F.coalesce(F.nullif(_source(rows, ("language", "lang", "locale")), F.lit("")), F.lit("en"))), "synthetic": F.lit(True), "has_system_prompt": F.col("_system") != ""}
    return _record(held, source, license_id, _pair(ask, F.col("_answer")), ("id", "sample_id", "question_id"), meta, _filled())


def distilled(rows: DataFrame, provider: str, model: str, license_id: str) -> DataFrame:
    """(prompt_id, lang, user, category, answer) as records that still need cleaning; an empty answer is an error of the teacher."""
    answer = strip(F.coalesce("answer", F.lit("")))
    checked = F.when(answer == "", F.raise_error(F.lit("the teacher's answer is empty"))).otherwise(answer)
    meta = {"language": F.col("lang"), "prompt_id": F.col("prompt_id"), "provider": F.lit(provider), "teacher_model": F.lit(model), "distill_source": F.lit("api")}
    out = _record(rows, f"distill:{provider}:{model}", license_id, _pair(F.col("user"), checked), ("prompt_id",), meta)
    return out.withColumn("quality_tags", F.array(F.lit("distilled"), F.lit("needs_cleaning")))


def selfplay(rows: DataFrame, asker: tuple[str, str], answerer: tuple[str, str], license_id: str) -> DataFrame:
    """(prompt_id, lang, category, topic, user, answer) of two models talking; rows whose texts don't pass ``generated`` are dropped."""
    meta = {"language": F.col("lang"), "prompt_id": F.col("prompt_id"), "topic": F.col("topic")}
    pair = _pair(generated(F.col("user"), "user"), generated(F.col("answer"), "assistant"))
    out = _record(rows, f"selfplay:{':'.join(asker)}->{':'.join(answerer)}", license_id, pair, ("prompt_id",), meta, _filled())
    return out.withColumn("quality_tags", F.array(F.lit("selfplay"), F.lit("api"), F.lit("needs_cleaning")))


def bad_generated(text: Column) -> Column:
    """Broken encoding: a certain sign, or two of the weaker ones, repeats counted."""
    hits = F.lit(0)
    for m in GENERATED_MOJIBAKE:
        hits = hits + ((F.length(text) - F.length(F.replace(text, F.lit(m), F.lit("")))) / len(m)).cast("int")
    return text.rlike(S.MOJIBAKE) | (hits >= 2)


def generated(text: Column, role: str) -> Column:
    """A model's message without quotes and its own role's label; '' if it speaks for the other role, is too long, broken or holds a banned term."""
    own, other = (r"(user|用户|question|问题)", r"(assistant|助手|answer|回答)")[:: 1 if role == "user" else -1]
    bare = lambda c: strip(F.regexp_replace(F.regexp_replace(strip(c), '^["“”]+|["“”]+$', ""), r"\n{3,}", "\n\n"))
    t = F.regexp_replace(bare(F.coalesce(text, F.lit(""))), rf"(?iu)^\s*{own}\s*[:：]\s*", "")
    wrong = t.rlike(rf"(?iu)^\s*{other}\s*[:：]")
    t = bare(t)
    banned = X.has_any(F.lower(t), BANNED)
    return F.when(wrong | (F.length(t) > (1200 if role == "user" else 6000)) | bad_generated(t) | banned, "").otherwise(t)


def english_or_chinese(rows: DataFrame, prompt: str, target: str) -> Column:
    """By language columns if any is filled, else by the text's letters."""
    marks = F.filter(F.array(*[F.lower(strip(_text(rows, n))) for n in ("language", "language_code", "lang", "locale", "script")]), lambda x: x.isNotNull())
    text = F.concat(F.coalesce(_text(rows, prompt), F.lit("")), F.lit("\n"), F.coalesce(_text(rows, target), F.lit("")))
    latin = F.regexp_count(text, F.lit("[A-Za-z]"))
    by_text = F.regexp_like(text, F.lit(r"[\x{4e00}-\x{9fff}]")) | ((latin >= 40) & (latin >= F.greatest(F.length(strip(text)), F.lit(1)) * F.lit(0.35)))
    return F.when(F.arrays_overlap(marks, F.array(*map(F.lit, EN_ZH))), True).when(F.size(marks) > 0, False).otherwise(by_text)


CONVERTERS = {
    "wildchat": wildchat, "prompt_target": prompt_target, "preference": preference, "transcript": transcript, "instruction": instruction,
    "question_answers": question_answers, "system_question": system_question,
}


def convert(rows: DataFrame, kind: str, source: str, license_id: str, **options) -> DataFrame:
    if kind not in CONVERTERS:
        raise ValueError(f"unknown converter: {kind}")
    return CONVERTERS[kind](rows, source, license_id, **options)
