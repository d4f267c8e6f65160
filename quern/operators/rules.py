"""Policy rules (the first that matches names the rejection) and additive quality scores, in a strict and a fast set."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import signals as S
from ..functions import text as X


@dataclass(frozen=True)
class Policy:
    licenses: tuple[str, ...] = S.LICENSES
    languages: tuple[str, ...] = S.LANGUAGES
    turns: tuple[int, int] = (2, 24)
    chars: tuple[int, int] = (80, 12_000)
    least_score: float = 0.45
    categories: tuple[str, ...] | None = None
    restricted: tuple[str, ...] = field(default=())

    def widened(self, allow_restricted: bool) -> Policy:
        """With the restricted licences, only if they are asked for."""
        from dataclasses import replace

        return replace(self, licenses=tuple(dict.fromkeys((*self.licenses, *self.restricted)))) if allow_restricted else self


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The reason of the first rule that holds, in one CASE; null if none does."""
    out = None
    for reason, holds in rules:
        out = F.when(holds, reason) if out is None else out.when(holds, reason)
    return out


def metadata_rules(policy: Policy, license_id: Column, language: Column, turns: Column, alternates: Column | None = None, fast: bool = False) -> list[tuple[str, Column]]:
    lang = X.canonical_language(language) if fast else F.lower(F.trim(F.coalesce(language, F.lit(""))))
    low, high = (2, 24) if fast else policy.turns
    rules = [
        ("license_not_allowed", ~F.lower(F.trim(F.coalesce(license_id, F.lit("")))).isin(*policy.licenses)),
        ("language_not_allowed", (lang != "") & ~lang.isin(*policy.languages)),
        ("too_few_turns", turns < low), ("too_many_turns", turns > high),
    ]
    return rules + ([("role_order", ~alternates)] if alternates is not None and not fast else [])


def _length_rules(policy: Policy, text: Column) -> list[tuple[str, Column]]:
    return [("too_short", F.length(text) < policy.chars[0]), ("too_long", F.length(text) > policy.chars[1])]


def strict_text_rules(policy: Policy, text: Column, lower: Column) -> list[tuple[str, Column]]:
    return [
        ("pii_or_secret", (F.contains(text, F.lit("@")) & text.rlike(S.EMAIL_ONCE)) | (X.has_any(lower, S.SECRET_MARKERS) & text.rlike(S.SECRET))),
        ("financial_market_advice", X.has_any(lower, S.MARKET_MARKERS) & text.rlike(S.MARKET)),
        ("bad_code_artifact", X.has_any(lower, S.BAD_CODE_MARKERS) & text.rlike(S.BAD_CODE)),
        ("mojibake", (F.octet_length(text) != F.length(text)) & text.rlike(S.MOJIBAKE)),  # none of its characters is ASCII alone
        ("child_persona_roleplay", X.has_any(lower, S.PERSONA_MARKERS) & text.rlike(S.PERSONA)),
        ("unsafe_security", X.has_any(lower, S.SENSITIVE) & X.has_any(lower, S.FORCING) & text.rlike(S.UNSAFE)),
        *_length_rules(policy, text),
        ("url_only", F.contains(lower, F.lit("http")) & text.rlike(S.URL_ONLY)),
        ("repetition", X.repetition_ratio(lower) > 0.35),
        ("bad_unicode", X.bad_unicode_ratio(text) > 0.01),
    ]


def _fast_email(text: Column) -> Column:
    """Some token, trimmed of other marks, that has something before its first @ and a dot after it."""
    return F.contains(text, F.lit("@")) & F.exists(F.split(text, r"\s+"), lambda t: F.regexp_replace(t, r"^[^A-Za-z0-9@._+-]+|[^A-Za-z0-9@._+-]+$", "").rlike(r"^[^@]+@.*\."))


def _fast_secret(lower: Column) -> Column:
    out = F.contains(lower, F.lit("akia")) | F.contains(lower, F.lit("sk-"))
    for k in S.SECRET_KEYS:  # only the first place of each key counts
        after = F.substring_index(lower, k, 1)
        out = out | (F.contains(lower, F.lit(k)) & F.substring(lower, F.length(after) + len(k) + 1, F.length(lower)).rlike(r"^\s*[:=]"))
    return out


def fast_text_rules(policy: Policy, text: Column, lower: Column) -> list[tuple[str, Column]]:
    persona = (X.has_any(lower, S.PERSONA_PLAY) & X.has_any(lower, S.PERSONA_AGE) & X.has_any(lower, S.PERSONA_WHO)) | X.has_any(lower, S.PERSONA_ALONE)
    return [
        *_length_rules(policy, text),
        ("pii_or_secret", _fast_email(text) | _fast_secret(lower)),
        ("financial_market_advice", X.has_any(lower, S.MARKET_TERMS)), ("bad_code_artifact", X.has_any(lower, S.BAD_CODE_TERMS)),
        ("mojibake", X.has_any(text, S.MOJIBAKE_TERMS)), ("child_persona_roleplay", persona),
        ("unsafe_security", X.has_any(lower, S.SENSITIVE) & X.has_any(lower, S.FORCING)),
        ("url_only", text.rlike(r"^\s*(https?://\S*\s+){0,2}https?://\S*\s*$")),
        ("repetition", X.repetition_ratio(lower, byte_length=True) > 0.35),
        ("bad_unicode", X.bad_unicode_ratio(text, returns_are_bad=False) > 0.01),
    ]


def lowered(ruleset: str, text: Column) -> Column:
    """The lower case that a set of rules looks at: the fast set knows that of ASCII only."""
    return X.ascii_lower(text) if ruleset == "fast" else F.lower(text)


def text_rules(ruleset: str, policy: Policy, text: Column, lower: Column) -> list[tuple[str, Column]]:
    return {"strict": strict_text_rules, "fast": fast_text_rules}[ruleset](policy, text, lower)


#: The order of the prefilter's rules, which is not that of the fast set.
PREFILTER_ORDER = ("too_short", "too_long", "pii_or_secret", "bad_code_artifact", "mojibake", "url_only", "bad_unicode", "unsafe_security", "financial_market_advice", "repetition")


def prefilter_rules(policy: Policy, text: Column, lower: Column) -> list[tuple[str, Column]]:
    """The hard rejections that may run ahead of the rest: the fast rules without the persona rule, in an order of their own."""
    rules = dict(fast_text_rules(policy, text, lower))
    return [(r, rules[r]) for r in PREFILTER_ORDER]


def features(ruleset: str, text: Column, lower: Column, turns: Column, generic_ratio: Column) -> list[tuple[str, float, Column, Column | None]]:
    """(tag, gain, condition, category it sets) in the order in which they add up."""
    strict = ruleset == "strict"
    named = lambda terms: (X.has_any(lower, terms) & text.rlike(S.words(terms))) if strict else X.has_any(lower, terms)
    code = (X.has_any(lower, S.CODE_MARKERS) & text.rlike(S.CODE)) if strict else X.has_any(lower, S.CODE_MARKERS)
    debug, tool, safe = F.lit("debug"), F.lit("tool_calling"), F.lit("security_defensive")
    return [
        ("multi_turn", 0.12, turns >= 4, None), ("substantive", 0.10, F.length(text) >= 250, None),
        ("question_answer", 0.05, X.has_any(text, S.CUE_MARKS) | X.has_any(lower, S.CUES), None),
        ("code_or_debug", 0.20, code, F.when(X.has_any(lower, S.FAILURE), debug).otherwise("engineering")),
        ("zh_debug", 0.22, X.has_any(text, S.ZH_DEBUG), debug), ("tool_use", 0.12, named(S.TOOL_TERMS), tool), ("zh_tool_use", 0.12, X.has_any(text, S.ZH_TOOL), tool),
        ("security", 0.16, named(S.SECURITY_TERMS), safe), ("zh_security", 0.16, X.has_any(text, S.ZH_SECURITY), safe),
        ("reasoning", 0.08, named(S.REASONING_TERMS), None), ("zh_reasoning", 0.08, X.has_any(text, S.ZH_REASONING), None),
        ("repair", 0.10, text.rlike(S.REPAIR) if strict else X.has_any(lower, S.REPAIR_TERMS), None),
        ("", -0.20, generic_ratio > 0.45, None),
    ]


def scored(ruleset: str, text: Column, lower: Column, turns: Column, generic_ratio: Column) -> tuple[Column, Column, Column]:
    """(score, category, quality_tags).  The gains add up as doubles in their order, as the threshold's rounding needs."""
    score, category, tags = F.lit(0.25), F.lit("general"), []
    for tag, gain, holds, sets in features(ruleset, text, lower, turns, generic_ratio):
        score = score + F.when(holds, F.lit(gain)).otherwise(F.lit(0.0))
        category = category if sets is None else F.when(holds, sets).otherwise(category)
        tags += [F.when(holds, tag)] if tag else []
    return F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))), category, F.filter(F.array(*tags), lambda t: t.isNotNull())
