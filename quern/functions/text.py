"""Text as Columns: normal forms, ratios, language groups."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import signals as S

_LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


@F.pandas_udf(T.StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """Unicode compatibility composition; Spark has no built-in for it."""
    return x.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.ArrayType(T.StringType()))
def nfkc_each(x: pd.Series) -> pd.Series:
    """``nfkc`` of every text of an array; lambda functions can't call Python."""
    return x.map(lambda a: None if a is None else [t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in a])


@F.pandas_udf(T.StringType())
def unescape(x: pd.Series) -> pd.Series:
    """HTML entities to characters."""
    return x.map(lambda t: None if t is None else html.unescape(t))


def tidy(text: Column) -> Column:
    """Lines without repeated blanks, trailing blanks or empty lines; no NUL."""
    t = F.replace(text, F.lit("\x00"), F.lit(""))
    t = F.regexp_replace(F.regexp_replace(t, _LINE_ENDS, "\n"), "[ \t]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\s*\n\s*", "\n"), r"^\s+|\s+$", ""))


def clean_text(text: Column, compose: bool = True) -> Column:
    """The stored form of a message; ``compose`` adds the compatibility composition, which costs a Python pass."""
    return tidy(nfkc(text) if compose else text)


def normalize_for_hash(text: Column, compose: bool = True) -> Column:
    """The form in which two texts count as equal."""
    return F.trim(F.regexp_replace(F.lower(clean_text(text, compose)), r"\s+", " "))


def let(x: Column, f) -> Column:
    """f(x), with x computed once however often f speaks of it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _up_to_last(text: Column, end: str, f) -> Column:
    """f of the text up to the last match of ``end``, and the rest as it is.

    A pattern that runs to such an end would search the whole rest anew from each place that has none.
    """

    def cut(t: Column) -> Column:
        return let(F.regexp_extract(t, f"(?isu)^.*{end}", 0), lambda head: F.concat(f(head), F.substring(t, F.length(head) + 1, F.length(t))))

    return let(text, cut)


def without_tags(text: Column, space: str = r"\s") -> Column:
    """HTML without scripts, styles and tags, block ends as line ends; in time linear in the text.  ``space`` matches a blank inside a tag."""
    t = text
    for tag in ("script", "style"):
        t = _up_to_last(t, f"</{tag}>", lambda head, tag=tag: F.regexp_replace(head, rf"(?isu)<{tag}.*?</{tag}>", ""))
    t = F.regexp_replace(t, rf"(?iu)<{space}*+br{space}*+/?{space}*+>", "\n")
    t = F.regexp_replace(t, rf"(?iu)</{space}*+(p|li|div|pre|blockquote|h[1-6]){space}*+>", "\n")
    return _up_to_last(t, ">", lambda head: F.regexp_replace(head, r"(?s)<[^>]++>", ""))


def clean_html(text: Column, entities: bool = True) -> Column:
    """Visible text of HTML: entities, scripts and styles out, block ends as line ends, tags out; in time linear in the text."""
    return tidy(without_tags(unescape(text) if entities else text))


def clean_page(text: Column, entities: list[tuple[str, str]]) -> Column:
    """``clean_html`` of a page whose only entities are those given, replaced one after the other; lines end at line feeds, and blanks are those of ASCII."""
    for name, sign in entities:
        text = F.replace(text, F.lit(name), F.lit(sign))
    t = F.regexp_replace(without_tags(text, r"[ \t\n\f\r]"), "[ \t]+", " ")
    t = F.regexp_replace(t, r"(?<![ \t\f\r])[ \t\f\r]*+\n[ \t\n\f\r]*+", "\n")
    return F.regexp_replace(t, r"\A[ \t\n\f\r]++|(?<![ \t\n\f\r])[ \t\n\f\r]++\z", "")


def ascii_lower(text: Column) -> Column:
    """Lower case of A to Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def has_any(text: Column, terms: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(text, F.lit(t))
    return out


def repetition_ratio(lower: Column, byte_length: bool = False) -> Column:
    """Share of the tokens longer than two that occur more than four times; 0 for fewer than twenty tokens.

    Tokens are found and sorted once.  Among sorted tokens, one that equals the
    fourth after it counts 1, and the first such of its run counts for the four
    that have none.
    """
    size = F.octet_length if byte_length else F.length

    def of(t: Column) -> Column:
        def counted(n: Column, i: Column) -> Column:
            first = (i == 0) | (F.get(t, i - 1) != F.get(t, i))
            return n + F.when((F.get(t, i) == F.get(t, i + 4)) & (size(F.get(t, i)) > 2), F.when(first, 5).otherwise(1)).otherwise(0)

        return F.when(F.size(t) < 20, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(t) - 5), F.lit(0), counted) / F.size(t))

    return let(F.sort_array(F.regexp_extract_all(lower, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))), of)


def bad_unicode_ratio(text: Column, returns_are_bad: bool = True) -> Column:
    pattern = r"[\x00-\x08\x0b-\x1f\x7f-\x9f]" if returns_are_bad else r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(F.regexp_count(text, F.lit(pattern)) / F.length(text))


def language_group(code: Column, text: Column) -> Column:
    """``zh`` or ``en``: by the language code, else by the share of Chinese characters."""
    c = F.lower(F.trim(F.coalesce(code, F.lit(""))))
    cjk, latin = F.regexp_count(text, F.lit(r"[\x{4e00}-\x{9fff}]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when(c.isin(*S.CHINESE), "zh").when(c.isin(*S.ENGLISH), "en").when((cjk >= 8) & (cjk >= latin * F.lit(0.2)), "zh").otherwise("en")


def canonical_language(code: Column) -> Column:
    """The code of the fast rules: Chinese and English names to zh and en, others as they are."""
    c = F.lower(F.trim(F.coalesce(code, F.lit(""))))
    return F.when(c.isin(*[x for x in S.CHINESE if x != "yue"]), "zh").when(c.isin(*S.ENGLISH), "en").otherwise(c)
