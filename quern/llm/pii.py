"""PII: regular expressions propose spans, checksums confirm them, context words adjust their score.

Everything is a Spark column: ``regexp_extract_all`` gives the matches and
``split`` by the same pattern the text between them, so that the running sum
of both lengths gives each match's place in code points.  No Python runs and
nothing is shuffled.  Time is in proportion to the text and its spans.

The patterns here find exactly the leftmost non-overlapping matches of the
plain patterns of ``BASE``, but in time linear in the text: a run of
characters that can start a match is entered at its first character only, and
no repetition gives characters back (Java's regular expressions would
otherwise overflow the stack, or take the square of a long run's length).

Kinds: email, ip, card and phone are the base; a base span that passes its
validator always stays.  The method adds iban (mod 97) and secret (a long
hexadecimal or mixed key), which stay if their score, raised by context words
before them, reaches ``LEAST_SCORE``.

Defined results: a null text counts as empty; a text without spans has an empty
list of spans; an empty table gives no rows.  Spans of one kind never overlap;
spans of several kinds may, and are all listed, by start and then kind.  A very
long text is searched whole.  Rows that repeat, or share a doc_id, are treated
each for itself; extra columns, whatever their names, pass through ``redact``
untouched and aren't read by ``find``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

_T = "__q_text"
LEAST_SCORE = 0.5
#: How many characters before a span, since the match before it of its kind, are searched for context words.
CONTEXT_CHARS = 40

#: The base patterns as specified.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]++", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, k: Column) -> Column:
        d = F.substring(digits, n - k + 1, F.lit(1)).cast("int") * (F.lit(2) - k % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _mod97(compact: Column) -> Column:
    """ISO 7064 mod 97-10 of an IBAN without spaces."""
    turned = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))

    def add(rest: Column, k: Column) -> Column:
        c = F.ascii(F.substring(turned, k, F.lit(1)))
        return F.when(c >= 65, rest * 100 + c - 55).otherwise(rest * 10 + c - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str  # a cheap test: a text that fails it has no match
    valid: object
    context: str
    base: float
    in_base: bool


def _between(x: Column, low: int, high: int) -> Column:
    return (x >= low) & (x <= high)


#: In the order in which kinds are listed.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
         lambda m: F.lit(True), "mail|contact|write|courriel|correo", 0.8, True),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]",
         lambda m: F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255")),
         r"\bip\b|address|host|server|login", 0.6, True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){13}",
         lambda m: _between(F.length(_digits(m)), 14, 19) & _luhn(_digits(m)), "card|visa|master|credit|payment|karte|carte|tarjeta", 0.7, True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]",
         lambda m: _between(F.length(_digits(m)), 10, 15), "phone|call|tel|mobile|fax", 0.6, True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}[\x20]?[A-Z0-9]{4}",
         lambda m: _between(F.length(F.replace(m, F.lit(" "), F.lit(""))), 15, 34) & _mod97(F.replace(m, F.lit(" "), F.lit(""))), "iban|account|bank|konto|compte|cuenta", 0.7, False),
    Kind("secret", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{32,}+", r"[A-Za-z0-9_-]{32}",
         lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]") & ~m.rlike("^[A-Za-z]+[0-9]{0,4}$"), r"token|secret|passw|api.?key|access.?key|auth", 0.3, False),
)
#: A context word before the span adds so much.
CONTEXT_GAIN = 0.25


#: Folds over a text's spans go in steps of so many, as a step copies what it has gathered.
_STEP = 64


def _let(x: Column, f) -> Column:
    """f(x), with x computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _folded(items: Column, total, combine, fold, none: Column) -> Column:
    """``fold(chunk, start)`` over chunks of ``items``, flattened; ``start`` combines the totals of all chunks before.

    It takes time in proportion to the items, which one fold that appends to an
    array would not.
    """

    def over(chunks: Column) -> Column:
        def with_totals(totals: Column) -> Column:
            starts = F.transform(totals, lambda _, c: F.aggregate(F.slice(totals, F.lit(1), c), F.lit(0), combine))
            return F.flatten(F.zip_with(chunks, starts, fold))

        return _let(F.transform(chunks, total), with_totals)

    def cut(all_of: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(all_of) - 1) / _STEP).cast("int"))
        return F.when(F.size(all_of) == 0, none).otherwise(_let(F.transform(places, lambda c: F.slice(all_of, c * _STEP + 1, F.lit(_STEP))), over))

    return _let(items, cut)


def _found(kind: Kind, at: int) -> Column:
    """array<struct<start, kind, end, score>> of the kind's spans that its validator confirms, by start."""
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,score:double>>)")

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        before = F.lower(F.substring(pair["gap"], -CONTEXT_CHARS, CONTEXT_CHARS))
        score = F.lit(kind.base) + F.when(before.rlike(kind.context), F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0))
        span = F.struct(start.alias("start"), F.lit(at).alias("kind"), end.alias("end"), score.alias("score"))
        ok = kind.valid(pair["match"]) if kind.in_base else kind.valid(pair["match"]) & (score >= LEAST_SCORE)
        return F.struct(end.alias("at"), F.when(ok, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    def pairs(matches: Column) -> Column:  # the last gap has no match after it
        return F.zip_with(F.slice(F.split(_T, kind.pattern, -1), F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))

    out = _folded(
        _let(F.regexp_extract_all(_T, F.lit(kind.pattern), F.lit(0)), pairs),
        lambda chunk: F.aggregate(chunk, F.lit(0), lambda n, p: n + F.length(p["gap"]) + F.length(p["match"])),
        lambda a, b: a + b,
        lambda chunk, start: F.aggregate(chunk, F.struct(start.alias("at"), none.alias("spans")), step, lambda s: s["spans"]),
        none,
    )
    hint = F.contains(F.col(_T), F.lit(kind.hint)) if kind.hint == "@" else F.col(_T).rlike(kind.hint)
    return F.when(hint, out).otherwise(none)


def with_spans(docs: DataFrame, *, text: str = "text", to: str = "__q_spans") -> DataFrame:
    """``docs`` and the array ``to`` of its spans by start, then kind: struct<start, kind, end, score>, places in code points, end exclusive."""
    own = [f"__q_pii_{k.name}" for k in KINDS]
    out = docs.withColumn(_T, text_or_empty(text))
    out = out.withColumns({c: _found(k, at) for at, (c, k) in enumerate(zip(own, KINDS, strict=True))})
    return out.withColumn(to, F.array_sort(F.flatten(F.array(*own)))).drop(_T, *own)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the number of base spans by kind, base_sha256, all spans as text; then the method's own counts and every span's score."""
    n_base = sum(k.in_base for k in KINDS)
    out = with_spans(docs.select("doc_id", "text"), to="__q_spans").drop("text")
    count = lambda at: F.size(F.filter("__q_spans", lambda s: s["kind"] == at)).cast("long")
    return out.select(
        "doc_id", *[count(at).alias(f"n_{k.name}") for at, k in enumerate(KINDS) if k.in_base],
        F.sha2(_listed(F.filter("__q_spans", lambda s: s["kind"] < n_base)), 256).alias("base_sha256"), _listed(F.col("__q_spans")).alias("spans"),
        *[count(at).alias(f"n_{k.name}") for at, k in enumerate(KINDS) if not k.in_base],
        F.size("__q_spans").cast("long").alias("n_spans"), F.transform("__q_spans", lambda s: s["score"]).alias("scores"),
    )


def redact(docs: DataFrame, *, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets, and ``n_chars``, if there, counted anew where text changed.

    Of spans that overlap the first stays, and the others are taken out as far as they stick out of it.
    """
    names = F.array(*[F.lit(f"<{k.name.upper()}>") for k in KINDS])
    out = with_spans(docs.withColumn("__q_src", F.col(f"`{text}`")), text="__q_src", to="__q_spans")
    none = F.expr("cast(array() as array<string>)")

    def clean(chars: Column) -> Column:
        """The text from its characters, of which slices are taken in time of their own length."""

        def step(state: Column, s: Column) -> Column:
            gap = F.array_join(F.slice(chars, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0))), "")
            fresh = s["start"] >= state["at"]
            return F.struct(
                F.greatest(state["at"], s["end"]).alias("at"),
                F.when(fresh, F.concat(state["parts"], F.array(gap, F.element_at(names, s["kind"] + 1)))).otherwise(state["parts"]).alias("parts"),
            )

        last = F.array_max(F.transform("__q_spans", lambda s: s["end"]))
        rest = F.slice(chars, last + 1, F.size(chars))
        parts = _folded(
            F.col("__q_spans"),
            lambda chunk: F.array_max(F.transform(chunk, lambda s: s["end"])),
            lambda a, b: F.greatest(a, b),
            lambda chunk, start: F.aggregate(chunk, F.struct(start.alias("at"), none.alias("parts")), step, lambda s: s["parts"]),
            none,
        )
        return F.concat(F.array_join(parts, ""), F.array_join(rest, ""))

    new = {text: F.when(F.size("__q_spans") > 0, _let(F.regexp_extract_all("__q_src", F.lit("(?s)."), F.lit(0)), clean)).otherwise(F.col("__q_src"))}
    out = out.withColumns(new)
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(F.size("__q_spans") > 0, F.length(F.col(f"`{text}`")).cast(dict(docs.dtypes)[n_chars])).otherwise(F.col(f"`{n_chars}`")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
