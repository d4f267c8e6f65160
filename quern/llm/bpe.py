"""BPE encoding and decoding by dynamic programming over prefixes.

The tokens of a prefix of a pre-token end in exactly one last token.  For each
prefix an automaton of all tokens lists those that are suffixes of it; of
these, the last token is the one that starts the pre-token or is compatible
with the last token of the prefix it leaves.  Two tokens are compatible if
byte-pair merging of their joined text keeps the border between them, which
the merges along that border decide.  Following the last tokens back from the
end gives the exact ids, in time linear in the pre-token's length.

Texts are normalised and cut to pre-tokens as the vocabulary's own file says
(NFC, white space as one space, lower case; words, digits, other runs).  A
pre-token's ids are kept for the next time it occurs, in a store of bounded
size.

Defined results: a null text counts as empty and has no ids; a very long text
is encoded whole, a very long pre-token in time linear in its length; an empty
table gives no rows; rows that repeat, or share a doc_id, are encoded each;
extra columns pass through untouched, but for those that have the name of a
result, which are replaced.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import freeing

#: A worker keeps the ids of between one and two times so many pieces (what stands between white space) and pre-tokens.
KEPT = 100_000
#: Most pairs of tokens of which it is known whether they are compatible.
FITS = 500_000
#: Texts encoded at a time.
ROWS = 256
#: Stands for the end of a word; not a character of the byte alphabet.
_END = "\x01"
_ENDLESS = 1 << 30


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable Latin-1 characters for themselves, the others by 256 and up in turn."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A vocabulary file with word ends, compiled."""

    def __init__(self, raw: bytes) -> None:
        import ahocorasick

        spec = json.loads(raw)
        model = spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        inner = lambda t: t[: -len(suffix)] + _END if suffix and t.endswith(suffix) else t
        self.names = {i: t for t, i in model["vocab"].items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        ids = {inner(t): i for t, i in model["vocab"].items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rule: dict[tuple[int, int], int] = {}  # a pair's rank
        self.parts: dict[int, tuple[int, int, int]] = {}  # a merged token's halves and rank
        for rank, (a, b) in enumerate(pairs):
            x, y, z = ids[inner(a)], ids[inner(b)], ids[inner(a) + inner(b)]
            if self.rule.setdefault((x, y), rank) == rank:
                self.parts.setdefault(z, (x, y, rank))
        for x, y, rank in self.parts.values():
            if max(self.parts.get(x, (0, 0, -1))[2], self.parts.get(y, (0, 0, -1))[2]) > rank:
                raise ValueError("a merge comes before those of its halves")
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._fits: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        whole: dict[int, bool] = {}
        for text, i in sorted(ids.items(), key=lambda p: self.parts.get(p[1], (0, 0, -1))[2]):
            # a token is of use only if merging its own text ends in it
            half = self.parts.get(i)
            whole[i] = text in (text[:1], text[:1] + _END) if half is None else whole[half[0]] and whole[half[1]] and self._border(half[0], half[1], half[2])
            if whole[i]:
                self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        self.alphabet = byte_alphabet()
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.split_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pretokens = regex.compile(pattern.replace(r"\s", WHITE), regex.V0)
        self.pieces: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}  # those before; what is asked for again moves up

    def _side(self, token: int, right: bool) -> list[tuple[int, int]]:
        """(symbol, rank of the merge that takes it up) at the token's right or left edge, from the whole token down."""
        kept = self._right if right else self._left
        if token not in kept:
            out, taken, at = [], _ENDLESS, token
            while True:
                out.append((at, taken))
                if at not in self.parts:
                    break
                *halves, taken = self.parts[at]
                at = halves[right]
            kept[token] = out
        return kept[token]

    def _border(self, a: int, b: int, own: int = -1) -> bool:
        """Whether no merge crosses the border between the tokens a and b (but the one of rank ``own``)."""
        for x, x_taken in self._side(a, True):
            for y, y_taken in self._side(b, False):
                rank = self.rule.get((x, y))
                # of equal ranks the merge further left goes first: x's own merge before, y's after the one that crosses
                if rank is not None and rank != own and rank < x_taken and rank <= y_taken:
                    return False
        return True

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the joined text of the tokens a and b gives a and b again; the answer is kept."""
        if len(self._fits) > FITS:
            self._fits.clear()
        fits = self._fits[a << 20 | b] = self._border(a, b)
        return fits

    def word_ids(self, word: str) -> list[int]:
        """The ids of one pre-token."""
        if word.isascii() and word.isalnum():
            s = word + _END
        else:
            s = "".join([self.alphabet[b] for b in word.encode("utf-8", "surrogatepass")]) + _END
        kept = self._fits.get
        last = [-1] * (len(s) + 1)  # of each prefix: -1 for none, -2 for the empty prefix
        size = [0] * (len(s) + 1)
        last[0] = -2
        for end, (token, n) in self.automaton.iter(s):
            if last[end + 1] >= 0:
                continue
            before = last[end + 1 - n]
            if before == -1:
                continue
            if before >= 0:
                fits = kept(before << 20 | token)
                if fits is None:
                    fits = self.compatible(before, token)
                if not fits:
                    continue
            last[end + 1], size[end + 1] = token, n
        out, at = [], len(s)
        while at:
            if last[at] < 0:
                raise ValueError(f"no tokens for {word!r}")
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def _piece(self, piece: str) -> tuple[str, str]:
        """Ids and token names of a piece without white space, each joined by spaces."""
        got = self.older.get(piece)
        if got is None:
            words = [piece] if piece.isalpha() else self.pretokens.findall(piece)
            if words == [piece]:
                ids = self.word_ids(piece)
                got = " ".join(map(str, ids)), " ".join([self.names[i] for i in ids])
            else:
                found = [self.pieces.get(w) or self._piece(w) for w in words]
                got = " ".join([a for a, _ in found]), " ".join([b for _, b in found])
        if len(piece) < 64:
            if len(self.pieces) >= KEPT:
                self.pieces, self.older = {}, self.pieces
            self.pieces[piece] = got
        return got

    def encode(self, text: str) -> tuple[str, str]:
        """The text's ids and the names of its tokens (which are its decoded text), each joined by spaces."""
        if self.split_added is not None and "<|" in text and self.split_added.search(text):
            found, at = [], 0
            for m in self.split_added.finditer(text):
                found += [self.encode_plain(text[at : m.start()]), (str(self.added[m[0]]), m[0])]
                at = m.end()
            found.append(self.encode_plain(text[at:]))
            return " ".join([a for a, _ in found if a]), " ".join([b for a, b in found if a])
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> tuple[str, str]:
        if not text.isascii():
            # capital sigma by hand: each character is lowered for itself, with no special case for a final one
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
        text = text.lower()
        pieces = text.split() if not ODD_WHITE.search(text) else SPLIT_WHITE.split(text)
        piece = self._piece
        found = [self.pieces.get(p) or piece(p) for p in pieces]
        return " ".join([a for a, _ in found if a]), " ".join([b for a, b in found if a])


#: White space as the vocabulary's pattern means it; Python's own split also cuts at four control characters.
WHITE = r"\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ODD_WHITE = regex.compile(r"[\x1c-\x1f]")
SPLIT_WHITE = regex.compile(f"[{WHITE}]+")

_compiled: dict[str, WordBpe] = {}


def compiled(raw: bytes) -> WordBpe:
    """The vocabulary, compiled once in each Python worker."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = WordBpe(raw)
    return _compiled[key]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, *, vocabulary: str | None = None, text: str = "text", ids: bool = True, decoded: bool = False, digests: bool = True, keep_text: bool = False) -> DataFrame:
    """``docs`` without its text, and n_tokens, ids (array<int>), decoded, ids_sha256 and decoded_sha256 as asked for.

    Columns of ``docs`` that have these names are replaced.  The vocabulary (a file of about 2 MB) is read by the driver and sent to the executors.
    """
    with open(vocabulary or default_vocabulary(), "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    new = [T.StructField("n_tokens", T.LongType(), False)]
    new += [T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)] * ids + [T.StructField("decoded", T.StringType(), False)] * decoded
    new += [T.StructField("ids_sha256", T.StringType(), False), T.StructField("decoded_sha256", T.StringType(), False)] * digests
    names = {f.name for f in new}
    rest = [f for f in docs.schema.fields if f.name not in names and (keep_text or f.name != text)]
    slim = docs.select(*[F.col(f"`{f.name}`") for f in rest], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__q_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = compiled(raw.value)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):  # token lists take many times the memory of their texts
                part = batch.slice(k, ROWS)
                pairs = [model.encode(t) for t in part.column(len(rest)).to_pylist()]
                out = [part.column(i) for i in range(len(rest))]
                out.append(pa.array([a.count(" ") + 1 if a else 0 for a, _ in pairs], pa.int64()))
                if ids:
                    each = [np.fromstring(a, dtype=np.int32, sep=" ") for a, _ in pairs]
                    out.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32), np.concatenate(each)))
                if decoded:
                    out.append(pa.array([b for _, b in pairs], pa.string()))
                if digests:
                    out += [pa.array([sha(p[side]) for p in pairs], pa.string()) for side in (0, 1)]
                yield pa.RecordBatch.from_arrays(out, names=[f.name for f in rest] + [f.name for f in new])

    return slim.mapInArrow(freeing(run), T.StructType(rest + new))


def decode(rows: DataFrame, *, vocabulary: str | None = None, ids: str = "ids", to: str = "text") -> DataFrame:
    """``rows`` with the text of the array ``ids``: the tokens' names joined by spaces, as the vocabulary file, which names no decoder, has it; null for null."""
    with open(vocabulary or default_vocabulary(), "rb") as f:
        raw = rows.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf(T.StringType())
    def names(col: pd.Series) -> pd.Series:
        model = compiled(raw.value)
        return col.map(lambda a: None if a is None else " ".join([model.names[int(i)] for i in a]))

    return rows.withColumn(to, names(F.col(f"`{ids}`")))
