"""Byte-level BPE by a sentencepiece model that is written straight from a vocabulary of ranks.

A vocabulary names byte strings by rank.  Each byte is written as one printable
character, so a token is a piece, and the piece's score is its rank's negative:
sentencepiece then merges, of all neighbours that form a piece, those of the
least rank, the leftmost first, which is byte-level BPE.  The model has the
identity as its normalisation, adds no prefix and leaves white space alone.  No
model is trained: the driver serialises it and sends it to the executors.

Texts are cut to pre-tokens by the vocabulary's pattern; each is encoded for
itself, and one that is a token as a whole is that token.  The ids of short
pre-tokens, and of what stands between single spaces, are kept in stores of
bounded size.  Decoding maps each id's piece
back to its bytes.

Defined results: a null text counts as empty and has no ids; a very long text
is encoded whole, in blocks that end at spaces, and a very long pre-token in about
linear time; an empty table gives no rows; rows that repeat, or share a doc_id,
are encoded each; extra columns pass through untouched, but for those that have
the name of a result, which are replaced.  The strings of special tokens are
ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, chain, groupby, islice, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_alphabet
from .common import freeing

#: A worker keeps between one and two times so many pre-tokens, and as many chunks, each of at most SHORT characters.
KEPT, SHORT = 200_000, 64
#: Texts encoded at a time; a text that is longer than LONG characters is cut to such lengths, and BLOCK tokens are decoded at a time.
ROWS, LONG, BLOCK = 256, 1 << 20, 1 << 17
#: The piece for the unknown: a character that stands for no byte.
_UNKNOWN = "⁇"


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """A vocabulary file: a token in base64 and its rank on each line."""
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing or len(set(ranks.values())) < len(ranks):
        raise ValueError(f"the vocabulary lacks the bytes {missing}" if missing else "two tokens share a rank")
    return ranks


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The vocabulary as a serialised sentencepiece BPE model; a piece's place is that of its rank among all ranks."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    to_char = byte_alphabet()
    model = proto.ModelProto()
    for place, token in enumerate(sorted(ranks, key=ranks.__getitem__)):
        model.pieces.add(piece="".join([to_char[b] for b in token]), score=-float(place), type=proto.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece=_UNKNOWN, score=0.0, type=proto.ModelProto.SentencePiece.UNKNOWN)
    trainer, normalizer = model.trainer_spec, model.normalizer_spec
    trainer.model_type, trainer.vocab_size, trainer.unk_id, trainer.unk_piece = proto.TrainerSpec.BPE, len(ranks) + 1, len(ranks), _UNKNOWN
    trainer.bos_id = trainer.eos_id = trainer.pad_id = -1
    normalizer.name, normalizer.precompiled_charsmap = "identity", b""
    normalizer.add_dummy_prefix = normalizer.remove_extra_whitespaces = normalizer.escape_whitespaces = False
    return model.SerializeToString()


class _Kept:
    """Ids by key, for short keys between KEPT and twice as many."""

    def __init__(self) -> None:
        self.new: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # those before; what is asked for again moves up

    def of(self, keys: Iterable[str], find: Callable[[list[str]], list[bytes]]) -> dict[str, bytes]:
        """The ids of keys that ``new`` lacks; ``find`` gives those that aren't kept at all."""
        if len(self.new) >= KEPT:
            self.new, self.older = {}, self.new
        older, out, rest = self.older.get, {}, []
        for k in keys:
            ids = older(k)
            if ids is None:
                rest.append(k)
            else:
                out[k] = ids
        out.update(zip(rest, find(rest), strict=True) if rest else ())
        self.new.update(out if max(map(len, out)) <= SHORT else {k: v for k, v in out.items() if len(k) <= SHORT})
        return out


class ByteBpe:
    """A serialised model with the ranks of its pieces and the pattern of pre-tokens; ids are little-endian, 32 bits each."""

    def __init__(self, model: bytes, ranks: np.ndarray, pattern: str, by_chunks: bool) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.unknown = self.model.unk_id()
        self.ranks = ranks.astype("<u4")
        to_char = byte_alphabet()
        self.to_char = dict(enumerate(to_char))
        to_byte = {c: b for b, c in enumerate(to_char)}
        pieces = [bytes([to_byte[c] for c in self.model.id_to_piece(k)]) for k in range(len(ranks))]
        self.blob, self.sizes = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces], np.int32)
        self.starts = np.cumsum(self.sizes, dtype=np.int32) - self.sizes
        self.pattern = regex.compile(pattern, regex.V0)
        self.words, self.chunks, self.by_chunks = _Kept(), _Kept(), by_chunks

    def _mapped(self, word: str) -> str:
        if word.isascii() and word.isprintable():  # printable characters stand for themselves, but for the space
            return word.replace(" ", self.to_char[32])
        return word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_char)

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each pre-token."""
        mapped = [self._mapped(w) for w in words]
        places = self.model.piece_to_id(mapped)
        places = [[k] if k != self.unknown else None for k in places]
        parts = iter(self.model.encode([m for m, k in zip(mapped, places, strict=True) if k is None], num_threads=1))
        places = [k or next(parts) for k in places]
        ids, ends = self.ranks[list(chain.from_iterable(places))].tobytes(), [0, *accumulate(4 * len(p) for p in places)]
        return [ids[i:j] for i, j in pairwise(ends)]

    def _encode_lists(self, words: list[str], sizes: list[int]) -> list[bytes]:
        """The joined ids of each list of pre-tokens, of which ``words`` holds all and ``sizes`` the lengths."""
        ids = list(map(self.words.new.get, words))
        missing = dict.fromkeys([w for w, i in zip(words, ids, strict=True) if i is None])
        if missing:
            more = self.words.of(missing, self._encode_words)
            ids = [more[w] if i is None else i for w, i in zip(words, ids, strict=True)]
        each = iter(ids)
        return [next(each) if n == 1 else b"".join(islice(each, n)) for n in sizes]

    def _encode_chunks(self, parts: list[str]) -> list[bytes]:
        """The ids of each part with a space before it."""
        words, sizes = [], []
        for p in parts:
            if p.isalpha():
                words.append(" " + p)
                sizes.append(1)
                continue
            letters = p.rstrip(_ENDS)
            if letters.isalpha():
                words += (" " + letters, p[len(letters) :])
                sizes.append(2)
            else:
                found = self.pattern.findall(" " + p)
                words += found
                sizes.append(len(found))
        return self._encode_lists(words, sizes)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text.

        With the public pattern a single space after a character that is no
        white space always begins a pre-token, and no pre-token or its look
        ahead passes it; so a text falls into chunks there, whose ids are kept.
        """
        if not self.by_chunks:
            words = [self.pattern.findall(t) for t in texts]
            return self._encode_lists(list(chain.from_iterable(words)), list(map(len, words)))
        out: list[bytes] = []
        for k, group in groupby(texts, lambda t: len(t) > LONG):
            out += [b"".join([self._encode_parts([p])[0] for p in _cut(t)]) for t in group] if k else self._encode_parts([(t, True) for t in group])
        return out

    def _encode_parts(self, texts: list[tuple[str, bool]]) -> list[bytes]:
        """The ids of each text that ends where a text may be cut; (text, whether it begins there too, without the space)."""
        split = [_joined(t.split(" ")) for t, _ in texts]
        heads = [self.pattern.findall(parts[0]) if first else [] for parts, (_, first) in zip(split, texts, strict=True)]
        heads = self._encode_lists(list(chain.from_iterable(heads)), list(map(len, heads)))
        split = [parts[1:] if first else parts for parts, (_, first) in zip(split, texts, strict=True)]
        found = [list(map(self.chunks.new.get, parts)) for parts in split]
        missing = dict.fromkeys([p for parts, ids in zip(split, found, strict=True) if None in ids for p, i in zip(parts, ids, strict=True) if i is None])
        more = self.chunks.of(missing, self._encode_chunks) if missing else {}
        return [head + b"".join([more[p] if i is None else i for p, i in zip(parts, ids, strict=True)] if None in ids else ids) for head, parts, ids in zip(heads, split, found, strict=True)]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for, by the inverse mapping."""
        ranks = np.frombuffer(ids, "<u4")
        out = []
        for k in range(0, len(ranks), BLOCK):
            part = ranks[k : k + BLOCK]
            places = np.searchsorted(self.ranks, part) if self.ranks[-1] >= len(self.ranks) else part
            if len(places) and (places.max() >= len(self.ranks) or (self.ranks[places] != part).any()):
                raise ValueError("an id is not in the vocabulary")
            sizes = self.sizes[places]
            ends = np.cumsum(sizes, dtype=np.int32)
            at = np.repeat(self.starts[places] - ends + sizes, sizes)
            at += np.arange(len(at), dtype=np.int32)
            out.append(self.blob[at].tobytes())
        return b"".join(out)


#: A space where a text may be cut.
_CUT = regex.compile(r"(?<=\S) ")
#: Some characters that end words; a run of them is one pre-token.
_ENDS = ".,;:!?*&$%|#)"


def _cut(text: str) -> Iterator[tuple[str, bool]]:
    """A text in lengths of about LONG, without the spaces it is cut at; with the first goes True."""
    at, first = 0, True
    while True:
        cut = _CUT.search(text, at + LONG)
        yield text[at : cut.start() if cut else len(text)], first
        if cut is None:
            return
        at, first = cut.end(), False


def _joined(parts: list[str]) -> list[str]:
    """Parts between spaces, joined where the space follows white space or begins the text."""
    if all(parts) and not any([p[-1].isspace() for p in parts]):
        return parts
    out, run = [], [parts[0]]
    for p in parts[1:]:
        if run[-1] and not run[-1][-1].isspace():
            out.append(" ".join(run))
            run = [p]
        else:
            run.append(p)
    return [*out, " ".join(run)]


_compiled: dict[tuple[str, str], ByteBpe] = {}


def compiled(shipped: tuple[bytes, np.ndarray, str, bool]) -> ByteBpe:
    """The model, loaded once in each Python worker."""
    key = hashlib.sha256(shipped[0]).hexdigest(), shipped[2]
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = ByteBpe(*shipped)
    return _compiled[key]


def vocabulary_of(path: str | None = None, pattern: str | None = None) -> tuple[bytes, np.ndarray, str, bool]:
    """What executors need: the serialised model, the rank of each piece, the pattern of pre-tokens (default: the public one), and whether it is that."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = read_ranks(f.read())
    pattern = pattern or public_tokenizers.PATTERN
    return model_bytes(ranks), np.array(sorted(ranks.values()), np.int64), pattern, pattern == public_tokenizers.PATTERN


def encode(docs: DataFrame, *, vocabulary: str | None = None, pattern: str | None = None, text: str = "text", ids: bool = True, decoded: bool = False, digests: bool = True, keep_text: bool = False) -> DataFrame:
    """``docs`` without its text, and n_tokens, ids (array<int>), decoded (binary), ids_sha256 and decoded_sha256 as asked for.

    Columns of ``docs`` that have these names are replaced.  The vocabulary (a
    file of about 1 MB) is read by the driver and sent to the executors.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary_of(vocabulary, pattern))
    new = [T.StructField("n_tokens", T.LongType(), False)]
    new += [T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)] * ids + [T.StructField("decoded", T.BinaryType(), False)] * decoded
    new += [T.StructField("ids_sha256", T.StringType(), False), T.StructField("decoded_sha256", T.StringType(), False)] * digests
    names = {f.name for f in new}
    rest = [f for f in docs.schema.fields if f.name not in names and (keep_text or f.name != text)]
    slim = docs.select(*[F.col(f"`{f.name}`") for f in rest], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__q_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = compiled(shipped.value)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                found = model.encode(part.column(len(rest)).to_pylist())
                back = [model.decode(a) for a in found] if decoded or digests else []
                out = [part.column(i) for i in range(len(rest))]
                out.append(pa.array([len(a) // 4 for a in found], pa.int64()))
                if ids:
                    ends = np.cumsum([0] + [len(a) // 4 for a in found])
                    out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<u4").astype(np.int32))))
                if decoded:
                    out.append(pa.array(back, pa.binary()))
                if digests:
                    out += [pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string()) for xs in (found, back)]
                yield pa.RecordBatch.from_arrays(out, names=[f.name for f in rest] + [f.name for f in new])

    return slim.mapInArrow(freeing(run), T.StructType(rest + new))


def decode(rows: DataFrame, *, vocabulary: str | None = None, ids: str = "ids", to: str = "text") -> DataFrame:
    """``rows`` with the text of the array ``ids`` (bytes that are no UTF-8 as the replacement character); null for null."""
    shipped = rows.sparkSession.sparkContext.broadcast(vocabulary_of(vocabulary))

    @F.pandas_udf(T.StringType())
    def texts(col: pd.Series) -> pd.Series:
        model = compiled(shipped.value)
        return col.map(lambda a: None if a is None else model.decode(np.asarray(a, '<u4').tobytes()).decode("utf-8", "replace"))

    return rows.withColumn(to, texts(F.col(f"`{ids}`")))
