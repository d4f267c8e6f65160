"""Token counts under a unigram model, by dynamic programming that a trie of pre-tokens shares.

A pre-token (a word with the mark of its start) is cut into the pieces whose
log probabilities add up to the most.  The best score of a prefix depends on
the prefix alone, so the distinct pre-tokens of a batch are put in a trie, and
the forward scores are computed once per trie node, level by level in numpy;
each pre-token's token count is that of its terminal node.

Pieces come from a public vocabulary file, which carries no probabilities but
an order; a piece's probability is by the Zipf-Mandelbrot law of its place in
that order, 1 / (place + SHIFT).  Characters that no piece covers are spelled in
bytes, a token each, at BYTE_SCORE.  Equal scores go to the longer last piece.

Defined results: a null or blank text has no tokens; a very long text or word
is counted whole; an empty table gives no rows; rows that repeat, or share a
doc_id, count each; white space is Python's; extra columns aren't read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
SHIFT = 2.7
BYTE_SCORE = -20.0
#: Pre-tokens up to this length go through the trie level by level, as rows of a matrix; longer ones, which would cost
#: their length for all, in depth first order, each from the prefix that it shares with the one before.
LONGEST = 48
#: Texts whose pre-tokens share one trie.
TEXTS = 1500


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces(raw: bytes) -> dict[str, float]:
    """Log probabilities of the ordinary pieces, by the Zipf-Mandelbrot law."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_proto=raw)
    own = [p.id_to_piece(i) for i in range(p.vocab_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
    return {t: float(-np.log(k + 1 + SHIFT)) for k, t in enumerate(own)}


class Unigram:
    """Pieces as a trie in sorted arrays: (state, character) to state, and each state's score if it ends a piece."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        step: dict[int, int] = {}
        ends = {}
        for text, score in scores.items():
            state = 0
            for c in text:
                state = step.setdefault(state << 21 | ord(c), len(step) + 1)
            ends[state] = score
        self.keys = np.array(sorted(step), np.int64)
        self.to = np.array([step[k] for k in self.keys.tolist()], np.int64)
        self.ends = np.full(len(step) + 1, np.nan)
        self.ends[list(ends)] = list(ends.values())

    def depth_first(self, words: list[str]) -> list[int]:
        """Tokens of each of the sorted ``words``: the trie walked from word to word, so that a shared prefix keeps its scores."""
        best, n, out, before = [0.0], [0], [], ""
        for word in words:
            shared = len(os.path.commonprefix([before, word]))
            del best[shared + 1 :], n[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                width = len(word[end - 1].encode("utf-8", "surrogatepass"))
                top, tokens = best[end - 1] + width * BYTE_SCORE, n[end - 1] + width
                for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
                    score = self.scores.get(word[start:end])
                    if score is not None and best[start] + score >= top:
                        top, tokens = best[start] + score, n[start] + 1
                best.append(top)
                n.append(tokens)
            out.append(n[-1])
            before = word
        return out

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each of the distinct pre-tokens ``words``."""
        out = np.zeros(len(words), np.int64)
        length = np.array([len(w) for w in words], np.int64)
        long = sorted(np.flatnonzero(length > LONGEST).tolist(), key=words.__getitem__)
        out[long] = self.depth_first([words[k] for k in long])
        own = np.flatnonzero((length > 0) & (length <= LONGEST))
        if not len(own):
            return out
        text = np.array([words[k] for k in own])
        order = np.argsort(text, kind="stable")
        own, text = own[order], text[order]
        n, wide = len(own), int(length[own].max())
        chars = text.view(np.uint32).reshape(n, -1).astype(np.int64)
        length = length[own]
        node = np.zeros((n, wide + 1), np.int64)  # of each word's prefixes, within the prefix's level
        best, tokens = [np.zeros(1)], [np.zeros(1, np.int64)]
        new = np.zeros(n, bool)  # where a word leaves the trie path of the word before
        new[0] = True
        live_node, live_start, live_state = (np.zeros(0, np.int64) for _ in range(3))
        for d in range(1, wide + 1):
            c = chars[:, d - 1]
            new = new | np.concatenate([[True], c[1:] != c[:-1]])
            node[:, d] = np.cumsum(new) - 1
            deep = length >= d
            head = np.flatnonzero(new & deep)  # one word for each node of this level
            at, parent = node[head, d], node[head, d - 1]
            size = int(node[-1, d]) + 1
            # live matches of the parents go on in the children; a match begins at every node
            order = np.argsort(live_node, kind="stable")
            live_node, live_start, live_state = live_node[order], live_start[order], live_state[order]
            lo, hi = np.searchsorted(live_node, parent, "left"), np.searchsorted(live_node, parent, "right")
            many = hi - lo
            rep = np.repeat(np.arange(len(head)), many)
            source = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))
            word = np.concatenate([rep, np.arange(len(head))])
            start = np.concatenate([live_start[source], np.full(len(head), d - 1)])
            state = np.concatenate([live_state[source], np.zeros(len(head), np.int64)])
            key = state << 21 | c[head][word]
            spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[spot] == key
            word, start, state = word[ok], start[ok], self.to[spot[ok]]
            live_node, live_start, live_state = at[word], start, state
            # the bytes of the last character, and every piece that ends here
            width = 1 + (c[head] > 0x7F).astype(np.int64) + (c[head] > 0x7FF) + (c[head] > 0xFFFF)
            top, count = best[d - 1][parent] + width * BYTE_SCORE, tokens[d - 1][parent] + width
            score = self.ends[state]
            hit = np.flatnonzero(~np.isnan(score))
            hit = hit[np.argsort(-start[hit], kind="stable")]  # from the shortest piece to the longest, which wins ties
            for s in np.unique(start[hit])[::-1]:
                mine = hit[start[hit] == s]
                w, before = word[mine], node[head[word[mine]], s]
                value = best[s][before] + score[mine]
                better = value >= top[w]
                top[w[better]], count[w[better]] = value[better], tokens[s][before[better]] + 1
            level_best, level_count = np.full(size, -np.inf), np.zeros(size, np.int64)
            level_best[at], level_count[at] = top, count
            best.append(level_best)
            tokens.append(level_count)
            done = np.flatnonzero(length == d)
            out[own[done]] = level_count[node[done, d]]
        return out


_compiled: dict[str, Unigram] = {}


def compiled(raw: bytes) -> Unigram:
    key = hashlib.sha256(raw).hexdigest()
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Unigram(pieces(raw))
    return _compiled[key]


def count(docs: DataFrame, *, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every document."""
    with open(vocabulary or default_vocabulary(), "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())  # a file of half a MB
    doc_type = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = compiled(raw.value)
        for batch in batches:
            for k in range(0, len(batch), TEXTS):
                part = batch.iloc[k : k + TEXTS]
                words = [t.split() for t in part["text"]]
                n = np.array([len(w) for w in words], np.int64)
                flat = np.empty(int(n.sum()), object)
                flat[:] = list(chain.from_iterable(words))
                codes, distinct = pd.factorize(flat)
                each = model.count([MARK + w for w in distinct])[codes] if len(flat) else np.zeros(0, np.int64)
                sums = np.concatenate([[0], np.cumsum(each)])
                ends = np.cumsum(n)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n_pretokens": n, "n_tokens": sums[ends] - sums[ends - n]})

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, f"doc_id {doc_type}, n_pretokens long, n_tokens long")
