"""Language identification: a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in windows from both sides, labels every
position with a probability for each language, and the document's probabilities
are the mean over its positions.  It is written and trained in numpy, by back
propagation through time, on a bounded sample of labelled documents.

Defined results: a null text, or one without any letter, is ``und`` with score
0; without labelled documents every other text is ``und`` too.  Of languages of
equal probability the first by name is taken.  A very long text is read whole.
An empty table gives no rows.  Rows that repeat are labelled each, and learned
from once (the one of least language and windows).  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold

#: At most so many labelled documents are fitted on (those of smallest hash), with so many windows of each.
MAX_TRAIN_DOCS, MAX_WINDOWS = 4000, 6
WINDOW, HIDDEN, PAD = 64, 16, 256
#: Windows that run through the network at a time.
LANES = 2048


@dataclass
class Network:
    """Weights of both directions: ``x`` byte table, ``u`` recurrent, ``b`` its bias; ``w`` and ``c`` give the labels."""

    labels: list[str]
    x: np.ndarray  # 2, 257, 3 H: update, reset, candidate
    u: np.ndarray  # 2, H, 3 H
    b: np.ndarray  # 2, H: bias of the candidate's recurrent part
    w: np.ndarray  # 2 H, labels
    c: np.ndarray  # labels

    @staticmethod
    def fresh(labels: list[str], hidden: int, seed: int) -> Network:
        r = np.random.default_rng(seed)
        draw = lambda *shape, scale: r.normal(0, scale, shape).astype(np.float32)
        return Network(labels, draw(2, PAD + 1, 3 * hidden, scale=0.5), draw(2, hidden, 3 * hidden, scale=hidden**-0.5), np.zeros((2, hidden), np.float32), draw(2 * hidden, len(labels), scale=0.3), np.zeros(len(labels), np.float32))

    def weights(self) -> list[np.ndarray]:
        return [self.x, self.u, self.b, self.w, self.c]

    def run(self, codes: np.ndarray, side: int, trace: list | None = None) -> np.ndarray:
        """States (time, lanes, H) of one direction over codes (time, lanes); ``trace`` gets what back propagation needs."""
        n, (x, u, b) = self.u.shape[1], (self.x[side], self.u[side], self.b[side])
        out = np.empty((*codes.shape, n), np.float32)
        h = np.zeros((codes.shape[1], n), np.float32)
        for t in range(len(codes)) if side == 0 else range(len(codes) - 1, -1, -1):
            g, a = x[codes[t]], h @ u
            zr = g[:, : 2 * n] + a[:, : 2 * n]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r = zr[:, :n], zr[:, n:]
            s = a[:, 2 * n :] + b
            k = np.tanh(g[:, 2 * n :] + r * s)
            if trace is not None:
                trace.append((t, h, z, r, s, k))
            h = h + z * (k - h)
            out[t] = h
        return out

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        """(time, lanes, labels): each position's probabilities."""
        n = self.u.shape[1]
        logits = self.run(codes, 0) @ self.w[:n]
        logits += self.run(codes, 1) @ self.w[n:]
        logits += self.c
        logits -= logits.max(axis=-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=-1, keepdims=True)
        return logits

    def gradients(self, codes: np.ndarray, real: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over the real positions, and its gradients, through time."""
        n, traces = self.u.shape[1], ([], [])
        h = np.concatenate([self.run(codes, s, traces[s]) for s in (0, 1)], axis=-1)
        logits = h @ self.w + self.c
        logits -= logits.max(axis=-1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=-1, keepdims=True)
        lanes = np.arange(codes.shape[1])
        loss = -float((np.log(p[:, lanes, label] + 1e-9) * real).sum() / real.sum())
        d = p
        d[:, lanes, label] -= 1
        d *= (real / real.sum())[:, :, None]
        gw, gc, dh = np.einsum("tbi,tbj->ij", h, d, optimize=True), d.sum(axis=(0, 1)), d @ self.w.T
        gx, gu, gb = np.zeros_like(self.x), np.zeros_like(self.u), np.zeros_like(self.b)
        for side in (0, 1):
            flow = np.zeros((codes.shape[1], n), np.float32)
            every, codes_of = [], []
            for t, h0, z, r, s, k in reversed(traces[side]):
                g = flow + dh[t, :, side * n : (side + 1) * n]
                dk = g * z * (1 - k * k)
                dz = g * (k - h0) * z * (1 - z)
                dr = dk * s * r * (1 - r)
                ds = dk * r
                da = np.concatenate([dz, dr, ds], axis=1)
                gu[side] += h0.T @ da
                gb[side] += ds.sum(axis=0)
                flow = g * (1 - z) + da @ self.u[side].T
                every.append(np.concatenate([dz, dr, dk], axis=1))
                codes_of.append(codes[t])
            flat, rows = np.concatenate(codes_of), np.concatenate(every)
            order = np.argsort(flat, kind="stable")
            seen, at = np.unique(flat[order], return_index=True)
            gx[side][seen] = np.add.reduceat(rows[order], at, axis=0)
        return loss, [gx, gu, gb, gw, gc]


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (windows, WINDOW), the rest of each text's last window padded, and each text's number of windows."""
    count = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    out = np.full((int(count.sum()), WINDOW), PAD, np.int16)
    flat, at = out.reshape(-1), 0
    for t, n in zip(texts, count, strict=True):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += n * WINDOW
    return out, count


def fit(texts: list[str], langs: list[str], *, hidden: int = HIDDEN, lanes: int = 256, most_steps: int = 160, rate: float = 0.02, seed: int = 7) -> Network | None:
    """Train on windows spread evenly over each text; stops early once recent batches are nearly all right."""
    labels = sorted(set(langs))
    if not labels:
        return None
    codes, count = windows([t.encode("utf-8", "replace") for t in texts])
    begin = np.concatenate([[0], np.cumsum(count)])
    pick = [np.unique(np.linspace(begin[k], begin[k + 1] - 1, min(MAX_WINDOWS, n)).astype(int)) for k, n in enumerate(count) if n]
    own = [np.full(len(p), labels.index(langs[k])) for p, k in zip(pick, np.flatnonzero(count), strict=True)]
    if not pick:
        return None
    codes, label = codes[np.concatenate(pick)], np.concatenate(own)
    net, r = Network.fresh(labels, hidden, seed), np.random.default_rng(seed)
    first, second = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()]
    recent: list[float] = []
    order = np.empty(0, int)
    for step in range(1, most_steps + 1):
        if len(order) < min(lanes, len(codes)):
            order = r.permutation(len(codes))
        take, order = order[:lanes], order[lanes:]
        x = codes[take].T.astype(np.intp)
        loss, grads = net.gradients(x, (x != PAD).astype(np.float32), label[take])
        norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
        speed = rate * min(1.0, 2 * (1 - step / (most_steps + 1)))
        for w, g, a, b in zip(net.weights(), grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= (speed * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        recent = [*recent[-9:], loss]
        if len(recent) == 10 and max(recent) < 0.03:
            break
    return net


def train(docs: DataFrame, *, max_docs: int = MAX_TRAIN_DOCS, **options) -> Network | None:
    """Fit on at most ``max_docs`` documents with a language, outside of the held-out fold (crc32 of the id, modulo 4, is 2)."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold("doc_id", 4, 2))
    ids = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    # max_docs ids: small enough to broadcast at any size of the table; of a long text the spread windows alone go to the driver
    spread = F.transform(
        F.sequence(F.lit(0), F.lit(MAX_WINDOWS - 1)),
        lambda k: F.substring("text", F.floor(k * F.greatest(F.length("text") - WINDOW, F.lit(0)) / (MAX_WINDOWS - 1)).cast("int") + 1, F.lit(WINDOW)),
    )
    # one row an id, however often the table repeats it
    one = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", F.array_distinct(spread).alias("parts"))).alias("x"))
    got = one.select("doc_id", F.col("x.lang").alias("lang"), F.explode("x.parts").alias("part")).where("part <> ''").toPandas().sort_values(["doc_id", "lang", "part"])
    return fit(list(got["part"]), list(got["lang"]), **options)


def identify(docs: DataFrame, net: Network | None, *, runs: bool = False) -> DataFrame:
    """doc_id, lang_pred and score of every document; with ``runs`` also the stretches of bytes of one label, as array<struct<start, end, lang>>."""
    slim = docs.select("doc_id", F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))
    doc_type = dict(docs.dtypes)["doc_id"]

    def pooled(texts: list[bytes]) -> tuple[np.ndarray, list]:
        codes, count = windows(texts)
        total, best = np.empty((len(codes), len(net.labels))), []
        for k in range(0, len(codes), LANES):
            x = codes[k : k + LANES].T.astype(np.intp)
            p = net.probabilities(x)
            total[k : k + LANES] = np.einsum("tbl,tb->bl", p, (x != PAD).astype(np.float32))
            if runs:
                best.append(p.argmax(axis=-1).T.astype(np.int8))
        begin = np.concatenate([[0], np.cumsum(count)])
        sums = np.add.reduceat(total, begin[:-1], axis=0) / np.array([len(t) for t in texts])[:, None]
        if not runs:
            return sums, []
        flat = np.concatenate(best).reshape(-1)
        out = []
        for k, t in enumerate(texts):
            own = flat[begin[k] * WINDOW : begin[k] * WINDOW + len(t)]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]])
            out.append([(int(a), int(b), net.labels[own[a]]) for a, b in zip(cut[:-1], cut[1:], strict=True)])
        return sums, out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 400):
                part = batch.iloc[k : k + 400]
                lang, score, spans = np.full(len(part), "und", object), np.zeros(len(part)), [[] for _ in range(len(part))]
                some = [i for i, t in enumerate(part["text"]) if t] if net is not None else []
                if some:
                    p, found = pooled([part["text"].iloc[i].encode("utf-8", "replace") for i in some])
                    lang[some] = np.array(net.labels, object)[p.argmax(axis=1)]
                    score[some] = np.clip(p.max(axis=1), 0, 1)
                    for i, f in zip(some, found, strict=False):
                        spans[i] = f
                out = pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "lang_pred": lang, "score": score})
                if runs:
                    out["runs"] = spans
                yield out

    schema = f"doc_id {doc_type}, lang_pred string, score double" + ", runs array<struct<start:long,end:long,lang:string>>" * runs
    return slim.mapInPandas(run, schema)


def predict(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    found = identify(docs, train(docs, **options))
    return found.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
