"""The pipeline's operators against brute force, on small tables with the awkward cases."""

import hashlib
import io
import random
import re
import zipfile

import numpy as np
import pytest

llm = pytest.importorskip("quern.llm")
from quern.llm import ann, bpe, exact_topk, jaccard, language_id, mixing, pii, quality, token_counts, warc  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"
WORDS = "the mill stone turns slowly while grain falls into hopper and flour leaves through spout".split()


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    text = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))
    base = text(60)
    rows = [(i, text(r.randrange(1, 80)), "en", f"s{i % 4}" if i % 5 else None, 1, "x") for i in range(40)]
    rows += [(100, base, "en", "s0", 1, "x"), (101, base, "en", "s0", 1, "x"), (102, base + " tail1", "en", "s1", 1, "x"), (102, base + " tail1", "en", "s1", 1, "x")]
    rows += [(200, None, None, None, None, None), (201, "", "en", "s0", 0, "x"), (202, "a@b.org or +1 (555) 010-9999 or 4111111111111111 or 10.0.0.1 or GB82 WEST 1234 5698 7654 32", "en", "s1", 1, "x"), (203, "9" * 30_000, "en", "s1", 1, "x")]
    return spark.createDataFrame(rows, SCHEMA)


def test_pii(docs):
    def luhn(x):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(x))) % 10 == 0

    def brute(text):
        out = []
        for k, (name, p) in enumerate(pii.BASE.items()):
            for m in re.finditer(p, text, re.ASCII):
                d = re.sub("[^0-9]", "", m[0])
                if {"email": True, "ip": name != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[name]:
                    out.append((m.start(), k, m.end(), name))
        return ",".join(f"{n}:{a}:{e}" for a, _, e, n in sorted(out))

    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    for r in docs.where("doc_id <> 203").collect():
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(brute(r["text"] or "").encode()).hexdigest()
    assert got[203]["spans"] == "" and "iban" in got[202]["spans"]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).where("doc_id in (200, 202)").collect()}
    assert clean[200] is None and clean[202].startswith("<EMAIL> or <PHONE> or <CARD> or <IP> or <IBAN>")


def test_jaccard(docs):
    rows = [r.asDict() for r in docs.collect()]
    sets = {}
    for r in rows:
        w = (r["text"] or "").split()
        sets[r["text"]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    links = lambda t: sum(bool(sets[t] | s) and u not in (t, None) and len(sets[t] & s) >= 0.8 * len(sets[t] | s) for u, s in sets.items())
    got = jaccard.classes(docs).collect()
    assert len(got) == len(rows)
    of = {r["doc_id"]: r for r in got}
    for r in rows:
        assert of[r["doc_id"]]["n_links"] == (links(r["text"]) if r["text"] else 0)
    assert {of[i]["class_id"] for i in (100, 101, 102)} == {100}
    kept = sorted(r["doc_id"] for r in jaccard.keep_one(docs).collect())
    assert 100 in kept and not {101, 102} & set(kept) and len(kept) == len(set(kept))


@pytest.mark.parametrize("kind", ["docs", "odd", "blank", "empty"])
def test_mixing_is_duckdbs(spark, docs, kind):
    """Against the SQL on awkward tables: null and clashing columns, repeats, documents longer than their source's target, no words at all."""
    import duckdb
    import pandas as pd

    r = random.Random(4)
    rows = {
        "docs": [(x["doc_id"], x["text"], x["source"]) for x in docs.collect()],
        "odd": [(i, "w " * r.randrange(40), r.choice(["a", "b", "é", "", None])) for i in range(200)] + [(7, "w " * 5000, "z"), (8, None, "a"), (8, "w", "a"), (9, "\x1c \xa0", None)],
        "blank": [(1, None, "a"), (2, " \n", None)], "empty": [],
    }[kind]
    frame = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, source string, size string")
    got = sorted(tuple(x) for x in mixing.mix(frame).collect())
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "int64", "text": object, "source": object}))
    want = sorted(con.sql(f"select doc_id, size, source_size, target, taken from ({mixing.SQL})").fetchall()) if rows else []
    assert [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in want]
    assert all(abs(a[3] - b[3]) < 1e-6 for a, b in zip(got, want, strict=True))
    once = {}
    for i, n, *_, taken in got:
        once[i] = max(once.get(i, 0), taken // n if n else 0)
    if kind != "odd":  # there two rows of one id have sizes of their own
        out = mixing.take(frame)
        each = [i for i, text, _ in rows if (text or "").strip(" \t\n") for _ in range(once[i])]
        assert out.columns == frame.columns and sorted(x["doc_id"] for x in out.collect()) == sorted(each)


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    t = mixing.targets({"a": 10, "b": 100, None: 100})
    assert t["a"] == 20 and abs(sum(t.values()) - 315) < 1e-9


def test_bpe_is_the_librarys(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    model = bpe.WordBpe(open(bpe.default_vocabulary(), "rb").read())
    r = random.Random(5)
    for _ in range(3000):
        text = "".join(r.choice("aehinorst  éßΣ字1!'\t\x1c<|endoftext|>") for _ in range(r.randrange(40)))
        ids = t.encode(text, add_special_tokens=False).ids
        assert model.encode(text) == (" ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False))
    from pyspark.sql import functions as F

    odd = spark.createDataFrame([(1, "x" * 200_000 + " é" * 1000), (2, None), (2, None), (3, ""), (None, " \t\n"), (5, "ab" * 50_000)], "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    for frame in (docs, odd):
        rows = frame.collect()
        out = bpe.encode(frame, decoded=True)
        got = out.collect()
        assert len(got) == len(rows) and bpe.decode(out.select("ids", "decoded"), to="again").where("again <> decoded").count() == 0
        want = sorted((str(r["doc_id"]), t.encode(r["text"] or "", add_special_tokens=False).ids) for r in rows)
        assert sorted((str(r["doc_id"]), list(r["ids"])) for r in got) == want and all(r["n_tokens"] == len(r["ids"]) for r in got)
        for r in got:
            assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()
            assert r["decoded"] == t.decode(list(r["ids"]), skip_special_tokens=False) and r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert bpe.encode(docs.limit(0)).count() == 0


def test_token_counts():
    """Against all ways to cut a word, and words of any length against a plain recursion."""
    scores = token_counts.pieces(open(token_counts.default_vocabulary(), "rb").read())
    m = token_counts.Unigram(scores)
    r = random.Random(6)

    def cuts(word):
        for k in range(1 << (len(word) - 1)):
            at = [0, *[i + 1 for i in range(len(word) - 1) if k >> i & 1], len(word)]
            total = n = 0
            for a, b in zip(at, at[1:], strict=False):
                own = scores.get(word[a:b])
                if own is None and b - a > 1:
                    break
                spelled = len(word[a:b].encode())
                own, count = (own, 1) if own is not None and own >= spelled * token_counts.BYTE_SCORE else (spelled * token_counts.BYTE_SCORE, spelled)
                total, n = total + own, n + count
            else:
                yield total, n

    short = sorted({"▁" + "".join(r.choice("aehinorsté한🙂") for _ in range(r.randrange(1, 9))) for _ in range(150)})
    for word, n in zip(short, m.count(short).tolist(), strict=True):
        every = list(cuts(word))
        best = max(t for t, _ in every)
        assert n in {k for t, k in every if t > best - 1e-9}

    def plain(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            width = len(word[end - 1].encode())
            options = [(best[end - 1][0] + width * token_counts.BYTE_SCORE, 0, best[end - 1][1] + width)]
            options += [(best[a][0] + scores[word[a:end]], end - a, best[a][1] + 1) for a in range(max(0, end - m.longest), end) if word[a:end] in scores]
            top = max(options, key=lambda o: (o[0], o[1]))
            best.append((top[0], top[2]))
        return best[-1][1]

    words = sorted({"▁" + "".join(r.choice("aehinorsté한🙂") for _ in range(r.randrange(130))) for _ in range(1500)} | {"▁" + "ha" * 400, "▁" + "ha" * 400 + "x"})
    assert m.count(words).tolist() == [plain(w) for w in words]


def test_token_counts_of_documents(spark, docs):
    got = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in token_counts.count(docs).collect()}
    m = token_counts.Unigram(token_counts.pieces(open(token_counts.default_vocabulary(), "rb").read()))
    for r in docs.collect():
        words = ["▁" + w for w in (r["text"] or "").split()]
        assert got[r["doc_id"]] == (len(words), sum(int(m.count([w])[0]) for w in words))


def test_quality_column_is_the_model(spark, docs):
    """The compiled column gives the model's score of each row's statistics; nulls, empty texts, repeats and a column named score included."""
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)] + [(5, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    x = quality.with_statistics(docs).select("doc_id", *quality.FEATURES).toPandas()
    want = dict(zip(x["doc_id"], model.score(x[list(quality.FEATURES)].to_numpy(float)), strict=True))
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert abs(r["score"] - want[r["doc_id"]]) < 1e-9 and r["predicted"] == int(r["score"] >= 0.3)
    assert quality.classify(docs.limit(0), labels).count() == 0 and quality.keep_good(docs, labels).columns == docs.columns
    assert quality.classify(docs, labels.limit(0)).where("score <> 0.5").count() == 0


def test_quality_learns():
    r = np.random.default_rng(0)
    x = r.random((1500, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 0.8)).astype(float)
    m = quality.fit(x, y)
    assert ((m.score(x) >= 0.5) == (y == 1)).mean() > 0.97
    assert 0 < quality.fit(x[:5], np.ones(5)).score(x).min() and quality.fit(x[:0], y[:0]).score(x[:1])[0] == 0.5


def test_language(docs):
    net = language_id.fit(["der die das und " * 5, "the of and to " * 5] * 20, ["de", "en"] * 20, most_steps=60)
    got = {r["doc_id"]: r for r in language_id.identify(docs, net, runs=True).collect()}
    assert got[200]["lang_pred"] == got[201]["lang_pred"] == got[203]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[100]["runs"]


def test_language_net_by_scalars():
    """Probabilities by a loop over single numbers, and gradients by differences."""
    import math

    net = language_id.Network.fresh(["a", "b", "c"], 3, 4)
    for w in net.weights():
        w += np.random.default_rng(1).normal(0, 0.3, w.shape).astype(w.dtype)
    codes = np.random.default_rng(2).integers(0, 257, (5, 2))
    p = net.probabilities(codes)
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    n = 3
    for lane in range(2):
        states = []
        for side in (0, 1):
            h, own = [0.0] * n, {}
            for t in range(5) if side == 0 else range(4, -1, -1):
                g = net.x[side, codes[t, lane]]
                a = [sum(h[i] * net.u[side, i, j] for i in range(n)) for j in range(3 * n)]
                z = [sigmoid(g[i] + a[i]) for i in range(n)]
                r = [sigmoid(g[n + i] + a[n + i]) for i in range(n)]
                k = [math.tanh(g[2 * n + i] + r[i] * (a[2 * n + i] + net.b[side, i])) for i in range(n)]
                h = [h[i] + z[i] * (k[i] - h[i]) for i in range(n)]
                own[t] = h
            states.append(own)
        for t in range(5):
            both = [*states[0][t], *states[1][t]]
            e = [math.exp(sum(both[i] * net.w[i, j] for i in range(2 * n)) + net.c[j]) for j in range(3)]
            assert np.allclose(p[t, lane], np.array(e) / sum(e), atol=1e-5)
    exact = language_id.Network(net.labels, *[w.astype(np.float64) for w in net.weights()])
    real, label = np.ones((5, 2)), np.array([0, 2])
    _, grads = exact.gradients(codes, real, label)
    r = np.random.default_rng(3)
    for w, g in zip(exact.weights(), grads, strict=True):
        for _ in range(6):
            at = tuple(r.integers(0, s) for s in w.shape) if w is not exact.x else (r.integers(0, 2), codes[r.integers(0, 5), r.integers(0, 2)], r.integers(0, 9))
            kept = w[at]
            w[at] = kept + 1e-4
            up = exact.gradients(codes, real, label)[0]
            w[at] = kept - 1e-4
            down = exact.gradients(codes, real, label)[0]
            w[at] = kept
            assert abs((up - down) / 2e-4 - g[at]) < 2e-3 + 0.02 * abs(g[at])


def test_language_of_documents(spark, docs):
    from pyspark.sql import functions as F

    twice = docs.union(docs).withColumn("score", F.lit("clash"))
    got = language_id.predict(twice, most_steps=5).collect()
    assert len(got) == twice.count() and {r["lang_pred"] for r in got} <= {"en", "und"}
    assert language_id.predict(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(v) for v in r.normal(size=8)]) for i in range(200)] + [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (7, [9.0] * 8)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def least_of_each(rows):
    out = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v):
            out[i] = min(list(v), out.get(i, list(v)))
    return out


def best_by_whole_numbers(rows, every=50, k=5):
    """By Python's integers: (query, rank) to (id, score within a long)."""
    import math

    whole = {i: [math.floor(256 * min(max(x, -(2.0**1000)), 2.0**1000)) for x in v] for i, v in least_of_each(rows).items()}
    clip = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    out = {}
    for q in (i for i in whole if i % every == 0):
        scores = [(-clip(sum(a * b for a, b in zip(whole[q], whole[i], strict=True))), i) for i in whole if i != q and len(whole[i]) == len(whole[q])]
        for rank, (s, i) in enumerate(sorted(scores)[:k]):
            out[q, rank + 1] = (i, -s)
    return out


def vector_rows(kind):
    r = np.random.default_rng(9)
    rows = [(i, [float(v) for v in r.normal(size=6)]) for i in range(130)]
    ties = [(i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(400, 460)]
    odd = [(50, None), (500, []), (501, [float("inf")] * 6), (502, [None] * 6), (503, [0.5, 0.5]), (550, [0.25, -1.0]), (7, [9.0] * 6), (7, [9.0] * 6)]
    huge = [(600, [1.7e308] * 6), (601, [-1.7e308, 1e300, 1.0, 0.0, 0.0, 0.0]), (650, [1e-300] * 6)]
    return {"plain": rows + ties + odd, "huge": rows[:60] + huge, "few": rows[:1] + [(1, [0.0] * 6), (2, [3.0] * 6)], "alone": rows[:1], "empty": []}[kind]


@pytest.mark.parametrize("kind", ["plain", "huge", "few", "alone", "empty"])
@pytest.mark.parametrize("slices", [1, 2, 5])
def test_exact_topk(spark, kind, slices):
    rows = vector_rows(kind)
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in exact_topk.search(frame, slices=slices).collect()}
    assert got == best_by_whole_numbers(rows)


def test_exact_topk_over_blocks(spark, monkeypatch):
    from quern.llm import vectors as V

    monkeypatch.setattr(V, "BLOCK_BYTES", 1)  # blocks of 256 vectors
    r = np.random.default_rng(4)
    rows = [(i, [float(v) for v in r.normal(size=4)]) for i in range(700)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in exact_topk.search(frame).collect()}
    assert got == best_by_whole_numbers(rows)


@pytest.mark.parametrize("kind", ["plain", "huge", "few", "alone", "empty"])
def test_ann(spark, kind):
    """Every result is one of the table's with its exact score; recall against brute force; ties go to the smaller id."""
    rows = vector_rows(kind)
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    own = {i: np.array(v) for i, v in least_of_each(rows).items() if any(v)}
    got, hit, whole = ann.search(frame).collect(), 0, 0
    with np.errstate(over="ignore", invalid="ignore"):
        for q in (i for i in own if i % 20 == 0):
            mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
            assert [m[0] for m in mine] == list(range(1, len(mine) + 1))
            exact = {i: sum(int(a * 2**60) * int(b * 2**60) if abs(a) + abs(b) < 1e6 else int(a) * int(b) << 120 for a, b in zip(v, own[q], strict=True)) for i, v in own.items() if i != q and len(v) == len(own[q])}
            best = sorted(exact, key=lambda i: (-exact[i], i))[:20]
            assert len(mine) == len(best)
            hit, whole = hit + len(set(best) & {m[1] for m in mine}), whole + len(best)
            if kind == "plain":
                assert all(abs(m[2] - float(own[q] @ own[m[1]])) < 1e-12 for m in mine)
    assert hit >= 0.9 * whole


def test_ann_recall_and_share(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(3000, 32))
    frame = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(frame).toPandas()
    hit = share = n = 0
    for q, own in got.groupby("query_id"):
        score = x @ x[q]
        score[q] = -np.inf
        hit, n = hit + len(set(np.argsort(-score)[:20]) & set(own["vec_id"])), n + 20
        share += own["verified"].iat[0] / 3000 / 150
    assert hit >= 0.9 * n and share < 0.6


def test_warc(spark, monkeypatch):
    big = "<p>" + "x" * 1500
    pages = spark.createDataFrame([(1, "http://a", big), (2, None, big), (3, "http://c\r\nX: y", "small"), (4, "http://d", "small"), (5, "http://e", None)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert (got[1]["record_type"], got[1]["refers_to"], got[2]["record_type"]) == ("revisit", 2, "response")
    assert got[4]["record_type"] == "response" and got[5]["payload_bytes"] == 0 and got[1]["payload_digest"] == hashlib.sha1(big.encode()).hexdigest()
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)  # directory entries beyond the limit take the ZIP64 form
    raw = io.BytesIO()
    writer = warc.ArchiveWriter(raw)
    raw.close = lambda: None
    for i in range(5):
        writer.add(i, "http://z", b"payload %d" % i, None)
    writer.close()
    reader = warc.ArchiveReader(raw, len(raw.getvalue()))
    spots = list(reader.entries())
    assert len(spots) == 5 and warc.parse(__import__("gzip").decompress(reader._at(*spots[3])))[2] == b"payload 3"


def test_warc_awkward_rows(spark):
    big = "<p>" + "y" * 2000
    rows = [(7, None, big, "a"), (7, "u", big, "b"), (None, "u", big, "c"), (9, "u", "z" * 3_000_000, "d"), (10, "", "", "e"), (10, "", "", "e"), (11, "u", "é🙂", "f")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    got = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"]), r["payload_bytes"]) for r in warc.round_trip(pages).collect())
    size = len(big)
    want = [("7", "response", "None", size)] * 2 + [("None", "revisit", "7", size), ("9", "response", "None", 3_000_000), ("11", "response", "None", 6)] + [("10", "response", "None", 0)] * 2
    assert got == sorted(want)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_pii_is_native(docs):
    for out in (pii.find(docs), pii.redact(docs)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "Exchange"))


def test_pii_many_and_awkward_spans(spark):
    import time

    many = " ".join(f"10.0.0.{k % 256}" for k in range(50_000))
    rows = [(1, many, 1), (2, "to a@b.org 1.2.3.4@c.de +1 555 010 9999.1.2.3", 1), (3, "token=" + "ab1" * 20, 1), (3, "ip " + "9" * 20, 1), (4, "@" * 50_000 + "+1" * 50_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans long")
    began = time.time()
    got = [r.asDict() for r in pii.find(df).collect()]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).where("doc_id < 3").collect()}
    assert time.time() - began < 60
    first = next(r for r in got if r["doc_id"] == 1)
    assert first["n_ip"] == 50_000 == first["n_spans"] and clean[1] == " ".join(["<IP>"] * 50_000) and len(got) == 5
    at, ends = [], 0
    for part in many.split(" "):
        at.append(f"ip:{ends}:{ends + len(part)}")
        ends += len(part) + 1
    assert first["spans"] == ",".join(at)
    assert [r["n_secret"] for r in got if r["doc_id"] == 3 and r["n_spans"]] == [1]
    assert all(len(r["scores"]) == r["n_spans"] for r in got)


@pytest.mark.parametrize("name", ["find", "classes", "mix", "encode", "count"])
def test_empty_tables(spark, name):
    none = spark.createDataFrame([], SCHEMA)
    f = {"find": pii.find, "classes": jaccard.classes, "mix": mixing.mix, "encode": bpe.encode, "count": token_counts.count}[name]
    assert f(none).count() == 0
