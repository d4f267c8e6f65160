"""Byte-level BPE, the filter audit and whitening against the library, SQL and exact arithmetic, with the awkward cases."""

import hashlib
import random
import re
import struct
from fractions import Fraction
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

llm = pytest.importorskip("quern.llm")
from quern.llm import byte_bpe, filter_audit, whitening  # noqa: E402


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = byte_bpe.read_ranks(f.read())
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def texts():
    r = random.Random(5)
    odd = "".join(chr(r.choice([r.randrange(0, 128), r.randrange(0x80, 0xD800), r.randrange(0xE000, 0x110000)])) for _ in range(4000))
    white = "".join(r.choice(["a", "b's", " ", "  ", "\n", " ", " ", "\x1c", ".", "1", "'ll"]) for _ in range(5000))
    mixed = [" ".join(r.choice(["the", "Mühle,", "x1y2", "don't", "***", "12", "", "\n", "naïve..."]) for _ in range(r.randrange(60))) for _ in range(60)]
    return [None, "", " ", "  a", "x" * 100_000, " " * 3000, "<|endoftext|> ⁇ <unk> ▁▁", "é" * 2000, odd, white, "word, " * 300_000, "a  b" * 400_000, *mixed, mixed[0]]


def test_byte_bpe_is_the_librarys(spark, library):
    rows = [(k // 2, t, "clash", 7) for k, t in enumerate(texts())]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, extra int")
    got = byte_bpe.encode(frame, decoded=True, keep_text=True).collect()
    assert len(got) == len(rows)
    for r in got:
        text = r["text"] or ""
        ids = library[0].encode_ordinary(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and bytes(r["decoded"]) == text.encode() and r["extra"] == 7
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    back = byte_bpe.decode(byte_bpe.encode(frame.select("doc_id", "text")), to="again").collect()
    assert sorted(r["again"] for r in back) == sorted(t or "" for t in texts())
    assert byte_bpe.encode(frame.limit(0)).count() == 0


def test_byte_bpe_of_every_token_and_class(library):
    model = byte_bpe.compiled(byte_bpe.vocabulary_of())
    whole = [t.decode() for t in library[1] if not re.search(rb"[\x80-\xff]", t)]
    assert model.encode(whole) == [struct.pack(f"<{len(i)}I", *i) for i in map(library[0].encode_ordinary, whole)]
    assert model.decode(struct.pack(f"<{len(library[1])}I", *library[1].values())) == b"".join(library[1])
    with pytest.raises(ValueError):
        model.decode(struct.pack("<I", len(library[1])))
    # what the chunks rest on: Python's letters are the pattern's, and its white space holds the pattern's
    for c in map(chr, range(0x110000)):
        assert not c.isalpha() or byte_bpe.regex.match(r"\p{L}", c)
        assert c.isspace() or not byte_bpe.regex.match(r"\s", c)


def test_byte_bpe_with_its_own_ranks_and_pattern(spark, library, tmp_path, monkeypatch):
    """Ranks with gaps, another pattern, and stores that turn over."""
    import base64

    import tiktoken

    monkeypatch.setattr(byte_bpe, "KEPT", 20)
    ranks = {t: 3 * i + 5 for t, i in library[1].items() if i < 2000}
    (tmp_path / "own").write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for t, i in ranks.items()))
    for pattern in (None, r"[a-z]+|[^a-z]+"):
        shipped = byte_bpe.vocabulary_of(f"{tmp_path}/own", pattern)
        model, own = byte_bpe.ByteBpe(*shipped), tiktoken.Encoding("own", pat_str=shipped[2], mergeable_ranks=ranks, special_tokens={})
        for k in range(0, 60, 7):
            some = [t or "" for t in texts()[k : k + 7]]
            got = model.encode(some)
            assert [list(struct.unpack(f"<{len(g) // 4}I", g)) for g in got] == [own.encode_ordinary(t) for t in some]
            assert [model.decode(g).decode() for g in got] == some


def audited(docs, labels):
    """The counts of the filter audit by plain loops."""
    fails, out = [], {}
    for i, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        twin = any(j is not None and i is not None and j < i and (u or "") == t for j, u, _ in docs)
        flags = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": twin}
        mine = [(q, x) for j, q, x in labels if j is not None and j == i]
        fails.append((lang or "", flags, any(q == 1 for q, _ in mine), any(x == 1 for _, x in mine)))
    for part in {p for p, *_ in fails}:
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                c = dict.fromkeys(["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"], 0)
                for p, flags, good, toxic in fails:
                    if p == part:
                        before = any(flags[g] for g in order[:step])
                        c["kept"] += not before and not flags[f]
                        c["removed"] += not before and flags[f]
                        c["redundant"] += before and flags[f]
                        c["unique_fails"] += flags[f] and sum(flags.values()) == 1
                        c["good_lost"] += not before and flags[f] and good
                        c["toxic_lost"] += not before and flags[f] and toxic
                out[part, "".join(order), step + 1] = c
    return out


def test_filter_audit(spark):
    r = random.Random(9)
    text = lambda n, k: " ".join(f"w{r.randrange(k)}" for _ in range(n))
    some = [text(250, 900), text(250, 100), text(20, 50), "A" * 30, "", text(220, 900) + " #", "x y\x1fz\x0bw", text(3000, 50) + " ÀÉ" + "Q" * 400]
    docs = [(r.randrange(30), r.choice([*some, None]), r.choice(["en", "de", None, ""])) for _ in range(60)] + [(None, some[0], "en"), (None, some[0], "en"), (None, None, None), (-5, some[0], "en"), (-5, some[0], "en")]
    labels = [(r.randrange(30), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(30)] + [(None, 1, 1), (-5, 1, 0)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, lang string, fails string, n int")
    named = spark.createDataFrame([(*x, "x") for x in labels], "doc_id long, quality int, toxic int, digest string")
    want = audited(docs, labels)
    got = filter_audit.audit(frame, named).collect()
    assert len(got) == len(want) == 600 * 3
    total: dict = {}
    for (part, order, step), c in want.items():
        total[part, order[step - 1]] = total.get((part, order[step - 1]), 0) + c["removed"]
    for x in got:
        key = x["part"], x["filter_order"], x["step"]
        assert {c: x[c] for c in want[key]} == want[key] and x["shapley"] == total[key[0], key[1][key[2] - 1]]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([d[0] for d in docs], pa.int64()), "text": pa.array([d[1] for d in docs], pa.string()), "lang": pa.array([d[2] for d in docs], pa.string())}))
    con.register("labels", pa.table({c: pa.array([x[k] for x in labels], pa.int64()) for k, c in enumerate(("doc_id", "quality", "toxic"))}))
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(con.sql(f"select {', '.join(columns)} from ({filter_audit.SQL})").fetchall()) == sorted(tuple(x[c] for c in columns) for x in got)
    assert filter_audit.audit(frame.limit(0), named).count() == 0 and filter_audit.audit(frame, named.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def exact(rows):
    """n, deviations, and the covariance of x in fractions."""
    x = [[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for v in rows]
    n, d = len(x), len(x[0])
    s = [sum(v[k] for v in x) for k in range(d)]
    y = [[n * v[k] - s[k] for k in range(d)] for v in x]
    return n, [sum(a * a for a in v) for v in y], [[Fraction(sum(v[i] * v[j] for v in y), n**3) for j in range(d)] for i in range(d)], [[Fraction(a, n) for a in v] for v in y]


@pytest.mark.parametrize("kind", ["plain", "wide", "repeated"])
def test_whitening(spark, kind, monkeypatch):
    monkeypatch.setattr(whitening, "ENTRIES", 200)
    r = np.random.default_rng(3)
    d = {"plain": 5, "wide": 40, "repeated": 3}[kind]
    rows = (r.normal(size=(300, d)) * (1 + np.arange(d)) + 1000 * np.arange(d)).astype(np.float32).tolist()
    if kind == "repeated":
        rows = [[a, b, 7.0] for a, b, _ in rows[:50] * 3]  # the last has no variance
    bad = [(900, None), (901, []), (902, [float("nan")] * d), (903, [1.0] * (d - 1) + [None]), (904, [float("inf")] * d), (905, [1.0] * (d + 1))]
    ids = [k if k % 7 else None for k in range(len(rows))]
    frame = spark.createDataFrame([(i, v, "x", 0) for i, v in [*zip(ids, rows, strict=True), *bad]], "vec_id long, embedding array<float>, v string, n int")
    n, deviations, covariance, centred = exact(rows)
    fit = whitening.Fit.of(whitening.usable(frame, "vec_id"))
    assert fit.n == n and [[Fraction(v, n**3) for v in row] for row in whitening.scatter(whitening.usable(frame), fit)] == covariance
    got = whitening.whiten(frame).collect()
    k = min(32, d)
    assert len(got) == n * k and {x["component"] for x in got} == set(range(1, k + 1)) and {x["n"] for x in got} == {n}
    v = np.array([[float(c) for c in row] for row in covariance])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    want: dict = {}
    for i, dev, y in zip(ids, deviations, centred, strict=True):
        want.setdefault(i, []).append((dev, np.array([float(c) for c in y]) @ vectors[:, :k]))
    flat = kind == "repeated"
    for i, mine in want.items():
        for c in range(1, k + 1):
            found = sorted((x["deviation"], abs(x["whitened"]) if x["whitened"] is not None else None) for x in got if x["vec_id"] == i and x["component"] == c)
            if flat and c == 3:
                assert {w for _, w in found} == {None}
            else:
                assert [a for a, _ in found] == sorted(a for a, _ in mine)
                assert np.allclose(sorted(b for _, b in found), sorted(abs(p[c - 1]) / values[c - 1] ** 0.5 for _, p in mine), rtol=1e-6, atol=1e-9)
    for x in got:
        assert abs(x["explained"] - values[x["component"] - 1] / np.trace(v)) <= 1e-9
        assert 0 <= x["identity_error"] <= 1e-6


def test_whitening_of_awkward_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(frame([])).count() == 0 and whitening.whiten(frame([(1, None), (2, [])])).count() == 0
    one = whitening.whiten(frame([(1, [0.5, 2.0])])).collect()
    assert [(x["component"], x["n"], x["deviation"], x["whitened"], x["explained"]) for x in one] == [(1, 1, 0, None, 0.0), (2, 1, 0, None, 0.0)]
    huge = {(x["vec_id"], x["component"]): x for x in whitening.whiten(frame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])])).collect()}
    assert all(x["deviation"] is None and x["identity_error"] < 1e-6 for k, x in huge.items() if k[0] < 3) and huge[1, 1]["explained"] == 1.0
    x = whitening.integers(np.array([1.0, -0.001, 1e300, -1e300]))
    assert x.tolist() == [1_000_064, 999_999, 2**62 + 10**6, -(2**62) + 10**6]


def test_residues_sum_exactly():
    ps = whitening.primes(1 << 150)
    assert len(set(ps)) == len(ps) and all(p < 1 << whitening.PRIME_BITS for p in ps) and np.prod([float(p) for p in ps]) > 2.0**150
    assert (whitening.primes(1)[0] // 2) ** 2 * whitening.EXACT_ROWS <= 1 << 53


def test_archives_of_whole_pages(spark):
    """Every page of a table by hashlib and a dict, and the archives by zipfile."""
    import os
    import zipfile
    import zlib

    from quern.llm import warc
    from quern.llm.common import shared_dir, table

    pages = table(spark, os.environ.get("QUERN_TEST_DIR", "/root/testdata/sf0.001"), "pages")
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    largest: dict = {}
    for i, payload in rows:
        largest[payload] = max(i, largest.get(payload, i))
    want = {(i, len(p), hashlib.sha1(p).hexdigest(), *(("revisit", largest[p]) if len(p) >= 1000 and largest[p] != i else ("response", None))) for i, p in rows}
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    archives = warc.write(pages, shared_dir(spark, "warc-test"))
    got = warc.read(archives).select(*columns).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(rows)
    held = {}
    for r in archives.collect():
        with zipfile.ZipFile(r["path"].removeprefix("file://")) as z:
            assert z.testzip() is None
            for entry in z.infolist():
                rest = z.read(entry)
                while rest[:2] == b"\x1f\x8b":  # records, each compressed by itself, one after another
                    one = zlib.decompressobj(31)
                    headers, _, payload = warc.parse(one.decompress(rest))
                    rest = one.unused_data
                    if headers["warc-type"] == "response":
                        held[int(headers["warc-record-id"].removeprefix("<urn:page:").rstrip(">"))] = payload
    assert held == {i: p for i, p in rows if (i, len(p), hashlib.sha1(p).hexdigest(), "response", None) in want}


def test_very_long_texts_are_joined(spark):
    from quern.llm import jaccard

    r = random.Random(8)
    long = [f"w{r.randrange(100_000)}" for _ in range(60_000)]
    near = [*long[:30_000], "changed", *long[30_001:]]
    far = [f"v{r.randrange(100_000)}" for _ in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(long[:100])), (5, " ".join(long))]
    got = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: c for i, (c, _) in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1} and got[2][1] > 0 and got[3][1] == 0
