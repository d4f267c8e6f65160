"""The pipeline and its stages against brute force, with a group of near copies that takes several blocks."""

import random
from collections import Counter

import pytest

pytest.importorskip("quern.llm")
import corpus_pipeline  # noqa: E402
from quern.llm import jaccard, mixing, quality  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COPIES = 400


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    text = lambda n: [f"w{r.randrange(500)}" for _ in range(n)]
    base, texts = text(200), []
    for k in range(COPIES):
        copy = list(base)
        for at in r.sample(range(200), r.randrange(6)):
            copy[at] = f"c{k}x{at}"
        texts.append(" ".join(copy))
    texts += [" ".join(text(r.randrange(5, 80))) for _ in range(60)] + [None, "", "mail a@b.org now please do it"]
    r.shuffle(texts)
    return [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def sf(spark, rows, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] % 4 > 0), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def linked(texts):
    """Of each text, the texts at a similarity of 0.8 or more."""
    sets = {}
    for t in set(texts):
        w = t.split()
        sets[t] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return {t: [u for u, s in sets.items() if u != t and mine | s and 10 * len(mine & s) >= 8 * len(mine | s)] for t, mine in sets.items()}


def one_of_each(rows):
    """The ids that brute force keeps: the smallest of each class of linked texts, and documents without text."""
    links, least = linked([t for _, t in rows if t is not None]), {}
    seen = set()
    for start in links:
        if start in seen:
            continue
        group, todo = {start}, [start]
        while todo:
            new = set(links[todo.pop()]) - group
            group |= new
            todo += new
        seen |= group
        least[start] = min(i for i, t in rows if t in group)
    return sorted([*least.values(), *(i for i, t in rows if t is None)])


def taken(rows):
    """DuckDB's mix of (doc_id, text, source): times of each id."""
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]))
    return Counter({i: n // size for i, size, n in con.sql(f"select doc_id, size, taken from ({mixing.SQL})").fetchall() if size and n})


def test_large_group_has_all_links(spark, rows):
    assert COPIES > jaccard.SMALL_GROUP
    links = linked([r[1] for r in rows if r[1]])
    got = {r["doc_id"]: r["n_links"] for r in jaccard.classes(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_links").collect()}
    want = {r[0]: len(links[r[1]]) for r in rows if r[1]}
    assert len(got) == len(rows) and min(want.values()) == 0 and max(want.values()) > jaccard.SMALL_GROUP
    assert {i: got[i] for i in want} == want


@pytest.mark.parametrize("texts", [40, 150])
def test_blocks_of_a_large_group_meet(spark, rows, monkeypatch, texts):
    """Blocks smaller than the group: links across blocks, read from the written ones, are all there."""
    monkeypatch.setattr(jaccard, "LARGE_TEXTS", texts)
    links = linked([r[1] for r in rows if r[1]])
    got = {r["doc_id"]: r for r in jaccard.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {r[0]: got[r[0]]["n_links"] for r in rows if r[1]} == {r[0]: len(links[r[1]]) for r in rows if r[1]}
    least = {}
    for i, t, *_ in rows:
        if t:
            least.setdefault(got[i]["class_id"], set()).add(t)
    assert all(set(links[t]) <= own for own in least.values() for t in own)


def test_climbing_sorted_tries():
    """Runs of shared prefixes, however the sorted labels are cut into batches."""
    import numpy as np
    import pandas as pd

    r = np.random.default_rng(3)
    p, bits, depth = 7, jaccard.BITS, jaccard.DEPTH
    label = r.integers(0, 3, (300, depth)) @ (1 << (bits * np.arange(depth)[::-1]))
    label[:120] = np.where(r.random(120) < 0.5, label[0], label[:120])
    rows = pd.DataFrame({"tree": r.integers(0, 2, 300), "label": label, "tid": r.permutation(300)}).sort_values(["tree", "label", "tid"], ignore_index=True)
    run = rows.groupby(["tree", rows["label"].to_numpy() >> (bits * (depth - p))])["tid"]
    want = {int(t): frozenset(map(int, own)) for _, own in run for t in own if len(own) > 1}
    for step in (1, 2, 7, 50, 300):
        out = pd.concat(list(jaccard._climb(p)(iter([rows.iloc[k : k + step] for k in range(0, 300, step)]))))
        own = out[~out["edge"]]
        assert set(own["tid"]) == set(want)
        reach = {t: {t} for t in want}  # joined by their first texts, the rows give the runs again
        for t, first in zip(own["tid"], own["first"], strict=True):
            both = reach[t] | reach[first]
            for x in both:
                reach[x] = both
        assert {t: frozenset(x) for t, x in reach.items()} == want
        named = own.groupby("key")["tid"].agg(set)
        assert {frozenset(map(int, x)) for x in named} == set(want.values())
        assert (own["depth"] >= p).all() and out["edge"].sum() == 2


def test_awkward_rows_of_the_join(spark):
    """Nulls in every column, repeats, short and long texts, clashing names; each class keeps one row."""
    long = " ".join(f"w{k}" for k in range(30_000))
    data = [(1, "a b c"), (2, "a b c"), (2, "a b c"), (None, "a b c"), (None, "lonely words of an id that is null"), (None, None), (5, None), (5, None), (6, ""), (7, ""), (8, "one"), (9, "one  "), (10, long), (11, long + " end"), (12, "x y z v w"), (12, "other text under the same id")]
    frame = spark.createDataFrame([(i, t, "z", 1) for i, t in data], "doc_id long, text string, digest string, tid int")
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in jaccard.classes(frame).collect()), key=str)
    assert len(got) == len(data)
    assert got.count((2, 1, 0, 4)) == 2 and (None, 1, 0, 4) in got and (1, 1, 0, 4) in got
    assert (10, 10, 1, 1) in got and (11, 10, 1, 1) in got and (6, 6, 0, 2) in got and (7, 6, 0, 2) in got
    assert (8, 8, 1, 1) in got and (9, 8, 1, 1) in got and got.count((5, 5, 0, 1)) == 2
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard.keep_one(frame).collect()), key=str)
    want = [(1, "a b c"), (None, "lonely words of an id that is null"), (None, None), (5, None), (5, None), (6, ""), (8, "one"), (10, long), (12, "x y z v w"), (12, "other text under the same id")]
    assert kept == sorted(want, key=str) and jaccard.keep_one(frame).columns == frame.columns
    assert jaccard.classes(frame.limit(0)).count() == 0 == jaccard.keep_one(frame.limit(0)).count()


def test_recall_at_the_threshold(spark):
    """Pairs whose similarity is 0.8 or little more, the hardest to meet."""
    r, data = random.Random(2), []
    for k in range(150):
        words = [f"v{r.randrange(10**6)}" for _ in range(94)]
        data += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: 94 - 2] + ["t"] * 0 + words[94:]))] if k % 2 else [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:-10], *[f"u{k}x{j}" for j in range(10)]]))]
    links = linked([t for _, t in data])
    got = {x["doc_id"]: x["n_links"] for x in jaccard.classes(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    there = sum(len(links[t]) for _, t in data)
    assert there >= 250 and sum(got.values()) >= 0.99 * there and all(got[i] <= len(links[t]) for i, t in data)


def test_stages(spark, rows, sf):
    docs, stages = spark.createDataFrame(rows, SCHEMA), dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.score_documents(docs, quality.train(docs, labels), score="s")
    want = sorted(r["doc_id"] for r in scored.collect() if r["s"] is not None and r["s"] >= quality.THRESHOLD)
    assert sorted(r["doc_id"] for r in stages["quality"](spark, docs, sf).collect()) == want
    assert sorted(r["doc_id"] for r in stages["near_copies"](spark, docs, sf).collect()) == one_of_each([r[:2] for r in rows])
    clean = {r["doc_id"]: r["text"] for r in stages["pii"](spark, docs, sf).collect()}
    assert clean == {r[0]: r[1] and r[1].replace("a@b.org", "<EMAIL>") for r in rows}
    assert Counter(r["doc_id"] for r in stages["mixing"](spark, docs, sf).collect()) == taken([(r[0], r[1], r[3]) for r in rows])


def test_run_is_its_stages(spark, rows, sf):
    docs, stages = spark.createDataFrame(rows, SCHEMA), dict(corpus_pipeline.STAGES)
    good = [(r["doc_id"], r["text"], r["source"]) for r in stages["quality"](spark, docs, sf).collect()]
    assert good
    left = set(one_of_each([r[:2] for r in good]))
    clean = [(i, t and t.replace("a@b.org", "<EMAIL>"), s) for i, t, s in good if i in left]
    out = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r["doc_id"] for r in out) == taken(clean)
    assert all(r["n_tokens"] == len(r["ids"]) > 0 for r in out)
