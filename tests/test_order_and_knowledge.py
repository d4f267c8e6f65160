"""Selection by counting, components folded in order, points upserted by key, and skeletons, against plain Python."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import dedup, knowledge, retrieval, selection, training


@pytest.mark.parametrize("small", [1, 5, 10_000])
def test_boundary_is_the_kth(spark, monkeypatch, small):
    monkeypatch.setattr(selection, "SMALL", small)
    monkeypatch.setattr(selection, "BINS", 7)
    r = random.Random(small)
    rows = [(r.choice([None, -1e9, 0.5, 2.0, 2.5, r.random()]), r.choice([None, "", "a", "ab", "abc", "é", "b" * 9]), r.randrange(6)) for _ in range(90)]
    frame = spark.createDataFrame(rows, "x double, s string, n long").cache()
    order = [F.col("x"), F.col("s"), F.col("n")]
    key = lambda t: [(v is not None, v if v is not None else 0) for v in t]
    ordered = sorted(rows, key=lambda t: [(p, v.encode() if isinstance(v, str) else v) if p else (p, 0) for p, v in key(t)])
    for k in (1, 2, 17, 45, 89, 90):
        assert selection.boundary(frame, order, k) == ordered[k - 1]
        assert frame.where(selection.first_rows(frame, order, k)).count() == max(i for i, t in enumerate(ordered) if t == ordered[k - 1]) + 1
    assert selection.boundary(frame, order, 91) is None and selection.boundary(frame, order, 0) is None


def test_splits_take_no_ordered_limit(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"))
    out = dedup.split(docs, "doc_id", 0.1, 3)
    assert "TakeOrdered" not in out._jdf.queryExecution().executedPlan().toString()
    want = {i for _, i in sorted((hashlib.md5(f"{i}|3".encode()).hexdigest(), i) for i in range(500))[:50]}
    assert {r["doc_id"] for r in out.where("part = 'valid'").collect()} == want
    left = retrieval.prune_to_count(docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 7).alias("w")), 20, ["w"])
    assert {r["id"] for r in left.collect()} == {i for _, i in sorted((i % 7, i) for i in range(500))[-20:]}


def fold(rows):
    prints, threads, out = set(), set(), {}
    for seq, fp, thread in sorted(rows):
        out[seq] = "duplicate_thread" if thread in threads else "duplicate" if fp in prints else None
        if out[seq] is None:
            prints.add(fp)
            threads |= {thread} - {None}
    return out


@pytest.mark.parametrize("most", [3, 1_000_000])
def test_first_wins_by_components(spark, monkeypatch, most):
    """Components in one fold each, giant ones (here: of more than three rows) by rounds."""
    monkeypatch.setattr(dedup, "FOLD_ALL", 0)
    monkeypatch.setattr(dedup, "FOLD_PAIRS", most)
    r = random.Random(most)
    rows = [(i, f"f{r.randrange(30)}", r.choice([None, *[f"t{k}" for k in range(30)]])) for i in range(80)]
    got = dedup.first_wins(spark.createDataFrame(rows, "seq long, fp string, thread string"), lambda df: df.checkpoint())
    assert {x["seq"]: x["reason"] for x in got.collect()} == fold(rows)


def test_a_long_chain_takes_few_jobs(spark, monkeypatch):
    """Each row waits for the one before it; rounds would need half as many jobs as there are rows."""
    monkeypatch.setattr(dedup, "FOLD_ALL", 0)
    n = 10_000
    rows = [(i, f"f{(i + 1) // 2}", f"t{i // 2}") for i in range(n)]
    cuts = []

    def keep(df):
        cuts.append(1)
        return df.checkpoint()

    got = dedup.first_wins(spark.createDataFrame(rows, "seq long, fp string, thread string").repartition(4), keep)
    assert {x["seq"]: x["reason"] for x in got.collect()} == fold(rows) and len(cuts) < 80


def test_memory_search_is_the_plain_share(spark):
    r = random.Random(6)
    text = lambda n: " ".join(r.choice(["the", "Mill,", "(stone)", "grain.", "flour", "a", "x;y"]) for _ in range(n))
    held = [(f"m{i}", i * 3 % 41, text(r.randrange(0, 9))) for i in range(40)] + [("n", 99, None)]
    asked = [(q, text(r.randrange(0, 7))) for q in range(12)] + [(99, None)]
    got = knowledge.memory_search(spark.createDataFrame(held, "id string, seq long, text string"), spark.createDataFrame(asked, "query_id long, text string"), 3)
    want = set()
    for q, t in asked:
        words = list(dict.fromkeys((t or "").lower().split()))
        scored = []
        for i, seq, u in held:
            bare = {w.strip(".,:;()[]{}") for w in (u or "").lower().split()} if u is not None else set()
            hits = sum(w in bare for w in words)
            if hits:
                scored.append((-round(hits / len(words), 4), seq, i))
        want |= {(q, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scored)[:3])}
    assert {(x["query_id"], x["rank"], x["id"], x["score"]) for x in got.collect()} == want


def test_upserts_by_key(spark):
    schema = "id string, rule string, domain string, importance double, positive_examples array<string>, negative_examples array<string>, dependencies array<string>"
    points = spark.createDataFrame([("a", "use with", "Python", 0.5, ["x"], [], ["d"]), ("b", "reserve", "C++", 0.6, [], [], []), ("c", "own it", "Rust", 0.7, [], [], []), ("d", "same", "Go", 0.1, None, None, None)], schema)
    held = points.withColumn("vector", F.array(*[F.lit(7.0)] * 128))  # a mark: vectors that aren't computed stay as they are
    changes = [
        (1, "a", "update", "use with blocks", None, None, "y", None), (2, "a", "update", None, None, 0.9, "z", "n"), (3, "b", "delete", None, None, None, None, None), (4, "b", "update", "lost", None, None, None, None),
        (5, "c", "update", None, None, 0.2, None, "n"), (6, "e", "create", "new", None, None, "p", None), (7, "f", "update", "no such point", None, None, None, None), (8, "g", "create", "x", "D", 0.3, None, None),
        (9, "g", "delete", None, None, None, None, None), (10, "c", "delete", None, None, None, None, None), (11, "c", "create", "again", "Rust", None, "q", None),
    ]
    news = spark.createDataFrame(changes, "seq long, id string, op string, rule string, domain string, importance double, add_positive string, add_negative string")
    embedded = []

    def embed(rows):
        embedded.extend(r["id"] for r in rows.select("id").collect())
        return knowledge.embedded(rows)

    got = {r["id"]: r for r in knowledge.upserted(held, news, embed).collect()}
    row = lambda i: tuple(got[i][c] for c in ("rule", "domain", "importance", "positive_examples", "negative_examples", "dependencies"))
    assert set(got) == {"a", "c", "d", "e"} and sorted(embedded) == ["a", "c", "e"]
    assert row("a") == ("use with blocks", "Python", 0.9, ["x", "y", "z"], ["n"], ["d"])
    assert row("c") == ("again", "Rust", 0.5, ["q"], [], []) and row("e") == ("new", "general", 0.5, ["p"], [], []) and row("d")[:3] == ("same", "Go", 0.1)
    assert got["d"]["vector"] == [7.0] * 128 and all(abs(sum(x * x for x in got[i]["vector"]) - 1) < 1e-9 for i in "ace")
    whole = {r["id"]: r["vector"] for r in knowledge.embedded(spark.createDataFrame([got[i].asDict() for i in "ace"], knowledge.upserted(held, news).schema).drop("vector")).collect()}
    assert all(got[i]["vector"] == whole[i] for i in "ace")
    only = knowledge.upserted(held, spark.createDataFrame([(1, "c", "update", None, None, 0.2, None, "n")], news.schema)).where("id = 'c'").first()
    assert only["vector"] == [7.0] * 128 and only["importance"] == 0.2 and only["negative_examples"] == ["n"]


def test_skeletons_of_deep_and_sampled_sources(spark):
    deep = "def f():\n    return " + "(" * 400 + ")" * 400
    rows = [("deep.py", deep), ("prose", "def " + "( " * 9000), ("none", "no function here"), *[(f"m{i}.py", f"def f{i}(a):\n    return a\n\nasync def g{i}():\n    pass\n") for i in range(60)]]
    frame = spark.createDataFrame(rows, "path string, source string")
    every = {(r["path"], r["name"]) for r in training.function_skeletons(frame).collect()}
    assert len(every) == 120
    some = lambda seed, df=frame: {(r["path"], r["name"]) for r in training.function_skeletons(df, 0.3, seed).collect()}
    assert some(1) < every and 12 < len(some(1)) < 72 and some(1) == some(1, frame.repartition(5)) != some(2)
    task = training.skeleton_tasks(training.function_skeletons(frame)).where("metadata['function'] = 'f7'").first()
    skeleton = {"kind": "python_function", "name": "f7", "params": ["a"], "steps": [{"op": "parse_input"}, {"op": "return"}]}
    assert json.loads(task["skeleton"]) == skeleton and task["skeleton"] == json.dumps(skeleton, ensure_ascii=False, sort_keys=True)
    assert task["text"] == f"[skeleton]\nCode:\ndef f7(a):\n    return a\nSkeleton JSON:\n{task['skeleton']}" and task["metadata"] == {"source_path": "m7.py", "function": "f7", "task": "skeleton_generation"}


def test_shards_over_many_ranges_are_the_fold(spark, monkeypatch):
    """Step functions of many small ranges, composed over several levels; sizes below, about and above the limit."""
    from quern.operators import quota

    monkeypatch.setattr(quota, "FAN", 3)
    monkeypatch.setattr(quota, "FOLD_ROWS", 0)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        r = random.Random(1)
        for sizes, limit in (([1, 3, 9, 40, 200], 100), ([5], 1), ([1, 2], 10**6), ([1, 2, 3], 7), ([300, 1], 100)):
            rows = [(7 * k, r.choice(sizes)) for k in range(400)]
            want, used, shard = {}, 0, 0
            for seq, n in rows:
                if used and used + n > limit:
                    used, shard = 0, shard + 1
                used += n
                want[seq] = shard
            got = quota.shards(spark.createDataFrame(rows, "seq long, n long"), limit)
            assert {x["seq"]: x["shard"] for x in got.collect()} == want, (sizes, limit)
        assert quota.shards(spark.createDataFrame([], "seq long, n long"), 5).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_steps_compose():
    """Ranges entered at every place do what the rows do one by one."""
    import numpy as np

    from quern.operators.quota import _Steps

    r = random.Random(5)
    for _ in range(60):
        limit = r.choice([5, 20, 60])
        sizes = [r.choice([1, 2, 5, 9, 30, 80]) for _ in range(30)]
        ends = np.cumsum(sizes)
        cut = sorted(r.sample(range(1, 30), 3))
        parts = [_Steps.of(ends[a:b], ends[a:b] - np.array(sizes[a:b]), limit) for a, b in zip([0, *cut], [*cut, 30], strict=True)]
        whole = parts[0].then(parts[1], limit).then(parts[2].then(parts[3], limit), limit)
        for began in range(-limit - 1, 0):
            last, count = began, 0
            for end, n in zip(ends.tolist(), sizes, strict=True):
                if end > last + limit and end - n > last:
                    last, count = end - n, count + 1
            got = whole.enter(np.array([began]), limit)
            assert (int(got[0][0]), int(got[1][0])) == (last, count)
