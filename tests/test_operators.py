"""Cases that the tables don't reach."""

import random

from pyspark.sql import functions as F

from quern.operators import dedup


def test_two_key_dedup_is_one_pass_in_order(spark):
    r = random.Random(3)
    rows = [(i, f"f{r.randrange(25)}", None if r.random() < 0.2 else f"t{r.randrange(20)}") for i in range(120)]
    threads, prints, want = set(), set(), {}
    for seq, fp, thread in rows:
        want[seq] = "duplicate_thread" if thread in threads else "duplicate" if fp in prints else None
        if want[seq] is None:
            prints.add(fp)
            threads |= {thread} - {None}
    got = dedup.first_wins(spark.createDataFrame(rows, "seq long, fp string, thread string"), lambda df: df.checkpoint())
    assert {r["seq"]: r["reason"] for r in got.collect()} == want


def test_split_keeps_both_parts(spark):
    parts = [r["part"] for r in dedup.split(spark.range(2).withColumnRenamed("id", "k"), "k", 0.01).collect()]
    assert sorted(parts) == ["train", "valid"]


def test_paths_end_at_gaps_and_loops(spark):
    from quern.operators import trees

    rows = [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("x", "gone"), ("y", "x"), ("self", "self"), ("l1", "l2"), ("l2", "l3"), ("l3", "l1"), ("m", "l1")]
    parents, want = dict(rows), {}
    for node in parents:
        path = [node]
        while parents[path[-1]] in parents and parents[path[-1]] not in path:
            path.append(parents[path[-1]])
        want[node] = path[::-1]
    got = {r["id"]: r["path"] for r in trees.ancestor_paths(spark.createDataFrame(rows, "id string, parent string")).collect()}
    assert got == want


def test_jsonl_round_trip_and_broken_lines(spark, tmp_path):
    from quern.sources import files, sinks

    rows = spark.createDataFrame([(1, "é"), (2, None)], "b long, a string")
    assert sinks.write_jsonl(rows, f"{tmp_path}/out") == 2
    lines = sorted(r["value"] for r in spark.read.text(f"{tmp_path}/out").collect())
    assert lines == ['{"a":"é","b":1}', '{"a":null,"b":2}']
    assert sorted(map(tuple, files.jsonl(spark, f"{tmp_path}/out", "b long, a string").collect())) == [(1, "é"), (2, None)]
    (tmp_path / "in.jsonl").write_text('{"b":1,"a":"x"}\n\n{"b":\n[1]\n{"b":2}\n', encoding="utf-8")
    assert sorted(r["b"] for r in files.jsonl(spark, f"{tmp_path}/in.jsonl", "b long, a string", strict=False).collect()) == [1, 2]
    held = files.training_records(spark, f"{tmp_path}/in.jsonl", "b long, a string").collect()
    assert sorted((r["b"], r["n_bytes"]) for r in held) == [(1, 16), (2, 8)]


def test_sharded_write_stops_at_the_whole_budget(spark, tmp_path):
    from quern.sources import sinks

    rows = spark.createDataFrame([(i, "en" if i % 2 else "zh", "x" * 20) for i in range(10)], "seq long, lang string, text string")
    report = sinks.write_sharded(rows, f"{tmp_path}/out", whole=300, budget={"en": 10_000, "zh": 10_000}, shard_bytes=120)
    records = {(r["lang"], r["verdict"]): r["records"] for r in report.collect()}
    n = len('{"lang":"en","seq":1,"text":"' + "x" * 20 + '"}\n')
    assert sum(v for (_, why), v in records.items() if why == "") == 300 // n
    assert sum(records.values()) == 10
    written = spark.read.text(f"{tmp_path}/out")
    assert written.count() == 300 // n and {r["shard"] for r in written.select("shard").distinct().collect()} == set(range(-(-(300 // n) // (120 // n))))


def test_paged_source_reads_every_row_once(spark):
    from quern.sources import paged

    def fetch(url):
        from urllib.parse import parse_qs, urlparse

        q = {k: int(v[0]) for k, v in parse_qs(urlparse(url).query).items()}
        return {"rows": [{"row": {"n": i}} for i in range(q["offset"], min(q["offset"] + q["length"], 23))]}

    paged.register(spark, fetch)
    got = spark.read.format("paged_rows").option("url", "http://none").option("rows", 40).option("page", 5).option("parts", 3).option("pause", 0).load()
    assert sorted(r["row_number"] for r in got.collect()) == list(range(23))


def test_sources_need_permission():
    import pytest

    from quern.sources.files import Source, chosen

    catalog = [Source("a", "mit", "wildchat"), Source("b", "mit", "wildchat", restricted=True), Source("c", "mit", "wildchat", enabled=False)]
    assert [s.key for s in chosen(catalog)] == ["a"]
    assert [s.key for s in chosen(catalog, ["b"], allow_restricted=True)] == ["b"]
    for bad in (["b"], ["nobody"]):
        with pytest.raises(ValueError):
            chosen(catalog, bad)


def test_knowledge_search_is_the_plain_sum(spark):
    from quern.operators import knowledge

    points = [("p1", "python", "use a with block", 0.5, ["open files"]), ("p2", "rust", "borrow it", 0.9, []), ("p3", "general", "", 0.1, [])]
    frame = spark.createDataFrame(points, "id string, domain string, rule string, importance double, positive_examples array<string>")
    hits = knowledge.search(frame, spark.createDataFrame([("q", "open a python block"), ("none", "")], "query_id string, text string"), k=3).collect()
    ranked = {q: [r["id"] for r in sorted(hits, key=lambda r: r["rank"]) if r["query_id"] == q] for q in ("q", "none")}
    assert ranked["q"][0] == "p1" and ranked["none"] == ["p2", "p1", "p3"]
    assert next(r["score"] for r in hits if r["query_id"] == "none" and r["id"] == "p2") == 0.045


def test_stream_keeps_each_text_once_over_two_runs(spark, tmp_path):
    from pyspark.sql import functions as F

    from quern.streaming import cleaning

    text = "The pump ran all night and the gauge held steady while the crew slept well in their bunks. "
    put = lambda name, xs: spark.createDataFrame([(x,) for x in xs], "text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for k, xs in enumerate(([text, text.upper(), "short"], [text, text + "More came later on."])):
        put(k, xs)
        rows = cleaning.source(spark, f"{tmp_path}/in", "text string")
        cleaning.run(cleaning.unseen(cleaning.cleaned(rows, F.col("text"))).select("fp", "text"), f"{tmp_path}/out", f"{tmp_path}/state")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_bytes_of_whole_texts(spark, tmp_path):
    import hashlib

    from quern.plans import registry

    texts = {1: "short", 2: "", 3: None, 4: "é鲸🐋 " * 3000, 5: "x" * 2000, 6: "y" * 2001}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for k, text in texts.items():
        ids = [1, *(b + 4 for b in (text or "").encode()), 2]
        want[k] = (len(ids), sum(ids), ids[0], ids[-1])
    assert {r["doc_id"]: tuple(r)[1:] for r in registry.queries()["byte_encode"](spark, str(tmp_path)).collect()} == want
    shas = {r["doc_id"]: r["sha"] for r in registry.queries()["byte_decode"](spark, str(tmp_path)).collect()}
    assert shas == {k: hashlib.sha256((text or "").encode()).hexdigest() for k, text in texts.items()}


def test_cosine_top_over_blocks_is_brute_force(spark, monkeypatch):
    import numpy as np

    from quern.operators import retrieval

    monkeypatch.setattr(retrieval.met, "__defaults__", (7, 3))
    x = np.random.default_rng(5).normal(size=(60, 4))
    x[40:] = x[:20]  # ties
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.round(unit @ unit.T, 6)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    want = {(q, i): n for q in range(0, 60, 3) for n, i in enumerate(sorted(set(range(60)) - {q}, key=lambda i: (-near[q, i], i))[:5], 1)}
    assert {(r["query_id"], r["id"]): r["rank"] for r in retrieval.cosine_top(v, v.where("id % 3 = 0"), 5).collect()} == want


def test_cosine_top_of_odd_vectors_is_what_columns_give(spark, monkeypatch):
    from quern.functions import arrays as A
    from quern.operators import retrieval

    monkeypatch.setattr(retrieval.met, "__defaults__", (5, 2))
    odd = [None, [], [0.0, 0.0, 0.0], [1.0, None, 2.0], [1.0, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 0.0], [1.0, 2.0, 3.0, 4.0]]
    rows = [(i, odd[i % 8] if i % 3 == 0 else [float(i % 5), 1.0, float(i % 7) - 3]) for i in range(48)] + [(None, [1.0, 1.0, 1.0])]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    q = v.where("id % 4 = 0")
    asked = q.select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    plain = retrieval.top(v.crossJoin(asked).where("id <> query_id").select("query_id", "id", F.round(A.cosine(F.col("qv"), F.col("v")), 6).alias("score")), 20)
    shown = lambda df: sorted((r["query_id"], r["rank"], r["id"], "nan" if r["score"] != r["score"] else r["score"]) for r in df.collect())
    assert shown(retrieval.cosine_top(v, q, 20)) == shown(plain)


def test_cosine_top_pairs_are_not_rows(spark):
    """Of 400 queries and 20,000 rows no row is made for each of the 8,000,000 pairs."""
    import time

    from quern.operators import retrieval

    v = spark.range(20_000).selectExpr("id", "transform(sequence(1, 64), k -> cast(cos(id * k) as float)) as v").localCheckpoint()
    began = time.time()
    assert retrieval.cosine_top(v, v.where("id % 50 = 0"), 10).count() == 4000
    assert time.time() - began < 20


def test_cosine_asks_every_fiftieth(spark, tmp_path):
    from quern.plans import registry

    spark.range(1001).selectExpr("id as vec_id", "array(cast(id as double), 1.0D) as embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.queries()["cosine_topk"](spark, str(tmp_path)).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got} == {q: 10 for q in range(0, 1001, 50)}


def test_every_item_searches_the_memories(spark, tmp_path):
    from quern.plans import registry

    docs = {d: " ".join(f"w{(d * m) % 11}" for m in range(1, 5)) + "." for d in range(20)}
    items = {i: f"w{i % 11} w{i * 3 % 11} W{i * 5 % 11} none" for i in range(12)}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {}
    for i, text in items.items():
        asked = set(text.lower().split())
        scores = {d: round(len(asked & {w.strip(".") for w in held.split()}) / len(asked), 4) for d, held in docs.items()}
        want |= {(i, n): d for n, d in enumerate(sorted((d for d in docs if scores[d] > 0), key=lambda d: (-scores[d], d))[:3], 1)}
    assert {(r["query_id"], r["rank"]): r["id"] for r in registry.queries()["lexical_memory_search"](spark, str(tmp_path)).collect()} == want
    assert {q for q, _ in want} == set(items)


def test_knowledge_search_takes_any_number_of_queries(spark, monkeypatch):
    from quern.operators import knowledge, retrieval

    monkeypatch.setattr(retrieval, "MOST_QUERIES", 3)
    points = [(f"p{k}", "general", f"word{k} common", k / 10, []) for k in range(5)]
    frame = spark.createDataFrame(points, "id string, domain string, rule string, importance double, positive_examples array<string>")
    asked = spark.createDataFrame([(q, f"word{q % 5}") for q in range(10)], "query_id long, text string")
    hits = knowledge.search(frame, asked, k=5).collect()
    assert {(r["query_id"], r["id"]) for r in hits} == {(q, p[0]) for q in range(10) for p in points}
    assert {r["query_id"]: r["id"] for r in hits if r["rank"] == 1} == {q: f"p{q % 5}" for q in range(10)}


def test_knowledge_query_asks_every_item(spark, tmp_path):
    from quern.plans import registry

    spark.createDataFrame([(d, "en", f"word{d}") for d in range(6)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, f"word{i % 6}") for i in range(8)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    best = registry.queries()["knowledge_query"](spark, str(tmp_path)).where("rank = 1").collect()
    assert {r["query_id"]: r["id"] for r in best} == {i: i % 6 for i in range(8)}


def test_fingerprints_compose(spark, tmp_path):
    from pyspark.sql import functions as F

    from quern.plans import registry
    from quern.streaming import cleaning

    plain = "The pump ran all night and the gauge held steady while the crew slept well in their bunks."
    wide = plain.replace("The", "".join(chr(ord(c) + 0xFEE0) for c in "The"))
    docs = spark.createDataFrame([(1, "a", plain), (2, "b", wide), (3, "b", plain.replace(" ", "\u00a0")), (4, "b", plain + " More.")], "doc_id long, source string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = registry.queries()["fingerprint_dedup"](spark, str(tmp_path)).where("kept").collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 4]
    assert [r["doc_id"] for r in registry.queries()["seed_dedup_antijoin"](spark, str(tmp_path)).collect()] == [4]
    fps = cleaning.cleaned(docs, F.col("text")).orderBy("doc_id").collect()
    assert fps[0]["fp"] == fps[1]["fp"] == fps[2]["fp"] != fps[3]["fp"]


def test_ema_takes_vectors_of_any_length(spark, tmp_path):
    from quern.plans import registry

    vectors = {n: [float(k + 1) for k in range(n)] for n in (0, 1, 2, 5, 64, 100)}
    spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = {}
    for n, x in vectors.items():
        s = 0.0
        for v in x[:-2]:
            s = s * 0.5 + v * 0.5
        want[n] = (round(s, 6), round(sum(x[-2:]) / len(x[-2:]), 6) if x else None)
    assert {r["vec_id"]: (r["summary"], r["kept"]) for r in registry.queries()["ema_window"](spark, str(tmp_path)).collect()} == want


def test_linear_rules_match_the_plain_patterns(spark):
    import random
    import re

    from quern.functions import signals as S
    from quern.functions import text as X

    r = random.Random(3)
    texts = ["".join(r.choice("ab.@_-%1 é") for _ in range(r.randrange(30))) + r.choice(["", "@x.org", "a@b.co", "..@d.com", "éa@b.co", "a-@b.co"]) for _ in range(4000)]
    for t in texts:
        assert bool(re.search(S.EMAIL, t, re.ASCII)) == bool(re.search(S.EMAIL_ONCE, t, re.ASCII)), t
    # ratios by brute force
    from collections import Counter

    rows = [(k, " ".join(r.choice(["mill", "to", "stone", "ox", "grain", "é"]) for _ in range(r.randrange(60)))) for k in range(300)]
    got = {x["k"]: x["v"] for x in spark.createDataFrame(rows, "k int, t string").select("k", X.repetition_ratio(F.col("t")).alias("v")).collect()}
    for k, t in rows:
        n = Counter(t.split())
        assert abs(got[k] - (0 if sum(n.values()) < 20 else sum(c for w, c in n.items() if c > 4 and len(w) > 2) / sum(n.values()))) < 1e-12


def test_long_runs_take_linear_time(spark):
    import time

    from quern.functions import signals as S
    from quern.functions import text as X

    bad = spark.createDataFrame([("a." * 200_000 + "@",), ("<" * 200_000,), ("<script " * 50_000,), ("<br" + " " * 200_000,), ("</p" + " " * 200_000,)], "t string")
    began = time.time()
    out = bad.select(F.col("t").rlike(S.EMAIL_ONCE).alias("mail"), X.clean_html(F.col("t")).alias("text")).collect()
    assert time.time() - began < 20 and not any(x["mail"] for x in out)


def test_html_is_cleaned_as_by_the_plain_patterns(spark):
    import random
    import re

    from quern.functions import text as X

    r = random.Random(8)
    parts = ["<script>", "</script>", "<SCRIPT x>", "<style>", "</style>", "<p>", "</p>", "< br / >", "<br/", "<", ">", "a", " ", "b c", "\n", "</ li >", "<i>"]
    pages = ["".join(r.choice(parts) for _ in range(r.randrange(25))) for _ in range(400)]

    def plain(t):
        for p, to in [("(?is)<script.*?</script>", ""), ("(?is)<style.*?</style>", ""), (r"(?i)<\s*br\s*/?\s*>", "\n"), (r"(?i)</\s*(p|li|div|pre|blockquote|h[1-6])\s*>", "\n"), ("(?s)<[^>]+>", ""), ("[ \t]+", " "), (r"\s*\n\s*", "\n"), (r"^\s+|\s+$", "")]:
            t = re.sub(p, to, t)
        return t

    got = spark.createDataFrame(list(enumerate(pages)), "k int, t string").select("k", X.clean_html(F.col("t")).alias("v")).collect()
    assert {x["k"]: x["v"] for x in got} == {k: plain(t) for k, t in enumerate(pages)}


def test_sources_by_backend(spark, tmp_path):
    import pytest

    from quern.sources import files

    assert len(files.CATALOG) == 16 and [s.key for s in files.CATALOG if s.restricted] == ["lmsys_chat_1m"]
    assert len(files.chosen(files.CATALOG)) == 11 and files.catalog_frame(spark, files.CATALOG).count() == 16
    source = files.Source("x", "mit", "dolly", dataset="org/set", config="c", split="train")
    spark.range(3).write.parquet(f"{tmp_path}/org/set/c/train-0")
    spark.range(5).write.parquet(f"{tmp_path}/org/set/d/test-0")
    assert files.load(spark, source, str(tmp_path)).count() == 3 and files.load(spark, source, str(tmp_path), "datasets").count() == 8
    spark.createDataFrame([("a",), ("b",)], "v string").write.json(f"{tmp_path}/org/lines")
    lines = files.Source("y", "mit", "dolly", dataset="org/lines")
    assert files.load(spark, lines, str(tmp_path), most=1).count() == 1
    with pytest.raises(ValueError, match="no backend"):
        files.load(spark, files.Source("z", "mit", "dolly", dataset="none"), str(tmp_path))
    (tmp_path / "points").mkdir()
    for name, text in {"b.json": '{"id": "2",\n "rule": "r"}', "a.json": '{"id": "1", "rule": "q"}', "c.json": "{broken"}.items():
        (tmp_path / "points" / name).write_text(text)
    assert [r["id"] for r in files.points(spark, f"{tmp_path}/points", "id string, rule string").collect()] == ["1", "2"]
    (tmp_path / "rank.tsv").write_text("a\tone\ttwo\n\tnothing\nb\nc\t\n")
    assert {(r["id"], r["text"]) for r in files.ranked_texts(spark, f"{tmp_path}/rank.tsv").collect()} == {("a", "one\ttwo"), ("b", ""), ("c", "")}


def test_readers_of_files(spark, tmp_path):
    from quern.sources import files, sinks

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("one\n\ntwo\n")
    (tmp_path / "d" / "b.jsonl").write_text('{"text": "t"}\n{"solution": "s"}\n{}\nplain\n')
    (tmp_path / "d" / "c.bin").write_text("no")
    got = sorted(r["line_text"] for r in files.corpus_lines(spark, f"{tmp_path}/d").collect())
    assert got == sorted(["one", "", "two", "t", "s", "", "plain"])
    whole = {r["file"].rpartition("/")[2]: r["record"] for r in files.whole_texts(spark, f"{tmp_path}/d", "*.txt").collect()}
    assert whole == {"a.txt": '{"text":"one\\n\\ntwo\\n"}'}
    lines = spark.createDataFrame([('{"prompt_id": "1", "lang": "en", "user": "hi"}',), (" ",)], "value string")
    assert [tuple(r) for r in files.prompts(lines).collect()] == [("1", "en", "hi", "daily_dialogue")]
    import pytest

    with pytest.raises(Exception, match="lacks user"):
        files.prompts(spark.createDataFrame([('{"prompt_id": "1", "lang": "en"}',)], "value string")).collect()
    found = spark.createDataFrame([("x/run10.json",), ("x/run9.json",), ("x/run.json",)], "path string")
    assert [r["path"] for r in sinks.in_run_order(found).collect()] == ["x/run.json", "x/run9.json", "x/run10.json"]
    shards = spark.createDataFrame([("a/shard-00004.jsonl",), ("a/other.jsonl",)], "path string")
    assert sinks.next_shard(shards) == 5 and sinks.next_shard(shards.limit(0)) == 0


def test_knowledge_upkeep(spark):
    from pyspark.sql import functions as F

    from quern.operators import knowledge

    held = spark.createDataFrame([("a", 1, "2020"), ("b", 0, "2020")], "id string, access_count long, last_access string")
    out = {r["id"]: (r["access_count"], r["last_access"]) for r in knowledge.touched(held, spark.createDataFrame([("a",), ("a",)], "id string"), F.lit("2024")).collect()}
    assert out == {"a": (3, "2024"), "b": (0, "2020")}
    schema = "id string, rule string, positive_examples array<string>, negative_examples array<string>"
    big = spark.createDataFrame([("p", "r" * 5000, ["e" * 2000] * 12, ["x"]), ("q", "short", ["a"] * 12, [])], schema)
    kept = {r["id"]: r for r in knowledge.fitted(big).collect()}
    assert len(kept["p"]["rule"]) == 4096 and len(kept["p"]["positive_examples"]) == 8 and len(kept["q"]["positive_examples"]) == 12
    hits = spark.createDataFrame([(1, 2, "two"), (1, 1, "one")], "query_id long, rank int, text string")
    assert knowledge.injection(hits).first()["prefix"] == "<|memory|> one <|/memory|>\n<|memory|> two <|/memory|>"


def test_function_skeletons(spark):
    from quern.operators import training

    code = "import os\n\ndef f(a, b):\n    x = a\n    for i in b:\n        if i:\n            print(i)\n    return x\n\nclass C:\n    def m(self): pass\n\nasync def g():\n    pass\n"
    rows = spark.createDataFrame([("a.py", code), ("b.py", "def broken(:"), ("c.py", None)], "path string, source string")
    got = {r["name"]: (r["params"], r["steps"]) for r in training.function_skeletons(rows).collect()}
    assert got == {"f": (["a", "b"], ["parse_input", "assign", "loop", "branch", "call", "return"]), "g": ([], ["emit_output"])}


def test_unknown_verdicts_are_errors(spark):
    import pytest

    from quern.operators import cleaner

    rows = spark.createDataFrame([(1,), (2,)], "i long")
    verdict = lambda action: spark.createDataFrame([(1, action, "why")], "i long, action string, reason string")
    assert {(r["i"], r["action"], r["reason"]) for r in cleaner.with_verdicts(rows, verdict("reject"), "i").collect()} == {(1, "reject", "why"), (2, "accept", "accepted")}
    with pytest.raises(Exception, match="unknown action"):
        cleaner.with_verdicts(rows, verdict("maybe"), "i").collect()


def test_whole_run_as_a_stream(spark, tmp_path):
    """Two keys over batches, budgets, a stop, a second run that goes on, and a report."""
    from quern.operators import cleaner
    from quern.streaming.run import CleaningRun

    talk = lambda k: [("user", f"How do I fix bug {k} in the pump function, because the pytest run fails with an error?"), ("assistant", f"First step by step: the root cause {k} is a wrong argument in def pump, so check the traceback and call the tool again. " * 2)]
    row = lambda i, k, tree: (i, "s", f"id{i}", "mit", "en", talk(k), tree)
    schema = "seq long, source string, source_id string, license_id string, language string, messages array<struct<role:string,content:string>>, tree_id string"
    one = [row(1, 1, "t1"), row(2, 2, "t1"), row(3, 1, ""), row(4, 4, None)]
    two = [row(5, 4, "t9"), row(6, 6, "t1"), row(7, 7, "t2"), row(8, 8, None)]
    folder = f"{tmp_path}/in"
    spark.createDataFrame(one, schema).coalesce(1).write.mode("append").parquet(folder)
    run = CleaningRun(f"{tmp_path}/out", whole=10**6, shard_bytes=700)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    work = lambda: stream().writeStream.foreachBatch(run.clean_batch).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    work()
    spark.createDataFrame(two, schema).coalesce(1).write.mode("append").parquet(folder)
    work()
    told = {(r["metric"], r["key"]): r["cnt"] for r in run.report(spark).collect()}
    assert told["seen", ""] == 8 and told["accepted", ""] == 4 and told["rejected", "duplicate_thread"] == 2 and told["rejected", "duplicate"] == 2
    assert told["written", "en"] == 4 and told["source", "s"] == 4 and told["converted", "s"] == 8
    lines = spark.read.text(f"{tmp_path}/out/shards")
    assert sorted(r["value"].split('"source_id":"')[1].split('"')[0] for r in lines.collect()) == ["id1", "id4", "id7", "id8"]
    assert lines.select("batch", "shard").distinct().count() > 2
    run.clean_batch(spark.createDataFrame(two, schema), 1)  # a batch that runs again changes nothing
    assert {(r["metric"], r["key"]): r["cnt"] for r in run.report(spark).collect()} == told
    assert '"seen": 8' in cleaner.quality_report(run.report(spark), {"least_score": 0.45}, {"shards": "x"})

    small = CleaningRun(f"{tmp_path}/small", whole=1500)
    small.take(spark, {"a": stream(), "b": stream()})
    assert small.stopped(spark) and small.exhausted(spark) == set()
    told = {(r["metric"], r["key"]): (r["cnt"], r["bytes"]) for r in small.report(spark).collect()}
    assert told["written", "en"][1] <= 1500 and told["skipped", "stopped"][0] >= 1
    large = CleaningRun(f"{tmp_path}/large", whole=10**6)
    large.take(spark, {"a": stream()})
    assert large.exhausted(spark) == {"a"} and not large.stopped(spark)


def test_quotas_by_running_sums_are_the_fold(spark, monkeypatch):
    """More rows than one task folds: the passes give what one walk in order gives, for both orders of the tests."""
    import pytest

    from quern.operators import quota, retrieval

    r = random.Random(12)
    rows = [(k, r.choice(["de", "fr", "en", None]), r.choice([1, 3, 10, 40, 200, 999])) for k in range(600)]
    frame = spark.createDataFrame(rows, "seq long, lang string, n long")

    def walk(budget, whole, total_first, used):
        left, spent, stopped, out = {k: v - used.get(k, 0) for k, v in budget.items()}, sum(used.values()), False, {}
        for seq, lang, n in rows:
            over = whole is not None and spent + n > whole
            fits = lang in left and n <= left[lang]
            stopped = stopped or (over and (total_first or fits))
            out[seq] = "stopped" if stopped else "language_not_target" if lang not in left else "" if fits else "language_quota_full"
            if out[seq] == "":
                left[lang], spent = left[lang] - n, spent + n
        return out

    for limit in (10**6, 5, 60):
        monkeypatch.setattr(quota, "FOLD_ROWS", limit)
        for budget, used in (({"de": 9000, "fr": 700}, {}), ({"de": 2000, "fr": 10**9}, {"de": 500})):
            got = {x["seq"]: x["verdict"] for x in quota.per_language(frame, budget, used).collect()}
            assert got == walk(budget, None, False, used), (limit, budget)
            for total_first in (True, False):
                got = {x["seq"]: x["verdict"] for x in quota.with_total(frame, budget, 6000, total_first, used).collect()}
                assert got == walk(budget, 6000, total_first, used), (limit, budget, total_first)
    used, shard, want = 0, 0, []
    for _, _, n in rows:
        if used and used + n > 1000:
            used, shard = 0, shard + 1
        used += n
        want.append(shard)
    assert [x["shard"] for x in quota.shards(frame, 1000).orderBy("seq").collect()] == want
    assert quota.per_language(frame.limit(0), {"de": 1}).count() == 0 and quota.with_total(frame, {}, 10, True).where("verdict = ''").count() == 0
    assert retrieval.prune_to_budget(spark.createDataFrame([], "id string, importance double, access_count long, last_access double, payload_bytes long"), 5, 0.0).count() == 0
    with pytest.raises(ValueError, match="more than zero"):
        quota.ratios({"a": 0.0}, 5)


def test_annotated_files_plans_and_reports(spark, tmp_path):
    import pytest

    from quern.operators import reports, training

    rows = [(f"in/{d}/a.jsonl", k, f'{{"text": "{d}{k}"}}', [5.0, 0.1, float("nan")], 4) for d in ("x", "y") for k in range(3)]
    frame = spark.createDataFrame(rows, "file string, seq long, record string, losses array<double>, encoded_len int")
    told = training.annotate_files(frame, f"{tmp_path}/out", 1.0, 0.5).first()
    assert (told["records"], told["valid_tokens"], told["positive_tokens"]) == (6, 12, 6)
    lines = spark.read.text(f"{tmp_path}/out")
    assert lines.select("source").distinct().count() == 2 and lines.count() == 6 and '"hot_token_losses":[5.0,0.1,null,null]' in lines.first()["value"]
    assert training.annotate_files(frame, f"{tmp_path}/few", 1.0, 0.5, limit=4).first()["records"] == 4
    assert training.stage_steps(["stage1", "odd"], "5") == [("structural_reconstruction", 5), ("odd", 5)] and training.stage_steps(["stage5"], None, 7) == [("knowledge_management", 7)]
    with pytest.raises(ValueError, match="numbers of steps"):
        training.stage_steps(["a", "b", "c"], "1,2")
    text = reports.run_report({"seed": 1}, {"loss": 0.25}, [{"step": 1, "loss": 0.5}])
    assert "- seed: 1" in text and "- loss: 0.2500" in text and "| 1 | 0.5 |" in text
    assert reports.due(10, 5, 9.0, 0.0, 5.0) and not reports.due(10, 5, 3.0, 0.0, 5.0) and not reports.due(11, 5, 9.0, 0.0, 0.0) and not reports.due(10, 0, 9.0, 0.0, 0.0)


def test_sessions_and_learning(spark, tmp_path):
    import pytest
    from pyspark.sql import functions as F

    from quern.operators import memory

    rows = lambda s, n: [(s, k, [float(k), 1.0], f"w{k}") for k in range(n)]
    schema = "session string, pos long, hidden array<double>, text string"
    held = memory.chunks(spark.createDataFrame(rows("a", 5) + rows("b", 3), schema), size=2)
    memory.save_sessions(held, f"{tmp_path}/s")
    memory.save_sessions(memory.chunks(spark.createDataFrame(rows("b", 1), schema), size=2), f"{tmp_path}/s")
    assert [(r["chunk_id"], r["vector"], r["text"]) for r in memory.load_session(spark, f"{tmp_path}/s", "a").orderBy("chunk_id").collect()] == [(0, [0.5, 1.0], "w0 w1"), (1, [2.5, 1.0], "w2 w3"), (2, [4.0, 1.0], "w4")]
    assert memory.load_session(spark, f"{tmp_path}/s", "b").count() == 1
    with pytest.raises(KeyError):
        memory.load_session(spark, f"{tmp_path}/s", "c")
    failures = spark.createDataFrame([("1", "python loop", "bad", "good"), ("2", "python loop", "bad", "good"), ("3", "rust", "x", "y")], "id string, requirement string, failed string, corrected string")
    from quern.operators import knowledge

    known = knowledge.learned(failures.where("id = '1'")).withColumns({"access_count": F.lit(0).cast("long"), "last_access": F.lit(0.0)})
    out = {r["id"]: r["access_count"] for r in memory.learned_twice(known, failures.where("id > '1'"), F.lit(5.0)).collect()}
    assert out == {"1": 1, "3": 0}


def test_copies_of_runs_and_their_report(spark, tmp_path):
    import pytest

    from quern.operators import reports
    from quern.sources import sinks

    for run in (2, 10):
        (tmp_path / f"run{run}").mkdir()
        (tmp_path / f"run{run}" / f"shard-{run}.jsonl").write_text(f'{{"run": {run}}}\n' * run)
    paths = lambda *runs: spark.createDataFrame([(f"{tmp_path}/run{r}/shard-{r}.jsonl",) for r in runs], "path string")
    target, manifest = f"{tmp_path}/all", f"{tmp_path}/manifest"
    assert [r["bytes"] for r in sinks.copy_pending(paths(2), target, manifest).collect()] == [22]
    assert {r["dest"].rpartition("/")[2] for r in sinks.copy_pending(paths(10, 2), target, manifest).collect()} == {"shard-00001.jsonl"}
    assert sinks.copy_pending(paths(10, 2), target, manifest).count() == 0
    assert (tmp_path / "all" / "shard-00001.jsonl").read_text() == '{"run": 10}\n' * 10
    (tmp_path / "all" / ".copying").write_text("")
    with pytest.raises(RuntimeError, match="another copy"):
        sinks.copy_pending(paths(2), target, manifest)
    rows = spark.createDataFrame([("seen", "", 5), ("accepted", "", 2), ("category", "debug", 2), ("rejected", "mojibake", 3)], "metric string, key string, cnt long")
    text = reports.quality_markdown(rows, 1, 1)
    assert "seen=5 accepted=2 train=1 valid=1" in text and "- mojibake: 3" in text and "## Sources\n- none: 0" in text and text.endswith("duplicates are removed.\n")


def test_soft_penalty_of_odd_vectors_is_its_sql(spark, tmp_path):
    """Small negative values round to -0.0; null, empty and short vectors, null and non-finite entries."""
    import duckdb

    from quern.plans import registry

    nan, inf = float("nan"), float("inf")
    odd = [[-3e-7] * 9, [0.2, -2e-7, 2e-7, 0.0, -0.0] * 2, None, [], [0.5, -1e-7], [None, 0.25, -0.25], [nan, 1.0, inf], [-inf, 1.0, -4e-7], [-0.5] * 12, [0.1, None, 0.3]]
    spark.createDataFrame(list(enumerate(odd)), "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = {k: repr(v) for k, v in con.sql(registry.oracle_sql()["soft_penalty"]).fetchall()}
    assert {r["vec_id"]: repr(r["logits"]) for r in registry.queries()["soft_penalty"](spark, str(tmp_path)).collect()} == want
    assert "-0.0," in want[0]


def test_html_clean_pages_of_odd_pages_is_its_sql(spark, tmp_path):
    """Entities without a semicolon, of other names, twice escaped; other blanks and line ends; letters that fold to ASCII."""
    import random

    import duckdb

    from quern.plans import registry

    r = random.Random(9)
    parts = ["&amp", "&amp;", "&lt;", "&gt", "&quot", "&eacute;", "&#39;", "&#65;", "&amp;lt;", "&nbsp;", "<p>", "</p>", "</p\x0b>", "<br\x0b>", "<br\f/>", "<script>", "</script>", "<\u017fcript>", "</\u017fcript>", "</bloc\u212aquote>", "<", ">",
             "a", "b ", " ", "\t", "\n", "\r", "\r\n", "\x0b", "\f", "\x1c", "\x85", "\u2028", "\xa0", "\U0001f600"]
    pages = [None, "", "x&amp</title>", *("".join(r.choice(parts) for _ in range(r.randrange(20))) for _ in range(2000))]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = sorted(con.sql(f"select page_id, text_sha256, n_chars from ({registry.oracle_sql()['html_clean_pages']})").fetchall())
    got = registry.queries()["html_clean_pages"](spark, str(tmp_path)).select("page_id", "text_sha256", "n_chars").collect()
    assert [pages[g[0]] for g, w in zip(sorted(map(tuple, got)), want, strict=True) if g != w] == []


def test_questions_are_cleaned_once(spark, capsys):
    """Title, body and answers are cleaned where they are made, not wherever a later column speaks of them."""
    from quern.plans import registry

    registry.queries()["conv_from_stack_exchange"](spark, "/root/testdata/sf0.001").explain(True)
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert 0 < plan.count("p|li|div|pre") <= 6


#: Queries that once made their rows up, or seemed to.
QUERIES_MOVED = ["deliberation_levels", "lr_schedule", "routing_topk", "selfplay_tasks", "source_catalog", "toy_rows"]


def test_queries_read_given_tables(spark):
    from quern.plans import registry

    for name in QUERIES_MOVED:
        assert registry.queries()[name](spark, "/root/testdata/sf0.001").inputFiles(), name
