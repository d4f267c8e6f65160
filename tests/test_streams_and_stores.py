"""State by key, streams that resume, sinks that commit, and stores, against plain folds."""

import json
import os
import random
import threading
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

TALK = "array<struct<role:string,content:string>>"
RUN = f"seq long, source string, source_id string, license_id string, language string, messages {TALK}, tree_id string"


def talk(k):
    return [("user", f"How do I fix bug {k} in the pump function, because the pytest run fails with an error?"), ("assistant", f"First step by step: the root cause {k} is a wrong argument in def pump, so check the traceback and call the tool again. " * 2)]


def fold(rows):
    """One pass in order: what each row counts as."""
    prints, threads, out = set(), set(), {}
    for seq, source, _, _, _, messages, tree in rows:
        thread, fp = f"{source}:{tree}" if tree else None, messages[0][1]
        out[seq] = "duplicate_thread" if thread in threads else "duplicate" if fp in prints else None
        if out[seq] is None:
            prints.add(fp)
            threads |= {thread} - {None}
    return out


def test_two_keys_over_restarts_are_one_fold(spark, tmp_path):
    from quern.streaming.run import CleaningRun

    r = random.Random(2)
    rows = [(i, r.choice("ab"), f"id{i % 7}", "mit", "en", talk(r.randrange(9)), r.choice([None, "", "t1", "t2", "t3", "t4"])) for i in range(40)]
    want, folder = fold(rows), f"{tmp_path}/in"
    for k in range(3):  # three runs, the first of two batches, each a new object over the same folders
        for part in [rows[:8], rows[8:16]] if k == 0 else [rows[16 * k - 0 : 16 * k + 16]] if k == 1 else [rows[32:]]:
            spark.createDataFrame(part, RUN).coalesce(1).write.mode("append").parquet(folder)
        run = CleaningRun(f"{tmp_path}/out", whole=10**7, state_parts=2)
        stream = spark.readStream.schema(RUN).option("maxFilesPerTrigger", 1).parquet(folder)
        stream.writeStream.foreachBatch(run.clean_batch).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    told = {(x["metric"], x["key"]): x["cnt"] for x in run.report(spark).collect()}
    counts = [list(want.values()).count(v) for v in ("duplicate_thread", "duplicate", None)]
    assert [told["rejected", "duplicate_thread"], told["rejected", "duplicate"], told["accepted", ""]] == counts and told["seen", ""] == 40
    lines = [json.loads(x["value"]) for x in spark.read.text(f"{tmp_path}/out/shards").collect()]
    kept = [(s, i, m[0][1]) for q, s, i, _, _, m, _ in rows if want[q] is None]
    assert sorted((x["source"], x["source_id"], x["text"].split("\n")[0].removeprefix("User: ")) for x in lines) == sorted(kept)
    run.clean_batch(spark.createDataFrame(rows[32:], RUN), 3)  # the last batch again: its own keys don't count against it
    assert {(x["metric"], x["key"]): x["cnt"] for x in run.report(spark).collect()} == told


def test_equal_ids_of_two_sources_and_trees_stay_apart(spark, tmp_path):
    from quern.operators import conversations
    from quern.streaming.run import CleaningRun

    rows = [(1, "srcA", "7", "mit", "en", talk(1), "t1"), (2, "srcB", "7", "mit", "en", talk(2), "t2")]
    run = CleaningRun(f"{tmp_path}/out", whole=10**7, state_parts=2)
    run.clean_batch(spark.createDataFrame(rows, RUN), 0)
    lines = [json.loads(x["value"]) for x in spark.read.text(f"{tmp_path}/out/shards").collect()]
    assert sorted((x["source"], "bug 1 " in x["text"], "bug 2 " in x["text"]) for x in lines) == [("srcA", True, False), ("srcB", False, True)]
    judged = conversations.judge(spark.createDataFrame(rows, RUN).withColumn("conv_id", F.col("source_id")))
    full = conversations.full_record(judged, "s").collect()
    assert sorted((x["metadata"]["message_tree_id"], "bug 1 " in x["text"]) for x in full) == [("t1", True), ("t2", False)]


def test_key_state_answers_for_its_own_keys(spark, tmp_path):
    from quern.streaming.keys import KeyState

    state = KeyState(f"{tmp_path}/keys", parts=2)
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    ask = lambda b, *k: {r["key"] for r in state.taken_before(keys(*k), b).collect()}
    assert ask(0, "a", "b") == set()
    state.take(keys("a", "c"), 0)
    assert ask(1, "a", "b", "a") == {"a"} and ask(0, "a", "b") == set()  # asked again by the batch that took it
    state.take(keys("b"), 1)
    assert ask(2, "b", "c", "z") == {"b", "c"} and ask(1, "b", "c") == {"c"}
    known = spark.read.parquet(f"{tmp_path}/keys/known")
    assert known.where("batch = 2").count() == 2  # no more than its own keys
    timed = KeyState(f"{tmp_path}/timed", keep_ms=1, parts=1, late="0 seconds")
    timed.take(keys("a"), 0)
    assert {r["key"] for r in timed.taken_before(keys("b"), 1).collect()} == set()
    assert {r["key"] for r in timed.taken_before(keys("a"), 2).collect()} == set()  # let go by then


def test_trees_close_once_others_go_on(spark, tmp_path):
    from quern.operators import trees
    from quern.streaming import trees as stream

    r = random.Random(4)
    nodes, at = [], 0
    for t in range(9):
        tree, chain = f"t{t}", [None]
        for k in range(r.randrange(2, 7)):
            parent = chain[-1] if k < 2 else r.choice(chain[1:])
            depth = 0 if parent is None else int(parent.split("-")[1]) % 2 + 1
            chain.append(f"{tree}n{k}-{depth % 2}")
            nodes.append((chain[-1], parent, tree, "user" if depth % 2 == 0 else "assistant", f"text {t % 3} {k}", str(k), "en", 0, t * 60 + k * 25))
    nodes = [(*n[:7], i, n[8]) for i, n in enumerate(sorted(nodes, key=lambda n: n[8]))]  # trees interleave
    schema = f"{stream.NODE}, at long"
    frame = spark.createDataFrame(nodes, schema)
    batch = {(x["source_id"], str(x["messages"])) for x in trees.conversations(frame, "s", "mit", per_tree=True).collect()}
    store = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    session = spark.newSession()
    for k, v in store.items():
        session.conf.set(k, v)
    session.conf.set("spark.sql.shuffle.partitions", "2")
    out, seen = [], []

    def whole(rows, k):
        held = rows.collect()
        seen.append(sorted({x["tree_id"] for x in held}))  # a tree is in one batch only
        out.extend(held)

    def work():
        rows = stream.complete(session.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), gap="100 seconds")
        rows.writeStream.foreachBatch(whole).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()

    for part in (nodes[:15], nodes[15:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        work()
    early = {t for b in seen for t in b}
    assert early and early < {n[2] for n in nodes}  # some are out, some wait
    stream.closing(frame, "100 seconds").select(*[c.split()[0] for c in schema.split(", ")[:-1]], F.col("at").cast("long").alias("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    work()
    got = {(x["source_id"], str(x["messages"])) for x in trees.conversations(spark.createDataFrame(out, stream.NODE), "s", "mit", per_tree=True).collect()}
    assert got == batch and len(batch) > 5
    assert sorted(t for b in seen for t in b if t != "\n") == sorted({n[2] for n in nodes})  # each tree once, whole


def service(total, told=True, broken=None):
    """A paged service; ``told``: says its total; ``broken``: a one-item list with the offset from which it fails, once."""

    def fetch(url):
        q = {k: int(v[0]) for k, v in parse_qs(urlparse(url).query).items()}
        n = int(open(total).read()) if isinstance(total, str) else total
        if broken and os.path.exists(broken) and q["length"] > 1 and q["offset"] >= int(open(broken).read()):
            raise OSError("connection lost")
        rows = {"rows": [{"row": {"n": i}} for i in range(q["offset"], min(q["offset"] + q["length"], n))]}
        return rows | ({"num_rows_total": n} if told else {})

    return fetch


@pytest.mark.parametrize("told", [True, False])
def test_paged_tables_have_no_cap(spark, told):
    from quern.sources import paged

    for n in (0, 1, 5, 237):
        paged.register(spark, service(n, told), "paged_all")
        reader = spark.read.format("paged_all").option("url", "http://none").option("page", 5).option("parts", 3).option("pause", 0)
        assert sorted(r["row_number"] for r in reader.load().collect()) == list(range(n))
        assert sorted(r["row_number"] for r in reader.option("start", 3).load().collect()) == list(range(3, n))


def test_paged_stream_resumes(spark, tmp_path):
    """A run that is killed between pages repeats its batch; none is lost, and none twice."""
    from quern.sources import paged

    total, broken, out = f"{tmp_path}/total", f"{tmp_path}/broken", f"{tmp_path}/out"

    def say(path, n):
        with open(path, "w") as f:
            f.write(str(n))

    say(total, 23)
    paged.register(spark, service(total, True, broken), "paged_stream")

    def work():
        rows = spark.readStream.format("paged_stream").option("url", "http://none").option("page", 5).option("parts", 2).option("pause", 0).option("start", 2).load()
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()

    held = lambda: sorted(r["row_number"] for r in spark.read.parquet(out).collect())
    work()
    assert held() == list(range(2, 23))
    work()
    assert held() == list(range(2, 23))  # nothing new: no batch
    say(total, 51)
    say(broken, 35)
    with pytest.raises(Exception, match="connection lost"):
        work()
    assert held() == list(range(2, 23))
    os.remove(broken)
    work()
    assert held() == list(range(2, 51))


def test_shards_commit_under_free_names(spark, tmp_path):
    from quern.sources import shards

    folder = str(tmp_path / "shards")
    os.makedirs(folder)
    rows = lambda tag: spark.createDataFrame([(i // 4, i, f"{tag}{i}") for i in range(10)], "shard long, seq long, value string")
    write = lambda tag: shards.add(rows(tag), folder, F.col("shard"), ["seq"], F.col("value"))
    write("a")
    read = lambda n: open(f"{folder}/{n}").read().split()
    assert shards.names(folder) == [f"shard-{k:05d}.jsonl" for k in range(3)] == sorted(os.listdir(folder))
    assert [read(n) for n in shards.names(folder)] == [[f"a{i}" for i in range(4)], [f"a{i}" for i in range(4, 8)], ["a8", "a9"]]
    os.link(f"{folder}/shard-00000.jsonl", f"{folder}/shard-00004.jsonl")  # a name in the way
    work = [threading.Thread(target=write, args=(t,)) for t in "bc"]
    [t.start() for t in work]
    [t.join() for t in work]
    held = {n: read(n) for n in shards.names(folder)}
    assert len(held) == 3 + 1 + 6 and sorted(x for v in held.values() for x in v if x[0] in "bc") == sorted(f"{t}{i}" for t in "bc" for i in range(10))
    for t in "bc":  # each writer's shards keep their order
        assert [x for v in held.values() for x in v if x[0] == t] == [f"{t}{i}" for i in range(10)]
    bad = rows("d").withColumn("value", F.when(F.col("seq") == 9, F.raise_error(F.lit("broken off"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="broken off"):
        shards.add(bad, folder, F.col("shard"), ["seq"], F.col("value"))
    assert sorted(os.listdir(folder)) == sorted(held)
    with pytest.raises(Exception, match="only added"):
        rows("e").select("shard", "value").write.format("jsonl_shards").mode("overwrite").option("path", folder).save()


def test_locks_have_one_holder(tmp_path):
    from quern.sources.shards import Lock

    path = str(tmp_path / "lock")
    with Lock(path), pytest.raises(RuntimeError, match="at work"):
        Lock(path).__enter__()
    assert not os.path.exists(path)
    open(path, "w").close()
    os.utime(path, (1, 1))  # left by a holder that was broken off
    with Lock(path, stale=60), pytest.raises(RuntimeError):
        Lock(path, stale=60).__enter__()
    got, go = [], threading.Barrier(8)

    def claim():
        go.wait()
        try:
            Lock(path).__enter__()
            got.append(1)
        except RuntimeError:
            pass

    work = [threading.Thread(target=claim) for _ in range(8)]
    [t.start() for t in work]
    [t.join() for t in work]
    assert got == [1]


def test_memory_store_filters_in_the_scan(spark, tmp_path):
    from quern.sources import memory_store

    r = random.Random(3)
    rows = [(f"m{i}", r.choice(["fact", "task"]), f"text {i}", float(i), r.random(), i % 5, None if i % 3 else 1.5, "{}") for i in range(300)]
    frame = spark.createDataFrame(rows, memory_store.SCHEMA)
    path = f"{tmp_path}/memories.db"
    assert memory_store.save(frame, path) == 300 == memory_store.save(frame, path)
    held = memory_store.memories(spark, path, parts=4)
    assert sorted(map(tuple, held.collect())) == sorted(rows)
    some = held.where("importance >= 0.5 and type = 'fact' and content like '%7%'")
    assert sorted(map(tuple, some.collect())) == sorted(x for x in rows if x[4] >= 0.5 and x[1] == "fact" and "7" in x[2])
    plan = some._jdf.queryExecution().executedPlan().toString()
    left = plan[plan.index("Filter") :].split("\n")[0]
    assert "importance" not in left and "type" not in left and "content" in left  # the scan has taken the two others
    memory_store.save(frame.limit(0), f"{tmp_path}/none.db")
    assert memory_store.memories(spark, f"{tmp_path}/none.db").count() == 0


def test_live_report_adds_up(spark, tmp_path):
    from quern.streaming import cleaning, live

    told, now = [], [0.0]

    def clock():
        now[0] += 1
        return now[0]

    report = live.LiveReport(told.append, every=2, least_seconds=0, clock=clock)
    texts = [f"The pump number {k} turns because its valve is open; see def pump and pytest for a test of it. " * 4 for k in range(6)] + ["x", None]
    for k in range(4):
        spark.createDataFrame([(texts[2 * k],), (texts[2 * k + 1],)], "text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.streams.addListener(report)
    try:
        rows = cleaning.cleaned(spark.readStream.schema("text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), F.col("text"))
        query = live.observed(rows, ["too_short"]).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
        for _ in range(100):
            if told and told[-1]["seen"] == 8:
                break
            threading.Event().wait(0.1)
    finally:
        spark.streams.removeListener(report)
    out = spark.read.parquet(f"{tmp_path}/out")
    good = out.where("reject_reason is null")
    assert told[-1]["seen"] == 8 == out.count() and told[-1]["accepted"] == good.count() > 0
    assert told[-1]["bytes"] == good.agg(F.sum(F.octet_length("text"))).first()[0] and len(told) >= 2
    assert all(a["seen"] <= b["seen"] for a, b in zip(told, told[1:], strict=False))


def test_parquet_among_many_other_files(spark, tmp_path):
    """The format of a folder is its Parquet files', wherever they stand among its names."""
    from quern.sources import files

    (tmp_path / "set").mkdir()
    for k in range(1100):
        (tmp_path / "set" / f"a{k:04d}.txt").write_text("{}")
    spark.range(7).coalesce(1).write.parquet(f"{tmp_path}/set/z")
    assert sorted(r["id"] for r in files.dataset_rows(spark, f"{tmp_path}/set").collect()) == list(range(7))
    spark.createDataFrame([("a",), ("b",)], "v string").write.json(f"{tmp_path}/lines")
    assert files.dataset_rows(spark, f"{tmp_path}/lines").count() == 2 and files.dataset_rows(spark, f"{tmp_path}/lines", 1).count() == 1
