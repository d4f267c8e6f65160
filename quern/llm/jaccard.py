"""N-gram Jaccard join: documents whose sets of word 5-grams overlap by 0.8 or more, found by a MinHash LSH forest.

Words are maximal runs without white space.  A text's signature in each of
``TREES`` prefix tries is a label of ``DEPTH`` MinHash values, and two texts of
similarity s share a prefix of p values with probability s^p or more.  A trie
is the sorted array of its labels: texts that share a prefix lie side by side,
and a text's longest shared prefix is the one it shares with the label before
it.  The array is range-partitioned, so that no prefix, however common, is a
task's burden.

Each text starts from the longest prefix that it shares in a trie, and the
prefix is shortened from there, value by value, until a pair at the threshold
meets in some trie with the target recall (``prefix_length``); a text whose
longest shared prefix is shorter in every trie has no candidates.  In the run
of the shortened prefix each text is linked to the run's least text; the first
text of its longest prefix is kept too, to lay the nearest texts side by side.

The rest avoids listing the pairs of a group, which may hold thousands of
texts: exact copies are one text first.  Linked runs give candidate groups.
Small groups are packed into blocks; large ones are cut into blocks, each of
which is compared within and written once, in compressed form, to the shared
folder; two blocks that share a run are fetched by ranges and compared in one
task.  Comparisons are exact, all pairs at once, and give back only each text's
number of links and a spanning forest.

Joins by a hot key (a text with a third of all rows, a hub of a group) are
split: see ``common.lookup``.  Texts are not shuffled but for those that may
have a candidate, or may have to go.

Defined results: a null text is a class of its own, without links; an empty
text (no words) links to nothing but its exact copies; a text of one to four
words has one shingle, all its words; a very long text is compared whole.
Copies (equal texts) are always one class.  Rows that repeat a doc_id get a row
each.  A null doc_id is an id like any other, but never a ``class_id`` where
the class has another.  ``class_id`` is the smallest doc_id of the class;
``n_links`` counts different texts, not rows.  An empty table gives no rows.
Extra columns, whatever their names, are kept by ``keep_one`` and not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MemberFilter, delete, file, freeing, heavy_keys, lookup, shared_dir, stage, unstage

WIDTH = 5
THRESHOLD = 0.8
TREES = 32
#: A label is a long: DEPTH values of BITS bits, the first in the highest place.
DEPTH, BITS = 9, 7
RECALL = 0.999
#: A block of small groups has about so many texts; one of a large group so many; neither much more shingles than that.
BLOCK_TEXTS, LARGE_TEXTS, BLOCK_SHINGLES = 192, 512, 400_000
#: Groups up to this size share blocks with others.
SMALL_GROUP = 96
_CHUNK = 1 << 15
#: Texts that are in Python's hands at a time.
ROWS = 250


def prefix_length(trees: int = TREES, threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH) -> int:
    """Start from the tries' whole depth and shorten the prefix until pairs at the threshold are met with the target recall."""
    for p in range(depth, 0, -1):
        if 1 - (1 - threshold**p) ** trees >= recall:
            return p
    raise ValueError("even prefixes of one value miss the target recall: more trees are needed")


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def shingles(texts: list[str | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all texts' shingles, in order and with repeats, and the n + 1 places between texts."""
    words = [t.split() if t else [] for t in texts]
    count = np.array([len(w) for w in words], np.int64)
    n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    flat = np.empty(int(count.sum()), object)
    flat[:] = list(chain.from_iterable(words))
    if not len(flat):
        return np.empty(0, np.uint64), at
    h = np.concatenate([pd.util.hash_array(flat, categorize=True), np.zeros(width, np.uint64)])
    factor = _odd(width, 11)
    begin = np.concatenate([[0], np.cumsum(count)[:-1]])
    own = np.repeat(begin - at[:-1], n) + np.arange(at[-1])  # the first word of each shingle
    length = np.repeat(np.minimum(count, width), n)
    out = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(width):
        out += np.where(length > k, _mix(h[own + k]) * factor[k], np.uint64(0))
    return _mix(out), at


def sketch(values: np.ndarray, at: np.ndarray, trees: int) -> np.ndarray:
    """Each text's labels, one a trie: int64 of shape (texts, trees); of texts without shingles, zeros."""
    n, factor, flip = len(at) - 1, _odd(trees * DEPTH, 12), _odd(trees * DEPTH, 13)
    low = np.zeros((n, trees * DEPTH), np.uint64)
    some = np.flatnonzero(np.diff(at) > 0)
    first = 0
    while first < len(some):
        last = max(first + 1, int(np.searchsorted(at[some + 1], at[some[first]] + _CHUNK, side="right")))
        docs = some[first:last]
        part, starts = values[at[docs[0]] : at[docs[-1] + 1]], at[docs] - at[docs[0]]
        work = np.empty_like(part)
        for k in range(trees * DEPTH):
            np.bitwise_xor(part, flip[k], out=work)
            np.multiply(work, factor[k], out=work)
            low[docs, k] = np.minimum.reduceat(work, starts)
        first = last
    low = (_mix(low) >> np.uint64(64 - BITS)).reshape(n, trees, DEPTH)
    label = np.zeros((n, trees), np.uint64)
    for k in range(DEPTH):
        label = (label << np.uint64(BITS)) | low[:, :, k]
    return label.view(np.int64)


def sketches(docs: DataFrame, trees: int, width: int) -> DataFrame:
    """doc_id, digest (of the text), n (shingles) and labels of every document with a text."""
    slim = docs.where(F.col("text").isNotNull()).select("doc_id", F.unhex(F.md5("text")).alias("digest"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                values, at = shingles(part.column(2).to_pylist(), width)
                n = np.diff(at)
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, trees, 0))]).astype(np.int32)
                labels = pa.ListArray.from_arrays(ends, sketch(values, at, trees)[n > 0].reshape(-1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), labels], names=["doc_id", "digest", "n", "labels"])

    doc_type = dict(docs.dtypes)["doc_id"]
    return slim.mapInArrow(freeing(run), f"doc_id {doc_type}, digest binary, n long, labels array<long>")


def _climb(p: int):
    """Walk along sorted tries: one row (tid, first, head, depth, key, edge) per text and trie where a prefix of ``p`` values or more is shared.

    ``depth`` is the longest prefix shared with the label before and ``head``
    its first text; ``key`` names the prefix shortened to ``p`` values, and
    ``first`` is the least text of its run (as far as this batch knows; if a
    later one holds a lesser text, one more row links the two).  ``edge`` marks
    the first and the last run of a partition, which may go on next door.
    """

    def key_of(tree: np.ndarray, label: np.ndarray) -> np.ndarray:
        return (tree << (BITS * p)) | (label >> (BITS * (DEPTH - p)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # tree, label, heads by level, and of the run of p values its least text and whether it is the only one
        for batch in batches:
            tree, label, tid = (batch[c].to_numpy(np.int64) for c in ("tree", "label", "tid"))
            n, rows = len(tid), []
            if not n:
                continue
            key = key_of(tree, label)
            if last is None:
                rows.append((tid[:1], tid[:1], tid[:1], np.full(1, p), key[:1], np.ones(1, bool)))
                last = (-1, 0, np.zeros(DEPTH + 1, np.int64), 0, False)
            other = np.concatenate([[last[0]], tree[:-1]]) != tree
            differ = np.concatenate([[last[1]], label[:-1]]) ^ label
            depth, head, heads = np.full(n, DEPTH), tid.copy(), last[2].copy()
            for level in range(p, DEPTH + 1):
                fresh = other | ((differ >> (BITS * (DEPTH - level))) != 0)
                begin = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
                of_level = np.where(begin >= 0, tid[begin], heads[level])
                depth[~fresh], head[~fresh] = level, of_level[~fresh]
                heads[level] = of_level[-1]
                if level == p:
                    starts = fresh
            goes_on = not starts[0]
            at = np.flatnonzero(starts | (np.arange(n) == 0))
            least, size = np.minimum.reduceat(tid, at), np.diff(np.append(at, n))
            several = size > 1
            if goes_on:
                before, least[0], several[0] = last[3], min(last[3], least[0]), True
                if last[4] or least[0] < before:
                    rows.append((np.array([before]), least[:1], least[:1], np.full(1, p), key[:1], np.zeros(1, bool)))
            first, met = np.repeat(least, size), np.repeat(several, size)
            rows.append((tid[met], first[met], head[met], depth[met], key[met], np.zeros(int(met.sum()), bool)))
            last = (tree[-1], label[-1], heads, least[-1], not several[-1])
            yield pd.DataFrame({c: np.concatenate([r[k] for r in rows]) for k, c in enumerate(("tid", "first", "head", "depth", "key", "edge"))})
        if last is not None:
            yield pd.DataFrame({"tid": [last[3]], "first": [last[3]], "head": [last[3]], "depth": [p], "key": key_of(np.array([last[0]]), np.array([last[1]])), "edge": [True]})

    return run


def forest(texts: DataFrame, p: int) -> DataFrame:
    """(tid, first, head, depth, key) of all texts that share a prefix of ``p`` values or more in some trie, a row per trie."""
    entries = texts.select(F.posexplode("labels").alias("tree", "label"), "tid")
    tries = entries.repartitionByRange("tree", "label", "tid").sortWithinPartitions("tree", "label", "tid")
    walked = stage(tries.mapInPandas(freeing(_climb(p)), "tid long, first long, head long, depth int, key long, edge boolean"), "jaccard-tries")
    ends = walked.where("edge")  # two rows a partition
    over = ends.groupBy("key").agg(F.min("tid").alias("least"), F.max("tid").alias("most")).where("least <> most").select("key", "least")
    stitched = ends.join(over, "key").select("tid", F.col("least").alias("first"), F.col("least").alias("head"), F.lit(p).alias("depth"), "key")
    met = stage(walked.where("not edge").drop("edge").union(stitched), "jaccard-met")
    unstage(walked)
    return met


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): its component's least node.

    Labels run along the edges and, from label to label's label, in leaps, so
    that long chains need few rounds.  Each round is a written table, and the
    one before it is deleted.  Hubs and large components are heavy keys.
    """
    both = stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{label}-edges")
    n = both.count()
    hubs = stage(heavy_keys(both.groupBy("b").agg(F.count("*").alias("n")), n), f"{label}-hubs")
    roots = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), f"{label}-0")
    nodes, k = roots.count(), 0
    while True:
        k += 1
        heard = lookup(both, "b", roots.withColumnsRenamed({"node": "b", "root": "heard"}), hubs).groupBy(F.col("a").alias("node")).agg(F.min("heard").alias("heard"))
        new = stage(roots.join(heard, "node").select("node", "root", F.least("root", "heard").alias("now")), f"{label}-{k}a")
        large = heavy_keys(new.groupBy("now").agg(F.count("*").alias("n")), nodes)
        then = new.select(F.col("node").alias("now"), F.col("now").alias("then"))
        leapt = stage(lookup(new, "now", then, large).select("node", F.col("root").alias("was"), F.least("now", "then").alias("root")), f"{label}-{k}")
        unstage(roots, new)
        roots = leapt
        if not roots.where("was <> root").limit(1).count():
            unstage(both, hubs)
            return roots.select("node", "root")


def _links(sets: list[np.ndarray], side: np.ndarray, whole: bool, threshold: float) -> np.ndarray:
    """Which texts of one group are linked: a boolean matrix (left texts x right texts)."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero((side == 1) if not whole else (side == 0))
    size = np.array([len(s) for s in sets])
    if len(left) * len(right) <= 64:
        both = np.zeros((len(left), len(right)))
        for i, a in enumerate(left):
            for j, b in enumerate(right):
                if (j > i or not whole) and min(size[a], size[b]) >= threshold * max(size[a], size[b]):
                    both[i, j] = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if whole:
            both += both.T
    else:
        doc, value = np.repeat(np.arange(len(sets)), size), np.concatenate(sets)
        order = np.argsort(value, kind="stable")
        doc, value = doc[order], value[order]
        fresh = np.concatenate([[True], value[1:] != value[:-1]])
        col = np.cumsum(fresh) - 1
        shared = np.bincount(col) > 1
        doc, col = doc[shared[col]], (np.cumsum(shared) - 1)[col[shared[col]]]
        both = np.zeros((len(left), len(right)), np.float64)
        place = np.empty(len(sets), np.int64)
        place[left], place[right] = np.arange(len(left)), np.arange(len(right))
        is_left = (side == 0)[doc]
        step = 4096
        cuts = np.searchsorted(col, np.arange(0, (col[-1] if len(col) else -1) + 1 + step, step))
        for k in range(len(cuts) - 1):
            d, c, own = doc[cuts[k] : cuts[k + 1]], col[cuts[k] : cuts[k + 1]] - k * step, is_left[cuts[k] : cuts[k + 1]]
            x = np.zeros((len(left), step), np.float32)
            x[place[d[own]], c[own]] = 1
            if whole:
                y = x
            else:
                y = np.zeros((len(right), step), np.float32)
                y[place[d[~own]], c[~own]] = 1
            both += x @ y.T
    union = size[left][:, None] + size[right][None, :] - both
    out = both >= threshold * union - 1e-9
    if whole:
        np.fill_diagonal(out, False)
    return out


def _forest_of(linked: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, n, b) of the texts with links in a symmetrical matrix: the id, its number of links, the least id that it reaches here."""
    root = np.arange(len(ids))
    while True:
        new = np.minimum(root, np.where(linked, root[None, :], len(ids)).min(axis=1))
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    n = linked.sum(axis=1)
    some = n > 0
    return ids[some], n[some], ids[root[some]]


def _packed(ids: np.ndarray, sets: list[np.ndarray]) -> bytes:
    """A block's texts, compressed: its distinct shingles once, in the order of first use, and each text's as places among them."""
    size = np.array([len(s) for s in sets], np.int64)
    distinct, first, place = np.unique(np.concatenate(sets), return_index=True, return_inverse=True)
    order = np.argsort(first, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    places = np.concatenate([np.diff(np.sort(r), prepend=0) for r in np.split(rank[place], np.cumsum(size)[:-1])]).astype(np.int32)
    return zlib.compress(np.array([len(ids), len(distinct)], np.int64).tobytes() + ids.astype(np.int64).tobytes() + size.tobytes() + distinct[order].tobytes() + places.tobytes(), 1)


def _unpacked(raw: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    raw = zlib.decompress(raw)
    n, m = np.frombuffer(raw, np.int64, 2)
    ids, size = np.frombuffer(raw, np.int64, n, 16), np.frombuffer(raw, np.int64, n, 16 + 8 * n)
    distinct = np.frombuffer(raw, np.uint64, m, 16 + 16 * n)
    places = np.frombuffer(raw, np.int32, -1, 16 + 16 * n + 8 * m)
    return ids, [distinct[np.cumsum(p)] for p in np.split(places, np.cumsum(size)[:-1])]


def _within(folder: str, threshold: float):
    """Compare the texts of a block, group by group; a block of a large group is written to the folder as well."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("tid").sort_values(["root", "tid"], kind="stable")
        out = []
        for _, g in pdf.groupby("root", sort=False):
            ids, sets = g["tid"].to_numpy(np.int64), [np.frombuffer(b, np.uint64) for b in g["shingles"]]
            if len(g) > 1:
                a, n, b = _forest_of(_links(sets, np.zeros(len(ids), int), True, threshold), ids)
                out.append(pd.DataFrame({"a": pd.array(a, "Int64"), "n": pd.array(n, "Int64"), "b": pd.array(b, "Int64"), "block": None, "path": None}))
            if g["large"].iloc[0]:
                path = f"{folder}/{uuid.uuid4().hex}"
                with file(path, True) as f:
                    f.write(_packed(ids, sets))
                out.append(pd.DataFrame({**{c: pd.array([pd.NA], "Int64") for c in "anb"}, "block": g["block"].iloc[0], "path": path}))
        return pd.concat(out) if out else pd.DataFrame({**{c: pd.array([], "Int64") for c in "anb"}, "block": np.array([], object), "path": np.array([], object)})

    return run


def _across(threshold: float):
    """Compare pairs of written blocks: rows of two paths."""

    def fetched(path: str) -> tuple[np.ndarray, list[np.ndarray]]:
        with file(path, False) as f:
            return _unpacked(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, other in zip(batch["path"], batch["with"], strict=True):
                (ids, sets), (more, more_sets) = fetched(path), fetched(other)
                linked = _links(sets + more_sets, np.repeat([0, 1], [len(sets), len(more_sets)]), False, threshold)
                a, b = linked.shape
                full = np.zeros((a + b, a + b), bool)
                full[:a, a:], full[a:, :a] = linked, linked.T
                out = _forest_of(full, np.concatenate([ids, more]))
                yield pd.DataFrame(dict(zip("anb", out, strict=True)))

    return run


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (first_id, digest, ...) with the texts: only documents that may be wanted are shuffled."""
    may = MemberFilter(wanted, "first_id").split(docs.where(F.col("text").isNotNull()).select("doc_id", "text"), "doc_id").where("__q_may").drop("__q_may")
    own = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.unhex(F.md5("text")) == F.col("digest"))
    return may.join(wanted.hint("merge"), own).drop("doc_id")


def _compare(docs: DataFrame, texts: DataFrame, met: DataFrame, groups: DataFrame, width: int, threshold: float) -> DataFrame:
    """Exact comparison of all texts that meet: (a, n, b) per text and task: its links there and the least text reached."""
    near = met.groupBy("tid").agg(F.min_by("head", F.struct(-F.col("depth"), "head")).alias("star"))
    member = groups.withColumnRenamed("node", "tid").join(texts.select("tid", "digest", "first_id", "n"), "tid").join(near, "tid")
    member = stage(member, "jaccard-members")
    size = stage(member.groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("mass")), "jaccard-sizes")
    all_of = size.agg(F.coalesce(F.sum("members"), F.lit(0)).alias("m"), F.coalesce(F.sum("mass"), F.lit(0)).alias("w")).first()
    packs = max(1, -(-all_of["m"] // BLOCK_TEXTS), -(-all_of["w"] // BLOCK_SHINGLES))
    small = (F.col("members") <= SMALL_GROUP) & (F.col("mass") <= BLOCK_SHINGLES)
    sized = lookup(member, "root", size, heavy_keys(size.select("root", F.col("members").alias("n")), all_of["m"]))
    packed = sized.where(small).select("tid", "digest", "first_id", "root", F.concat(F.lit("s"), F.pmod(F.xxhash64("root"), F.lit(packs)).cast("string")).alias("block"), F.lit(False).alias("large"))
    # places along a large group: its range partitions count on their own, then each adds what comes before it
    ranged = stage(sized.where(~small).select("tid", "digest", "first_id", "root", "star", "n").repartitionByRange("root", "star", "tid").withColumn("slice", F.spark_partition_id()), "jaccard-ranged")
    prior = Window.partitionBy("root").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    runs = ranged.groupBy("root", "slice").agg(F.count("*").alias("texts"), F.sum("n").alias("mass"))
    runs = runs.select("root", "slice", F.coalesce(F.sum("texts").over(prior), F.lit(0)).alias("texts0"), F.coalesce(F.sum("mass").over(prior), F.lit(0)).alias("mass0"))
    order = Window.partitionBy("root", "slice").orderBy("star", "tid")
    local = ranged.withColumns({"k": F.row_number().over(order), "m": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    place = F.greatest(F.floor((F.col("texts0") + F.col("k")) / LARGE_TEXTS), F.floor((F.col("mass0") + F.col("m")) / BLOCK_SHINGLES))
    cut = local.join(runs, ["root", "slice"]).withColumn("place", place)
    chopped = cut.select("tid", "digest", "first_id", "root", F.concat_ws("/", F.col("root").cast("string"), F.col("place").cast("string")).alias("block"), F.lit(True).alias("large"))
    blocks = stage(packed.union(chopped), "jaccard-blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                tid = part.column(0).to_numpy()  # rows that repeat a document come out of the join side by side; one is enough
                part, last = part.filter(pa.array(np.concatenate([[tid[0] != last], tid[1:] != tid[:-1]]))), tid[-1]
                values, at = shingles(part.column(4).to_pylist(), width)
                sets = pa.array([np.unique(values[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in range(4)], sets], names=["tid", "root", "block", "large", "shingles"])

    text = _fetch(docs, blocks).select("tid", "root", "block", "large", "text")
    sets = text.mapInArrow(freeing(run), "tid long, root long, block string, large boolean, shingles binary")
    folder = shared_dir(docs.sparkSession, "jaccard-packed")
    within = stage(sets.groupBy("block").applyInPandas(_within(folder, threshold), "a long, n long, b long, block string, path string"), "jaccard-within")
    # blocks of large groups meet if they share a run
    shared = met.join(blocks.where("large").select("tid", "block"), "tid").select("key", "block").distinct()
    pairs = shared.join(shared.withColumnRenamed("block", "other"), "key").where("block < other").select("block", "other").distinct()
    paths = within.where("path is not null").select("block", "path")
    tasks = pairs.join(paths, "block").join(paths.select(F.col("block").alias("other"), F.col("path").alias("with")), "other").select("path", "with")
    across = tasks.repartition("path", "with").mapInPandas(_across(threshold), "a long, n long, b long")
    out = stage(within.where("a is not null").select("a", "n", "b").union(across), "jaccard-links")
    unstage(member, size, ranged, blocks, within)
    delete(docs.sparkSession, folder)
    return out


def _stars(met: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what the runs connect: each text with its least first text, and that with the text's others, once for all texts.

    A text has about one first text a trie, so its set of them is small.
    """
    of = met.groupBy("tid").agg(F.min("first").alias("b"), F.collect_set("first").alias("all"))
    own = of.select(F.col("tid").alias("a"), "b")
    return own.union(of.select(F.explode("all").alias("a"), "b")).where("a <> b").distinct()


def link(docs: DataFrame, *, width: int = WIDTH, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): doc_id and digest of every document with a text; per distinct text digest, first_id, n_copies, n_links, root (the class's least text)."""
    p = prefix_length(trees, threshold, recall)
    if trees << (BITS * p) >= 1 << 62:
        raise ValueError("a run's name must fit a long: fewer trees or shorter prefixes are needed")
    rows = stage(sketches(docs, trees, width), "jaccard-sketches")
    texts = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies"), F.first("n").alias("n"), F.first("labels").alias("labels"))
    texts = stage(texts.withColumn("tid", F.monotonically_increasing_id()), "jaccard-texts")  # the ids are fixed by being written
    met = forest(texts, p)
    groups = components(_stars(met), "jaccard-groups")
    found = _compare(docs, texts, met, groups, width, threshold)
    linked = found.groupBy(F.col("a").alias("tid")).agg(F.sum("n").alias("n_links"))
    classes = components(found.where("a <> b").select("a", "b"), "jaccard-classes").withColumnRenamed("node", "tid")
    out = texts.select("tid", "digest", "first_id", "n_copies").join(linked.join(classes, "tid"), "tid", "left")
    out = stage(out.select("tid", "digest", "first_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "tid").alias("root")), "jaccard-classed")
    slim = stage(rows.select("doc_id", "digest"), "jaccard-rows")
    unstage(rows, texts, met, found)
    return slim, out


def _least(texts: DataFrame) -> DataFrame:
    """``texts`` with class_id and class_digest, the id and digest of the class's first text."""
    n = texts.count()
    least = texts.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull(), "first_id", "digest")).alias("w"), F.count("*").alias("n"))
    known = least.select("root", F.col("w.first_id").alias("class_id"), F.col("w.digest").alias("class_digest"))
    return lookup(texts, "root", known, heavy_keys(least.select("root", "n"), n))


def classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, n_links and n_copies of every document."""
    rows, texts = link(docs, **options)
    total = rows.count()
    found = stage(_least(texts).select("digest", "class_id", "n_links", "n_copies"), "jaccard-found")
    known = lookup(rows, "digest", found, heavy_keys(found.select("digest", F.col("n_copies").alias("n")), total))
    none = docs.where(F.col("text").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return known.select("doc_id", "class_id", "n_links", "n_copies").union(none)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Of each class the document of the smallest (doc_id, digest), with its own columns; documents without text stay.

    Only documents that may have to go, or to be told from a repeated row, are
    shuffled; all others are known to stay from a small filter of ids.
    """
    rows, texts = link(docs, **options)
    total = rows.count()
    winner = F.col("first_id").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("class_digest"))
    # texts whose class has another text or that have copies; all their rows are looked at closely
    mine = stage(_least(texts).select("digest", "first_id", "n_copies", winner.alias("wins")), "jaccard-winners")
    close = mine.where("n_copies > 1 or not wins")
    ids = stage(lookup(rows, "digest", close.select("digest", "first_id", "wins"), heavy_keys(close.select("digest", F.col("n_copies").alias("n")), total)), "jaccard-close")
    has = MemberFilter(ids, "doc_id").split(docs, "doc_id")
    sure = has.where(~F.col("__q_may") | F.col("text").isNull())
    verdict = ids.select(F.col("doc_id").alias("__q_id"), F.col("digest").alias("__q_of"), (F.col("wins") & F.col("doc_id").eqNullSafe(F.col("first_id"))).alias("__q_wins")).distinct()
    risky = has.where(F.col("__q_may") & F.col("text").isNotNull()).withColumn("__q_digest", F.unhex(F.md5("text")))
    met = risky.join(verdict.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__q_id")) & (F.col("__q_digest") == F.col("__q_of")), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = met.where(F.col("__q_wins")).dropDuplicates(["doc_id", "__q_digest"])
    return sure.select(*columns).union(met.where(F.col("__q_wins").isNull()).select(*columns)).union(kept.select(*columns))
