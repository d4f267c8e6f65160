"""Token-level datasets: bytes as tokens, packing, label alignment and derivation, collation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAD, BOS, EOS, UNK, SHIFT = 0, 1, 2, 3, 4


def each_byte(raw: Column) -> Column:
    """The bytes of a binary as ints: read as Latin-1, where a byte is a character of that number."""
    chars = F.split(F.decode(raw, "ISO-8859-1"), "")
    return F.when(F.octet_length(raw) == 0, F.expr("cast(array() as array<int>)")).otherwise(F.transform(chars, lambda c: F.ascii(c)))


def _bytes(text: Column) -> Column:
    return each_byte(F.encode(text, "UTF-8"))


def byte_encode(text: Column, bos: bool = False, eos: bool = False) -> Column:
    """Each UTF-8 byte plus four."""
    body = F.transform(_bytes(text), lambda b: b + SHIFT)
    return F.concat(*([F.array(F.lit(BOS))] * bos), body, *([F.array(F.lit(EOS))] * eos))


def raw_bytes(ids: Column) -> Column:
    """The bytes of the ids from four up, as a binary."""
    body = F.filter(ids, lambda i: i >= SHIFT)
    return F.encode(F.array_join(F.transform(body, lambda i: F.char((i - SHIFT).cast("long"))), ""), "ISO-8859-1")


def byte_decode(ids: Column) -> Column:
    """The text of the ids from four up; malformed UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(raw_bytes(ids).cast("string"))


def skeleton_encode(text: Column, vocab: int, length: int) -> Column:
    """1, byte mod (vocab - 4) + 4 of the first length - 2 bytes, 2, zeros."""
    body = F.transform(F.slice(_bytes(F.substring(text, 1, length - 2)), F.lit(1), F.lit(length - 2)), lambda b: b % (vocab - SHIFT) + SHIFT)
    return F.slice(F.concat(F.array(F.lit(BOS)), body, F.array(F.lit(EOS)), F.array_repeat(F.lit(PAD), length)), 1, length)


def line_starts(lines: DataFrame, seq: str, size: Column, buckets: int = 1024) -> DataFrame:
    """Adds ``start``: the running sum of sizes before each line, in two levels.

    Sums of ranges of ``seq`` come first; within each range a window adds up.
    No task sees more than a range, so this holds at any number of lines.
    """
    sized = lines.withColumn("n", size)
    low, high = sized.agg(F.min(seq), F.max(seq)).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // buckets))
    sized = sized.withColumn("_range", F.floor((F.col(seq) - (low or 0)) / width))
    sums = sized.groupBy("_range").agg(F.sum("n").alias("_sum"))
    before = sums.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # at most ``buckets`` rows
    within = Window.partitionBy("_range").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    return sized.join(before, "_range").withColumn("start", F.col("_before") + F.coalesce(F.sum("n").over(within), F.lit(0))).drop("_range", "_before")


def pack(lines: DataFrame, seq: str, text: str, length: int) -> DataFrame:
    """(chunk, input_ids): all lines, each with a line end, as one stream after a BOS, cut to chunks of ``length``.

    A chunk needs one token to look ahead to, so the last, partial one drops,
    and a full last one too.  A line's tokens are its bytes, so places come
    from its length alone, slices travel as bytes, and only a whole chunk is
    made tokens.
    """
    own = lines.select(F.col(seq), F.encode(F.concat(F.coalesce(F.col(text), F.lit("")), F.lit("\n")), "UTF-8").alias("raw"))
    starts = line_starts(own.select(seq, F.octet_length("raw").alias("bytes")), seq, F.col("bytes"))
    whole = 1 + (own.agg(F.sum(F.octet_length("raw"))).first()[0] or 0)
    chunks = (whole - 1) // length
    placed = own.join(starts.select(F.col(seq).alias("_seq"), (F.col("start") + 1).alias("start"), "n"), F.col(seq) == F.col("_seq"))  # the BOS comes first
    first, last = F.floor(F.col("start") / length), F.floor((F.col("start") + F.col("n") - 1) / length)
    parts = placed.select("start", "n", "raw", F.explode(F.sequence(first, last)).alias("chunk")).where(F.col("chunk") < chunks)
    lo, hi = F.greatest(F.col("chunk") * length - F.col("start"), F.lit(0)), F.least((F.col("chunk") + 1) * length - F.col("start"), F.col("n"))
    cut = parts.select("chunk", "start", F.hex(F.substring("raw", (lo + 1).cast("int"), (hi - lo).cast("int"))).alias("raw"))
    body = cut.groupBy("chunk").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "raw"))), lambda p: p["raw"]), "")).alias("raw"))
    ids = F.transform(each_byte(F.col("raw")), lambda b: b + SHIFT)
    return body.select("chunk", F.when(F.col("chunk") == 0, F.concat(F.array(F.lit(BOS)), ids)).otherwise(ids).alias("input_ids"))


def hard_labels(losses: Column, threshold: float, rate: float | None = None) -> Column:
    """1 where a finite loss reaches the threshold (and, with a rate, the k-th largest), 0 elsewhere, null where the loss isn't finite."""
    ok = lambda v: v.isNotNull() & ~F.isnan(v)
    valid = F.filter(losses, ok)
    bar = F.lit(threshold)
    if rate is not None and 0 < rate < 1:
        k = F.greatest(F.lit(1), F.floor(F.size(valid) * F.lit(rate))).cast("int")
        bar = F.greatest(bar, F.coalesce(F.try_element_at(F.sort_array(valid, False), k), bar))
    return F.transform(losses, lambda v: F.when(ok(v), (v >= bar).cast("double")))


def external_labels(hot: Column, teacher: Column, least_hot: float = 3.0, most_teacher: float = 1.0, margin: float = 1.0) -> Column:
    ok = lambda v: v.isNotNull() & ~F.isnan(v)
    return F.zip_with(hot, teacher, lambda h, t: F.when(ok(h) & ok(t), ((h >= least_hot) & (t <= most_teacher) & (h - t >= margin)).cast("double")).otherwise(F.lit(-1.0)))


def fnv1a(texts: list[str]) -> np.ndarray:
    """64-bit FNV-1a of each text; all step together, byte by byte."""
    raw = [t.encode() for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    order = np.argsort(-size, kind="stable")  # longest first, so that those still at it are a prefix
    flat = np.frombuffer(b"".join(raw[k] for k in order), np.uint8).astype(np.uint64)
    at, left = np.concatenate([[0], np.cumsum(size[order])[:-1]]).astype(np.int64)[: len(raw)], size[order]
    h = np.full(len(raw), 0xCBF29CE484222325, np.uint64)
    for k in range(int(size.max()) if len(size) else 0):
        n = int(np.searchsorted(-left, -k, "left"))  # those longer than k
        h[:n] = (h[:n] ^ flat[at[:n] + k]) * np.uint64(0x100000001B3)
    out = np.empty_like(h)
    out[order] = h
    return out
