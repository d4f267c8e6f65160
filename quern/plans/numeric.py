"""Kernels, tokens, quotas and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import dedup, quota, retrieval, tokens
from . import derived
from .common import Fixture, table
from .registry import query

_VEC = "v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"
_r = lambda x, n=6: F.transform(x, lambda v: F.round(v, n))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))


_Q4 = "greatest(-8.0::DOUBLE, least(7.0::DOUBLE, round_even(x / s, 0)))::INT + 8"


@query("int4_quantize", f"""WITH {_VEC}, q AS (SELECT vec_id, e, greatest(list_max(list_transform(e, lambda x: abs(x))), 1e-8::DOUBLE) / 7 AS s FROM v),
c AS (SELECT vec_id, s, list_transform(e, lambda x: {_Q4}) AS codes FROM q)
SELECT vec_id, round(s, 9) AS scale, array_to_string(list_transform(range(0, (len(codes) + 1) // 2), lambda k: codes[2 * k + 1] + coalesce(codes[2 * k + 2], 0) * 16), ',') AS packed,
  array_to_string(list_transform(codes, lambda c: round((c - 8) * s, 6)::VARCHAR), ',') <> '' AS restored FROM c""")
def int4_quantize(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumn("s", A.int4_scale(F.col("e"))).withColumn("codes", A.int4_codes(F.col("e"), F.col("s")))
    packed = v.withColumn("packed", A.pack_nibbles(F.col("codes")))
    same = A.unpack_nibbles(F.col("packed"), F.size("codes")) == F.col("codes")
    return packed.select("vec_id", F.round("s", 9).alias("scale"), F.array_join("packed", ",").alias("packed"), same.alias("restored"))


@query("int8_quantize", f"""WITH {_VEC}, q AS (SELECT vec_id, e, greatest(list_max(list_transform(e, lambda x: abs(x))), 1e-8::DOUBLE) / 127 AS s FROM v)
SELECT vec_id, round(s, 9) AS scale, array_to_string(list_transform(e, lambda x: greatest(-127.0::DOUBLE, least(127.0::DOUBLE, round_even(x / s, 0)))::INT), ',') AS codes FROM q""")
def int8_quantize(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumn("s", A.int8_scale(F.col("e")))
    return v.select("vec_id", F.round("s", 9).alias("scale"), F.array_join(A.int8_codes(F.col("e"), F.col("s")), ",").alias("codes"))


@query("topk_softmax", f"""WITH {_VEC}, q AS (SELECT vec_id, e, list_sort(e, 'DESC')[4] AS bar, list_max(e) AS top FROM v),
m AS (SELECT *, list_sum(list_transform(list_filter(e, lambda x: x >= bar), lambda x: exp(x - top))) AS mass FROM q)
SELECT vec_id, list_transform(e, lambda x: CASE WHEN x >= bar THEN round(exp(x - top) / mass, 6) ELSE 0.0::DOUBLE END) AS p FROM m""")
def topk_softmax(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", _r(A.topk_softmax(F.col("e"), 4)).alias("p"))


@query("entropy", f"""WITH {_VEC}, x AS (SELECT vec_id, list_transform(e, lambda x: exp(x - list_max(e))) AS z FROM v), p AS (SELECT vec_id, list_transform(z, lambda x: x / list_sum(z)) AS p FROM x)
SELECT vec_id, round(greatest(0, least(1, -list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)) / ln(greatest(len(p), 2)))), 6) AS h FROM p""")
def entropy(spark, sf_dir):
    return _vectors(spark, sf_dir).withColumn("p", A.softmax(F.col("e"))).select("vec_id", F.round(A.normalized_entropy(F.col("p")), 6).alias("h"))


@query("ema_window", f"WITH {_VEC} SELECT vec_id, round(coalesce(list_sum(list_transform(range(1, len(e) - 1), lambda k: e[k] * 0.5::DOUBLE * pow(0.5::DOUBLE, len(e) - 2 - k))), 0), 6) AS summary, round(list_sum(e[greatest(len(e) - 1, 1):len(e)]) / least(len(e), 2), 6) AS kept FROM v")
def ema_window(spark, sf_dir):
    """Of vectors of any length, the mean of the last two values and the EMA of those before."""
    kept = F.slice("e", F.greatest(F.size("e") - 1, F.lit(1)), F.lit(2))
    return _vectors(spark, sf_dir).select("vec_id", F.round(A.ema_of_evicted(F.col("e"), 2, 0.5), 6).alias("summary"), F.round(F.try_divide(A.total(kept), F.size(kept)), 6).alias("kept"))


@query("masked_mean", f"WITH {_VEC} SELECT vec_id, round(coalesce(list_sum(list_filter(e, lambda x: x > 0)), 0) / greatest(len(list_filter(e, lambda x: x > 0)), 1), 6) AS m, greatest(len(list_filter(e, lambda x: 1 / (1 + exp(-x)) >= 0.5)), 1) AS ranks FROM v")
def masked_mean(spark, sf_dir):
    e = F.col("e")
    return _vectors(spark, sf_dir).select("vec_id", F.round(A.masked_mean(e, F.transform(e, lambda x: (x > 0).cast("double"))), 6).alias("m"), A.active_ranks(e).alias("ranks"))


@query("tail_mean", f"WITH {_VEC} SELECT vec_id, round(list_avg(e[greatest(len(e) - 15, 1):len(e)]), 6) AS m FROM v")
def tail_mean(spark, sf_dir):
    tail = F.slice("e", F.greatest(F.size("e") - 15, F.lit(1)), F.lit(16))
    return _vectors(spark, sf_dir).select("vec_id", F.round(A.total(tail) / F.size(tail), 6).alias("m"))


@query("mean_pool", """WITH x AS (SELECT label, embedding, generate_subscripts(embedding, 1) AS k FROM embeddings) SELECT label, k::INT AS pos, round(avg(embedding[k]::DOUBLE), 6) AS m FROM x GROUP BY 1, 2""")
def mean_pool(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"))
    return x.groupBy("label", (F.col("pos") + 1).alias("pos")).agg(F.round(F.avg("x"), 6).alias("m"))


@query("magnitude_mask", "SELECT vec_id, sum(k) AS places FROM (SELECT vec_id, k, row_number() OVER (PARTITION BY vec_id ORDER BY abs(embedding[k]) DESC, k) AS r FROM (SELECT *, generate_subscripts(embedding, 1) AS k FROM embeddings)) WHERE r <= 16 GROUP BY vec_id")
def magnitude_mask(spark, sf_dir):
    ranked = F.slice(F.array_sort(F.transform("embedding", lambda x, k: F.struct((-F.abs(x)).alias("m"), (k + 1).alias("k")))), 1, 16)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.aggregate(ranked, F.lit(0).cast("long"), lambda s, r: s + r["k"]).alias("places"))


_CONF = Fixture.over(derived.confidences, "id long, conf array<double>, load double", ["BIGINT", "DOUBLE[]", "DOUBLE"], [(1, [0.9, 0.8, 0.7, 0.2, 0.9], 0.0), (2, [0.9, 0.8, 0.7, 0.2, 0.9], 1.0), (3, [0.1, 0.1], 0.5), (4, [1.5, 1.0, 0.99, 0.98], 0.2), (5, [0.5, -1.0, 0.5], 0.0)])


@query("verify_schedule", f"""WITH RECURSIVE {_CONF.sql('fx')}, s AS (SELECT id, conf, load, 1 AS k, greatest(0, least(1, conf[1])) AS p FROM fx UNION ALL SELECT id, conf, load, k + 1, p * greatest(0, least(1, conf[k + 1])) FROM s WHERE k < len(conf))
SELECT id, greatest(1, least(any_value(len(conf)) - 1, count(*) FILTER (p >= 0.2::DOUBLE + 0.6::DOUBLE * load))) AS n FROM s GROUP BY id""")
def verify_schedule(spark, sf_dir):
    return _CONF.frame(spark, sf_dir).select("id", A.verify_length(F.col("conf"), F.col("load"), 0.2, 0.8).cast("long").alias("n"))


_DRAFT = Fixture.over(derived.drafts, "id long, draft array<int>, target array<int>", ["BIGINT", "INTEGER[]", "INTEGER[]"], [(1, [5, 6, 7], [5, 6, 7]), (2, [5, 6, 7], [5, 9, 7]), (3, [1, 2], [3, 2]), (4, [4, 4, 4, 4], [4, 4, 4, 5])])


@query("accept_prefix", f"WITH {_DRAFT.sql('fx')} SELECT id, coalesce(list_min(list_filter(range(1, len(draft) + 1), lambda k: draft[k] <> target[k])) - 1, len(draft)) AS n FROM fx")
def accept_prefix(spark, sf_dir):
    return _DRAFT.frame(spark, sf_dir).select("id", A.accepted_prefix(F.col("draft"), F.col("target")).alias("n"))


_UNITS = Fixture.over(derived.units, "layer int, kind string, idx int, logit double, active boolean", ["INTEGER", "VARCHAR", "INTEGER", "DOUBLE", "BOOLEAN"], [(la, k, i, float((la * 7 + i * 5 + (3 if k == "ffn" else 0)) % 11) / 4 + la * 0.01 + i * 0.001, (la + i) % 4 != 0) for la in range(6) for k in ("head", "ffn") for i in range(5)])


@query("routing_topk", f"""WITH {_UNITS.sql('fx')}, live AS (SELECT * FROM fx WHERE active), kinds AS (SELECT layer, kind, avg(logit) AS m FROM live GROUP BY ALL), layers AS (SELECT layer, row_number() OVER (ORDER BY max(m) DESC, layer) AS r FROM kinds GROUP BY layer),
picked AS (SELECT u.*, row_number() OVER (PARTITION BY u.layer, kind ORDER BY logit DESC, idx) AS k FROM live u JOIN layers l ON u.layer = l.layer AND l.r <= 3)
SELECT layer, kind, idx, round(exp(logit) / sum(exp(logit)) OVER (), 6) AS weight FROM picked WHERE k <= 2""")
def routing_topk(spark, sf_dir):
    from pyspark.sql import Window

    live = _UNITS.frame(spark, sf_dir).where("active")
    layers = live.groupBy("layer", "kind").agg(F.avg("logit").alias("m")).groupBy("layer").agg(F.max("m").alias("m")).orderBy(F.desc("m"), "layer").limit(3).select("layer")
    picked = dedup.ranked_first(live.join(layers, "layer"), ["layer", "kind"], [F.desc("logit"), F.asc("idx")], 2)
    return picked.select("layer", "kind", "idx", F.round(F.exp("logit") / F.sum(F.exp("logit")).over(Window.partitionBy()), 6).alias("weight"))


# ---- tokens


_HEX = "list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::INT)"


def _encoded(docs):
    d = docs.select("doc_id", tokens.byte_encode(F.coalesce("text", F.lit("")), bos=True, eos=True).alias("ids"))
    return d.select("doc_id", F.size("ids").cast("long").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.element_at("ids", 1).alias("first"), F.element_at("ids", -1).alias("last"))


def _decoded(docs):
    return docs.select("doc_id", F.sha2(tokens.byte_decode(tokens.byte_encode(F.coalesce("text", F.lit("")), bos=True)), 256).alias("sha"))


@query("byte_encode", f"SELECT doc_id, len(ids) AS n, list_sum(list_transform(ids, lambda x: x::BIGINT)) AS total, ids[1] AS first, ids[len(ids)] AS last FROM (SELECT doc_id, [1] || list_transform({_HEX.replace('text', "coalesce(text, '')")}, lambda b: b + 4) || [2] AS ids FROM documents)")
def byte_encode(spark, sf_dir):
    """Every document, at any length; a null text counts as an empty one, as in ``tokens.pack``."""
    d = table(spark, sf_dir, "documents").select("doc_id", tokens.byte_encode(F.coalesce("text", F.lit("")), bos=True, eos=True).alias("ids"))
    return d.select("doc_id", F.size("ids").cast("long").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.element_at("ids", 1).alias("first"), F.element_at("ids", -1).alias("last"))


@query("byte_decode", "SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents")
def byte_decode(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(tokens.byte_decode(tokens.byte_encode(F.coalesce("text", F.lit("")), bos=True)), 256).alias("sha"))


@query("skeleton_encode", f"SELECT doc_id, ([1] || list_transform(({_HEX})[1:30], lambda b: b % 60 + 4) || [2] || list_transform(range(0, 32), lambda k: 0))[1:32] AS ids FROM documents")
def skeleton_encode(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tokens.skeleton_encode(F.col("text"), 64, 32).alias("ids"))


@query("pack_tokens", """WITH b AS (SELECT doc_id, '0A' AS e, hex(encode(text)) AS h FROM documents), s AS (SELECT string_agg(h || e, '' ORDER BY doc_id) AS h FROM b), n AS (SELECT h, length(h) // 2 + 1 AS n FROM s),
c AS (SELECT unnest(range(0, (n - 1) // 4096)) AS chunk, h FROM n)
SELECT chunk, CASE WHEN chunk = 0 THEN md5('01' || h[1 : 4095 * 2]) ELSE md5(h[(chunk * 4096 - 1) * 2 + 1 : (chunk * 4096 + 4095) * 2]) END AS digest FROM c""")
def pack_tokens(spark, sf_dir):
    packed = tokens.pack(table(spark, sf_dir, "documents"), "doc_id", "text", 4096)
    bos = F.when(F.element_at("input_ids", 1) == tokens.BOS, "01").otherwise("")
    return packed.select("chunk", F.md5(F.concat(bos, F.hex(tokens.raw_bytes(F.col("input_ids"))))).alias("digest"))


@query("hard_token_labels", f"""WITH {_VEC}, a AS (SELECT vec_id, list_transform(e, lambda x: abs(x)) AS l FROM v), b AS (SELECT *, greatest(0.1::DOUBLE, list_sort(l, 'DESC')[greatest(1, floor(len(l) * 0.125::DOUBLE))::INT]) AS bar FROM a)
SELECT vec_id, len(list_filter(l, lambda x: x >= bar)) AS positive, len(l) AS valid FROM b""")
def hard_token_labels(spark, sf_dir):
    labels = tokens.hard_labels(F.transform("e", lambda x: F.abs(x)), 0.1, 0.125)
    return _vectors(spark, sf_dir).withColumn("y", labels).select("vec_id", F.size(F.filter("y", lambda v: v == 1)).cast("long").alias("positive"), F.size(F.filter("y", lambda v: v.isNotNull())).cast("long").alias("valid"))


_nan = float("nan")
_LOSS = Fixture.over(derived.losses, "id long, hot array<double>, teacher array<double>", ["BIGINT", "DOUBLE[]", "DOUBLE[]"], [(1, [3.5, 2.0, 4.0, 3.0], [0.5, 0.1, 3.5, 1.0]), (2, [_nan, 5.0], [0.2, 1.0]), (3, [3.0, 3.0], [2.0, _nan])])


@query("external_labels", f"WITH {_LOSS.sql('fx')} SELECT id, list_transform(range(1, len(hot) + 1), lambda k: CASE WHEN isnan(hot[k]) OR isnan(teacher[k]) THEN -1.0::DOUBLE WHEN hot[k] >= 3 AND teacher[k] <= 1 AND hot[k] - teacher[k] >= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS y FROM fx")
def external_labels(spark, sf_dir):
    return _LOSS.frame(spark, sf_dir).select("id", tokens.external_labels(F.col("hot"), F.col("teacher")).alias("y"))


@query("align_supervision", f"WITH {_LOSS.sql('fx')} SELECT id, (list_transform(hot, lambda x: coalesce(nullif(x, 'nan'::DOUBLE), -1)) || [-1.0::DOUBLE, -1.0::DOUBLE, -1.0::DOUBLE])[1:3] AS y FROM fx")
def align_supervision(spark, sf_dir):
    filled = F.transform("hot", lambda x: F.nanvl(x, F.lit(-1.0)))
    return _LOSS.frame(spark, sf_dir).select("id", A.fit_length(filled, F.lit(3), F.lit(-1.0)).alias("y"))


_BATCH = Fixture.over(derived.batches, "batch long, seq long, skeleton array<int>, losses array<double>", ["BIGINT", "BIGINT", "INTEGER[]", "DOUBLE[]"], [(1, 1, [1, 2], [0.5]), (1, 2, [3, 4], None), (2, 1, None, None), (2, 2, [5, 6], None)])


@query("collate_optional", f"""WITH {_BATCH.sql('fx')}, f AS (SELECT *, bool_and(skeleton IS NOT NULL) OVER (PARTITION BY batch) AS all_s, bool_or(losses IS NOT NULL) OVER (PARTITION BY batch) AS any_l FROM fx)
SELECT batch, seq, CASE WHEN all_s THEN skeleton END AS skeleton, CASE WHEN any_l THEN coalesce(losses, [-1.0::DOUBLE]) END AS losses FROM f""")
def collate_optional(spark, sf_dir):
    rows = _BATCH.frame(spark, sf_dir)
    has = rows.groupBy("batch").agg(F.bool_and(F.col("skeleton").isNotNull()).alias("s"), F.bool_or(F.col("losses").isNotNull()).alias("l"))
    return rows.join(has, "batch").select("batch", "seq", F.when(F.col("s"), F.col("skeleton")).alias("skeleton"), F.when(F.col("l"), F.coalesce("losses", F.array(F.lit(-1.0)))).alias("losses"))


# ---- quotas and shards

_SIZED = "d AS (SELECT doc_id AS seq, lang, strlen(text)::BIGINT AS n FROM documents)"


def _sized(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "lang", F.octet_length("text").cast("long").alias("n"))


@query("language_quota", f"""WITH RECURSIVE {_SIZED}, o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY seq) AS k FROM d WHERE lang IN ('de', 'fr')),
f AS (SELECT seq, lang, n, k, CASE WHEN n <= 100000 THEN n ELSE 0 END AS used, n <= 100000 AS fits FROM o WHERE k = 1
  UNION ALL SELECT o.seq, o.lang, o.n, o.k, f.used + CASE WHEN f.used + o.n <= 100000 THEN o.n ELSE 0 END, f.used + o.n <= 100000 FROM f JOIN o ON o.lang = f.lang AND o.k = f.k + 1)
SELECT d.seq, d.lang, CASE WHEN f.seq IS NULL THEN 'language_not_target' WHEN fits THEN '' ELSE 'language_quota_full' END AS verdict FROM d LEFT JOIN f USING (seq)""")
def language_quota(spark, sf_dir):
    return quota.per_language(_sized(spark, sf_dir), {"de": 100_000, "fr": 100_000}).select("seq", "lang", "verdict")


def _quota_sql(total_first: bool) -> str:
    room = lambda lang: f"CASE WHEN o.lang = 'de' THEN f.de WHEN o.lang = 'fr' THEN f.fr END + o.n <= {60000 if lang else 0}"
    fits_lang, fits_all = room(True), "f.spent + o.n <= 100000"
    skip = "'language_not_target'"
    order = f"WHEN NOT ({fits_all}) THEN 'stopped' WHEN o.lang NOT IN ('de', 'fr') THEN {skip} WHEN NOT ({fits_lang}) THEN 'language_quota_full'" if total_first else f"WHEN o.lang NOT IN ('de', 'fr') THEN {skip} WHEN NOT ({fits_lang}) THEN 'language_quota_full' WHEN NOT ({fits_all}) THEN 'stopped'"
    return f"""WITH RECURSIVE {_SIZED}, o AS (SELECT *, row_number() OVER (ORDER BY seq) AS k FROM d),
f AS (SELECT 0::BIGINT AS seq, '' AS lang, 0::BIGINT AS k, 0::BIGINT AS de, 0::BIGINT AS fr, 0::BIGINT AS spent, 'begin' AS verdict
  UNION ALL SELECT seq, lang, k, de + CASE WHEN verdict = '' AND lang = 'de' THEN n ELSE 0 END, fr + CASE WHEN verdict = '' AND lang = 'fr' THEN n ELSE 0 END, spent + CASE WHEN verdict = '' THEN n ELSE 0 END, verdict
  FROM (SELECT o.seq, o.lang, o.k, o.n, f.de, f.fr, f.spent, CASE WHEN f.verdict = 'stopped' THEN 'stopped' {order} ELSE '' END AS verdict FROM f JOIN o ON o.k = f.k + 1))
SELECT seq, lang, verdict FROM f WHERE k > 0"""


@query("language_quota_batch", _quota_sql(True))
def language_quota_batch(spark, sf_dir):
    return quota.with_total(_sized(spark, sf_dir), {"de": 60_000, "fr": 60_000}, 100_000, True).select("seq", "lang", "verdict")


@query("language_quota_stream", _quota_sql(False))
def language_quota_stream(spark, sf_dir):
    return quota.with_total(_sized(spark, sf_dir), {"de": 60_000, "fr": 60_000}, 100_000, False).select("seq", "lang", "verdict")


@query("shard_assignment", f"""WITH RECURSIVE {_SIZED}, o AS (SELECT *, row_number() OVER (ORDER BY seq) AS k FROM d),
f AS (SELECT seq, k, n AS used, 0 AS shard FROM o WHERE k = 1 UNION ALL SELECT o.seq, o.k, CASE WHEN f.used > 0 AND f.used + o.n > 50000 THEN o.n ELSE f.used + o.n END, f.shard + CASE WHEN f.used > 0 AND f.used + o.n > 50000 THEN 1 ELSE 0 END FROM f JOIN o ON o.k = f.k + 1)
SELECT seq, shard FROM f""")
def shard_assignment(spark, sf_dir):
    return quota.shards(_sized(spark, sf_dir), 50_000).select("seq", "shard")


@query("shard_report", f"WITH {_SIZED} SELECT lang, '' AS verdict, count(*) AS records, sum(n)::BIGINT AS bytes FROM d GROUP BY lang")
def shard_report(spark, sf_dir):
    return quota.shard_report(_sized(spark, sf_dir).withColumn("verdict", F.lit("")))


@query("train_valid_split", "WITH n AS (SELECT greatest(least(greatest(1, floor(count(*) * 0.1::DOUBLE)), count(*) - 1), 0) AS k FROM documents) SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '|0'), doc_id) <= (SELECT k FROM n) THEN 'valid' ELSE 'train' END AS part FROM documents")
def train_valid_split(spark, sf_dir):
    return dedup.split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.1)


@query("top_n_accepted", "SELECT doc_id, source FROM documents JOIN labels USING (doc_id) ORDER BY quality DESC, toxic, source, doc_id LIMIT 100")
def top_n_accepted(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.orderBy(F.desc("quality"), "toxic", "source", "doc_id").limit(100).select("doc_id", "source")


# ---- retrieval

_TOKS = lambda t: f"flatten(list_transform(regexp_extract_all(lower(coalesce({t}, '')), '[a-z0-9_]+'), lambda x: CASE WHEN length(x) > 3 AND ends_with(x, 's') THEN [x[1:-2], x] ELSE [x] END))"
_OVERLAP = f"""q AS (SELECT item_id AS query_id, {_TOKS('text')} AS t FROM benchmark), qt AS (SELECT query_id, len(t) AS size, unnest(t) AS tok FROM q), qc AS (SELECT query_id, size, tok, count(*) AS times FROM qt GROUP BY ALL),
dt AS (SELECT DISTINCT doc_id AS id, unnest({_TOKS('text')}) AS tok FROM documents), o AS (SELECT query_id, id, sum(times)::DOUBLE / any_value(size) AS overlap FROM qc JOIN dt USING (tok) GROUP BY query_id, id)"""


def _bench_docs(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


@query("lexical_topk", f"WITH {_OVERLAP} SELECT query_id, id, round(overlap, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(overlap, 6) DESC, id) AS rank FROM o) WHERE rank <= 5")
def lexical_topk(spark, sf_dir):
    return retrieval.lexical(*_bench_docs(spark, sf_dir), 5).select("query_id", "id", "score", "rank")


_FNV = "list_reduce(list_transform(regexp_extract_all(hex(encode(tok)), '..'), lambda x: ('0x' || x)::INT::UHUGEINT), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616, 14695981039346656037::UHUGEINT)"
_DENSE = f"""tk AS (SELECT 'q' AS kind, query_id AS id, unnest(t) AS tok FROM q UNION ALL SELECT 'd', doc_id, unnest({_TOKS('text')}) FROM documents), hh AS (SELECT tok, {_FNV} AS h FROM (SELECT DISTINCT tok FROM tk)),
cl AS (SELECT kind, id, (h % 4294967296 % 128)::INT AS cell, sum(CASE WHEN h >= 9223372036854775808 THEN -1 ELSE 1 END)::DOUBLE AS v FROM tk JOIN hh USING (tok) GROUP BY ALL),
nm AS (SELECT kind, id, sqrt(sum(v * v)) AS n FROM cl GROUP BY ALL), w AS (SELECT kind, id, cell, v / n AS w FROM cl JOIN nm USING (kind, id) WHERE n > 0),
dn AS (SELECT a.id AS query_id, b.id AS id, sum(a.w * b.w) AS dense FROM w a JOIN w b ON a.kind = 'q' AND b.kind = 'd' AND a.cell = b.cell GROUP BY ALL),
al AS (SELECT query_id, doc_id AS id FROM q, documents)"""


@query("hybrid_rank", f"WITH {_OVERLAP}, {_DENSE}, sc AS (SELECT query_id, id, round(0.7::DOUBLE * coalesce(dense, 0) + 0.3::DOUBLE * coalesce(overlap, 0), 6) AS score FROM al LEFT JOIN dn USING (query_id, id) LEFT JOIN o USING (query_id, id)) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 5")
def hybrid_rank(spark, sf_dir):
    return retrieval.hybrid(*_bench_docs(spark, sf_dir), 5)


@query("cosine_topk", "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(qv, embedding::DOUBLE[]), 6) AS score FROM q, embeddings WHERE vec_id <> query_id) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10")
def cosine_topk(spark, sf_dir):
    """The stated query set is every vec_id divisible by 50, which grows with the table; candidates are all rows."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return retrieval.cosine_top(v, v.where("id % 50 = 0"), 10)


_MEM = Fixture.over(derived.memories, "id string, importance double, access_count long, last_access double, payload_bytes long", ["VARCHAR", "DOUBLE", "BIGINT", "DOUBLE", "BIGINT"], [(f"m{k}", 0.5 + (k * 37 % 50) / 100, k * 13 % 7, 1e6 - k * 50_000.0, 100 + k * 29 % 83) for k in range(20)])


@query("memory_write_gate", f"WITH {_MEM.sql('fx')} SELECT id, importance FROM fx WHERE importance > 0.5::DOUBLE")
def memory_write_gate(spark, sf_dir):
    return _MEM.frame(spark, sf_dir).where(F.col("importance") > 0.5).select("id", "importance")


@query("memory_prune_budget", f"""WITH {_MEM.sql('fx')}, s AS (SELECT *, importance * pow(0.995::DOUBLE, (1e6::DOUBLE - last_access) / 86400) + 0.01::DOUBLE * access_count AS score FROM fx),
r AS (SELECT *, row_number() OVER w AS k, coalesce(sum(payload_bytes) OVER (ORDER BY score, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(payload_bytes) OVER () AS total, count(*) OVER () AS n FROM s WINDOW w AS (ORDER BY score, id))
SELECT id, round(score, 6) AS score FROM r WHERE NOT (total - before > 1200 AND k < n)""")
def memory_prune_budget(spark, sf_dir):
    return retrieval.prune_to_budget(_MEM.frame(spark, sf_dir), 1200, 1e6)


@query("knowledge_prune", f"WITH {_MEM.sql('fx')} SELECT id FROM (SELECT id, row_number() OVER (ORDER BY importance, access_count, last_access, id) AS k, count(*) OVER () AS n FROM fx) WHERE k > n - 8")
def knowledge_prune(spark, sf_dir):
    return retrieval.prune_to_count(_MEM.frame(spark, sf_dir), 8, ["importance", "access_count", "last_access"]).select("id")


@query("hra_chunks", """WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, (len(w) + 511) // 512)) AS chunk FROM w)
SELECT doc_id, chunk, (chunk * 512)::BIGINT AS token_start, least((chunk + 1) * 512, len(w))::BIGINT AS token_end, md5(array_to_string(w[chunk * 512 + 1 : (chunk + 1) * 512], ' ')) AS digest FROM c""")
def hra_chunks(spark, sf_dir):
    w = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.split("text", " ").alias("w"))
    c = w.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 512).cast("int"))).alias("chunk"))
    return c.select("doc_id", F.col("chunk").cast("long").alias("chunk"), (F.col("chunk") * 512).cast("long").alias("token_start"), F.least((F.col("chunk") + 1) * 512, F.size("w")).cast("long").alias("token_end"), F.md5(F.array_join(F.slice("w", F.col("chunk") * 512 + 1, F.lit(512)), " ")).alias("digest"))


@query("hra_level2", "WITH w AS (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents) SELECT doc_id, ((n - 1) // 512 // 4 + 1)::BIGINT AS spans FROM w")
def hra_level2(spark, sf_dir):
    chunks = hra_chunks(spark, sf_dir)
    return chunks.groupBy("doc_id").agg(F.count_distinct(F.floor(F.col("token_start") / 2048)).alias("spans"))
