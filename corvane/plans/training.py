"""Queries on packing, log-probabilities and time-ordered batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corvane.functions import arithmetic, dates, sampling
from corvane.operators import analytics, logprobs, packing, temporal
from corvane.plans.registry import Tables, query, sql_uniform

_LENGTH = 8000


def _pack_sql(mode: str) -> str:
    over = "batch" if mode == "truncate" else "batch + 1"
    used = "0" if mode == "truncate" else f"CASE WHEN n > {_LENGTH} THEN 0 ELSE n END"
    # A batch number is given to each element; state after it: next batch number and tokens used.
    following = "batch + 1" if mode == "truncate" else f"CASE WHEN n > {_LENGTH} THEN batch + 2 ELSE batch + 1 END"
    return f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT doc_id, length(text) AS n, row_number() OVER (ORDER BY {sql_uniform(40, 'doc_id')}, doc_id) AS i FROM documents),
s(i, doc_id, own, batch, used) AS (
  SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT
  UNION ALL
  SELECT e.i, e.doc_id,
    CASE WHEN used = 0 AND n > {_LENGTH} THEN batch WHEN used + n > {_LENGTH} THEN {over} ELSE batch END,
    CASE WHEN used = 0 AND n > {_LENGTH} THEN batch + 1 WHEN used + n > {_LENGTH} THEN {following} ELSE batch END,
    CASE WHEN used = 0 AND n > {_LENGTH} THEN 0 WHEN used + n > {_LENGTH} THEN {used} ELSE used + n END
  FROM s JOIN e ON e.i = s.i + 1)
SELECT doc_id, own AS batch FROM s WHERE i > 0"""


def _packed(t: Tables, mode: str) -> DataFrame:
    """Packed in one order over the whole table."""
    return packing.pack(t.documents, sampling.uniform(40, "doc_id"), F.length("text"), "doc_id", _LENGTH, mode)


@query(_pack_sql("pad"))
def pack_pad(t: Tables) -> DataFrame:
    return _packed(t, "pad")


@query(_pack_sql("truncate"))
def pack_truncate(t: Tables) -> DataFrame:
    return _packed(t, "truncate")


_COLLATE = f"""
WITH p AS ({{pack}}), o AS (SELECT doc_id, batch, length(text) AS n, row_number() OVER (ORDER BY {sql_uniform(40, 'doc_id')}, doc_id) AS position FROM p JOIN documents USING (doc_id)),
c AS (SELECT batch, doc_id, n, row_number() OVER w - 1 AS element_id, sum(n) OVER w - n AS "offset" FROM o WINDOW w AS (PARTITION BY batch ORDER BY position ROWS UNBOUNDED PRECEDING))
SELECT batch, doc_id, element_id, "offset"::BIGINT AS "offset", greatest(0, least(n, {_LENGTH} - "offset"))::BIGINT AS kept FROM c"""


@query(_COLLATE.format(pack=_pack_sql("truncate")))
def collate_positions(t: Tables) -> DataFrame:
    sizes = t.documents.select("doc_id", F.length("text").cast("bigint").alias("n_tokens"))
    order = sampling.shuffled(t.documents.select("doc_id"), 40, ["doc_id"])
    return packing.collate(_packed(t, "truncate").join(sizes, "doc_id").join(order, "doc_id"), _LENGTH, "doc_id")


@query("""
WITH r AS (SELECT conv_id AS batch, turn AS element_id, len(string_split(text, ' ')) AS n FROM conversations),
o AS (SELECT *, sum(n) OVER (PARTITION BY batch ORDER BY element_id ROWS UNBOUNDED PRECEDING) - n AS o FROM r),
k AS (SELECT batch, element_id, o, greatest(0, least(n, 512 - o))::BIGINT AS kept FROM o),
u AS (SELECT batch, sum(kept) AS used, sum(element_id * kept) AS e, sum(kept * (kept - 1) // 2) AS p, sum(kept * o + kept * (kept - 1) // 2) AS s FROM k GROUP BY batch)
SELECT batch, 512::BIGINT AS n, e::BIGINT AS element_sum, p::BIGINT AS position_sum, 130816::BIGINT AS pos_sum FROM u""")
def padded_positions(t: Tables) -> DataFrame:
    """Element and position ids of all places of a sequence, summed up."""
    rows = t.conversations.select(F.col("conv_id").alias("batch"), F.col("turn").alias("position"), "turn", F.size(F.split("text", " ")).cast("bigint").alias("n_tokens"))
    places = packing.positions(packing.collate(rows, 512, "turn"), 512)
    return places.groupBy("batch").agg(F.count("*").alias("n"), F.sum("element_id").alias("element_sum"), F.sum("position_id").alias("position_sum"), F.sum("pos").alias("pos_sum"))


@query("""
WITH t AS (SELECT conv_id AS batch, turn AS e, greatest(1, length(text) % 7) AS n FROM conversations)
SELECT batch, (sum(n * (n + 1) // 2) + 3 * sum(n))::BIGINT AS visible FROM t GROUP BY batch""")
def attention_visibility(t: Tables) -> DataFrame:
    """How many (query, key) places attention may see: three cache places, and earlier ones of the same element."""
    n = F.greatest(F.lit(1), F.length("text") % 7)
    tokens = t.conversations.select(F.col("conv_id").alias("batch"), F.col("turn").alias("element_id"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i")).select("batch", "element_id", (F.col("element_id") * 100 + F.col("i")).alias("pos"))
    return packing.visible_pairs(tokens, 3).groupBy("batch").agg(F.count("*").alias("visible"))


# Log-probabilities: none of the tables has them, so both sides derive the same ones by arithmetic.
_K = 5
_DENSE = f"SELECT conv_id AS msg_id, turn::INTEGER AS token_idx, k::INTEGER AS k, ((conv_id * 31 + turn * 7 + k * 13) % 997)::INTEGER AS token_id, -(k + 1) * (1 + (conv_id + turn) % 4) / 4.0::DOUBLE AS logprob FROM conversations, range({_K}) AS r(k)"
_KEPT = f"WITH d AS ({_DENSE}), c AS (SELECT *, sum(exp(logprob)) OVER (PARTITION BY msg_id, token_idx ORDER BY k) AS cum FROM d), s AS (SELECT *, coalesce(min(k) FILTER (cum >= 0.9) OVER (PARTITION BY msg_id, token_idx), 0) AS cut FROM c), kept AS (SELECT msg_id, token_idx, k, token_id, logprob FROM s WHERE k <= cut)"


def _dense(t: Tables) -> DataFrame:
    rows = t.conversations.select(F.col("conv_id").alias("msg_id"), F.col("turn").cast("int").alias("token_idx"), F.explode(F.sequence(F.lit(0), F.lit(_K - 1))).alias("k"))
    return rows.withColumns({"token_id": ((F.col("msg_id") * 31 + F.col("token_idx") * 7 + F.col("k") * 13) % 997).cast("int"), "logprob": -(F.col("k") + 1) * (1 + (F.col("msg_id") + F.col("token_idx")) % 4) / F.lit(4.0)})


@query(_KEPT + " SELECT msg_id, token_idx, k, token_id, logprob FROM kept")
def topp_sparsify(t: Tables) -> DataFrame:
    return logprobs.sparsify(_dense(t), 0.9)


@query(_KEPT + f" SELECT g.msg_id, g.token_idx, g.k, coalesce(token_id, -1) AS token_id, coalesce(logprob, -1000.0)::DOUBLE AS logprob FROM ({_DENSE}) g LEFT JOIN kept USING (msg_id, token_idx, k)".replace("SELECT g.msg_id, g.token_idx, g.k, coalesce(token_id, -1)", "SELECT g.msg_id, g.token_idx, g.k, coalesce(kept.token_id, -1)").replace("coalesce(logprob, -1000.0)", "coalesce(kept.logprob, -1000.0)"))
def densify(t: Tables) -> DataFrame:
    tokens = t.conversations.select(F.col("conv_id").alias("msg_id"), F.col("turn").cast("int").alias("token_idx"))
    return logprobs.densify(logprobs.sparsify(_dense(t), 0.9), tokens, _K)


@query("SELECT conv_id, turn, (length(text) % 6)::BIGINT AS n, array_to_string(list_resize(list_transform(range(length(text) % 6), lambda x: -x), 6, -1000), ',') AS padded FROM conversations")
def pad_rectangular(t: Tables) -> DataFrame:
    from corvane.functions.nested import pad_to

    n = F.length("text") % 6
    ragged = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda x: -x)).otherwise(F.array().cast("array<int>"))
    return t.conversations.select("conv_id", "turn", n.cast("bigint").alias("n"), F.array_join(F.transform(pad_to(ragged, 6, -1000), lambda x: x.cast("string")), ",").alias("padded"))


@query(_KEPT + " SELECT msg_id, n_targets, round(loss, 6) AS loss, round(exp(loss), 6) AS perplexity FROM (SELECT msg_id, count(*) AS n_targets, sum(-exp(logprob) * (logprob - 0.1::DOUBLE)) / count(*) AS loss FROM kept GROUP BY msg_id)")
def sparse_ce_loss(t: Tables) -> DataFrame:
    kept = logprobs.sparsify(_dense(t), 0.9).select("msg_id", F.col("logprob").alias("teacher"), (F.col("logprob") - 0.1).alias("student"))
    return logprobs.perplexity(kept, ["msg_id"]).select("msg_id", "n_targets", F.round("loss", 6).alias("loss"), F.round("perplexity", 6).alias("perplexity"))


@query(_KEPT + """, m AS (SELECT msg_id, count(DISTINCT token_idx) AS n_types, sum(-exp(logprob) * (logprob - 0.1::DOUBLE)) AS loss, count(*) AS n FROM kept GROUP BY msg_id)
SELECT kind, round(sum(loss / 2), 6) AS loss, sum(n // 2)::BIGINT AS n FROM m, (VALUES ('a', 0), ('b', 1), ('c', 2)) AS k(kind, i) WHERE m.msg_id % 3 <> i GROUP BY kind""")
def loss_by_seed_type(t: Tables) -> DataFrame:
    """A packed row's loss split evenly among its seed types, its tokens by integer division."""
    kept = logprobs.sparsify(_dense(t), 0.9)
    per = kept.groupBy("msg_id").agg(F.sum(logprobs.cross_entropy(F.col("logprob"), F.col("logprob") - 0.1)).alias("loss"), F.count("*").alias("n"))
    kinds = F.filter(F.array(*(F.when(F.col("msg_id") % 3 != i, F.lit(k)) for i, k in enumerate("abc"))), lambda k: k.isNotNull())
    rows = per.withColumn("kinds", kinds).select(F.explode("kinds").alias("kind"), (F.col("loss") / F.size("kinds")).alias("loss"), F.expr("n div size(kinds)").alias("n"))
    return rows.groupBy("kind").agg(F.round(F.sum("loss"), 6).alias("loss"), F.sum("n").alias("n"))


@query(_KEPT + " SELECT msg_id, token_idx, count(*) AS n, string_agg(token_id, ',' ORDER BY logprob DESC, token_id) AS ids FROM kept GROUP BY msg_id, token_idx")
def token_alternatives(t: Tables) -> DataFrame:
    g = logprobs.group_alternatives(logprobs.sparsify(_dense(t), 0.9))
    return g.select("msg_id", "token_idx", F.size("alternatives").cast("bigint").alias("n"), F.array_join(F.transform("alternatives", lambda a: a["token_id"].cast("string")), ",").alias("ids"))


@query(f"WITH d AS ({_DENSE}), f AS (SELECT msg_id, token_idx, logprob FROM d WHERE k = 0), tk AS (SELECT conv_id AS msg_id, turn::INTEGER AS token_idx, ((conv_id * 31 + turn * 7 + (turn % 7) * 13) % 997)::INTEGER AS token_id FROM conversations) SELECT tk.msg_id, tk.token_idx, round(greatest(0.1, least(1.0, exp(coalesce(d.logprob, f.logprob)))), 6) AS probability FROM tk LEFT JOIN d USING (msg_id, token_idx, token_id) JOIN f USING (msg_id, token_idx)")
def chosen_probability(t: Tables) -> DataFrame:
    tokens = t.conversations.select(F.col("conv_id").alias("msg_id"), F.col("turn").cast("int").alias("token_idx"), ((F.col("conv_id") * 31 + F.col("turn") * 7 + (F.col("turn") % 7) * 13) % 997).cast("int").alias("token_id"))
    return logprobs.chosen_probability(tokens, _dense(t)).withColumn("probability", F.round("probability", 6))


@query(f"SELECT msg_id, token_idx, k, (token_idx * {_K} + k) // 20 AS row_no, (token_idx * {_K} + k) % 20 AS col_no, round(greatest(-10.0, logprob) / 10 + 1, 6) AS shade FROM ({_DENSE})")
def likelihood_grid(t: Tables) -> DataFrame:
    place = F.col("token_idx") * _K + F.col("k")
    return _dense(t).select("msg_id", "token_idx", "k", F.floor(place / 20).cast("int").alias("row_no"), (place % 20).alias("col_no"), F.round(F.greatest(F.lit(-10.0), F.col("logprob")) / 10 + 1, 6).alias("shade"))


_TB = "SELECT event_id, ts, user_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 250 AS batch_id FROM events WHERE ts IS NOT NULL"


@query(f"SELECT event_id, batch_id FROM ({_TB}) WHERE batch_id < 30")
def temporal_batches(t: Tables) -> DataFrame:
    return temporal.rank_batches(t.events, "ts", "event_id", 250, 30).select("event_id", "batch_id")


@query(f"SELECT batch_id, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS \"end\", md5(string_agg(event_id, ',' ORDER BY ts, event_id)) AS paths, array_to_string(list_sort(list(DISTINCT user_id)), ',') AS users FROM ({_TB}) GROUP BY batch_id")
def batch_metadata(t: Tables) -> DataFrame:
    m = temporal.batch_metadata(temporal.rank_batches(t.events, "ts", "event_id", 250), "ts", "event_id", "user_id")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return m.select("batch_id", "n", text("start"), text("end"), F.md5(joined("paths").cast("binary")).alias("paths"), joined("users").alias("users"))


@query(f"WITH b AS (SELECT DISTINCT batch_id FROM ({_TB})) SELECT a.batch_id, count(b.batch_id) AS n_later, coalesce(sum(b.batch_id), 0)::BIGINT AS sum_later FROM b a LEFT JOIN b ON b.batch_id > a.batch_id GROUP BY a.batch_id")
def future_context(t: Tables) -> DataFrame:
    b = temporal.rank_batches(t.events, "ts", "event_id", 250).select("batch_id").distinct()
    later = temporal.later_batches(b)
    return later.select("batch_id", F.size("later").cast("bigint").alias("n_later"), F.aggregate("later", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("sum_later"))


@query(f"SELECT batch_id, md5(string_agg('EVENT ' || i || '/' || n || ' ' || event_id, chr(10) ORDER BY i)) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY batch_id) AS n FROM ({_TB})) GROUP BY batch_id")
def batch_context(t: Tables) -> DataFrame:
    rows = temporal.numbered(temporal.rank_batches(t.events, "ts", "event_id", 250), ["batch_id"], ["ts", "event_id"])
    piece = F.concat(F.lit("EVENT "), F.col("i").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" "), F.col("event_id").cast("string"))
    return temporal.joined_text(rows, ["batch_id"], ["i"], piece, "\n").select("batch_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT strftime(low, '%Y-%m-%d') || '_to_' || strftime(high, '%Y-%m-%d') AS bucket, strftime(low, '%Y-%m-%d') AS low, strftime(high, '%Y-%m-%d') AS high FROM (SELECT DATE '2024-01-01' + i::INTEGER AS low, least(DATE '2024-01-01' + i::INTEGER + 30, DATE '2024-12-31') AS high FROM range(0, 365, 30) AS r(i))")
def day_buckets(t: Tables) -> DataFrame:
    return dates.day_buckets(t.spark, "2024-01-01", "2024-12-31", 30)


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def month_buckets(t: Tables) -> DataFrame:
    return t.orders.groupBy(dates.month_bucket(F.col("o_orderdate")).alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderkey, strftime(to_timestamp(978307200 + o_orderkey * 1000) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS since_2001, strftime(epoch_ms(o_orderkey * 1000000), '%Y-%m-%dT%H:%M:%S') AS of_millis FROM orders")
def epoch_times(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.date_format(dates.since_2001(F.col("o_orderkey") * 1000), "yyyy-MM-dd HH:mm:ss").alias("since_2001"), dates.iso_of_millis((F.col("o_orderkey") * 1_000_000).cast("string")).alias("of_millis"))


@query("SELECT bucket, CASE WHEN bucket = 'all_time' THEN 365.0::DOUBLE ELSE greatest(0.0::DOUBLE, date_diff('day', split_part(bucket, '_to_', 1)::DATE, DATE '2024-06-30')::DOUBLE) END AS age, bucket <> 'all_time' AND bucket > '2024-03-01' AS recent FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') || '_to_x' AS bucket FROM orders UNION ALL SELECT 'all_time')".replace("split_part(bucket, '_to_', 1)::DATE", "try_cast(split_part(bucket, '_to_', 1) AS DATE)"))
def bucket_ages(t: Tables) -> DataFrame:
    b = t.orders.select(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("_to_x")).alias("bucket")).distinct().unionByName(t.spark.createDataFrame([("all_time",)], "bucket string"))
    age = F.when(F.col("bucket") == "all_time", F.lit(365.0)).otherwise(dates.bucket_age(F.when(F.col("bucket") != "all_time", F.col("bucket")), "2024-06-30"))
    return b.select("bucket", age.alias("age"), dates.more_recent(F.col("bucket"), F.lit("2024-03-01")).alias("recent"))


@query("SELECT event_id, user_id FROM events WHERE event_id % 10 = 0 OR event_id % 7 = 0")
def incremental_diff(t: Tables) -> DataFrame:
    """Rows that a stored copy lacks (every tenth) or holds in an older version (every seventh)."""
    now = t.events.select("event_id", "user_id", F.md5(F.col("props").cast("binary")).alias("version"))
    stored = now.where("event_id % 10 <> 0").withColumn("version", F.when(F.col("event_id") % 7 == 0, "old").otherwise(F.col("version")))
    return analytics.changed(now, stored, "event_id", "version").select("event_id", "user_id")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def upsert_latest(t: Tables) -> DataFrame:
    return analytics.latest(t.events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("SELECT s::INTEGER AS step, round(CASE WHEN s < 100 THEN 0.001::DOUBLE * least(1.0, s / 100.0::DOUBLE) WHEN s > 1000 THEN 0.0001 ELSE 0.0001 + 0.0009::DOUBLE * 0.5 * (1 + cos((s - 100) / 900.0::DOUBLE * pi())) END, 9) AS cosine, round(CASE WHEN s < 100 THEN 0.001::DOUBLE * least(1.0, s / 100.0::DOUBLE) WHEN s > 1000 THEN 0.0001 ELSE 0.001 - 0.0009::DOUBLE * (s - 100) / 900 END, 9) AS linear FROM range(0, 1100, 10) AS r(s)")
def lr_schedule(t: Tables) -> DataFrame:
    s = F.col("step")
    return t.spark.range(0, 1100, 10).select(F.col("id").cast("int").alias("step")).select("step", F.round(arithmetic.cosine_schedule(s, 100, 1000, 1e-3, 1e-4), 9).alias("cosine"), F.round(arithmetic.linear_schedule(s, 100, 1000, 1e-3, 1e-4), 9).alias("linear"))


@query("SELECT model, tokens, layers * kv_heads * head_dim * 4 * tokens AS bytes FROM (VALUES ('3b', 28::BIGINT, 8::BIGINT, 128::BIGINT), ('8b', 32::BIGINT, 8::BIGINT, 128::BIGINT), ('70b', 80::BIGINT, 8::BIGINT, 128::BIGINT)) AS m(model, layers, kv_heads, head_dim), (SELECT unnest([1024, 4096, 131072])::BIGINT AS tokens)")
def kv_cache_bytes(t: Tables) -> DataFrame:
    """Cache sizes of a grid of models and lengths."""
    models = t.spark.createDataFrame([("3b", 28, 8, 128), ("8b", 32, 8, 128), ("70b", 80, 8, 128)], "model string, layers bigint, kv_heads bigint, head_dim bigint")
    grid = models.withColumn("tokens", F.explode(F.array(*(F.lit(n).cast("bigint") for n in (1024, 4096, 131072)))))
    return grid.select("model", "tokens", arithmetic.kv_cache_bytes(F.col("layers"), F.col("kv_heads"), F.col("head_dim"), F.col("tokens")).alias("bytes"))


@query("SELECT o_custkey, 'cache-step' || o_orderkey || '.pt' AS file FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn > 3")
def checkpoint_retention(t: Tables) -> DataFrame:
    files = t.orders.select("o_custkey", F.concat(F.lit("cache-step"), F.col("o_orderkey").cast("string"), F.lit(".pt")).alias("file"))
    return analytics.expired(files, ["o_custkey"], analytics.number_in(F.col("file")), 3)


@query("SELECT o_custkey, 'v' || max(o_orderkey) AS version FROM orders GROUP BY o_custkey")
def latest_version(t: Tables) -> DataFrame:
    v = t.orders.select("o_custkey", F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("version"))
    return v.groupBy("o_custkey").agg(F.max_by("version", F.expr("cast(ltrim('v', version) as bigint)")).alias("version"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE o_orderkey END AS step FROM orders ORDER BY step DESC, o_orderkey LIMIT 50")
def newest_checkpoints(t: Tables) -> DataFrame:
    name = F.when(F.col("o_orderkey") % 10 == 0, "final.pt").otherwise(F.concat(F.lit("step"), F.col("o_orderkey").cast("string"), F.lit(".pt")))
    return t.orders.select("o_orderkey", analytics.number_in(name).alias("step")).orderBy(F.desc("step"), "o_orderkey").limit(50)
