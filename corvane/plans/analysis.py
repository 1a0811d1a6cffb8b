"""Queries on joins, aggregates, scores and tables of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corvane.operators import analytics as an, scoring, temporal
from corvane.plans.registry import Tables, query

# --- joins -------------------------------------------------------------------


@query("SELECT c_custkey, c_name, count(o_orderkey) AS n, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY c_custkey, c_name HAVING count(o_orderkey) >= 10")
def thread_summary(t: Tables) -> DataFrame:
    """Chats of some services with enough messages: a left join, group, having."""
    chats = t.customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    per = chats.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey", "c_name").agg(F.count("o_orderkey").alias("n"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last"))
    return per.where("n >= 10")


@query("SELECT o_custkey, o_orderkey, l_linenumber, s_name, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0 WHERE l_returnflag <> 'N'")
def thread_messages(t: Tables) -> DataFrame:
    """All messages of all chats with their senders in one join, two inner sides and a left one."""
    senders = t.supplier.where("s_acctbal > 0")
    rows = t.lineitem.where("l_returnflag <> 'N'").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.join(senders, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("o_custkey", "o_orderkey", "l_linenumber", "s_name", "l_quantity")


@query("SELECT conv_id, count(DISTINCT role) AS n_roles, count(*) AS n_messages, max(turn) AS last_turn, md5(string_agg(role || '|' || text, '|' ORDER BY turn)) AS content_hash FROM conversations GROUP BY conv_id")
def thread_digest(t: Tables) -> DataFrame:
    joined = temporal.joined_text(t.conversations, ["conv_id"], ["turn"], F.concat("role", F.lit("|"), "text"), "|")
    per = t.conversations.groupBy("conv_id").agg(F.countDistinct("role").alias("n_roles"), F.count("*").alias("n_messages"), F.max("turn").alias("last_turn"))
    return per.join(joined, "conv_id").select("conv_id", "n_roles", "n_messages", "last_turn", F.md5(F.col("text").cast("binary")).alias("content_hash"))


@query("SELECT c_custkey, c_name FROM customer WHERE length(c_name) > 5 AND (contains(c_name, '7') OR contains(c_name, '#00000001')) AND NOT contains(c_name, '99')")
def chat_inclusion(t: Tables) -> DataFrame:
    keep = temporal.chat_included(F.col("c_name"), F.length("c_name"), 6, allow=("7", "#00000001"), deny=("99",))
    return t.customer.where(keep).select("c_custkey", "c_name")


@query("SELECT c_custkey, x LIKE '%chat%' AS group_chat FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'chat' || c_custkey WHEN 1 THEN '+1555' ELSE 'ann' END AS x FROM customer) WHERE x LIKE '%+%' OR x LIKE '%chat%'")
def group_chats(t: Tables) -> DataFrame:
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("chat"), F.col("c_custkey").cast("string"))).when(F.col("c_custkey") % 3 == 1, "+1555").otherwise("ann")
    return t.customer.withColumn("x", name).where(temporal.chat_included(F.col("x"), F.lit(9), 1, single=False)).select("c_custkey", F.contains("x", F.lit("chat")).alias("group_chat"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-12'")
def date_range(t: Tables) -> DataFrame:
    ts = F.col("ts")
    return t.events.where((ts >= F.lit("2024-01-05").cast("timestamp_ntz")) & (ts <= F.lit("2024-01-12").cast("timestamp_ntz"))).select("event_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE coalesce(nullif(l_linenumber % 3, 1), 0) = 0 AND coalesce(CASE WHEN l_returnflag = 'R' THEN 'app' END, '') = ''")
def drop_reactions(t: Tables) -> DataFrame:
    kind, app = F.nullif(F.col("l_linenumber") % 3, F.lit(1)), F.when(F.col("l_returnflag") == "R", "app")
    return t.lineitem.where((F.coalesce(kind, F.lit(0)) == 0) & (F.coalesce(app, F.lit("")) == "")).select("l_orderkey", "l_linenumber")


@query("SELECT conv_id, turn, text AS first_answer FROM conversations WHERE turn % 4 <> 3")
def answerable_first(t: Tables) -> DataFrame:
    """Questions zipped with answers: unanswerable ones left out, the first answer only."""
    zipped = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("m"))
    zipped = zipped.select("conv_id", F.explode(F.arrays_zip(F.transform("m", lambda m: m["turn"]).alias("turn"), F.transform("m", lambda m: F.when(m["turn"] % 4 != 3, F.array(m["text"], F.lit("more")))).alias("answers"))).alias("x"))
    return zipped.where("x.answers IS NOT NULL").select("conv_id", F.col("x.turn").alias("turn"), F.col("x.answers")[0].alias("first_answer"))


@query("SELECT doc_id, b.item_id, length(b.text)::BIGINT AS n FROM (SELECT doc_id, 'qa_' || (doc_id % 50) AS convo FROM documents) d JOIN benchmark b ON split_part(convo, '_', -1)::BIGINT = b.item_id")
def positional_lookup(t: Tables) -> DataFrame:
    """The item that a key's number names."""
    d = t.documents.select("doc_id", F.concat(F.lit("qa_"), (F.col("doc_id") % 50).cast("string")).alias("convo"))
    return d.join(t.benchmark, F.element_at(F.split("convo", "_"), -1).cast("bigint") == F.col("item_id")).select("doc_id", "item_id", F.length("text").cast("bigint").alias("n"))


@query("SELECT doc_id, quality, toxic FROM documents JOIN labels USING (doc_id)")
def key_lookup(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id").select("doc_id", "quality", "toxic")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join(t: Tables) -> DataFrame:
    return t.documents.join(t.labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id", "lang")


@query("SELECT item_id, s::INTEGER AS sample_idx FROM benchmark, range(4) AS r(s)")
def replicate_items(t: Tables) -> DataFrame:
    return scoring.replicate(t.benchmark.select("item_id"), 4)


@query("SELECT r_name, n_name, s AS flag FROM region, nation, (VALUES (true), (false)) AS f(s)")
def parameter_grid(t: Tables) -> DataFrame:
    """A grid of a few named values."""
    return t.region.select("r_name").crossJoin(t.nation.select("n_name")).withColumn("flag", F.explode(F.array(F.lit(True), F.lit(False))))


@query("SELECT conv_id, turn, length(text)::BIGINT AS n, upper(role) AS meta FROM conversations")
def zip_join(t: Tables) -> DataFrame:
    """Parallel lists put together by place, which must be of one length."""
    per = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("a"), F.array_sort(F.collect_list(F.struct("turn", F.upper("role").alias("meta")))).alias("b"))
    same = F.when(F.size("a") == F.size("b"), F.arrays_zip("a", "b")).otherwise(F.raise_error(F.lit("lists of two lengths")))
    return per.select("conv_id", F.explode(same).alias("x")).select("conv_id", "x.a.turn", F.length("x.a.text").cast("bigint").alias("n"), "x.b.meta")


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE lang END AS label FROM documents")
def mapping_default(t: Tables) -> DataFrame:
    names = t.spark.createDataFrame([("en", "English"), ("fr", "French")], "lang string, name string")
    return t.documents.join(F.broadcast(names), "lang", "left").select("doc_id", F.coalesce("name", "lang").alias("label"))


# --- aggregates ---------------------------------------------------------------


@query("SELECT round(avg(o_totalprice), 4) AS mean_price_score, round(avg(o_custkey), 4) AS mean_key_score FROM orders")
def score_means(t: Tables) -> DataFrame:
    r = scoring.mean_scores(t.orders.select(F.col("o_totalprice").alias("price_score"), F.col("o_custkey").alias("key_score"), "o_orderstatus"))
    return r.select(*(F.round(c, 4).alias(c) for c in r.columns))


@query("SELECT source, lang, count(*) AS n, round(avg(quality), 6) AS mean FROM documents JOIN labels USING (doc_id) GROUP BY source, lang")
def slice_means(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source", "lang").join(t.labels, "doc_id").groupBy("source", "lang").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("mean"))


@query("SELECT event_type, step, n, mean, row_number() OVER (PARTITION BY event_type ORDER BY step)::INTEGER AS place FROM (SELECT event_type, event_id // 500 AS step, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL)")
def slice_series(t: Tables) -> DataFrame:
    s = scoring.score_series(t.events.withColumn("step", F.floor(F.col("event_id") / 500)), ["event_type"], "step", "value")
    return s.withColumn("mean", F.round("mean", 6))


@query("SELECT slice, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT 'large' AS slice, value FROM events WHERE value > 50 UNION ALL SELECT 'click', value FROM events WHERE event_type = 'click' UNION ALL SELECT 'even', value FROM events WHERE user_id % 2 = 0) GROUP BY slice")
def named_slices(t: Tables) -> DataFrame:
    return an.slices(t.events, {"large": F.col("value") > 50, "click": F.col("event_type") == "click", "even": F.col("user_id") % 2 == 0}, [F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")])


@query("SELECT DISTINCT user_id, event_type FROM events WHERE value > 90 OR event_type = 'error'")
def slice_union_distinct(t: Tables) -> DataFrame:
    return an.slice_union(t.events.select("user_id", "event_type", "value"), [F.col("value") > 90, F.col("event_type") == "error"]).select("user_id", "event_type").distinct()


@query("SELECT event_type, round(sum(s) / sum(n), 6) AS micro, round(avg(s / n), 6) AS macro FROM (SELECT event_type, user_id, sum(value) AS s, count(value) AS n FROM events GROUP BY ALL) GROUP BY event_type")
def macro_micro_avg(t: Tables) -> DataFrame:
    return an.macro_mean(t.events, "user_id", "value", ["event_type"]).select("event_type", F.round("micro", 6).alias("micro"), F.round("macro", 6).alias("macro"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS rn FROM events WHERE value IS NOT NULL) WHERE rn = 1")
def group_argmax(t: Tables) -> DataFrame:
    return an.arg_best(t.events, ["user_id", "event_type"], "value", ["event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = 'O'), 6) AS O, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 6) AS F FROM lineitem GROUP BY l_returnflag")
def pivot_means(t: Tables) -> DataFrame:
    return an.pivot_mean(t.lineitem, ["l_returnflag"], "l_linestatus", ["O", "F"], "l_quantity")


@query("SELECT l_orderkey, l_linenumber, round((l_quantity + coalesce(x, 0)) / CASE WHEN x IS NULL THEN 1 ELSE 2 END, 6) AS mean FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN l_tax END AS x FROM lineitem)")
def row_avg(t: Tables) -> DataFrame:
    named = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a_score"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax")).alias("b_score"), F.lit(1e9).alias("memorization_score"))
    names = an.select_like(named.columns, "_score$")
    return named.select("l_orderkey", "l_linenumber", F.round(an.row_mean(names), 6).alias("mean"))


@query("SELECT bin, greatest(0.0, bin * 100.0::DOUBLE + 50.0) AS x, round(avg(value), 6) AS mean, round(avg(event_id), 6) AS mean_step FROM (SELECT ceil(event_id / 100.0::DOUBLE)::BIGINT AS bin, * FROM events) GROUP BY bin")
def step_bins(t: Tables) -> DataFrame:
    b = t.events.withColumn("bin", an.step_bin(F.col("event_id"), 100)).groupBy("bin").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg("event_id"), 6).alias("mean_step"))
    return b.withColumn("x", an.bin_center(F.col("bin"), 100))


@query("SELECT user_id, event_id, round(v, 6) AS var, round(s, 6) AS std, round(m, 6) AS mean FROM (SELECT user_id, event_id, count(value) OVER w AS n, var_pop(value) OVER w AS v, stddev_pop(value) OVER w AS s, avg(value) OVER w AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) WHERE n >= 50")
def rolling_loss(t: Tables) -> DataFrame:
    r = an.rolling(t.events, ["user_id"], ["ts", "event_id"], "value", 50)
    return r.select("user_id", "event_id", *(F.round(c, 6).alias(c) for c in ("var", "std", "mean")))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def step_percentiles(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(*(F.round(F.percentile("value", p / 100), 6).alias(f"p{p}") for p in (50, 90, 99)), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT user_id, median(value) AS median FROM events GROUP BY user_id")
def median_scores(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.median("value").alias("median"))


@query("SELECT user_id, event_type AS mode, n FROM (SELECT user_id, event_type, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE rn = 1")
def group_mode(t: Tables) -> DataFrame:
    return an.mode_of(t.events, ["user_id"], "event_type")


@query("SELECT min(value) AS low, max(value) AS high FROM events WHERE event_id % 5 <> 0")
def min_max_without_nan(t: Tables) -> DataFrame:
    x = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    clean = F.when(~F.isnan(x), x)
    return t.events.agg(F.min(clean).alias("low"), F.max(clean).alias("high"))


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def last_write_wins(t: Tables) -> DataFrame:
    return an.last_written(t.events, ["user_id", "event_type"], ["ts", "event_id"], "value")


@query("SELECT lang, source, count(*) AS n, grouping(lang, source) AS level FROM documents GROUP BY ROLLUP (lang, source)".replace("grouping(lang, source)", "grouping(lang) * 2 + grouping(source)"))
def bucket_counts(t: Tables) -> DataFrame:
    return t.documents.rollup("lang", "source").agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("level"))


@query("SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY ALL UNION ALL SELECT 'all', 'all', round(avg(l_extendedprice), 4) FROM lineitem")
def group_means_with_total(t: Tables) -> DataFrame:
    mean = F.round(F.avg("l_extendedprice"), 4).alias("mean")
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(mean).unionByName(t.lineitem.select(F.lit("all").alias("l_returnflag"), F.lit("all").alias("l_linestatus"), "l_extendedprice").groupBy("l_returnflag", "l_linestatus").agg(mean))


@query("SELECT l_returnflag, round(sum(l_extendedprice) / sum(l_quantity), 6) AS nll_per_token FROM lineitem GROUP BY l_returnflag")
def nll_per_token(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 6).alias("nll_per_token"))


@query("SELECT o_orderkey, round(avg(l_quantity), 6) AS mean FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def list_means(t: Tables) -> DataFrame:
    lists = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("scores"))
    return lists.join(t.orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", F.explode("scores").alias("s")).groupBy("o_orderkey").agg(F.round(F.avg("s"), 6).alias("mean"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, round(sum(value) / 86400.0, 6) AS per_second FROM events GROUP BY 1")
def throughput(t: Tables) -> DataFrame:
    return t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.sum("value") / 86400.0, 6).alias("per_second"))


@query("SELECT l_orderkey, l_linenumber, metric, value FROM (SELECT l_orderkey, l_linenumber, 'l_discount' AS metric, l_discount AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem)")
def wide_to_long(t: Tables) -> DataFrame:
    return t.lineitem.unpivot(["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"], "metric", "value")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END, '') AS status, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders")
def fill_nulls(t: Tables) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 6 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    return t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("status"), F.when(~F.isnan(price), price).alias("price")).na.fill("", ["status"])


@query("SELECT r_regionkey, r_name FROM region")
def drop_null_columns(t: Tables) -> DataFrame:
    from corvane.functions.nested import drop_null_columns as drop

    return drop(t.region.withColumn("empty", F.lit(None).cast("string")).withColumn("note", F.lit("x")), also=("note",))


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus IN ('F', 'O') AND o_totalprice >= 100000) OR (regexp_matches(o_orderpriority, '^1-') AND o_custkey <> 5)")
def nested_filters(t: Tables) -> DataFrame:
    f = {"$or": [{"$and": [{"o_orderstatus": {"$in": ["F", "O"]}}, {"o_totalprice": {"$gte": 100_000}}]}, {"o_orderpriority": {"$regex": "^1-"}, "o_custkey": {"$ne": 5}}]}
    return t.orders.where(an.matches(f)).select("o_orderkey")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 2")
def newest_per_run(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t.events.withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("user_id", "event_id")


@query("SELECT event_id, value FROM events WHERE event_id % 3 = 0")
def logged_steps(t: Tables) -> DataFrame:
    """Steps at which a value was logged."""
    return t.events.select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("value")).where("value IS NOT NULL")


@query("SELECT o_orderpriority, count(*) AS n, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '5-LOW' THEN 2 ELSE 3 END::BIGINT AS place FROM orders GROUP BY o_orderpriority")
def explicit_order(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n")).withColumn("place", an.in_order(F.col("o_orderpriority"), ["1-URGENT", "5-LOW"]).cast("bigint"))


# --- set operations -----------------------------------------------------------


@query("SELECT doc_id AS id, 'document' AS kind, lang FROM documents UNION ALL SELECT page_id, 'page', NULL FROM pages UNION ALL SELECT item_id, 'item', NULL FROM benchmark")
def union_widened(t: Tables) -> DataFrame:
    docs = t.documents.select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"), "lang")
    rest = t.pages.select(F.col("page_id").alias("id"), F.lit("page").alias("kind")).unionByName(t.benchmark.select(F.col("item_id").alias("id"), F.lit("item").alias("kind")))
    return docs.unionByName(rest, allowMissingColumns=True)


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def dedup_keys(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query(r"SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY trim(regexp_replace(lower(text), '\s+', ' ', 'g'))")
def dedup_text(t: Tables) -> DataFrame:
    """Keyed by two digests of the normalised text, which move less than the text."""
    from corvane.functions.text import squeeze

    norm = squeeze(F.lower("text"))
    return t.documents.select("doc_id", F.sha2(norm.cast("binary"), 256).alias("h")).groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("h")


@query("SELECT lang, max_by(text, (length(text), -doc_id)) AS longest FROM (SELECT lang, trim(text) AS text, doc_id FROM documents) GROUP BY lang".replace("(length(text), -doc_id)", "length(text) * 1000000000 - doc_id"))
def longest_text(t: Tables) -> DataFrame:
    x = t.documents.select("lang", F.trim("text").alias("text"), "doc_id")
    return x.groupBy("lang").agg(F.max_by("text", F.struct(F.length("text"), -F.col("doc_id"))).alias("longest"))


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 25")
def head_limit(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang").orderBy("doc_id").limit(25)


# --- scores -------------------------------------------------------------------


@query("SELECT o_orderkey, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 6) AS precision, round(tp / 3.0::DOUBLE, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)::DOUBLE) * (tp / 3.0::DOUBLE) / (tp / (tp + fp)::DOUBLE + tp / 3.0::DOUBLE) ELSE 0 END, 6) AS f1 FROM (SELECT o_orderkey, (o_custkey % 4)::INTEGER AS tp, (o_custkey % 3)::INTEGER AS fp, (3 - o_custkey % 4)::INTEGER AS fn FROM orders)")
def set_f1(t: Tables) -> DataFrame:
    k = F.col("o_custkey")
    parts = F.concat(F.slice(F.array(*(F.lit(x) for x in "abc")), F.lit(1), (k % 4).cast("int")), F.slice(F.array(F.lit("x"), F.lit("y")), F.lit(1), (k % 3).cast("int")))
    said = F.concat(F.lit("so <answer>\n"), F.upper(F.array_join(parts, " \n")), F.lit("\n</answer>"))
    s = scoring.set_scores(F.array(*(F.lit(x) for x in "abc")), scoring.tagged_variables(said))
    return t.orders.select("o_orderkey", "o_custkey").select("o_orderkey", *(s[c].cast("int").alias(c) for c in ("tp", "fp", "fn")), *(F.round(s[c], 6).alias(c) for c in ("precision", "recall", "f1")))


_QA = """
WITH q AS (SELECT item_id, lower(trim(text)) AS a, lower(trim(CASE item_id % 5 WHEN 0 THEN text WHEN 1 THEN 'It says: ' || text WHEN 2 THEN left(text, 12) WHEN 3 THEN array_to_string(list_reverse(string_split(text, ' ')), '  ') ELSE 'none' END)) AS p FROM benchmark)
SELECT item_id, CASE WHEN p = a THEN 'exact' WHEN contains(p, a) THEN 'substring' WHEN length(p) > 5 AND contains(a, p) THEN 'reverse_substring'
  WHEN len(list_intersect(list_distinct(list_filter(regexp_split_to_array(p, '\\s+'), lambda x: x <> '')), list_distinct(list_filter(regexp_split_to_array(a, '\\s+'), lambda x: x <> '')))) / len(list_distinct(list_filter(regexp_split_to_array(a, '\\s+'), lambda x: x <> '')))::DOUBLE >= 0.6 THEN 'token_overlap' ELSE 'none' END AS step FROM q"""


@query(_QA)
def qa_fallback_score(t: Tables) -> DataFrame:
    k = F.col("item_id") % 5
    said = F.when(k == 0, F.col("text")).when(k == 1, F.concat(F.lit("It says: "), "text")).when(k == 2, F.left("text", F.lit(12))).when(k == 3, F.array_join(F.reverse(F.split("text", " ")), "  ")).otherwise("none")
    return t.benchmark.select("item_id", scoring.qa_match(said, F.col("text")).alias("step"))


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE NULL END AS verdict FROM conversations")
def judge_verdicts(t: Tables) -> DataFrame:
    k = F.col("turn") % 4
    reply = F.when(k == 0, '{"correct": true, "why": "INCORRECT spelling"}').when(k == 1, "This is Incorrect.").when(k == 2, "correct!").otherwise("no idea")
    return t.conversations.select("conv_id", "turn", scoring.judge_verdict(reply).alias("verdict"))


_CHRF = """
WITH p AS (SELECT item_id, regexp_replace(replace(text, ' the ', ' a ') || ' the', '\\s+', '', 'g') AS h, regexp_replace(text, '\\s+', '', 'g') AS r FROM benchmark),
g AS (SELECT item_id, n, substr(h, i, n) AS g, 1 AS a, 0 AS b FROM p, range(1, 7) AS k(n), unnest(range(1, length(h) - n + 2)) AS u(i) UNION ALL SELECT item_id, n, substr(r, i, n), 0, 1 FROM p, range(1, 7) AS k(n), unnest(range(1, length(r) - n + 2)) AS u(i)),
c AS (SELECT item_id, n, g, sum(a) AS a, sum(b) AS b FROM g GROUP BY ALL),
s AS (SELECT n, sum(least(a, b)) AS m, sum(a) AS h, sum(b) AS r FROM c GROUP BY n), x AS (SELECT avg(m / h::DOUBLE) AS p, avg(m / r::DOUBLE) AS q FROM s)
SELECT round(100 * 5 * p * q / (4 * p + q), 4) AS chrf FROM x"""


@query(_CHRF)
def chrf_corpus(t: Tables) -> DataFrame:
    pairs = t.benchmark.select("item_id", F.concat(F.replace("text", F.lit(" the "), F.lit(" a ")), F.lit(" the")).alias("h"), F.col("text").alias("r"))
    return scoring.chrf(pairs, "h", "r", "item_id").select(F.round("chrf", 4).alias("chrf"))


# --- graphs --------------------------------------------------------------------


@query("""
WITH RECURSIVE e AS (SELECT p_partkey AS node, p_partkey // 2 AS needs FROM part WHERE p_partkey > 0), l(node, level) AS (SELECT 0::BIGINT, 0 UNION ALL SELECT e.node, l.level + 1 FROM e JOIN l ON e.needs = l.node)
SELECT node, max(level)::INTEGER AS level FROM l GROUP BY node""")
def topo_levels(t: Tables) -> DataFrame:
    """Import levels of a graph in which each part needs the one of half its number."""
    from corvane.operators import graphs

    nodes = t.part.select(F.col("p_partkey").alias("node"))
    edges = t.part.where("p_partkey > 0").select(F.col("p_partkey").alias("node"), F.expr("p_partkey div 2").alias("needs"))
    outside = t.part.select(F.col("p_partkey").alias("node"), F.lit(-1).cast("bigint").alias("needs"))  # not in the set
    return graphs.levels(nodes, edges.unionByName(outside))


@query("""
WITH RECURSIVE c AS (SELECT s_suppkey AS m, s_suppkey // 3 AS target FROM supplier), w(start, cur, depth) AS (SELECT m, m, 0 FROM c UNION ALL SELECT w.start, c.target, w.depth + 1 FROM w JOIN c ON c.m = w.cur WHERE w.cur > 0)
SELECT 'm' || start AS start, 'x' AS input, 'lit0' AS literal, depth FROM w WHERE cur = 0""")
def call_chain(t: Tables) -> DataFrame:
    """Where a chain of method calls ends and how deep it is."""
    from corvane.operators import graphs

    k = F.col("s_suppkey")
    name = lambda c: F.concat(F.lit("m"), c.cast("string"))
    calls = t.supplier.select(name(k).alias("method"), F.lit("x").alias("input"), F.when(k == 0, "literal").otherwise("call").alias("kind"), name(F.expr("s_suppkey div 3")).alias("target"), F.lit("x").alias("arg"), F.when(k == 0, "lit0").alias("literal"))
    return graphs.call_chain(t.spark, calls, calls.select("method", "input"))
