"""Queries on token ids, runs, prompts, request windows and stateful streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corvane.functions import arithmetic, sampling
from corvane.operators import benchmarks, chunking, graphs, prompts, runs, temporal, tokens
from corvane.plans.registry import Tables, query, sql_uniform as _U
from corvane.runtime import scratch
from corvane.sources import catalogs, shards
from corvane.streaming import events as stream, stateful




def _join(ids):
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


def _join_entries(entries):
    return F.array_join(F.transform(entries, lambda x: F.concat(x["token_idx"].cast("string"), F.lit(":"), x["token_id"].cast("string"))), ",")


# Messages whose answers think for length % 4 tokens; every fifth turn is cut off while it thinks.
@query("""
WITH m AS (SELECT conv_id, turn::INTEGER AS turn, (length(text) % 4)::INTEGER AS n, length(text)::INTEGER AS size, turn % 5 > 0 AS closed FROM conversations),
r AS (SELECT *, CASE WHEN closed THEN [turn, 151667, 151668, size] ELSE list_concat([turn, 151667], list_transform(range(1, n + 1), lambda x: x::INTEGER), [size]) END AS ids FROM m)
SELECT conv_id, turn, array_to_string(ids, ',') AS ids, array_to_string(list_transform(range(1, len(ids) + 1), lambda i: (i - 1) || ':' || ids[i]), ',') AS entries FROM r""")
def thinking_tokens(t: Tables) -> DataFrame:
    n, size = (F.length("text") % 4).cast("int"), F.length("text").cast("int")
    inside = F.filter(F.sequence(F.lit(0), n), lambda x: x > 0)
    ids = F.concat(F.array(F.col("turn").cast("int"), F.lit(151667)), inside, F.when(F.col("turn") % 5 > 0, F.array(F.lit(151668))).otherwise(F.array().cast("array<int>")), F.array(size))
    rows = t.conversations.select("conv_id", F.col("turn").cast("int").alias("turn"), ids.alias("token_ids"))
    rows = rows.withColumn("logprobs", F.transform("token_ids", lambda x, i: F.struct(i.alias("token_idx"), x.alias("token_id"), (-i).cast("double").alias("logprob"))))
    out = tokens.drop_thinking_tokens(rows)
    return out.select("conv_id", "turn", _join("token_ids").alias("ids"), _join_entries("logprobs").alias("entries"))


# Every second message lacks its end marker.
@query("""
WITH m AS (SELECT conv_id, turn, role, max(turn) OVER (PARTITION BY conv_id) = turn AS last, list_concat([length(text)::INTEGER, turn::INTEGER], CASE WHEN turn % 2 = 0 THEN [151645] ELSE [] END) AS ids FROM conversations),
h AS (SELECT *, CASE role WHEN 'user' THEN [151644, 872, 198] WHEN 'system' THEN [151644, 8948, 198] ELSE [151644, 77091, 198] END AS head FROM m),
x AS (SELECT *, list_concat(head, ids, CASE WHEN last THEN [] WHEN turn % 2 = 0 THEN [198] ELSE [151645, 198] END) AS whole FROM h),
o AS (SELECT *, coalesce(sum(len(whole)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + len(head) AS start FROM x)
SELECT conv_id, md5(string_agg(array_to_string(whole, ','), ',' ORDER BY turn)) AS ids, md5(coalesce(string_agg((start || ':' || ids[1] || ',' || (start + 1) || ':' || ids[2]), ',' ORDER BY turn) FILTER (role = 'assistant'), '')) AS targets FROM o GROUP BY conv_id""")
def stored_elements(t: Tables) -> DataFrame:
    ids = F.concat(F.array(F.length("text"), F.col("turn").cast("int")), F.when(F.col("turn") % 2 == 0, F.array(F.lit(151645))).otherwise(F.array().cast("array<int>")))
    rows = t.conversations.select("conv_id", "turn", "role", ids.alias("token_ids"))
    entries = F.transform(F.slice("token_ids", 1, 2), lambda x, i: F.struct(i.alias("token_idx"), x.alias("token_id"), F.lit(-0.5).alias("logprob")))
    built = tokens.build_stored_elements(rows.withColumn("logprobs", F.when(F.col("role") == "assistant", entries)), "qwen")
    return built.select("conv_id", F.md5(_join("input_ids").cast("binary")).alias("ids"), F.md5(_join_entries("targets").cast("binary")).alias("targets"))


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS message, (turn + 1)::VARCHAR AS role_ids, length(text) || ',' || turn || ',128009' AS token_ids FROM conversations WHERE turn % 7 < 6")
def token_split(t: Tables) -> DataFrame:
    """Streams with a token between messages, and messages without an end."""
    lit = lambda x: F.lit(x).cast("int")
    body = F.array(lit(7), lit(128006), (F.col("turn") + 1).cast("int"), lit(128007), F.length("text"), F.col("turn").cast("int"))
    ids = F.when(F.col("turn") % 7 < 6, F.concat(body, F.array(lit(128009), lit(9)))).otherwise(body)
    rows = t.conversations.select("conv_id", "turn", F.posexplode(ids).alias("i", "token_id")).select("conv_id", (F.col("turn") * 100 + F.col("i")).alias("pos"), "token_id")
    out = tokens.split_messages(rows, key="conv_id")
    return out.select("conv_id", "message", _join("role_ids").alias("role_ids"), _join("token_ids").alias("token_ids"))


@query("""
WITH RECURSIVE l AS (SELECT conv_id, text, least(length(text), 300)::BIGINT AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
f AS (SELECT conv_id, i, n AS used, 1 AS section FROM l WHERE i = 1 UNION ALL
  SELECT l.conv_id, l.i, CASE WHEN used + n + 20 > 1000 THEN n ELSE used + n END, CASE WHEN used + n + 20 > 1000 THEN section + 1 ELSE section END FROM f JOIN l ON l.conv_id = f.conv_id AND l.i = f.i + 1)
SELECT conv_id, section::INTEGER AS section, max(section) OVER (PARTITION BY conv_id)::BIGINT AS n_sections, digest, tokens FROM
(SELECT conv_id, section, md5(string_agg(text, chr(10) ORDER BY i)) AS digest, sum(n)::BIGINT AS tokens FROM f JOIN l USING (conv_id, i) GROUP BY conv_id, section)""")
def section_fill(t: Tables) -> DataFrame:
    lines = t.conversations.select("conv_id", "turn", "text", F.least(F.length("text"), F.lit(300)).alias("n"))
    out = tokens.fill_sections(lines, ["conv_id"], "turn", "text", "n", 1000)
    return out.select("conv_id", "section", "n_sections", F.md5(F.col("content").cast("binary")).alias("digest"), "tokens")


@query("""
SELECT c_custkey, c_mktsegment AS "config.segment", c_nationkey::VARCHAR AS "config.place.nation", CASE WHEN c_custkey % 2 = 0 THEN c_custkey::VARCHAR END AS "summary.score" FROM customer WHERE c_nationkey <= 20 AND c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def wide_runs(t: Tables) -> DataFrame:
    """Customers as runs of nested JSON; a summary that is null in all chosen runs gives no column."""
    config = F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.struct(F.col("c_nationkey").alias("nation")).alias("place")))
    summary = F.to_json(F.struct(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).alias("score"), F.when(F.col("c_nationkey") > 20, 1).alias("never")))
    rows = t.customer.select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("segment"), config.alias("config"), summary.alias("summary"))
    wide = runs.wide_runs(rows, "c_custkey", ["config", "summary"], {"c_nationkey": {"$lte": 20}, "segment": {"$in": ["BUILDING", "MACHINERY"]}})
    return wide.drop("c_nationkey", "segment")


@query("SELECT r_regionkey::BIGINT AS key, r_name AS name, NULL::BIGINT AS region, 'v1' AS artifact_id FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey, 'v2' FROM nation")
def stacked_artifacts(t: Tables) -> DataFrame:
    first = t.region.select(F.col("r_regionkey").cast("bigint").alias("key"), F.col("r_name").alias("name"))
    second = t.nation.select(F.col("n_nationkey").cast("bigint").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("bigint").alias("region"))
    return runs.stacked_tables({"v2": second, "v1": first}).select("key", "name", "region", "artifact_id")


@query("SELECT p_brand, p_partkey, 'v' || p_size AS version FROM part QUALIFY p_size = max(p_size) OVER (PARTITION BY p_brand)")
def artifact_latest(t: Tables) -> DataFrame:
    rows = t.part.select("p_brand", "p_partkey", F.concat(F.lit("v"), F.col("p_size").cast("string")).alias("version"), F.array().cast("array<string>").alias("aliases"))
    return runs.resolve_version(rows, ["p_brand"], "version").drop("aliases")


@query("SELECT o_orderkey, 2 AS page, 10 AS per_page, total, 30 < total AS has_more FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS rn, count(*) OVER () AS total FROM orders) WHERE rn BETWEEN 21 AND 30")
def run_page(t: Tables) -> DataFrame:
    return runs.page_of_runs(t.orders.select("o_orderkey", "o_orderdate"), 2, 10, "o_orderdate", "o_orderkey").select("o_orderkey", "page", "per_page", "total", "has_more")


@query("SELECT user_id, tokens, round(seconds, 3) AS seconds, round(tokens / seconds, 6) AS tokens_per_second FROM (SELECT user_id, sum(length(props))::BIGINT AS tokens, epoch(max(ts + INTERVAL 1 SECOND)) - epoch(min(ts)) AS seconds FROM events GROUP BY user_id)")
def step_throughput(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", F.length("props").alias("n"), F.col("ts").cast("timestamp").alias("begin"), (F.col("ts") + F.expr("INTERVAL 1 SECOND")).cast("timestamp").alias("end"))
    out = runs.step_throughput(rows, ["user_id"], "n", "begin", "end")
    return out.select("user_id", "tokens", F.round("seconds", 3).alias("seconds"), F.round("tokens_per_second", 6).alias("tokens_per_second"))


@query("SELECT l_returnflag AS eval_set, 40::BIGINT AS step, count(*) AS n_targets, round(avg(exp(-l_discount::DOUBLE) * l_tax::DOUBLE), 6) AS loss, round(exp(avg(exp(-l_discount::DOUBLE) * l_tax::DOUBLE)), 6) AS perplexity FROM lineitem GROUP BY l_returnflag")
def loss_eval(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_returnflag", (-F.col("l_discount").cast("double")).alias("teacher"), (-F.col("l_tax").cast("double")).alias("student"))
    out = runs.loss_eval({flag: rows.where(F.col("l_returnflag") == flag) for flag in ("A", "N", "R")}, step=40, every=20)
    return out.select("eval_set", "step", "n_targets", F.round("loss", 6).alias("loss"), F.round("perplexity", 6).alias("perplexity"))


@query()
def training_eval_mock(t: Tables) -> DataFrame:
    """Generation evaluation within training: result rows of two samples an item at a step."""
    from corvane.operators import scoring
    from corvane.operators.synthesis import EchoClient

    items = t.benchmark.select("item_id", F.col("text").alias("prompt"), F.col("text").alias("answer"))
    return runs.generation_eval(items, "item_id", "answer", 2, EchoClient, lambda p, a: scoring.qa_match(p, a).isin(*scoring.RIGHT), step=100)[0]


_KINDS = ("question", "qa", "generic")
_CHOICES = {k: c for k, _, c in prompts.VARIED}


@query(f"""
WITH d AS (SELECT conv_id, draw::INTEGER AS draw, (['question', 'qa', 'generic'])[floor({_U(80, 'conv_id', 'draw')} * 3)::INTEGER + 1] AS kind FROM (SELECT DISTINCT conv_id FROM conversations), range(4) AS r(draw)),
c AS (SELECT *, CASE kind WHEN 'question' THEN {list(_CHOICES['question'])} WHEN 'qa' THEN {list(_CHOICES['qa'])} ELSE {list(_CHOICES['generic'])} END AS choices FROM d)
SELECT conv_id, draw, kind, choices[floor({_U(81, 'conv_id', 'draw')} * len(choices))::INTEGER + 1] AS variant FROM c""")
def varied_prompts(t: Tables) -> DataFrame:
    made = prompts.varied_prompts(t.conversations.select("conv_id").distinct(), "conv_id", _KINDS, 4, 80)
    return made.where(F.contains("prompt", F.col("variant"))).select("conv_id", "draw", "kind", "variant")


@query("""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '') AS w FROM documents)
SELECT item_id, least(coalesce(len(w), 0), 50) AS n_context, coalesce(len(w), 0) > 50 AS cut, md5(coalesce(array_to_string(w[1:50], ' '), '') || CASE WHEN len(w) > 0 THEN chr(10) || chr(10) ELSE '' END || text) AS digest
FROM benchmark LEFT JOIN w ON doc_id = item_id""".replace("least(coalesce(len(w), 0), 50) AS", "least(coalesce(len(w), 0), 50)::INTEGER AS"))
def icl_prompts(t: Tables) -> DataFrame:
    contexts = t.documents.select(F.col("doc_id").alias("item_id"), chunking.words(F.col("text")).alias("w"))
    out = prompts.context_prompts(t.benchmark.select("item_id", "text"), contexts, "item_id", "w", 50, "text")
    return out.select("item_id", "n_context", "cut", F.md5(F.col("prompt").cast("binary")).alias("digest"))


@query("""
SELECT item_id, md5(CASE item_id % 5 WHEN 0 THEN text || chr(10) || chr(10) || 'Options:' || chr(10) || '- yes' || chr(10) || '- no' || chr(10) || chr(10) || 'Give the option as <answer>option</answer>.'
  WHEN 1 THEN text || chr(10) || 'Give all values as: The answers are: a, b.' WHEN 2 THEN 'Translate: ' || text || chr(10) || 'Give the translation only.'
  WHEN 3 THEN 'What does ' || text || ' return? Give the literal only.' ELSE text || chr(10) || 'Answer briefly.' END) AS digest FROM benchmark""")
def item_prompts(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("choice", "list", "translation", "lookup", "short"))), (F.col("item_id") % 5 + 1).cast("int"))
    text = prompts.item_prompts(t.benchmark, kind, question=F.col("text"), options=F.array(F.lit("yes"), F.lit("no")))
    return t.benchmark.select("item_id", F.md5(text.cast("binary")).alias("digest"))


@query("""
SELECT item_id, CASE item_id % 3 WHEN 0 THEN 's1|s2' WHEN 1 THEN 'grass|grass|grass' ELSE 'key 1|key 2|key 3' END AS sentences FROM benchmark""")
def haystack_kinds(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("essay", "noise", "needle"))), (F.col("item_id") % 3 + 1).cast("int"))
    made = prompts.haystack_source(kind, F.array(F.lit("s1"), F.lit("s2")), F.lit("grass"), F.lit("key"), F.lit(3))
    return t.benchmark.select("item_id", F.array_join(made, "|").alias("sentences"))


@query(f"SELECT conv_id, l[1] AS first, l[floor({_U(82, 'conv_id')} * len(l))::INTEGER + 1] AS drawn FROM (SELECT conv_id, list(role || turn ORDER BY turn) AS l FROM conversations GROUP BY conv_id)")
def label_choices(t: Tables) -> DataFrame:
    per = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.col("turn").cast("string")).alias("l")))).alias("x"))
    per = per.select("conv_id", F.transform("x", lambda x: x["l"]).alias("l"))
    return per.select("conv_id", prompts.label_choice(F.col("l"), F.lit(0.0), first=True).alias("first"), prompts.label_choice(F.col("l"), sampling.uniform(82, "conv_id")).alias("drawn"))


@query("SELECT user_id, string_agg(event_type, '|' ORDER BY event_id) AS answers FROM events GROUP BY user_id")
def needle_answers(t: Tables) -> DataFrame:
    return benchmarks.answers_by_key(t.events, ["user_id"], "event_id", "event_type").select("user_id", F.array_join("answers", "|").alias("answers"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT user_id, i, ts, ts AS start FROM e WHERE i = 1 UNION ALL
  SELECT e.user_id, e.i, e.ts, CASE WHEN e.ts - w.start >= INTERVAL 1 DAY THEN e.ts ELSE w.start END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT user_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, greatest(0, count(*) - 2)::BIGINT AS over_limit FROM w GROUP BY user_id, start""")
def request_windows(t: Tables) -> DataFrame:
    """Windows of a day from each user's first request, with two allowed."""
    out = temporal.request_windows(t.events, ["user_id"], "ts", 86_400, 2)
    return out.select("user_id", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n", F.col("over").alias("over_limit"))


@query("SELECT strftime(b - k * INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 12 HOUR, ts) AS b, event_type FROM events), range(2) AS r(k) GROUP BY ALL")
def sliding_windows(t: Tables) -> DataFrame:
    """Windows of a day that begin every twelve hours, over the stream."""
    source = stream.read_stream(t.spark, t.sf_dir, t.events, "events.parquet")
    return stream.run_to_table(stream.sliding_counts(source, "1 day", "12 hours", "2 days", ["event_type"]), scratch(t.spark, "stream"), "complete")


@query("""
WITH o AS (SELECT user_id, event_type, lag(event_type) OVER w AS before, last_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) AS n, count(*) FILTER (before <> event_type) AS changes, any_value(last) AS last FROM o GROUP BY user_id""")
def stream_streaks(t: Tables) -> DataFrame:
    """A stateful operator over the stream; the last state of each user."""
    source = stream.read_stream(t.spark, t.sf_dir, t.events, "events.parquet")
    told = stream.run_to_table(stream.streaks(source, "user_id", "60 days"), scratch(t.spark, "stream"), "update")
    return told.groupBy("user_id").agg(F.max_by(F.struct("n", "changes", "last"), "epoch").alias("s")).select("user_id", "s.n", "s.changes", "s.last")


@query("SELECT 'customer' AS name, count(*) AS rows FROM customer UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'part', count(*) FROM part")
def footer_counts(t: Tables) -> DataFrame:
    """Row counts from the footers of the tables' files."""
    paths = None
    for name in ("customer", "nation", "part"):
        part = getattr(t, name).select(F.col("_metadata.file_path").alias("path"), F.lit(name).alias("name")).distinct()
        paths = part if paths is None else paths.unionByName(part)
    counts = catalogs.footer_counts(t.spark, paths)
    near = paths.withColumn("path", F.regexp_replace("path", "^file:/(?=[^/])", "file:///"))
    return counts.join(near, "path").groupBy("name").agg(F.sum("rows").alias("rows"))


@query(f"""
WITH r AS (SELECT p AS program, m, w AS input FROM range(30) AS a(p), range(5) AS b(m), (VALUES ('x'), ('y'), ('z')) AS c(w)),
k AS (SELECT *, m > 0 AND {_U(90, 'program', 'm', 'input')} < 0.6 AS call FROM r)
SELECT program, 'p' || program || 'm' || m AS method, input, CASE WHEN call THEN 'call' ELSE 'literal' END AS kind, CASE WHEN call THEN 'p' || program || 'm' || floor({_U(91, 'program', 'm', 'input')} * greatest(1, m))::INTEGER END AS target,
  CASE WHEN call THEN (['x', 'y', 'z'])[floor({_U(92, 'program', 'm', 'input')} * 3)::INTEGER + 1] END AS arg, CASE WHEN NOT call THEN (['x', 'y', 'z'])[floor({_U(93, 'program', 'm', 'input')} * 3)::INTEGER + 1] END AS literal FROM k""")
def random_calls(t: Tables) -> DataFrame:
    return graphs.random_calls(t.spark, 30, 5, ["x", "y", "z"], 90)


@query("SELECT p_partkey, (p_size * 2 * 28 * 3072 * 2)::BIGINT AS bytes FROM part")
def hidden_cache_bytes(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", arithmetic.hidden_cache_bytes(F.lit(28), F.lit(3072), F.col("p_size")).cast("bigint").alias("bytes"))


@query("SELECT doc_id, length(text)::BIGINT AS n_chars, (length(text) // 4 + 1)::BIGINT AS n_tokens FROM documents")
def context_sizes(t: Tables) -> DataFrame:
    return temporal.text_sizes(t.documents).select("doc_id", "n_chars", "n_tokens")


@query("SELECT node, level FROM (WITH RECURSIVE e AS (SELECT p_partkey AS node, p_partkey // 2 AS needs FROM part WHERE p_partkey > 0), l(node, level) AS (SELECT 0::BIGINT, 0 UNION ALL SELECT e.node, l.level + 1 FROM e JOIN l ON e.needs = l.node) SELECT 'm' || node AS node, max(level)::INTEGER AS level FROM l GROUP BY ALL) WHERE level <= 2".replace("SELECT node, level FROM (WITH", "SELECT node AS module, level FROM (WITH"))
def level_filter(t: Tables) -> DataFrame:
    """Modules of the first three levels."""
    name = lambda c: F.concat(F.lit("m"), c.cast("string"))
    modules = t.part.select(name(F.col("p_partkey")).alias("module"))
    edges = t.part.where("p_partkey > 0").select(name(F.col("p_partkey")).alias("module"), name(F.expr("p_partkey div 2")).alias("imports"))
    return graphs.module_levels(modules, edges, 2)


@query("""
WITH m AS (SELECT user_id, epoch_us(ts) // 1000 AS ms FROM events WHERE ts IS NOT NULL),
e AS (SELECT user_id, ms, lag(ms) OVER (PARTITION BY user_id ORDER BY ms) AS p FROM m),
s AS (SELECT user_id, ms, sum(CASE WHEN p IS NULL OR ms - p >= 6 * 3600000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms) AS k FROM e),
c AS (SELECT user_id, min(ms) AS first_ms, max(ms) AS last_ms, count(*) AS n FROM s GROUP BY user_id, k)
SELECT c.* FROM c WHERE last_ms + 6 * 3600000 <= (SELECT max(ms) - 2 * 86400000 FROM m)""")
def stream_closed_sessions(t: Tables) -> DataFrame:
    """Sessions that end by a timer when the watermark, two days behind, has passed them by six hours; later ones are still open."""
    source = stream.read_stream(t.spark, t.sf_dir, t.events, "events.parquet")
    with stateful.rocksdb(t.spark):
        return stream.run_to_table(stateful.closed_sessions(source, "user_id", 6 * 3600, "2 days", buckets=8192), scratch(t.spark, "stream"), "append").drop("epoch")


@query("""
WITH v AS (SELECT * FROM documents WHERE doc_id % 3 <> 0)
SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars, 0::BIGINT AS unreadable FROM v GROUP BY lang
UNION ALL SELECT 'unreadable shard', 0, 0, 1""")
def shard_scan(t: Tables) -> DataFrame:
    """The newest version of a catalogue of shards, one of them broken, through the data source."""
    folder = scratch(t.spark, "catalogue")
    shards.write_version(t.documents, folder, 1)
    shards.write_version(t.documents.where("doc_id % 3 <> 0"), folder, 2)
    shards.put_broken(folder, "v2/data/zz-broken.parquet")
    shards.register(t.spark)
    rows = t.spark.read.format("corvane_shards").option("path", folder).load()
    lang = F.when(F.col("error").isNotNull(), F.lit("unreadable shard")).otherwise(F.col("lang")).alias("lang")
    found = F.col("error").isNull()
    return rows.groupBy(lang).agg(F.count_if(found).alias("n"), F.coalesce(F.sum(F.when(found, F.length("text"))), F.lit(0)).cast("bigint").alias("chars"), F.count_if(~found).alias("unreadable"))
