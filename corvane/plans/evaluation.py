"""Queries on evaluation items, prompts and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corvane.functions.sampling import uniform
from corvane.operators import batched_runs, benchmarks as bm, chunking, panels, percentiles, scoring
from corvane.operators.synthesis import EchoClient
from corvane.plans.registry import Tables, query, sql_uniform
from corvane.runtime import scratch
from corvane.sources import toolserver


@query("SELECT item_id, 'q' || item_id AS query, upper(left(text, 3)) AS answer FROM benchmark WHERE item_id % 4 = 2")
def sample_lookup(t: Tables) -> DataFrame:
    """The queries of the third of four samples."""
    q = F.struct(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("query"), F.array(F.upper(F.left("text", F.lit(3)))).alias("answers"), "item_id")
    per = t.benchmark.groupBy((F.col("item_id") % 4).alias("s")).agg(F.array_sort(F.collect_list(q)).alias("queries"))
    samples = per.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("s", F.concat(F.lit("c"), F.col("s").cast("string")).alias("context"), "queries"))), lambda x: x).alias("samples"))
    found = bm.sample_queries(samples, 2)
    return found.select(F.substring("query", 2, 10).cast("bigint").alias("item_id"), "query", F.col("answers")[0].alias("answer"))


@query("SELECT conv_id, md5(string_agg(role || ' ' || turn || chr(10) || text || chr(10) || 'end', chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def section_rendering(t: Tables) -> DataFrame:
    name = F.concat("role", F.lit(" "), F.col("turn").cast("string"))
    per = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", name.alias("name"), F.array("text", F.lit("end")).alias("p")))).alias("m"))
    text = bm.render_sections(F.transform("m", lambda x: x["name"]), F.transform("m", lambda x: x["p"]))
    return per.select("conv_id", F.md5(text.cast("binary")).alias("digest"))


@query("SELECT p_partkey, p_name || ': ' || p_brand || ', ' || p_type AS line FROM part")
def word_list_lines(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", bm.word_lines(F.col("p_name"), F.array("p_brand", "p_type")).alias("line"))


@query("SELECT event_id, 'From: u' || user_id || chr(10) || 'To: ' || chr(10) || 'Date: ' || strftime(ts, '%Y-%m-%d') || chr(10) || 'Subject: ' || event_type || chr(10) || chr(10) || props AS mail FROM events")
def mail_format(t: Tables) -> DataFrame:
    mail = bm.mail_text(F.concat(F.lit("u"), F.col("user_id").cast("string")), F.lit(None).cast("string"), F.date_format("ts", "yyyy-MM-dd"), F.col("event_type"), F.col("props"))
    return t.events.select("event_id", mail.alias("mail"))


@query("SELECT md5(string_agg('Item ' || item_id || ': ' || text, chr(10) || chr(10) ORDER BY item_id)) AS digest, sum(length(text))::BIGINT AS n_chars FROM benchmark")
def corpus_string(t: Tables) -> DataFrame:
    text = bm.corpus_text(t.benchmark, ["item_id"], F.concat(F.lit("Item "), F.col("item_id").cast("string"), F.lit(": "), "text"))
    return text.join(t.benchmark.agg(F.sum(F.length("text")).alias("n_chars")), how="cross").select(F.md5(F.col("text").cast("binary")).alias("digest"), "n_chars")  # two single rows


@query(f"SELECT item_id FROM benchmark ORDER BY {sql_uniform(70, 'item_id')}, item_id LIMIT 15")
def question_shuffle(t: Tables) -> DataFrame:
    return bm.first_shuffled(t.benchmark.select("item_id"), "item_id", 70, 15)


@query(f"WITH s AS (SELECT conv_id, turn, {sql_uniform(71, 'conv_id', 'turn')} AS u, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, row_number() OVER (PARTITION BY conv_id ORDER BY {sql_uniform(71, 'conv_id', 'turn')}, turn) AS r FROM conversations) SELECT a.conv_id, a.turn, row_number() OVER (ORDER BY b.u, a.conv_id, a.turn) - 1 AS place FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.p = b.r")
def random_interleave(t: Tables) -> DataFrame:
    return bm.interleave(t.conversations.select("conv_id", "turn"), "conv_id", "turn", ["conv_id", "turn"], 71)


@query("SELECT doc_id, 'quality_score' AS metric, quality::DOUBLE AS value FROM labels UNION ALL SELECT doc_id, 'score', toxic::DOUBLE FROM labels")
def result_assembly(t: Tables) -> DataFrame:
    scores = F.create_map(F.lit("quality"), F.col("quality").cast("double"), F.lit(""), F.col("toxic").cast("double"))
    return bm.result_rows(t.labels, scores).select("doc_id", "metric", "value")


@query("SELECT s_nationkey, 'def m' || s_nationkey || '(x):' || chr(10) || string_agg('    if x == ''' || s_suppkey || ''':' || chr(10) || '        return ''v' || s_suppkey || '''', chr(10) ORDER BY s_suppkey) AS source FROM supplier GROUP BY s_nationkey")
def code_emission(t: Tables) -> DataFrame:
    per = t.supplier.groupBy("s_nationkey").agg(F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda k: k.cast("string")).alias("k"))
    values = F.transform("k", lambda k: F.concat(F.lit("'v"), k, F.lit("'")))
    return per.select("s_nationkey", bm.method_source(F.concat(F.lit("m"), F.col("s_nationkey").cast("string")), F.col("k"), values).alias("source"))


@query("SELECT n_name, s_name, v AS vocab FROM nation JOIN supplier ON n_nationkey = s_nationkey, (VALUES ('a'), ('b'), ('c')) AS w(v)")
def question_grid(t: Tables) -> DataFrame:
    """Files, their methods, and a vocabulary of three words."""
    pairs = t.nation.join(t.supplier, F.col("n_nationkey") == F.col("s_nationkey"))
    return pairs.select("n_name", "s_name", F.explode(F.array(*(F.lit(v) for v in "abc"))).alias("vocab"))


@query(f"SELECT item_id, CASE WHEN u < 0.5 THEN 'literal' ELSE 'call' END AS kind, CASE WHEN u < 0.5 THEN 'w' || (item_id % 10) END AS literal FROM (SELECT item_id, {sql_uniform(72, 'item_id')} AS u FROM benchmark)")
def method_returns(t: Tables) -> DataFrame:
    """What a generated method returns: a literal or a call."""
    literal = uniform(72, "item_id") < 0.5
    return t.benchmark.select("item_id", F.when(literal, "literal").otherwise("call").alias("kind"), F.when(literal, F.concat(F.lit("w"), (F.col("item_id") % 10).cast("string"))).alias("literal"))


@query()
def generation_eval_mock(t: Tables) -> DataFrame:
    """Items times samples, answered by the stand-in and scored by the cascade."""
    items = scoring.replicate(t.benchmark.select("item_id", F.col("text").alias("prompt")), 3)
    made = bm.generate(items, "item_id", EchoClient).join(t.benchmark, "item_id")
    return made.select("item_id", "sample_idx", "pred", scoring.qa_match(F.col("pred"), F.col("text")).alias("step"), "error")


@query()
def summary_baseline_mock(t: Tables) -> DataFrame:
    """Even chunks of each document, a summary of each by the stand-in, joined in order."""
    words = t.documents.select("doc_id", chunking.words(F.col("text")).alias("w"))
    chunks = chunking.even_chunks(words, "w", 2000, ["doc_id"]).select("doc_id", "chunk_idx", F.array_join("chunk", " ").alias("chunk"))
    return bm.summarize(chunks, "doc_id", "chunk_idx", EchoClient)


@query()
def rewrite_mock(t: Tables) -> DataFrame:
    """Two dependent passes: the question is written anew, then the answer to it."""
    ask = t.benchmark.select("item_id", F.lit(0).alias("sample_idx"), F.concat(F.lit("Rewrite the question: "), "text").alias("prompt"))
    first = bm.generate(ask, "item_id", EchoClient).select("item_id", F.col("pred").alias("question"))
    second = bm.generate(first.select("item_id", F.lit(0).alias("sample_idx"), F.concat(F.lit("Answer: "), "question").alias("prompt")), "item_id", EchoClient)
    return first.join(second.select("item_id", F.col("pred").alias("answer")), "item_id")


@query()
def judge_mock(t: Tables) -> DataFrame:
    """A judge that says CORRECT to every other item; what it leaves open falls to the cascade."""

    class Judge:
        def chat(self, chats):
            return ["CORRECT" if len(c[0]["content"]) % 2 else "unsure" for c in chats]

    asked = t.benchmark.select("item_id", F.lit(0).alias("sample_idx"), F.col("text").alias("prompt"))
    said = bm.generate(asked, "item_id", Judge).join(t.benchmark, "item_id")
    fallback = scoring.qa_match(F.upper("text"), F.col("text")).isin(*scoring.RIGHT)
    return said.select("item_id", F.coalesce(scoring.judge_verdict(F.col("pred")), fallback).alias("correct"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1")
def batched_days(t: Tables) -> DataFrame:
    """Every day's summary as a batch of one run, written under its own name."""
    path = scratch(t.spark, "days")
    events = t.events.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id")
    batched_runs.run(events, "day", lambda rows: rows.groupBy("day").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users")), path, together=16)
    return batched_runs.results(t.spark, path, "day").select("day", "n", "n_users")


def _talk_frame(body, n):
    return F.concat(F.lit("Talk "), F.col("conv_id").cast("string"), F.lit(" ("), F.col("first_role"), F.lit(" begins), "), n.cast("string"), F.lit(" parts\n"), panels.tagged(F.lit("talk"), body))


def _talk_part(part, text):
    return panels.tagged(F.concat(F.lit("turn-"), part.cast("string")), text)


def _talks(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.min_by("role", "turn").alias("first_role"))


_FIRST_ROLES = "SELECT conv_id, arg_min(role, turn) AS first_role FROM conversations GROUP BY conv_id"
_TALK = "'Talk ' || conv_id || ' (' || first_role || ' begins), ' || n_parts || ' parts' || chr(10) || '<talk>' || chr(10) || body || chr(10) || '</talk>'"
_TALK_PART = "'<turn-' || turn || '>' || chr(10) || {} || chr(10) || '</turn-' || turn || '>'"


@query(f"""WITH l AS (SELECT conv_id, row_number() OVER (ORDER BY {sql_uniform(51, 'conv_id')}, conv_id) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations)),
d AS (SELECT draw, floor({sql_uniform(52, 'draw')} * n) AS pos, 1 + floor({sql_uniform(53, 'draw')} * 3) AS k FROM (SELECT unnest(range(n)) AS draw, n FROM (SELECT count(DISTINCT conv_id) AS n FROM conversations))),
r AS (SELECT draw, k, conv_id, turn, text, row_number() OVER (PARTITION BY draw ORDER BY {sql_uniform(54, 'draw', 'turn')}, turn) - 1 AS place FROM d JOIN l USING (pos) JOIN conversations USING (conv_id)),
w AS (SELECT *, CASE WHEN length(text) > 40 THEN '... ' || substr(text, floor({sql_uniform(55, 'draw', 'turn')} * (length(text) - 39))::BIGINT + 1, 40) || ' ...' ELSE text END AS shown FROM r WHERE place < k),
g AS (SELECT draw, conv_id, count(*)::INTEGER AS n_parts, string_agg({_TALK_PART.format('shown')}, chr(10) ORDER BY place) AS body FROM w GROUP BY draw, conv_id)
SELECT draw, conv_id, n_parts, md5({_TALK}) AS digest FROM g JOIN ({_FIRST_ROLES}) USING (conv_id)""")
def record_part_draws(t: Tables) -> DataFrame:
    """As many contexts as there are conversations, each of one to three drawn messages of a drawn conversation, long ones cut to a drawn window."""
    talks = _talks(t)
    made = panels.drawn_contexts(talks, t.conversations, "conv_id", "turn", "text", _talk_part, _talk_frame, talks.count(), 51, 1, 3, max_chars=40)
    return made.select("draw", "conv_id", "n_parts", F.md5(F.col("context").cast("binary")).alias("digest"))


@query(f"SELECT conv_id, n_parts, md5({_TALK}) AS digest FROM (SELECT conv_id, count(*)::INTEGER AS n_parts, string_agg({_TALK_PART.format('text')}, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id) JOIN ({_FIRST_ROLES}) USING (conv_id)")
def record_contexts(t: Tables) -> DataFrame:
    made = panels.whole_contexts(_talks(t), t.conversations, "conv_id", "turn", "text", _talk_part, _talk_frame)
    return made.select("conv_id", "n_parts", F.md5(F.col("context").cast("binary")).alias("digest"))


@query("SELECT item_id, CASE item_id % 4 WHEN 0 THEN replace(text, ' ', '-') WHEN 1 THEN length(text)::VARCHAR END AS response, CASE item_id % 4 WHEN 2 THEN 'not an allowed tool' WHEN 3 THEN 'missing argument: text' END AS error FROM benchmark")
def tool_server_calls(t: Tables) -> DataFrame:
    """Calls of a server of which two tools are allowed."""
    server = toolserver.ToolServer(toolserver.TextServer, ("dashed", "count"))
    kind = F.col("item_id") % 4
    tool = F.when(kind == 0, "dashed").when(kind == 2, "drop").otherwise("count")
    arguments = F.to_json(F.struct(F.when(kind != 3, F.col("text")).alias("text")))
    return toolserver.call_tools(t.benchmark.select("item_id", tool.alias("tool"), arguments.alias("arguments")), server).select("item_id", "response", "error")


@query("SELECT l_returnflag, l_linestatus, n, round(q[1], 6) AS low, round(q[2], 6) AS p50, round(q[3], 6) AS p90, round(q[4], 6) AS p99, round(q[5], 6) AS high FROM (SELECT l_returnflag, l_linestatus, count(*) AS n, quantile_cont(l_extendedprice::DOUBLE, [0, 0.5, 0.9, 0.99, 1]) AS q FROM lineitem GROUP BY ALL)")
def grouped_percentiles(t: Tables) -> DataFrame:
    found = percentiles.exact_percentiles(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice", [0, 0.5, 0.9, 0.99, 1], accuracy=500)
    return found.select("l_returnflag", "l_linestatus", "n", *(F.round(F.col("percentiles")[i], 6).alias(c) for i, c in enumerate(("low", "p50", "p90", "p99", "high"))))
