"""Queries that need Python in tasks, a client, or a stream."""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame, functions as F

from corvane.functions import nested, sampling
from corvane.operators import analytics, scoring, synthesis, tables
from corvane.plans.registry import Tables, query, sql_uniform
from corvane.runtime import scratch
from corvane.sources.files import python_imports
from corvane.sources.mail import payload_body
from corvane.streaming import events as stream


@query("SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events")
def json_flatten(t: Tables) -> DataFrame:
    return nested.json_nodes(t.events, "props", ["event_id"]).where("leaf").select("event_id", "path", "value")


_EVENT_NODES = """SELECT event_id, p AS path, CASE p WHEN 'none' THEN 'array' WHEN 'at/what' THEN 'array' WHEN '' THEN 'object' WHEN 'at' THEN 'object' WHEN 'props' THEN 'object' ELSE 'value' END AS kind,
  CASE p WHEN '' THEN '{"at":' || inner_doc || ',"none":[],"props":' || props || '}' WHEN 'at' THEN inner_doc WHEN 'at/user' THEN user_id::VARCHAR WHEN 'at/what' THEN what WHEN 'at/what/0' THEN event_type WHEN 'at/what/1' THEN k WHEN 'none' THEN '[]' WHEN 'props' THEN props ELSE k END AS value,
  p NOT IN ('', 'at', 'at/what', 'props') AS leaf
FROM (SELECT *, '{"user":' || user_id || ',"what":' || what || '}' AS inner_doc, '{"k":' || k || '}' AS props FROM (SELECT event_id, user_id, event_type, json_extract_string(props, '$.k') AS k, '["' || event_type || '",' || json_extract_string(props, '$.k') || ']' AS what FROM events)),
  (VALUES (''), ('at'), ('at/user'), ('at/what'), ('at/what/0'), ('at/what/1'), ('none'), ('props'), ('props/k')) AS v(p)"""


def _event_documents(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    what = F.concat(F.lit('["'), "event_type", F.lit('",'), k.cast("string"), F.lit("]"))
    events = t.events.repartition("event_id")  # walking a document costs far more than moving it, and few row groups would be few tasks
    return events.select("event_id", F.concat(F.lit('{"props": '), "props", F.lit(', "none": [], "at": {"user": '), F.col("user_id").cast("string"), F.lit(', "what": '), what, F.lit("}}")).alias("doc"))


@query(_EVENT_NODES)
def json_all_nodes(t: Tables) -> DataFrame:
    return nested.json_nodes(_event_documents(t), "doc", ["event_id"])


@query(f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY path) - 1 AS place, count(*) OVER (PARTITION BY event_id) AS n FROM ({_EVENT_NODES})),
d AS (SELECT event_id, draw::INTEGER AS draw FROM events, range(3) AS r(draw))
SELECT event_id, draw, path, 'The following is located at ' || path || ': ' || value AS context FROM n JOIN d USING (event_id) WHERE place = floor({sql_uniform(31, 'event_id', 'draw')} * n)""")
def json_subtree_draws(t: Tables) -> DataFrame:
    """Contexts from subtrees of JSON documents."""
    drawn = nested.draw_nodes(_event_documents(t), "doc", ["event_id"], 31, draws=3)
    return drawn.select("event_id", "draw", "path", F.concat(F.lit("The following is located at "), "path", F.lit(": "), "value").alias("context"))


@query("SELECT event_id, p AS path, CASE p WHEN '' THEN '{\"a\": [1, {\"k\": ' || k || '}]}' WHEN 'a' THEN '[1, {\"k\": ' || k || '}]' WHEN 'a/0' THEN '1' WHEN 'a/1' THEN '{\"k\": ' || k || '}' ELSE k END AS value FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events), (VALUES (''), ('a'), ('a/0'), ('a/1'), ('a/1/k')) AS v(p)")
def json_flatten_containers(t: Tables) -> DataFrame:
    doc = t.events.select("event_id", F.concat(F.lit('{"a": [1, '), "props", F.lit("]}")).alias("doc"))
    return nested.flatten_json(doc, "doc", ["event_id"], containers=True)


@query("SELECT event_id, '{\"a\": {\"b\": [' || event_id || ', \"x\"]}}' AS nested FROM events")
def json_unflatten(t: Tables) -> DataFrame:
    flat = F.concat(F.lit('{"a.b.0": '), F.col("event_id").cast("string"), F.lit(', "a.b.1": "x", "a.c": null}'))
    return t.events.select("event_id", nested.unflatten_json(flat).alias("nested"))


@query()
def fuzzy_choice(t: Tables) -> DataFrame:
    """The option most like a garbled answer."""
    options = F.array(F.substring("text", F.lit(20), F.length("text")), F.col("text"), F.reverse("text"))
    said = F.concat(F.lit("<answer>"), F.translate("text", "e", "3"), F.lit("</answer>"))
    rows = t.benchmark.select("item_id", options.alias("options"), said.alias("said"), F.col("text").alias("right"))
    return rows.select("item_id", scoring.multiple_choice(F.col("said"), F.col("options"), F.col("right")).alias("correct"))


@query("SELECT p_partkey, 'json' || CASE WHEN p_partkey % 2 = 0 THEN ',os' ELSE '' END AS imports FROM part")
def ast_imports(t: Tables) -> DataFrame:
    source = F.concat(F.lit("import json\nfrom . import x\n"), F.when(F.col("p_partkey") % 2 == 0, "from os.path import join\n").otherwise(""))
    return t.part.select("p_partkey", F.array_join(python_imports(source), ",").alias("imports"))


@query("SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS body FROM benchmark")
def mime_body(t: Tables) -> DataFrame:
    """The text of a nested message: the longer of two parts."""
    data = F.translate(F.base64(F.col("text").cast("binary")), "+/\r\n", "-_")
    part = lambda kind, d: F.concat(F.lit('{"mimeType": "' + kind + '", "body": {"data": "'), d, F.lit('"}}'))
    payload = F.concat(F.lit('{"mimeType": "multipart/mixed", "parts": ['), part("text/html", F.lit(base64.urlsafe_b64encode(b"<p>hi</p>").decode())), F.lit(", "), part("text/plain", data), F.lit("]}"))
    return t.benchmark.select("item_id", payload_body(payload).alias("body"))


@query()
def synth_rollout_mock(t: Tables) -> DataFrame:
    """Two parties, one round, about each benchmark item, with a stand-in for the model."""
    prompts = synthesis.draw_seed_prompts(t.benchmark, "item_id", 1, 50).join(t.benchmark, "item_id").select("item_id", F.col("text").alias("context"), "prompt")
    return synthesis.rollout(prompts, "item_id", synthesis.EchoClient)


@query("SELECT doc_id AS idx, CASE doc_id % 3 WHEN 0 THEN 'upper' WHEN 1 THEN 'size' ELSE 'broken' END AS tool, doc_id % 3 <> 2 AS success, CASE doc_id % 3 WHEN 0 THEN upper(lang) WHEN 1 THEN length(lang)::VARCHAR END AS response FROM documents")
def tool_scatter_gather_mock(t: Tables) -> DataFrame:
    def broken(inputs):
        raise RuntimeError("down")

    tools = {"upper": lambda xs: [x.upper() for x in xs], "size": lambda xs: [str(len(x)) for x in xs], "broken": broken}
    requests = t.documents.select(F.col("doc_id").alias("idx"), F.when(F.col("doc_id") % 3 == 0, "upper").when(F.col("doc_id") % 3 == 1, "size").otherwise("broken").alias("tool"), F.col("lang").alias("input"))
    return synthesis.run_tools(requests, tools).select("idx", "tool", "success", "response")


@query("SELECT conv_id, len(x)::BIGINT AS n_messages, x[1] AS message_0, x[2] AS message_1 FROM (SELECT conv_id, list(text ORDER BY turn) AS x FROM conversations GROUP BY conv_id)")
def conversation_preview(t: Tables) -> DataFrame:
    """Messages as columns of a preview."""
    from corvane.operators.conversations import nest
    from corvane.sources.conversations import preview

    p = preview(nest(t.conversations), "conv_id", "messages", rows=None, width=2)
    return p.withColumn("n_messages", F.col("n_messages").cast("bigint"))


@query("SELECT i::INTEGER AS line_no, line FROM (VALUES (0, '\\begin{tabular}{lrr}'), (1, '\\toprule'), (2, 'flag & O & F \\\\'), (3, '\\midrule'), (7, '\\bottomrule'), (8, '\\end{tabular}')) AS v(i, line) UNION ALL SELECT (3 + row_number() OVER (ORDER BY CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END))::INTEGER, l_returnflag || ' & ' || coalesce(printf('%.2f', avg(l_quantity) FILTER (l_linestatus = 'O')), '--') || ' & ' || coalesce(printf('%.2f', avg(l_quantity) FILTER (l_linestatus = 'F')), '--') || ' \\\\' FROM lineitem GROUP BY l_returnflag")
def latex_table(t: Tables) -> DataFrame:
    pivot = analytics.pivot_mean(t.lineitem.withColumnRenamed("l_returnflag", "flag"), ["flag"], "l_linestatus", ["O", "F"], "l_quantity", digits=12)
    return tables.latex(pivot, "flag", ["O", "F"], ["R", "A", "N"])


@query("SELECT p_partkey AS path, CASE WHEN p_partkey % 5 = 0 THEN 'added' WHEN p_partkey % 7 = 0 THEN 'removed' ELSE 'changed' END AS change FROM part WHERE (p_partkey % 5 = 0) <> (p_partkey % 7 = 0) OR (p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 3 = 0)")
def code_diff(t: Tables) -> DataFrame:
    files = t.part.select(F.col("p_partkey").alias("path"), F.col("p_name").alias("digest"))
    new = files.where("path % 7 <> 0").withColumn("digest", F.when(F.col("path") % 3 == 0, "edited").otherwise(F.col("digest")))
    return tables.code_diff(files.where("path % 5 <> 0"), new)


@query("SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_temporal(t: Tables) -> DataFrame:
    """Daily counts of the event stream, which must be those of the table."""
    source = stream.read_stream(t.spark, t.sf_dir, t.events, "events.parquet")
    counted = stream.window_counts(source, "1 day", "2 days", ["event_type"])
    return stream.run_to_table(counted, scratch(t.spark, "stream"), "complete")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(t: Tables) -> DataFrame:
    """Each user and kind of event once, from the stream; the watermark spans the table."""
    source = stream.read_stream(t.spark, t.sf_dir, t.events, "events.parquet")
    once = stream.distinct_events(source, ["user_id", "event_type"], "60 days").select("user_id", "event_type")
    return stream.run_to_table(once, scratch(t.spark, "stream"), "append").drop("epoch")


@query("SELECT user_id, count(*) AS n_sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR ts - p >= INTERVAL '6 hours' GROUP BY user_id")
def session_windows(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("n_sessions"))


@query("SELECT strftime(time_bucket(INTERVAL '1 minute', ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS n, count(*) > 2 AS over FROM events GROUP BY 1".replace("AS over", "AS over_limit"))
def rate_windows(t: Tables) -> DataFrame:
    """Requests a minute against a limit."""
    return t.events.groupBy(F.date_format(F.date_trunc("minute", "ts"), "yyyy-MM-dd HH:mm").alias("minute")).agg(F.count("*").alias("n")).withColumn("over_limit", F.col("n") > 2)


@query("SELECT doc_id, sum(CASE WHEN u < 0.5 THEN 1 ELSE 0 END)::BIGINT AS heads FROM (SELECT doc_id, (('0x' || substr(md5(concat_ws(':', '60', doc_id::VARCHAR, i::VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE) AS u FROM documents, range(8) AS r(i)) GROUP BY doc_id")
def interleave_draws(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    return rows.groupBy("doc_id").agg(F.sum(F.when(sampling.uniform(60, "doc_id", "i") < 0.5, 1).otherwise(0)).alias("heads"))


_TOOL = json.dumps({"type": "object", "properties": {"q": {"type": "string"}, "k": {"type": "integer"}}, "required": ["q"]})


@query("SELECT conv_id, turn, 'q' || turn AS q, CASE WHEN turn % 2 = 0 THEN turn ELSE -1 END AS k FROM conversations")
def tool_inputs(t: Tables) -> DataFrame:
    """Tool inputs read by the schema that the tool declares."""
    schema = synthesis.tool_schema(json.loads(_TOOL))
    text = F.concat(F.lit('{"q": "q'), F.col("turn").cast("string"), F.lit('"'), F.when(F.col("turn") % 2 == 0, F.concat(F.lit(', "k": '), F.col("turn").cast("string"))).otherwise(""), F.lit("}"))
    return t.conversations.select("conv_id", "turn", F.from_json(text, schema).alias("x")).select("conv_id", "turn", "x.q", F.coalesce("x.k", F.lit(-1)).alias("k"))
