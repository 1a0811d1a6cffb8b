"""Queries on conversations and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corvane.functions import arithmetic, text as tx
from corvane.operators import chunking, conversations as cv, packing, scoring, synthesis
from corvane.plans.registry import Tables, query

_SEARCH = "SELECT conv_id, count(*) AS n_turns, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY conv_id HAVING bool_or(contains(lower(text), 'then the'))"


@query(_SEARCH)
def message_search(t: Tables) -> DataFrame:
    return cv.search(t.conversations, "  Then THE ")


@query("SELECT conv_id, count(*) AS n_turns, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY conv_id HAVING bool_or(contains(lower(role), 'assist')) ")
def message_search_other_field(t: Tables) -> DataFrame:
    return cv.search(t.conversations, "assist", in_messages=False, extra=("role",))


@query("SELECT conv_id, 0::BIGINT AS n_turns, 0::BIGINT AS n_chars FROM conversations WHERE false")
def message_search_no_field(t: Tables) -> DataFrame:
    return cv.search(t.conversations, "the", in_messages=False)


@query("SELECT * FROM (SELECT conv_id, count(*) AS n_turns, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY conv_id) ORDER BY n_chars DESC, conv_id LIMIT 20 OFFSET 40")
def message_page(t: Tables) -> DataFrame:
    return cv.page(cv.search(t.conversations, ""), [F.desc("n_chars"), "conv_id"], 2, 20)


@query("SELECT ceil(count(DISTINCT conv_id) / 20.0)::BIGINT AS n_pages, count(DISTINCT conv_id) AS n_rows FROM conversations")
def page_count(t: Tables) -> DataFrame:
    return t.conversations.agg(F.countDistinct("conv_id").alias("n_rows")).select(F.ceil(F.col("n_rows") / 20).alias("n_pages"), "n_rows")


@query("SELECT conv_id, turn, text FROM conversations WHERE conv_id = 7")
def point_lookup(t: Tables) -> DataFrame:
    return t.conversations.where("conv_id = 7").select("conv_id", "turn", "text")


@query("SELECT conv_id, turn, CASE role WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'user' ELSE role END AS role, length(text)::BIGINT AS n_chars FROM conversations")
def role_flip(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", cv.flip_roles(F.col("role")).alias("role"), F.length("text").cast("bigint").alias("n_chars"))


@query("SELECT conv_id, string_agg(role || ':' || length(text), ',' ORDER BY turn) AS shape FROM conversations GROUP BY conv_id")
def message_trim(t: Tables) -> DataFrame:
    trimmed = cv.nest(t.conversations).select("conv_id", cv.trim_messages(F.col("messages")).alias("m"))
    return trimmed.select("conv_id", F.array_join(F.transform("m", lambda m: F.concat(m["role"], F.lit(":"), F.length(m["content"]).cast("string"))), ",").alias("shape"))


@query("SELECT conv_id, question, answer FROM (SELECT conv_id, max_by(text, turn) FILTER (role = 'user') AS question, max_by(text, turn) FILTER (role = 'assistant') AS answer FROM conversations GROUP BY conv_id) WHERE question <> '' AND answer <> ''")
def last_qa_pair(t: Tables) -> DataFrame:
    return cv.last_pairs(t.conversations)


@query("SELECT conv_id, (count(*) - 1)::BIGINT AS n_prompt, max_by(text, turn) AS answer FROM conversations GROUP BY conv_id HAVING count(*) > 1 AND max_by(role, turn) = 'assistant'")
def prompt_answer_split(t: Tables) -> DataFrame:
    return cv.split_prompt(cv.nest(t.conversations)).select("conv_id", F.size("prompt").cast("bigint").alias("n_prompt"), "answer")


@query("SELECT conv_id, count(*) > 1 AND max_by(role, turn) = 'assistant' AS valid FROM conversations GROUP BY conv_id")
def convo_validate(t: Tables) -> DataFrame:
    return cv.nest(t.conversations).select("conv_id", cv.is_valid(F.col("messages")).alias("valid"))


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS turn, role, text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, min(turn) - 1, 'system', 'Be brief.' FROM conversations GROUP BY conv_id)")
def prepend_system(t: Tables) -> DataFrame:
    return cv.prepend_system(t.conversations, "Be brief.")


_EST = "(length(text) // 4 + 1)"


@query(f"""
WITH e AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT conv_id, turn, role, {_EST} AS n FROM conversations)),
p AS (SELECT conv_id, coalesce(sum(before) FILTER (role = 'assistant'), 0)::BIGINT AS prompt_tokens, coalesce(sum(n) FILTER (role = 'assistant'), 0)::BIGINT AS completion_tokens, coalesce(max(before) FILTER (role = 'assistant'), 0)::BIGINT AS new_prompt_tokens FROM e GROUP BY conv_id)
SELECT conv_id, prompt_tokens, completion_tokens, prompt_tokens - new_prompt_tokens AS seen_prompt_tokens, new_prompt_tokens, prompt_tokens + completion_tokens AS total_tokens FROM p""")
def usage_rollup(t: Tables) -> DataFrame:
    return cv.usage(t.conversations, arithmetic.estimate_tokens(F.col("text")))


@query(f"SELECT role, count(*) AS n_messages, sum{_EST}::BIGINT AS n_tokens FROM conversations GROUP BY role")
def token_counts(t: Tables) -> DataFrame:
    return t.conversations.groupBy("role").agg(F.count("*").alias("n_messages"), F.sum(arithmetic.estimate_tokens(F.col("text"))).alias("n_tokens"))


@query(f"SELECT role, sum(c)::BIGINT AS n_tokens FROM (SELECT role, sum{_EST} OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS c FROM conversations) GROUP BY role")
def token_counts_cumulative(t: Tables) -> DataFrame:
    """The older count: at each message the length so far."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return t.conversations.select("role", F.sum(arithmetic.estimate_tokens(F.col("text"))).over(w).alias("c")).groupBy("role").agg(F.sum("c").alias("n_tokens"))


@query(f"SELECT conv_id, (sum({_EST} + 4) + 3)::BIGINT AS chat_tokens FROM conversations GROUP BY conv_id")
def chat_format_tokens(t: Tables) -> DataFrame:
    return cv.chat_tokens(t.conversations, arithmetic.estimate_tokens(F.col("text")), reply_prompt=True)


@query("""
WITH b AS (SELECT conv_id, turn, role, CASE WHEN turn >= 2 THEN text || '!' ELSE text END AS text FROM conversations),
m AS (SELECT a.conv_id, a.turn, CASE WHEN b.text = a.text AND b.role = a.role THEN 1 ELSE 0 END AS same FROM conversations a LEFT JOIN b USING (conv_id, turn)),
s AS (SELECT conv_id, min(same) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS s FROM m)
SELECT conv_id, sum(s)::BIGINT AS common FROM s GROUP BY conv_id""")
def prefix_match(t: Tables) -> DataFrame:
    edited = t.conversations.withColumn("text", F.when(F.col("turn") >= 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return cv.shared_prefix(t.conversations, edited, "conv_id")


@query("SELECT conv_id, string_agg('<div><b>' || role || '</b>: ' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</div>', chr(10) ORDER BY turn) AS html FROM conversations GROUP BY conv_id")
def conversation_html(t: Tables) -> DataFrame:
    return cv.nest(t.conversations).select("conv_id", cv.to_html(F.col("messages")).alias("html"))


_HTML = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?i)<br\\s*/?>', chr(10), 'g'), '(?i)</p>', chr(10) || chr(10), 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("SELECT page_id, " + _HTML.format(x="html") + " AS text FROM pages")
def html_to_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tx.html_to_text(F.col("html")).alias("text"))


@query("SELECT page_id, " + _HTML.format(x="regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g')") + " AS text FROM pages")
def visible_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tx.visible_text(F.col("html")).alias("text"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents")
def ws_normalize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(tx.squeeze(F.col("text")).cast("binary")).alias("digest"))


@query(r"SELECT doc_id, len(x)::BIGINT AS n, array_to_string(x, ',') AS addresses FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS x FROM documents) WHERE len(x) > 0")
def emails_extract(t: Tables) -> DataFrame:
    found = t.documents.select("doc_id", tx.email_addresses(F.col("text")).alias("x")).where(F.size("x") > 0)
    return found.select("doc_id", F.size("x").cast("bigint").alias("n"), F.array_join("x", ",").alias("addresses"))


@query("SELECT page_id, replace(regexp_replace(p, '\\.py$', ''), '/', '.') AS module, replace(replace(regexp_replace(p, '\\.py$', ''), '/', '.'), '.', '/') || '.py' AS path FROM (SELECT page_id, 'pkg/' || split_part(url, '/', 4) || '/m' || page_id || '.py' AS p FROM pages)")
def module_path(t: Tables) -> DataFrame:
    p = F.concat(F.lit("pkg/"), F.split_part(F.col("url"), F.lit("/"), F.lit(4)), F.lit("/m"), F.col("page_id").cast("string"), F.lit(".py"))
    return t.pages.select("page_id", tx.module_of_path(p).alias("module"), tx.path_of_module(tx.module_of_path(p)).alias("path"))


@query("SELECT c_custkey, regexp_replace(list_extract(string_split(lower('Org/' || c_mktsegment || '-' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '-Instruct' ELSE '' END), '/'), -1), '-instruct$', '') AS short_name FROM customer")
def short_name(t: Tables) -> DataFrame:
    name = F.concat(F.lit("Org/"), F.col("c_mktsegment"), F.lit("-"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, "-Instruct").otherwise(""))
    return t.customer.select("c_custkey", tx.short_model_name(name).alias("short_name"))


_ANSWER = "CASE WHEN turn % 3 = 0 THEN text || '<ANSWER>' || chr(10) || left(text, 20) || ' </answer> tail' ELSE text END"


@query(f"SELECT conv_id, turn, trim(CASE WHEN regexp_matches(x, '(?is)<answer>.*?</answer>') THEN trim(regexp_extract(x, '(?is)<answer>(.*?)</answer>', 1), ' ' || chr(10)) ELSE x END) AS answer FROM (SELECT conv_id, turn, {_ANSWER} AS x FROM conversations)")
def answer_extract(t: Tables) -> DataFrame:
    x = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("<ANSWER>\n"), F.left("text", F.lit(20)), F.lit(" </answer> tail"))).otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", F.btrim(tx.tagged_answer(x), F.lit(" \n")).alias("answer"))


@query("""
WITH c AS (SELECT conv_id, turn, '<tool_call>{"name": "t", "k": ' || turn || '}</tool_call> x <tool_call>oops</tool_call>' || CASE WHEN turn % 2 = 0 THEN '<tool_call>{"name": "u"}' ELSE '' END AS x FROM conversations)
SELECT conv_id, turn, (1 + CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_calls, '{"name": "t", "k": ' || turn || '}' AS first_call FROM c""")
def tool_call_parse(t: Tables) -> DataFrame:
    x = F.concat(F.lit('<tool_call>{"name": "t", "k": '), F.col("turn").cast("string"), F.lit("}</tool_call> x <tool_call>oops</tool_call>"), F.when(F.col("turn") % 2 == 0, '<tool_call>{"name": "u"}').otherwise(""))
    return t.conversations.select("conv_id", "turn", tx.tool_calls(x).alias("calls")).select("conv_id", "turn", F.size("calls").cast("bigint").alias("n_calls"), F.col("calls")[0].alias("first_call"))


@query("""
WITH d AS (SELECT doc_id, replace(text, ' | ', ' % ') || chr(10) || '% whole line' || chr(10) || 'keep 5\\% here % note' AS x FROM documents),
l AS (SELECT doc_id, i, rtrim(regexp_replace(regexp_replace(line[i], '^%.*$', ''), '([^\\\\])%.*$', '\\1')) AS line FROM (SELECT doc_id, string_split(x, chr(10)) AS line FROM d), unnest(range(1, len(line) + 1)) AS u(i))
SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY i)) AS digest, count(*) AS n_lines FROM l WHERE trim(line) <> '' GROUP BY doc_id""")
def latex_comment_strip(t: Tables) -> DataFrame:
    x = F.concat(F.replace("text", F.lit(" | "), F.lit(" % ")), F.lit("\n% whole line\nkeep 5\\% here % note"))
    stripped = t.documents.select("doc_id", tx.strip_latex_comments(x).alias("s"))
    return stripped.select("doc_id", F.md5(F.col("s").cast("binary")).alias("digest"), F.size(F.split("s", "\n")).cast("bigint").alias("n_lines"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN 'a' || text ELSE text END AS kept, text AS after FROM conversations")
def think_drop(t: Tables) -> DataFrame:
    x = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("a<think>let me\nsee</think>"), F.col("text"))).otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", tx.drop_thinking(x).alias("kept"), tx.after_thinking(F.concat(x, F.lit("<|eot|>"))).alias("after"))


@query("SELECT o_orderkey, ends_with(lower(trim('the answer: ' || o_orderstatus || ' ')), lower('F')) AS right_answer FROM orders")
def suffix_match(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", tx.ends_with_answer(F.concat(F.lit("the answer: "), F.col("o_orderstatus"), F.lit(" ")), F.lit("F")).alias("right_answer"))


@query("SELECT o_orderkey, o_custkey % 5 < 3 AS right_set FROM orders")
def answer_set_equal(t: Tables) -> DataFrame:
    said = F.when(F.col("o_custkey") % 5 < 3, F.concat(F.lit("The numbers are: {'"), F.col("o_orderkey").cast("string"), F.lit("', 12, 12}."))).otherwise(F.concat(F.lit("Here: 12, x"), F.col("o_orderkey").cast("string")))
    right = F.array(F.lit("12"), F.concat(F.col("o_orderkey").cast("string"), F.lit("'")))
    return t.orders.select("o_orderkey", scoring.listed_exactly(said, right).alias("right_set"))


@query("SELECT part.p_partkey, upper(left(x, 1)) || translate(lower(substr(x, 2)), '_-', '  ') AS label FROM part, (SELECT p_partkey, replace(p_name, ' ', '_') AS x FROM part) AS y WHERE part.p_partkey = y.p_partkey")
def capitalize_names(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", tx.capitalize(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("label"))


@query("SELECT page_id, 'File: f' || page_id || CASE WHEN page_id % 2 = 0 THEN '.py' || chr(10) || '```python' || chr(10) || html || chr(10) || '```' ELSE '.txt' || chr(10) || html END AS framed FROM pages")
def frame_files(t: Tables) -> DataFrame:
    path = F.concat(F.lit("f"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ".py").otherwise(".txt"))
    return t.pages.select("page_id", tx.frame_file(path, F.col("html")).alias("framed"))


@query("SELECT page_id, CASE WHEN a > 0 AND instr(substr(html, a), '</h1>') > 0 THEN left(substr(html, a), instr(substr(html, a), '</h1>') + 4) ELSE '' END AS section FROM (SELECT page_id, html, instr(html, '<h1>') AS a FROM pages)")
def marker_section(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tx.section_between(F.col("html"), "<h1>", "</h1>").alias("section"))


@query("SELECT item_id, text || chr(10) || 'A. yes' || chr(10) || 'B. no' || chr(10) || 'C. ' || left(text, 5) || chr(10) || 'Answer within <answer> tags.' AS prompt FROM benchmark")
def choice_prompts(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", tx.choice_prompt(F.col("text"), F.array(F.lit("yes"), F.lit("no"), F.left("text", F.lit(5)))).alias("prompt"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'v' || p_partkey || ' = ' || p_size WHEN 1 THEN 'let v' || p_partkey || ' be ' || p_size WHEN 2 THEN 'set v' || p_partkey || ' to ' || p_size ELSE 'the value of v' || p_partkey || ' is ' || p_size END AS sentence FROM part")
def assignment_sentences(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", tx.assignment_sentence(F.concat(F.lit("v"), F.col("p_partkey").cast("string")), F.col("p_size").cast("string"), F.col("p_partkey") % 4).alias("sentence"))


@query("SELECT p_partkey, p_type FROM part WHERE NOT regexp_matches(replace(p_type, ' ', CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '-' END), '[ .-]')")
def word_filter(t: Tables) -> DataFrame:
    word = F.replace("p_type", F.lit(" "), F.when(F.col("p_partkey") % 2 == 0, "").otherwise("-"))
    return t.part.where(tx.is_plain_word(word)).select("p_partkey", "p_type")


@query("SELECT conv_id, string_agg('tool' || turn || ': ' || text, chr(10) ORDER BY turn) FILTER (turn <> 1) AS rendered FROM conversations GROUP BY conv_id")
def tool_results(t: Tables) -> DataFrame:
    out = F.struct("turn", F.concat(F.lit("tool"), F.col("turn").cast("string")).alias("tool"), (F.col("turn") != 1).alias("success"), F.col("text").alias("response"))
    per = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(out)).alias("outputs"))
    return per.select("conv_id", F.nullif(synthesis.render_tool_results(F.col("outputs")), F.lit("")).alias("rendered"))


@query("SELECT doc_id, x LIKE '[{%' AS is_conversation FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '[{\"role\": \"user\", \"content\": \"q\"}]' WHEN doc_id % 3 = 1 THEN '{\"role\": \"user\"}' ELSE 'plain' END AS x FROM documents)")
def conversation_cells(t: Tables) -> DataFrame:
    """Whether a cell is a JSON list of messages."""
    x = F.when(F.col("doc_id") % 3 == 0, '[{"role": "user", "content": "q"}]').when(F.col("doc_id") % 3 == 1, '{"role": "user"}').otherwise("plain")
    v = F.try_parse_json(x)
    has = F.try_variant_get(v, "$[0].role", "string").isNotNull() & F.try_variant_get(v, "$[0].content", "string").isNotNull()
    return t.documents.select("doc_id", F.coalesce(has, F.lit(False)).alias("is_conversation"))


@query("""
WITH d AS (SELECT doc_id, turn, role, ids FROM (SELECT conv_id AS doc_id, turn, role, [length(text)::INTEGER, turn::INTEGER] AS ids FROM conversations)),
h AS (SELECT doc_id, turn, role, CASE role WHEN 'user' THEN [151644, 872, 198] WHEN 'system' THEN [151644, 8948, 198] ELSE [151644, 77091, 198] END || ids || [151645, 198] AS x FROM d),
o AS (SELECT *, coalesce(sum(len(x)) OVER (PARTITION BY doc_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM h)
SELECT doc_id AS conv_id, sum(len(x))::BIGINT AS n_ids, (count(*) FILTER (role = 'assistant') * 3)::BIGINT AS n_targets, coalesce(min(o + 3) FILTER (role = 'assistant'), -1)::BIGINT AS first_target, md5(string_agg(array_to_string(x, ','), ',' ORDER BY turn)) AS digest FROM o GROUP BY doc_id""")
def element_build(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", "role", F.array(F.length("text"), F.col("turn").cast("int")).alias("token_ids"))
    built = packing.build_elements(rows, "qwen")
    return built.select("conv_id", F.size("input_ids").cast("bigint").alias("n_ids"), F.size("targets").cast("bigint").alias("n_targets"), F.coalesce(F.array_min(F.transform("targets", lambda x: x["token_idx"])), F.lit(-1)).cast("bigint").alias("first_target"), F.md5(F.array_join(F.transform("input_ids", lambda x: x.cast("string")), ",").cast("binary")).alias("digest"))


@query("SELECT conv_id, turn, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS token_offset FROM (SELECT conv_id, turn, length(text) AS n FROM conversations)")
def target_offsets(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    n = F.length("text")
    return t.conversations.select("conv_id", "turn", (F.sum(n).over(w) - n).alias("token_offset"))


@query("SELECT doc_id, least(len(w), 64)::BIGINT AS n, CASE WHEN len(w) > 64 THEN w[-1] ELSE list_extract(w, -1) END AS last_token FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '') AS w FROM documents)")
def system_prompt_cut(t: Tables) -> DataFrame:
    cut = t.documents.select("doc_id", packing.cut_system_prompt(chunking.words(F.col("text")), 64).alias("x"))
    return cut.select("doc_id", F.size("x").cast("bigint").alias("n"), F.try_element_at("x", F.lit(-1)).alias("last_token"))
