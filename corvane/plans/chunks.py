"""Queries on chunks, samples and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corvane.functions import sampling, text as tx
from corvane.operators import chunking, haystack, requests, retrieval, synthesis
from corvane.operators.bm25_index import FORMAT, Bm25Index
from corvane.operators.embedding_cache import EmbeddingCache
from corvane.plans.registry import Tables, query, sql_uniform
from corvane.runtime import kept_path, publish, version

_U = sql_uniform
_WORDS = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')"


@query("SELECT doc_id, (i // 1000)::INTEGER AS chunk_idx, substr(text, i + 1, 1000) AS chunk FROM documents, unnest(range(0, length(text), 1000)) AS u(i)")
def fixed_chunks(t: Tables) -> DataFrame:
    return chunking.fixed_chunks(t.documents, "text", 1000, ["doc_id"])


@query(f"SELECT doc_id, substr(text, floor({_U(3, 'doc_id')} * greatest(1, length(text) - 199))::INTEGER + 1, 200) AS chunk FROM documents")
def sampled_char_window(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", chunking.character_window(F.col("text"), 200, sampling.uniform(3, "doc_id")).alias("chunk"))


@query(f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), s AS (SELECT doc_id, w, least(len(w), 20 + floor({_U(4, 'doc_id')} * 31)::INTEGER) AS n FROM d),
p AS (SELECT doc_id, w, n, floor({_U(5, 'doc_id')} * greatest(1, len(w) - n + 1))::INTEGER AS a FROM s)
SELECT doc_id, n::BIGINT AS n_tokens, a::BIGINT AS start, '[' || a || ' tokens preceding]' || chr(10) || array_to_string(w[a + 1:a + n], ' ') || chr(10) || '[' || (a + n) || ' tokens preceding]' AS chunk FROM p""")
def sampled_token_window(t: Tables) -> DataFrame:
    w = F.col("w")
    d = t.documents.select("doc_id", chunking.words(F.col("text")).alias("w"))
    window = chunking.token_window(w, 20, 50, sampling.uniform(4, "doc_id"), sampling.uniform(5, "doc_id"))
    d = d.withColumn("x", window).withColumn("n", F.size("x"))
    start = sampling.below(sampling.uniform(5, "doc_id"), F.greatest(F.lit(1), F.size(w) - F.col("n") + 1))
    d = d.withColumn("start", start.cast("bigint"))
    return d.select("doc_id", F.col("n").cast("bigint").alias("n_tokens"), "start", chunking.position_marks(F.array_join("x", " "), F.col("start"), F.col("start") + F.col("n")).alias("chunk"))


@query(f"SELECT doc_id, CASE WHEN length(text) > 300 THEN '... ' || substr(text, floor({_U(6, 'doc_id')} * greatest(1, length(text) - 299))::INTEGER + 1, 300) || ' ...' ELSE text END AS piece FROM documents")
def truncate_ellipsis(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", chunking.truncate_with_dots(F.col("text"), 300, sampling.uniform(6, "doc_id")).alias("piece"))


@query(f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), n AS (SELECT doc_id, w, ceil(len(w) / 256.0)::BIGINT AS n_chunks FROM d WHERE len(w) > 0), s AS (SELECT *, ceil(len(w) / n_chunks::DOUBLE)::INTEGER AS size FROM n)
SELECT doc_id, n_chunks, (i // size)::INTEGER AS chunk_idx, least(size, len(w) - i)::BIGINT AS n_tokens FROM s, unnest(range(0, len(w), size)) AS u(i)""")
def even_token_chunks(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", chunking.words(F.col("text")).alias("w"))
    return chunking.even_chunks(d, "w", 256, ["doc_id"]).select("doc_id", "n_chunks", "chunk_idx", F.size("chunk").cast("bigint").alias("n_tokens"))


@query(f"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(text, '.'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS s FROM documents),
p AS (SELECT doc_id, draw, s, floor({_U(8, 'doc_id', 'draw')} * greatest(1, len(s) - 2))::INTEGER AS a FROM s, range(2) AS r(draw) WHERE len(s) > 0)
SELECT doc_id, draw::INTEGER AS draw, array_to_string(s[a + 1:a + 3], '. ') AS chunk FROM p""")
def sentence_windows(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", tx.sentences(F.col("text")).alias("s"))
    return chunking.sentence_windows(d, "s", 3, 2, 8, ["doc_id"])


@query(f"SELECT doc_id, draw::INTEGER AS draw, (['structuring', 'summarization', 'question', 'use_case', 'creative', 'generic', 'qa'])[floor({_U(9, 'doc_id', 'draw')} * 7)::INTEGER + 1] AS kind FROM documents, range(3) AS r(draw)")
def seed_prompt_draws(t: Tables) -> DataFrame:
    return synthesis.draw_seed_prompts(t.documents, "doc_id", 3, 9).drop("prompt")


@query(f"SELECT doc_id, (row_number() OVER (ORDER BY {_U(10, 'doc_id')}, doc_id) - 1)::BIGINT AS position FROM documents")
def shuffle_order(t: Tables) -> DataFrame:
    return sampling.shuffled(t.documents.select("doc_id"), 10, ["doc_id"])


@query(f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_U(11, 'doc_id')}, doc_id) AS rn FROM documents) WHERE rn <= 5")
def sample_k_per_group(t: Tables) -> DataFrame:
    return sampling.choose(t.documents.select("doc_id", "lang"), 11, ["doc_id"], ["lang"], 5)


@query(f"SELECT doc_id, source FROM documents ORDER BY {_U(12, 'doc_id')}, doc_id LIMIT 1")
def uniform_choice(t: Tables) -> DataFrame:
    return sampling.choose(t.documents.select("doc_id", "source"), 12, ["doc_id"])


@query(f"SELECT doc_id FROM documents ORDER BY {_U(13, 'doc_id')}, doc_id LIMIT 256")
def preview_sample(t: Tables) -> DataFrame:
    return sampling.choose(t.documents.select("doc_id"), 13, ["doc_id"], k=256)


_BUCKETS = "SELECT strftime(ts, '%Y-%m-%d') AS bucket, count(*) AS n FROM events GROUP BY 1"


def _days(t: Tables) -> DataFrame:
    return t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("bucket")).agg(F.count("*").alias("n"))


def _age():
    return F.greatest(F.lit(0.0), F.datediff(F.lit("2024-12-31").cast("date"), F.to_date("bucket")).cast("double"))


_AGE = "greatest(0.0::DOUBLE, date_diff('day', bucket::DATE, DATE '2024-12-31')::DOUBLE)"


@query(f"SELECT bucket, n, round(exp(-0.01::DOUBLE * {_AGE}), 6) AS by_rate, round(exp(-ln(2) / 30 * {_AGE}) * pow(n, 0.3), 6) AS by_half_life FROM ({_BUCKETS})")
def recency_weights(t: Tables) -> DataFrame:
    return _days(t).select("bucket", "n", F.round(sampling.decay(_age(), rate=0.01), 6).alias("by_rate"), F.round(sampling.decay(_age(), half_life=30.0) * F.pow("n", F.lit(0.3)), 6).alias("by_half_life"))


@query(f"SELECT bucket, n FROM ({_BUCKETS}) ORDER BY -ln(1 - {_U(14, 'bucket')}) / exp(-0.01::DOUBLE * {_AGE}), bucket LIMIT 3")
def weighted_bucket_pick(t: Tables) -> DataFrame:
    return sampling.weighted_choice(_days(t), sampling.decay(_age(), rate=0.01), 14, ["bucket"], 3)


@query(f"WITH s AS (SELECT source FROM (SELECT DISTINCT source FROM documents) ORDER BY {_U(15, 'source')}, source LIMIT 1), l AS (SELECT source, lang FROM (SELECT DISTINCT source, lang FROM documents JOIN s USING (source)) ORDER BY {_U(16, 'source', 'lang')}, lang LIMIT 1) SELECT doc_id, source, lang FROM documents JOIN l USING (source, lang) ORDER BY {_U(17, 'doc_id')}, doc_id LIMIT 1")
def two_stage_pick(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "source", "lang")
    s = sampling.choose(d.select("source").distinct(), 15, ["source"])
    langs = d.join(F.broadcast(s), "source").select("source", "lang").distinct()  # one row
    chosen = langs.orderBy(sampling.uniform(16, "source", "lang"), "lang").limit(1)
    return sampling.choose(d.join(F.broadcast(chosen), ["source", "lang"]), 17, ["doc_id"]).select("doc_id", "source", "lang")


@query(f"SELECT conv_id, turn, {_U(18, 'conv_id', 'turn')} < 0.4 AS enhanced, {_U(19, 'conv_id', 'turn')} < 0.25 AS thinking FROM conversations")
def bernoulli_gates(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", (sampling.uniform(18, "conv_id", "turn") < 0.4).alias("enhanced"), (sampling.uniform(19, "conv_id", "turn") < 0.25).alias("thinking"))


@query(f"SELECT doc_id, (1000000 + floor({_U(20, 'doc_id')} * 9000000)::INTEGER)::BIGINT AS number, upper(substr(md5(concat_ws(':', '21', doc_id::VARCHAR)), 1, 6)) AS code FROM documents")
def random_literals(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", (F.lit(1_000_000) + sampling.below(sampling.uniform(20, "doc_id"), 9_000_000)).cast("bigint").alias("number"), F.upper(F.substring(F.md5(F.concat_ws(":", F.lit("21"), F.col("doc_id").cast("string")).cast("binary")), 1, 6)).alias("code"))


_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_TERMS = f"list_filter(string_split(trim(regexp_replace(regexp_replace(lower({{x}}), '[^\\p{{{{L}}}}\\p{{{{N}}}}_\\s]', '', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ({_STOP}))"
_BM25 = f"""
c AS (SELECT doc_id, (i // 2000)::INTEGER AS idx, substr(text, i + 1, 2000) AS chunk FROM documents, unnest(range(0, length(text), 2000)) AS u(i)),
tk AS MATERIALIZED (SELECT doc_id * 100000 + idx AS id, {_TERMS.format(x='chunk')} AS w FROM c),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tk),
po AS MATERIALIZED (SELECT id, len(w) AS dl, term, count(*) AS tf FROM (SELECT id, w, unnest(w) AS term FROM tk) GROUP BY id, len(w), term),
df AS MATERIALIZED (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM po, st GROUP BY term, n),
me AS (SELECT avg(idf) AS m FROM df),
qt AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TERMS.format(x='text')}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT item_id, id, round(sum(qtf * CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score
       FROM qt JOIN df USING (term) JOIN po USING (term), st, me GROUP BY item_id, id),
top AS (SELECT item_id, id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id DESC)::INTEGER AS rank FROM sc)"""


#: Chosen chunks whose documents are broadcast; more are joined by a shuffle.
_FEW = 100_000


def _chunks_of(t: Tables, top: DataFrame) -> DataFrame:
    """Chosen chunks (id) with their texts: only their documents are cut again, and no text is shuffled where few are chosen."""
    few = (lambda x: F.broadcast(x)) if top.count() <= _FEW else (lambda x: x)
    wanted = top.select(F.expr("(id - pmod(id, 100000)) div 100000").alias("doc_id")).distinct()
    chunks = chunking.fixed_chunks(t.documents.join(few(wanted), "doc_id", "left_semi"), "text", 2000, ["doc_id"])
    return chunks.withColumn("id", F.col("doc_id") * 100_000 + F.col("chunk_idx")).join(few(top), "id")


def _bm25(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Chunks and the five best of each item; the index is kept and reused while the documents' files are the same."""
    chunks = chunking.fixed_chunks(t.documents, "text", 2000, ["doc_id"]).withColumn("id", F.col("doc_id") * 100_000 + F.col("chunk_idx"))
    path = kept_path(t.spark, "bm25", FORMAT, f"{t.sf_dir}/documents.parquet", version(t.spark, f"{t.sf_dir}/documents.parquet"))
    index = Bm25Index.at(t.spark, path) or Bm25Index.build(chunks, tx.retrieval_terms(F.col("chunk")), "id", path)
    queries = t.benchmark.select("item_id", F.explode(tx.retrieval_terms(F.col("text"))).alias("term"))
    return chunks, index.top(queries, "item_id", 5).rows.withColumnRenamed("key", "id")


@query(f"WITH {_BM25} SELECT item_id, rank, id, round(score, 4) AS score FROM top WHERE rank <= 5")
def bm25_topk(t: Tables) -> DataFrame:
    """Flagship: the five best chunks of the corpus for each benchmark item."""
    return _bm25(t)[1].select("item_id", "rank", "id", F.round("score", 4).alias("score"))


@query(f"""WITH {_BM25},
ch AS (SELECT item_id, c.doc_id, c.idx, c.chunk, lag(c.idx) OVER (PARTITION BY item_id, c.doc_id ORDER BY c.idx) AS before FROM top JOIN c ON c.doc_id * 100000 + c.idx = top.id JOIN benchmark b USING (item_id) WHERE rank <= 5 AND NOT contains(b.text, c.chunk))
SELECT item_id, doc_id, md5(string_agg(CASE WHEN idx <> before + 1 THEN chr(10) || chr(10) || '...<omitted chunks>...' || chr(10) || chr(10) ELSE '' END || chunk, '' ORDER BY idx)) AS digest FROM ch GROUP BY item_id, doc_id""")
def context_reassembly(t: Tables) -> DataFrame:
    top = publish(_bm25(t)[1], "bm25-top")
    chosen = _chunks_of(t, top).join(t.benchmark.select("item_id", F.col("text").alias("context")), "item_id")
    out = retrieval.reassemble(chosen, "item_id", "doc_id", "chunk_idx", "chunk", context="context")
    return out.select("item_id", "doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("""
WITH q AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id % 50 = 0), c AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS c FROM embeddings),
s AS (SELECT query_id, vec_id, round(list_inner_product(q, c) / (sqrt(list_inner_product(q, q)) * sqrt(list_inner_product(c, c))), 5) AS score FROM q, c WHERE query_id <> vec_id)
SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id DESC) AS rank FROM s) WHERE rank <= 10""")
def cosine_topk(t: Tables) -> DataFrame:
    """Every fiftieth vector against all others."""
    q = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return retrieval.cosine_top(t.embeddings, q, "vec_id", "embedding", 10).select("query_id", "vec_id", "score")


@query("SELECT sha256(string_agg(sha256(text), ',' ORDER BY item_id)) AS cache_key, count(*) AS n, ceil(count(*) / 150.0)::BIGINT AS n_batches FROM benchmark")
def embedding_cache_key(t: Tables) -> DataFrame:
    """The key of an embedding cache: a digest of all texts, taken as a digest of their digests."""
    per = t.benchmark.agg(F.array_sort(F.collect_list(F.struct("item_id", F.sha2(F.col("text").cast("binary"), 256).alias("h")))).alias("x"), F.count("*").alias("n"))
    return per.select(F.sha2(F.array_join(F.transform("x", lambda x: x["h"]), ",").cast("binary"), 256).alias("cache_key"), "n", F.ceil(F.col("n") / 150).alias("n_batches"))


def _letters():
    """A stand-in for a model: how often each vowel and the blank occur, by code points."""
    return lambda texts: [[float(t.count(c)) for c in "aeiou "] for t in texts]


_COUNT = "(length(text) - length(replace(text, '{c}', '')))"


@query(f"SELECT doc_id, 6::INTEGER AS width, (a + 2 * e + 3 * i + 4 * o + 5 * u + 6 * x)::DOUBLE AS checksum FROM (SELECT doc_id, text, {', '.join(_COUNT.format(c=c) + ' AS ' + ('x' if c == ' ' else c) for c in 'aeiou ')} FROM documents WHERE text IS NOT NULL)")
def embedding_lookup(t: Tables) -> DataFrame:
    """Vectors of all whole texts, through a cache that is kept: a second call computes none."""
    cache = EmbeddingCache(t.spark, kept_path(t.spark, "embeddings", "letters"))
    rows = cache.embed(t.documents.where("text IS NOT NULL").select("doc_id", "text"), "text", _letters).rows
    weighed = F.aggregate(F.zip_with("vector", F.sequence(F.lit(1), F.lit(6)), lambda v, w: v * w), F.lit(0.0), lambda s, x: s + x)
    return rows.select("doc_id", F.size("vector").alias("width"), weighed.alias("checksum"))


_SHAPES = "CASE WHEN i % 3 = 0 THEN 1 WHEN i % 3 = 1 THEN 2 ELSE 3 END"


@query(f"""
WITH w AS (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM conversations WHERE role = 'user'),
k AS (SELECT conv_id, turn, len(w[i + 1]) AS n, {_SHAPES} AS kept FROM w, unnest(range(len(w))) AS r(i))
SELECT w.conv_id, w.turn, len(w)::INTEGER AS n_tokens, coalesce(sum(kept), 0)::BIGINT AS n_targets, coalesce(sum(n), 0)::BIGINT AS id_sum,
       coalesce(sum(kept * n + kept * (kept - 1) // 2), 0)::BIGINT AS target_sum
FROM w LEFT JOIN k USING (conv_id, turn) GROUP BY w.conv_id, w.turn, len(w)""")
def reply_elements(t: Tables) -> DataFrame:
    """Replies with alternatives to every user message, thinned at 0.9 of the mass, as training elements."""
    chats = t.conversations.where("role = 'user'").select(F.struct("conv_id", "turn").alias("id"), F.array(F.struct("role", F.col("text").alias("content"))).alias("chat"))
    made = requests.elements(requests.conversations(requests.ask(chats, requests.WordClient, mass=0.9), "id"), "id")
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return made.select("id.*", F.size("input_ids").alias("n_tokens"), F.size("targets").cast("bigint").alias("n_targets"), total(F.col("input_ids")).alias("id_sum"), total(F.transform("targets", lambda x: x["token_id"])).alias("target_sum"))


_CHAIN_NAME = "'V' || upper(substr(md5(concat_ws(':', '30', item_id::VARCHAR, {h}::VARCHAR)), 1, 5))"


@query(f"""
WITH k AS (SELECT item_id, h::INTEGER AS hop FROM benchmark, range(4) AS r(h)),
v AS (SELECT item_id, hop, {_CHAIN_NAME.format(h='hop')} AS name, CASE WHEN hop = 0 THEN (1000000 + floor({_U(30, 'item_id')} * 9000000)::INTEGER)::VARCHAR ELSE {_CHAIN_NAME.format(h='(hop - 1)')} END AS value, floor({_U(30, 'item_id', 'hop')} * 4)::INTEGER AS f FROM k)
SELECT item_id, hop, CASE f WHEN 0 THEN name || ' = ' || value WHEN 1 THEN 'let ' || name || ' be ' || value WHEN 2 THEN 'set ' || name || ' to ' || value ELSE 'the value of ' || name || ' is ' || value END AS sentence FROM v""")
def variable_chains(t: Tables) -> DataFrame:
    return haystack.chains(t.benchmark, "item_id", 3, 30).select("item_id", "hop", "sentence")


@query("""
WITH s AS (SELECT conv_id, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS total FROM conversations)
SELECT conv_id, count(*) FILTER (total <= 1500) AS n, coalesce(max(total) FILTER (total <= 1500), 0)::BIGINT AS total FROM s GROUP BY conv_id""")
def haystack_budget(t: Tables) -> DataFrame:
    sizes = t.conversations.select("conv_id", "turn", F.length("text").cast("bigint").alias("tokens"))
    return haystack.fitting(sizes, ["conv_id"], ["turn"], "tokens", 1500)


@query("""
WITH s AS (SELECT doc_id, i, s[i] AS p FROM (SELECT doc_id, list_filter(list_transform(string_split(text, '.'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS s FROM documents), unnest(range(1, len(s) + 1)) AS u(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
r AS (SELECT doc_id, (i - 1)::DOUBLE AS place, p FROM s UNION ALL SELECT doc_id, floor(n * depth / 100.0) - 0.5, 'needle ' || depth FROM n, (VALUES (0), (50), (100)) AS d(depth))
SELECT doc_id, md5(string_agg(p, '. ' ORDER BY place, p)) AS digest, count(*) AS n_pieces FROM r GROUP BY doc_id""")
def haystack_build(t: Tables) -> DataFrame:
    s = t.documents.select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("i", "sentence"))
    depths = F.explode(F.array(*(F.lit(d) for d in (0, 50, 100))))
    needles = s.select("doc_id").distinct().select("doc_id", depths.alias("depth")).withColumn("needle", F.concat(F.lit("needle "), F.col("depth").cast("string")))
    built = haystack.build(s.withColumnRenamed("doc_id", "sample_id"), needles.withColumnRenamed("doc_id", "sample_id"))
    n = s.groupBy("doc_id").agg((F.count("*") + 3).alias("n_pieces"))
    return built.join(n, F.col("sample_id") == F.col("doc_id")).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "n_pieces")


@query("SELECT batch_id, least(32, 1000 - batch_id * 32)::BIGINT AS batch_size FROM range(32) AS r(batch_id)")
def batch_plan(t: Tables) -> DataFrame:
    return synthesis.plan_batches(t.spark, 1000, 32)


@query("SELECT conv_id, variant::INTEGER AS variant FROM (SELECT DISTINCT conv_id FROM conversations), range(3) AS r(variant)")
def batch_variants(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id").distinct().select("conv_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("variant"))


@query("SELECT kind FROM (VALUES ('analytical'), ('qa'), ('factual')) AS k(kind) WHERE kind NOT IN ('structuring', 'summarization', 'question', 'use_case', 'creative', 'generic', 'qa')")
def unknown_prompt_kinds(t: Tables) -> DataFrame:
    known = t.spark.createDataFrame(list(synthesis.SEED_PROMPTS), "kind string, prompt string")
    return t.spark.createDataFrame([("analytical",), ("qa",), ("factual",)], "kind string").join(known, "kind", "left_anti")
