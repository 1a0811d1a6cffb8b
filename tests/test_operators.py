import datetime
import json
import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corvane.functions import arithmetic, dates, nested, sampling, text as tx
from corvane.operators import analytics, conversations as cv, graphs, logprobs, packing, retrieval, scoring, synthesis, temporal


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["x"])
    return df.select(column.alias("y")).first().y


def test_text_functions(spark):
    s = F.col("s")
    assert one(spark, tx.tagged_answer(s), s="a <Answer>\n b\n</ANSWER> c") == "b" or one(spark, F.btrim(tx.tagged_answer(s), F.lit(" \n")), s="a <Answer>\n b\n</ANSWER> c") == "b"
    assert one(spark, tx.tagged_answer(s), s=" plain ") == "plain"
    assert one(spark, tx.tool_calls(s), s='<tool_call>{"a": 1}</tool_call><tool_call>no</tool_call><tool_call> {"b": 2}') == ['{"a": 1}', '{"b": 2}']
    assert one(spark, tx.strip_latex_comments(s), s="a % b\n% all\n50\\% kept % cut\n\n c") == "a\n50\\% kept\n c"
    assert one(spark, tx.drop_thinking(s), s="x<think>a\nb</think>y") == "xy"
    assert one(spark, tx.after_thinking(s), s="<think>a</think>y<|eot|>") == "y"
    assert one(spark, tx.list_answers(s), s="The answers are: {'12', 7}.") == ["12'", "7"]
    assert one(spark, tx.short_model_name(s), s="Org/Model-8B-Instruct") == "model-8b"
    assert one(spark, tx.retrieval_terms(s), s="The  quick, brown fox's été!") == ["quick", "brown", "foxs", "été"]
    assert one(spark, tx.section_between(s, "<a>", "</a>"), s="x<a>1</a>2</a>") == "<a>1</a>"
    assert one(spark, tx.section_between(s, "<a>", "</a>"), s="</a> only") == ""
    assert one(spark, tx.html_to_text(s), s="a<br/>b<p>c</p> <i>d</i>") == "a b c d"


def test_flattening_follows_the_documented_paths(spark):
    cases = {
        '{"a":1,"b":"hello","c":true}': [("a", "1"), ("b", "hello"), ("c", "true")],
        '{"user":{"name":"n","age":3,"details":{"city":"c"}},"status":"ok"}': [("status", "ok"), ("user/age", "3"), ("user/details/city", "c"), ("user/name", "n")],
        '{"items":[{"name":"x"},2],"metadata":{"tags":["p","q"]}}': [("items/0/name", "x"), ("items/1", "2"), ("metadata/tags/0", "p"), ("metadata/tags/1", "q")],
        "5": [("", "5")], "{}": [("", "{}")], "[]": [("", "[]")], "not json": [],
    }
    df = spark.createDataFrame([(i, doc) for i, doc in enumerate(cases)] + [(99, None)], "id int, doc string")
    got = nested.flatten_json(df, "doc", ["id"]).collect()
    for i, want in enumerate(cases.values()):
        assert sorted((r.path, r.value) for r in got if r.id == i) == want
    assert nested.unflatten({"a.0": 1, "a.1": 2, "b.c": None, "d": float("nan"), "e.x": 3}) == {"a": [1, 2], "e": {"x": 3}}


def test_nodes_and_draws_of_json(spark):
    deep = "[" * 400 + "7" + "]" * 400
    rows = [(1, '{"b": [1, {"k": 1.50}], "a": {"x/y": "q\\"r"}, "n": null, "e": {}}'), (2, "nope"), (3, '{"a": 1, "a": 2}'), (4, None), (5, '"s"'), (6, deep), (7, "[" * 1200 + "]" * 1200), (8, "null"), (9, "[]"), (10, "")]
    df = spark.createDataFrame(rows, "id int, doc string")
    got = nested.json_nodes(df, "doc", ["id"]).collect()
    of = lambda i: [(r.path, r.kind, r.value, r.leaf) for r in got if r.id == i]
    assert of(1) == [
        ("", "object", '{"a":{"x/y":"q\\"r"},"b":[1,{"k":1.5}],"e":{},"n":null}', False), ("a", "object", '{"x/y":"q\\"r"}', False), ("a/x/y", "value", 'q"r', True),
        ("b", "array", '[1,{"k":1.5}]', False), ("b/0", "value", "1", True), ("b/1", "object", '{"k":1.5}', False), ("b/1/k", "value", "1.5", True), ("e", "object", "{}", True), ("n", "value", "null", True),
    ]
    assert of(2) == of(3) == of(7) == of(10) == [(None, "unreadable", None, False)] and of(4) == []
    assert of(5) == [("", "value", "s", True)] and of(8) == [("", "value", "null", True)] and of(9) == [("", "array", "[]", True)]
    assert len(of(6)) == 401 and of(6)[-1] == ("/".join(["0"] * 400), "value", "7", True)
    draws = nested.draw_nodes(df, "doc", ["id"], 5, draws=2000)
    seen = draws.where("id = 1").groupBy("path", "value").count().collect()
    assert {(r.path, r.value) for r in seen} == {x[::2] for x in of(1)} and all(130 < r["count"] < 320 for r in seen)
    assert {r.id for r in draws.select("id").distinct().collect()} == {1, 5, 6, 8, 9}
    assert sorted(draws.collect()) == sorted(nested.draw_nodes(df.repartition(7), "doc", ["id"], 5, draws=2000).collect())
    assert {r.path for r in nested.draw_nodes(df, "doc", ["id"], 5, draws=300, leaves_only=True).where("id = 1").collect()} == {"a/x/y", "b/0", "b/1/k", "e", "n"}
    assert nested.draw_nodes(df, "doc", ["id"], 5, draws=0).count() == 0


def dense(spark, rows):
    return spark.createDataFrame([(0, i, k, 10 * (k + 1), lp) for i, row in enumerate(rows) for k, lp in enumerate(row)], "msg_id long, token_idx int, k int, token_id int, logprob double")


def test_sparse_logprobs(spark):
    probs = [[0.9, 0.09, 0.009, 0.001], [0.8, 0.15, 0.04, 0.01]]
    d = dense(spark, [[math.log(p) for p in row] for row in probs])
    kept = {m: logprobs.sparsify(d, m).count() for m in (0.5, 0.9, 0.99)}
    assert kept[0.5] <= kept[0.9] <= kept[0.99] and kept[0.5] == 2
    never = dense(spark, [[-1.0, -5.0, -6.0]])
    assert logprobs.sparsify(never, 0.99).count() == 1  # the mass is never reached
    for mass in (0.0, 1.5):
        with pytest.raises(ValueError):
            logprobs.sparsify(d, mass)
    full = logprobs.densify(logprobs.sparsify(d, 0.9), d.select("msg_id", "token_idx").distinct(), 4).orderBy("token_idx", "k").collect()
    assert [r.token_id for r in full] == [10, -1, -1, -1, 10, 20, -1, -1] and full[1].logprob == -1000.0


def pack_by_hand(sizes, length, mode):
    out, batch, used = [], 0, 0
    queue = list(sizes)
    while queue:
        n = queue[0]
        if used == 0 and n > length:
            out.append(batch)
            queue.pop(0)
            batch += 1
        elif used + n > length:
            if mode == "truncate":
                out.append(batch)
                queue.pop(0)
            batch, used = batch + 1, 0
        else:
            out.append(batch)
            queue.pop(0)
            used += n
    return out


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 15), max_size=30), st.sampled_from(["pad", "truncate"]))
def test_packing_is_the_greedy_fold(spark, sizes, mode):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "id long, n int")
    got = [r.batch for r in packing.pack(df, F.col("id"), F.col("n"), "id", 10, mode).orderBy("id").collect()]
    assert got == pack_by_hand(sizes, 10, mode)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 1, 2, 3, 7, 10, 11, 40]), min_size=1, max_size=60), st.sampled_from(["pad", "truncate"]), st.integers(1, 9))
def test_packing_over_ranges_is_one_fold(spark, sizes, mode, rows):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "id long, n int").repartition(3)
    kept, packing.RANGE_ROWS = packing.RANGE_ROWS, rows
    try:
        got = [r.batch for r in packing.pack(df, F.col("id"), F.col("n"), "id", 10, mode).orderBy("id").collect()]
    finally:
        packing.RANGE_ROWS = kept
    assert got == pack_by_hand(sizes, 10, mode)


@pytest.mark.parametrize("mode", ["pad", "truncate"])
def test_packing_of_many_ranges_in_few_rounds(spark, monkeypatch, mode):
    rows = [(i, (i * 7919) % 23) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, n int").repartition(5)
    monkeypatch.setattr(packing, "RANGE_ROWS", 100)
    rounds = []
    plain = packing.publish
    monkeypatch.setattr(packing, "publish", lambda df, name: rounds.append(name) or plain(df, name))
    got = [r.batch for r in packing.pack(df, F.col("id"), F.col("n"), "id", 50, mode).orderBy("id").collect()]
    assert got == pack_by_hand([n for _, n in rows], 50, mode)
    assert rounds.count("jumps") <= 6  # 30 ranges: five doublings and the one that finds none


def test_packing_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_ROWS", 2)
    df = spark.createDataFrame([("b", 1, None), ("a", 1, 5), ("a", 1, 5), (None, None, 4), ("c", 2, -3), ("d", 3, 6)], "id string, o int, batch int")
    got = packing.pack(df, F.col("o"), F.col("batch"), "id", 9)
    assert sorted((r.id or "", r.batch) for r in got.collect()) == [("", 0), ("a", 0), ("a", 1), ("b", 1), ("c", 1), ("d", 2)]
    assert packing.pack(df.limit(0), F.col("o"), F.col("batch"), "id", 9).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, F.col("o"), F.col("batch"), "id", 20, "other")


@pytest.mark.parametrize("seed", range(4))
def test_levels_of_random_graphs(spark, seed):
    import random

    rng = random.Random(seed)
    size = 60
    needs = {i: {rng.randrange(max(0, i - 4), i) for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))} if i else set() for i in range(size)}
    level = {}
    for i in range(size):
        level[i] = 1 + max((level[j] for j in needs[i]), default=-1)
    edges = [(i, j) for i, js in needs.items() for j in js] * 2 + [(3, 999), (998, 1)]
    got = graphs.levels(spark.range(size).withColumnRenamed("id", "node"), spark.createDataFrame(edges, "node long, needs long"))
    assert {r.node: r.level for r in got.collect()} == level


def test_a_long_chain_in_few_rounds(spark, monkeypatch):
    """100,000 modules, each needing the one before: links double twice a round."""
    n, tables = 100_000, []
    plain = graphs.publish
    monkeypatch.setattr(graphs, "publish", lambda df, name: tables.append(name) or plain(df, name))
    nodes = spark.range(n).withColumnRenamed("id", "node")
    got = graphs.levels(nodes, nodes.where("node > 0").select("node", (F.col("node") - 1).alias("needs")))
    assert got.where("node <> level").count() == 0 and got.count() == n
    assert len(tables) < 20
    ring = nodes.where("node < 1500").select("node", ((F.col("node") + 1) % 1500).alias("needs"))
    with pytest.raises(ValueError, match="cycle"):
        graphs.levels(nodes.where("node < 1500"), ring)
    deep = nodes.where("node < 1500")
    assert graphs.levels(deep, ring.where("needs > 0")).agg(F.max("level")).first()[0] == 1499


@pytest.mark.parametrize("block", [4096, 3])
def test_cosine_by_products(spark, block):
    import random

    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.5, 2.0]) for _ in range(4)]) for i in range(120)] + [(200, None), (201, [0.0] * 4), (202, [1.0, 2.0]), (203, [1.0, None, 1.0, 1.0]), (204, [float("nan")] * 4)]
    df = spark.createDataFrame(rows, "id int, v array<float>").repartition(5)
    queries = df.where("id % 20 = 0 AND id < 200").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    got = retrieval.cosine_top(df, queries, "id", "v", 6, block=block).select("query_id", "rank", "id", "score").collect()
    norm = lambda v: sum(x * x for x in v) ** 0.5
    want = set()
    for q, v in [r for r in rows[:120] if r[0] % 20 == 0]:
        scored = sorted(((round(sum(a * b for a, b in zip(v, w)) / norm(v) / norm(w), 5), i) for i, w in rows[:120] if i != q), reverse=True)[:6]
        want |= {(q, n + 1, i) for n, (_, i) in enumerate(scored)}
    assert {(r.query_id, r.rank, r.id) for r in got} == want
    assert retrieval.cosine_top(df, queries.limit(0), "id", "v", 6).count() == 0


def test_cosine_products_hold_little():
    """A task's memory doesn't grow with the queries; offers handed on in portions give the same best."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    vectors, units = rng.normal(size=(10_000, 8)), rng.normal(size=(4096, 8))
    units /= np.sqrt((units**2).sum(axis=1))[:, None]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.ListArray.from_arrays(pa.array(np.arange(0, 80_001, 8), pa.int32()), pa.array(vectors.ravel()))], names=["id", "v"])
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
    asked = SimpleNamespace(value=(pa.array(np.arange(4096) + 9_000), units))
    tracemalloc.start()
    got = pa.Table.from_batches(list(retrieval._products(asked, 5, 2e-5, schema)(iter([batch]))), schema).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000_000
    best = got.sort_values("score", ascending=False).groupby("query_id").head(5)
    for i in range(0, 4096, 500):
        s = vectors @ units[i] / np.sqrt((vectors**2).sum(axis=1))
        s[9_000 + i if i < 1_000 else []] = -np.inf
        assert set(best[best["query_id"] == 9_000 + i]["id"]) == set(np.argsort(s)[-5:].tolist())


def test_answers_hold_few_prompts():
    """A task turns only some prompts of an Arrow batch into texts at once; a failing call is rows with the error."""
    import tracemalloc

    import pyarrow as pa

    from corvane.operators import benchmarks

    class Sizes:
        def chat(self, chats):
            if chats[0][0]["content"] is None:
                raise ValueError("nothing asked")
            return [str(len(c[0]["content"])) for c in chats]

    schema = pa.schema([("id", pa.int64()), ("sample_idx", pa.int32()), ("pred", pa.string()), ("error", pa.string())])
    n = 2_000
    rows = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([0] * n, pa.int32()), pa.array(["x" * 10_000] * (n - 8) + [None] * 8)], names=["id", "sample_idx", "prompt"])
    tracemalloc.start()
    got = pa.Table.from_batches(list(benchmarks._answers(Sizes, 8, schema)(iter([rows])))).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5_000_000 and [r["id"] for r in got] == list(range(n))
    assert {(r["pred"], r["error"]) for r in got[:-8]} == {("10000", None)} and {(r["pred"], r["error"]) for r in got[-8:]} == {(None, "nothing asked")}


def test_bm25_by_hand(spark):
    chunks = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "a", "c"]), (3, ["d"]), (4, [])], "id long, t array<string>")
    queries = spark.createDataFrame([("q", "a"), ("q", "a"), ("q", "d")], "qid string, term string")
    got = {r.id: r.score for r in retrieval.bm25(chunks, F.col("t"), queries, "id", "qid").collect()}
    n, avgdl = 4, 6 / 4
    idf = {t: math.log(n - df + 0.5) - math.log(df + 0.5) for t, df in {"a": 2, "b": 1, "c": 1, "d": 1}.items()}
    weight = lambda t: idf[t] if idf[t] >= 0 else 0.25 * sum(idf.values()) / 4
    part = lambda t, tf, dl: weight(t) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))
    assert got == {1: pytest.approx(2 * part("a", 1, 2)), 2: pytest.approx(2 * part("a", 2, 3)), 3: pytest.approx(part("d", 1, 1))}


def test_scores(spark):
    s = scoring.set_scores(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"), F.lit("c")))
    assert one(spark, F.round(s["f1"], 6)) == 0.5 and one(spark, s["fp"]) == 1
    empty = scoring.set_scores(F.array().cast("array<string>"), F.array().cast("array<string>"))
    assert one(spark, empty["f1"]) == 0
    m = lambda p, a: one(spark, scoring.qa_match(F.col("p"), F.col("a")), p=p, a=a)
    assert [m(" Yes ", "yes"), m("it is yes", "yes"), m("the red", "see the red fox"), m("fox red big", "red fox big cat eats"), m("no", "maybe")] == list(scoring.RIGHT) + ["none"]
    v = lambda r: one(spark, scoring.judge_verdict(F.col("r")), r=r)
    assert [v('{"correct": false}'), v("CORRECT"), v("incorrect"), v("hm")] == [False, True, False, None]
    pairs = spark.createDataFrame([(1, "abc def", "abc def"), (2, "xx", "xx")], "id int, h string, r string")
    assert scoring.chrf(pairs, "h", "r", "id").first().chrf == pytest.approx(100)
    options = spark.createDataFrame([("<answer>appel</answer>", ["pear", "apple"], "apple"), ("", ["pear", "apple"], "pear")], "p string, o array<string>, r string")
    assert [r.ok for r in options.select(scoring.multiple_choice(F.col("p"), F.col("o"), F.col("r")).alias("ok")).collect()] == [True, True]


def test_graphs(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "os"), ("e", "c")], "node string, needs string")
    assert {r.node: r.level for r in graphs.levels(nodes, edges).collect()} == {"a": 0, "b": 1, "c": 2, "d": 0, "e": 3}
    with pytest.raises(ValueError):
        graphs.levels(nodes, edges.union(spark.createDataFrame([("a", "e")], "node string, needs string")))
    calls = spark.createDataFrame([("f", "1", "call", "g", "2", None), ("g", "2", "literal", None, None, "stored"), ("g", "1", "literal", None, None, "first")], "method string, input string, kind string, target string, arg string, literal string")
    starts = spark.createDataFrame([("f", "1")], "method string, input string")
    assert graphs.call_chain(spark, calls, starts).first().literal == "stored"
    assert graphs.call_chain(spark, calls, starts, follow_argument=False).first().literal == "first"


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(200).withColumn("w", F.lit(1.0))
    a = [r.id for r in sampling.choose(df, 3, ["id"], k=20).collect()]
    assert a == [r.id for r in sampling.choose(df.repartition(7), 3, ["id"], k=20).collect()] and len(set(a)) == 20
    assert sorted(r.position for r in sampling.shuffled(df, 5, ["id"]).collect()) == list(range(200))
    heavy = df.withColumn("w", F.when(F.col("id") < 10, 1000.0).otherwise(0.001))
    assert all(r.id < 10 for r in sampling.weighted_choice(heavy, F.col("w"), 1, ["id"], 5).collect())


def test_time(spark):
    assert one(spark, F.date_format(dates.since_2001(F.col("s")), "yyyy-MM-dd"), s=86400) == "2001-01-02"
    assert [r.bucket for r in dates.day_buckets(spark, "2024-01-01", "2024-01-25", 10).collect()] == ["2024-01-01_to_2024-01-11", "2024-01-11_to_2024-01-21", "2024-01-21_to_2024-01-25"]
    df = spark.createDataFrame([("Tue, 2 Jan 2001 10:00:00 +0200",), ("nonsense",), (None,)], "d string")
    assert [r.t for r in df.select(F.date_format(dates.mail_date("d"), "yyyy-MM-dd HH:mm").alias("t")).collect()] == ["2001-01-02 08:00", None, None]
    events = spark.createDataFrame([(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=7 * (i % 13))) for i in range(50)] + [(99, None)], "id long, ts timestamp_ntz")
    got = temporal.rank_batches(events, "ts", "id", 8, most=5).collect()
    order = sorted((i for i in range(50)), key=lambda i: (i % 13, i))
    assert {r.id: r.batch_id for r in got} == {i: n // 8 for n, i in enumerate(order) if n < 40}


def test_conversations(spark):
    turns = spark.createDataFrame([(1, 0, "user", "Hi There"), (1, 1, "assistant", "<b>"), (2, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in cv.search(turns, " THERE ").collect()] == [1]
    assert cv.search(turns, "there", in_messages=False).count() == 0
    assert [(r.conv_id, r.answer) for r in cv.split_prompt(cv.nest(turns)).collect()] == [(1, "<b>")]
    assert "&lt;b&gt;" in cv.nest(turns).where("conv_id = 1").select(cv.to_html(F.col("messages")).alias("h")).first().h


def test_synthesis(spark):
    prompts = spark.createDataFrame([(i, f"context {i}", "ask") for i in range(5)], "k long, context string, prompt string")
    got = synthesis.rollout(prompts, "k", synthesis.EchoClient, rounds=2, batch=2).collect()
    assert len(got) == 20 and {r.role for r in got} == {"user", "assistant"} and all(r.error is None for r in got)

    class Failing:
        def chat(self, chats):
            raise RuntimeError("no model")

    failed = synthesis.rollout(prompts, "k", Failing).collect()
    assert sorted(r.k for r in failed) == list(range(5)) and {r.error for r in failed} == {"no model"}
    with pytest.raises(ValueError):
        synthesis.draw_seed_prompts(prompts, "k", 1, 0, ("analytical",))
    assert json.loads(synthesis.render_tool("t", "d", {}))["function"]["name"] == "t"


def test_analytics(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", float("nan"), 2), ("a", None, 3), ("b", 2.0, 4), ("b", 2.0, 5)], "g string, v double, i int")
    assert {(r.g, r.i) for r in analytics.arg_best(df, ["g"], "v", ["i"]).collect()} == {("a", 1), ("b", 4)}
    assert analytics.select_like(["a/score", "b_score", "c/score"], "score$", ("^b",)) == ["a/score", "c/score"]
    assert nested.drop_null_columns(df.withColumn("n", F.lit(None).cast("int"))).columns == ["g", "v", "i"]
    assert df.where(analytics.matches({"g": {"$in": ["b"]}, "$or": [{"i": 4}, {"i": {"$gte": 9}}]})).count() == 1
    assert one(spark, analytics.number_in(F.col("s")), s="cache-step120.pt") == 120 and one(spark, analytics.number_in(F.col("s")), s="final") == 0
    assert arithmetic.grid_ticks(0.5, 200) == [0.1, 1.0, 10.0, 100.0, 1000.0] and arithmetic.back_off(9) == 60
    assert nested.config_hash({"a": 1, "t": 2}, ("t",)) == nested.config_hash({"t": 3, "a": 1}, ("t",))


def test_whole_texts(spark):
    assert one(spark, F.length(tx.capitalize(F.col("s"))), s="a" * 1_000_010) == 1_000_010
    from corvane.plans import catalog

    plan = catalog.QUERIES["fuzzy_choice"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "left(" not in plan and ", 40)" not in plan


def test_deep_call_chains_and_cycles(spark):
    schema = "method string, input string, kind string, target string, arg string, literal string"
    rows = [(f"m{i}", "x", "call", f"m{i + 1}", "x", None) for i in range(150)] + [("m150", "x", "literal", None, None, "end"), ("lost", "x", "call", "none", "x", None), ("c", "x", "call", "d", "x", None), ("d", "x", "call", "c", "x", None)]
    calls = spark.createDataFrame(rows, schema)
    starts = spark.createDataFrame([("m0", "x"), ("m149", "x"), ("m150", "x"), ("lost", "x")], "method string, input string")
    for follow in (True, False):
        got = {r.start: (r.literal, r.depth) for r in graphs.call_chain(spark, calls, starts, follow_argument=follow).collect()}
        assert got == {"m0": ("end", 150), "m149": ("end", 1), "m150": ("end", 0)}
    with pytest.raises(ValueError):
        graphs.call_chain(spark, calls, spark.createDataFrame([("c", "x")], "method string, input string"))
