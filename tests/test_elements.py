import base64
import gzip
import io
import json
import os
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import benchmarks, graphs, logprobs, packing, prompts, retrieval, runs, synthesis, temporal, tokens
from corvane.sources import catalogs, chats, files, mail, remote
from corvane.streaming import events


def pack(values, kind):
    return base64.b64encode(np.array(values, dtype=kind).tobytes()).decode()


def test_packed_arrays(spark):
    rows = [("a", pack([-0.1, -0.2], "<f4"), pack([1, 2, 3, 4, 5, 6], "<i4"), pack([-0.1, -1, -2, -0.2, -3, -4], "<f4")), ("empty", "", "", ""), ("bad", "!!", None, ""), ("odd", pack([-0.1, -0.2], "<f4"), pack([1, 2, 3], "<i4"), pack([1, 2, 3], "<f4")), ("null", None, None, None)]
    df = spark.createDataFrame(rows, "id string, chosen string, indices string, logprobs string")
    got = sorted((r.id, r.token_idx, r.k, r.token_id, round(r.logprob, 4)) for r in tokens.decode_arrays(df, "id").collect())
    assert got == [("a", 0, 0, 1, -0.1), ("a", 0, 1, 2, -1.0), ("a", 0, 2, 3, -2.0), ("a", 1, 0, 4, -0.2), ("a", 1, 1, 5, -3.0), ("a", 1, 2, 6, -4.0)]
    assert sorted(r.id for r in tokens.undecodable(df, "id").collect()) == ["bad", "null", "odd"]
    sparse = logprobs.sparsify(tokens.decode_arrays(df, "id").withColumnRenamed("id", "msg_id"), 0.9)
    assert sorted((r.token_idx, r.k) for r in sparse.collect()) == [(0, 0), (1, 0), ] or sparse.count() >= 2


def test_thinking_spans(spark):
    entry = "array<struct<token_idx:int,token_id:int,logprob:double>>"
    rows = [(1, [5, 151667, 8, 9, 151668, 7], [(i, i * 10, -1.0) for i in range(6)]), (2, [151668, 1, 151667], [(0, 1, -1.0)]), (3, [5, 151667, 8], None), (4, [151667, 151668], [(1, 2, -1.0)])]
    df = spark.createDataFrame(rows, f"id int, token_ids array<int>, logprobs {entry}")
    got = {r.id: (r.token_ids, [(x.token_idx, x.token_id) for x in r.logprobs] if r.logprobs is not None else None) for r in tokens.drop_thinking_tokens(df).collect()}
    assert got == {1: ([5, 151667, 151668, 7], [(0, 0), (1, 10), (2, 40), (3, 50)]), 2: ([151668, 1, 151667], [(0, 1)]), 3: ([5, 151667, 8], None), 4: ([151667, 151668], [(1, 2)])}


def test_sections(spark):
    lines = spark.createDataFrame([("a", i, f"l{i}", 30) for i in range(5)] + [("b", 0, "x", 1)], "d string, i int, t string, n int")
    got = sorted((r.d, r.section, r.n_sections, r.content, r.tokens) for r in tokens.fill_sections(lines, ["d"], "i", "t", "n", 100).collect())
    assert got == [("a", 1, 3, "l0\nl1", 60), ("a", 2, 3, "l2\nl3", 60), ("a", 3, 3, "l4", 30), ("b", 1, 1, "x", 1)]
    with pytest.raises(Exception, match="longer than a section"):
        tokens.fill_sections(lines, ["d"], "i", "t", "n", 40).collect()


def helpers():
    """A client and tools, made here so that tasks get them by value.

    The client calls a tool when it is offered some; else it tells what it sees.
    """

    class Asker:
        def chat(self, chats):
            out = []
            for c in chats:
                last = c[-1]["content"]
                if "\nTools:\n" in c[0]["content"]:
                    kind = c[0]["content"].split()[0]
                    want = "none" if kind == "plain" else "broken" if kind == "broken" else "find"
                    out.append("no call" if want == "none" else f'<tool_call>{json.dumps({"name": want, "arguments": {"q": c[0]["content"][:3]}})}</tool_call> and <tool_call>not json</tool_call><tool_call>{{"name": "absent"}}')
                else:
                    out.append(f"say {len(c)} {'found' if 'find: hit' in c[0]['content'] else 'bare'}")
            return out

    def find(arguments):
        return [f"hit {a['q']}" for a in arguments]

    def broken(arguments):
        raise RuntimeError("down")

    return Asker, find, broken


def test_rollout_with_tools(spark):
    Asker, find, broken = helpers()
    tools = {"find": (synthesis.render_tool("find", "finds", {}), find), "broken": (synthesis.render_tool("broken", "fails", {}), broken)}
    df = spark.createDataFrame([(1, "ctx one", "p"), (2, "plain text", "p"), (3, "broken one", "p")], "id int, context string, prompt string")
    got = {}
    for r in synthesis.rollout(df, "id", Asker, rounds=2, tools_a=tools, tools_b=tools).orderBy("id", "turn").collect():
        got.setdefault(r.id, []).append((r.role, r.text, r.error))
    assert [x[0] for x in got[1]] == ["tool", "user", "tool", "assistant"] * 2
    assert got[1][0][1] == "find: hit ctx" and "found" in got[1][1][1]
    assert [x[0] for x in got[2]] == [x[0] for x in got[3]] == ["user", "assistant"] * 2
    assert "bare" in got[2][0][1] and "bare" in got[3][1][1]
    step = synthesis.tool_step(Asker(), tools, ["ctx", "broken"], [[{"role": "user", "content": "x"}]] * 2)
    assert step == [[("find", True, "hit ctx"), ("", False, "unreadable call"), ("absent", False, "unknown tool")], [("broken", False, "down"), ("", False, "unreadable call"), ("absent", False, "unknown tool")]]


def test_retrieval_as_a_tool(spark):
    chunks = spark.createDataFrame([(1, "a", 0, "red apples grow"), (2, "a", 1, "green pears"), (3, "a", 2, "apples and more apples"), (4, "b", 0, "nothing here at all")], "id long, doc string, idx int, chunk string")
    asked = spark.createDataFrame([(0, "apples"), (1, "bananas"), (2, "the")], "idx long, input string")
    got = {r.idx: (r.success, r.error, r.response) for r in retrieval.as_tool(asked, chunks.withColumnRenamed("idx", "i"), tx.retrieval_terms, "id", "doc", "i", "chunk", 2).collect()}
    assert got[0] == (True, None, f"red apples grow{retrieval.OMITTED}apples and more apples")
    assert got[1] == (True, None, "") and got[2] == (False, "nothing asked", None)


def test_chat_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/chat"
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", f"{tmp_path}/derby.log")
    con = spark._jvm.java.sql.DriverManager.getConnection(url + ";create=true")
    statement = con.createStatement()
    for sql in (
        "CREATE TABLE message (rid INT, text VARCHAR(99), sent INT, own INT, handle_id INT)", "CREATE TABLE link (chat_id INT, message_id INT)", "CREATE TABLE chat (rid INT, identifier VARCHAR(20), name VARCHAR(20))", "CREATE TABLE handle (rid INT, contact VARCHAR(20))",
        "INSERT INTO message VALUES (1, 'hi', 10, 1, 0), (2, 'hello', 11, 0, 7), (3, NULL, 12, 0, 7), (4, 'lone', 13, 0, 9)", "INSERT INTO link VALUES (5, 1), (5, 2), (5, 3), (6, 4)", "INSERT INTO chat VALUES (5, 'id5', ''), (6, 'id6', 'six')", "INSERT INTO handle VALUES (7, 'ann')",
    ):
        statement.executeUpdate(sql)
    con.close()
    messages = "SELECT m.rid AS message_id, l.chat_id AS chat_id, m.text AS text, m.sent AS sent, m.own AS own, m.handle_id AS handle_id FROM message m JOIN link l ON l.message_id = m.rid"
    read = lambda least: sorted(tuple(r) for r in chats.read_chats(spark, url, messages, "SELECT rid AS chat_id, identifier, name FROM chat", "SELECT rid AS handle_id, contact FROM handle", least).collect())
    assert read(1) == [(5, "id5", 1, 10, "me", "hi"), (5, "id5", 2, 11, "ann", "hello"), (6, "six", 4, 13, "unknown", "lone")]
    assert [r[2] for r in read(2)] == [1, 2]
    assert chats.read_query(spark, url, "SELECT rid, sent FROM message", "RID", (1, 4), 2).rdd.getNumPartitions() == 2


def test_repository_levels(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "sub").mkdir(parents=True)
    for name, text in {"__init__.py": "", "base.py": "import os\n", "mid.py": "from pkg.base import x\n", "top.py": "from . import mid\nimport pkg.sub.deep\n", "sub/__init__.py": "", "sub/deep.py": "from ..base import y\n", "broken.py": "def ("}.items():
        (root / name).write_text(text)
    got = {r.module: r.level for r in files.read_repository(spark, str(root), "pkg").collect()}
    assert {k: v for k, v in got.items() if k in ("pkg.base", "pkg.mid", "pkg.top", "pkg.sub.deep", "pkg.broken")} == {"pkg.base": 0, "pkg.broken": 0, "pkg.mid": 1, "pkg.sub.deep": 1, "pkg.top": 2} or got["pkg.top"] > got["pkg.mid"] > got["pkg.base"]
    assert "pkg.top" not in {r.module for r in files.read_repository(spark, str(root), "pkg", 1).collect()}
    with pytest.raises(ValueError, match="cycle"):
        nodes = spark.createDataFrame([("a",), ("b",)], "module string")
        graphs.module_levels(nodes, spark.createDataFrame([("a", "b"), ("b", "a")], "module string, imports string")).collect()


def test_incremental_refresh(spark, tmp_path):
    path = f"{tmp_path}/store"

    def get(k):
        if k == 3:
            raise KeyError("gone")
        return f"body {k}"

    listed = lambda rows: spark.createDataFrame(rows, "id long, version string")
    now = lambda x: None
    table, failed = remote.refresh(path, listed([(1, "a"), (2, "a"), (3, "a")]), "id", "version", get, attempts=2, sleep=now)
    assert sorted(map(tuple, table.collect())) == [(1, "a", "body 1"), (2, "a", "body 2")]
    assert [r.id for r in failed.collect()] == [3]
    table, failed = remote.refresh(path, listed([(2, "b"), (4, "a")]), "id", "version", lambda k: f"new {k}", attempts=1, sleep=now)
    assert sorted(map(tuple, table.collect())) == [(1, "a", "body 1"), (2, "b", "new 2"), (4, "a", "new 4")] and not failed.count()


def test_fetches_are_tried_again_and_pages_fail_alone(spark):
    def flaky(k):
        flaky.__dict__.setdefault("seen", {})
        flaky.seen[k] = flaky.seen.get(k, 0) + 1
        if flaky.seen[k] < 3:
            raise OSError("again")
        return str(k)

    got = remote.fetch(spark.range(3).coalesce(1), "id", flaky, attempts=3, threads=1, sleep=lambda x: None).collect()
    assert sorted((r.id, r.content, r.error) for r in got) == [(0, "0", None), (1, "1", None), (2, "2", None)]

    def page(row, token):
        if row["label"] == "bad":
            raise OSError("down")
        return [{"label": row["label"], "i": 1}], None

    plan = spark.createDataFrame([("x",), ("bad",)], "label string")
    got = remote.list_pages(plan, page, "label string, i long", attempts=2, sleep=lambda x: None).collect()
    assert sorted((str(r.label), r.i, r.error) for r in got) == [("None", None, "down"), ("x", 1, None)]


def test_configs_and_run_folders(spark, tmp_path):
    for folder, text in {"a": "x: 1", "b/run": "x: 2"}.items():
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "config.yaml").write_text(text)
    (tmp_path / "a" / "my_config.yaml").write_text("no")
    found = catalogs.run_folders(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [("a", "x: 1"), ("b/run", "x: 2")]
    paths = spark.createDataFrame([("a/d.parquet",), ("a/sub/d.parquet",), ("b/run/s/t/d.parquet",), ("d.parquet",)], "path string")
    got = {r.path: (r.config, r.config_folder) for r in catalogs.with_config(paths, found).collect()}
    assert got == {"a/d.parquet": ("x: 1", "a"), "a/sub/d.parquet": ("x: 1", "a"), "b/run/s/t/d.parquet": (None, None), "d.parquet": (None, None)}


def test_sources_of_several_kinds(spark, tmp_path):
    (tmp_path / "one.txt").write_text("x <a>in</a> y")
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "two.md").write_text("two")
    sources = [{"kind": "text", "text": "raw", "name": "t"}, {"kind": "file", "path": f"{tmp_path}/one.txt"}, {"kind": "folder", "path": f"{tmp_path}/f", "extensions": [".md"]}, {"kind": "url", "url": "http://u"}, {"kind": "pdf", "url": "http://p"}, {"kind": "section", "of": {"kind": "file", "path": f"{tmp_path}/one.txt"}, "start": "<a>", "end": "</a>"}]
    got = [r.text for r in catalogs.read_sources(spark, sources, fetch=lambda u: u.encode(), pdf_text=lambda d: "pdf " + d.decode()).collect()]
    assert got == ["raw", "x <a>in</a> y", "two", "http://u", "pdf http://p", "<a>in</a>"]
    for bad in ([{"kind": "zip"}], [{"kind": "url", "url": "x"}], [{"kind": "pdf", "path": "x"}], []):
        with pytest.raises(ValueError):
            catalogs.read_sources(spark, bad)
    tree = files.read_tree(spark, str(tmp_path))
    assert catalogs.one_file(tree, 1).count() == 1 and catalogs.one_file(tree, 1).first() == catalogs.one_file(tree, 1).first()


def test_archives_are_unpacked_safely(spark, tmp_path):
    held = io.BytesIO()
    with tarfile.open(fileobj=held, mode="w:gz") as tar:
        for name in ("main.tex", "../evil.tex", "/abs.tex", "sub/x.tex", "fig.png"):
            data = f"in {name}".encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
        link = tarfile.TarInfo("link.tex")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        tar.addfile(link)
    rows = [("t", held.getvalue()), ("g", gzip.compress(b"alone")), ("bad", b"junk")]
    got = sorted((r.archive, str(r.path), r.text, bool(r.error)) for r in catalogs.unpack_archives(spark.createDataFrame(rows, "archive string, content binary"), (".tex",)).collect())
    assert got == [("bad", "None", None, True), ("g", "g", "alone", False), ("t", "main.tex", "in main.tex", False), ("t", "sub/x.tex", "in sub/x.tex", False)]

    whole = io.BytesIO()
    with tarfile.open(fileobj=whole, mode="w:gz") as tar:
        for i in range(40):
            info = tarfile.TarInfo(f"{i}.tex")
            data = bytes((i * j * 7919) % 251 for j in range(4000))
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    cut = whole.getvalue()[: len(whole.getvalue()) // 2]
    rows = [("cut", cut), ("cut gz", gzip.compress(bytes(range(256)) * 99)[:200]), ("none", None), ("t", held.getvalue())]
    got = catalogs.unpack_archives(spark.createDataFrame(rows, "archive string, content binary")).collect()
    assert {r.archive for r in got if r.error} == {"cut", "cut gz", "none"} and {r.path for r in got if r.archive == "t"} == {"main.tex", "sub/x.tex", "fig.png"}

    stored = dict(rows)

    def fetch(name):
        if name == "away":
            raise OSError("not there")
        return stored[name]

    asked = spark.createDataFrame([("t",), ("away",), (None,), ("cut",)], "archive string")
    got = catalogs.fetch_archives(asked, fetch, (".tex",), sleep=lambda s: None).collect()
    assert {(r.archive, r.error) for r in got if r.archive == "away"} == {("away", "not there")} and sorted(r.path for r in got if r.archive == "t") == ["main.tex", "sub/x.tex"]
    assert sum(bool(r.error) for r in got if r.archive == "cut") == 1
    failed = catalogs.read_source(spark, {"kind": "url", "url": "away"}, fetch=fetch).collect()
    assert [(r.name, r.text, r.error) for r in failed] == [("away", None, "not there")]


def test_json_folders_and_uploads(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    catalogs.write_json(rows, f"{tmp_path}/j", F.substring(F.sha2(F.col("s").cast("binary"), 256), 1, 8))
    assert sorted(r.i for r in spark.read.json(f"{tmp_path}/j").collect()) == [1, 2] and len(list((tmp_path / "j").glob("config=*"))) == 2
    folder = tmp_path / "up"
    (tmp_path / "run" / "s").mkdir(parents=True)
    folder.mkdir()
    for name in ("a.txt", "s/b.txt", "s/c.pt"):
        (tmp_path / "run" / name).write_text(name)
    base = str(folder)

    def put(path, content):
        if path == "a.txt":
            raise OSError("full")
        with open(f"{base}/{path.replace('/', '_')}", "wb") as f:
            f.write(content)

    got = sorted((r.path, r.error) for r in catalogs.upload_folder(spark, f"{tmp_path}/run", put, (".pt",)).collect())
    assert got == [("a.txt", "full"), ("s/b.txt", None)] and (folder / "s_b.txt").read_text() == "s/b.txt"


def test_mail_users(spark, tmp_path):
    for i in range(12):
        d = tmp_path / f"u{i:02d}" / ("inbox" if i % 2 else "sent")
        d.mkdir(parents=True)
        (d / "1.").write_text(f"From: u{i}\nDate: Mon, 14 May 2001 16:39:00 -0700\n\nbody {i}")
    users = lambda **k: sorted(r.user_id for r in mail.read_maildir(spark, str(tmp_path), **k).collect())
    assert users() == [f"u{i:02d}" for i in range(10)] and len(users(first_users=None)) == 12 and users(users=["u11"]) == ["u11"]
    assert users(selected=spark.createDataFrame([("u01", "inbox"), ("u02", "inbox")], "user_id string, folder string")) == ["u01"]
    assert users(selected=spark.createDataFrame([("u10",)], "user_id string")) == ["u10"]


def test_patient_items_and_row_counts(spark, tmp_path):
    item = {"No": 0, "question": "q?", "correct": "b", **{f"answer_{x}": x for x in "abcde"}}
    (tmp_path / "l.json").write_text(json.dumps({"p1": {"questions": [item, {**item, "No": 1}]}, "p2": {"questions": [item]}}))
    got = files.patient_items(spark, f"{tmp_path}/l.json", ["p1"])
    assert sorted((r.question_id, r.options, r.correct) for r in got.collect()) == [("p1_0", list("abcde"), "b"), ("p1_1", list("abcde"), "b")]
    assert files.expect_rows(got, 2) is got
    for n in (1, 3):
        with pytest.raises(ValueError):
            files.expect_rows(got, n)


def test_prompts(spark):
    rows = spark.createDataFrame([(1, "a grammar", "G"), (2, "a word list", "W")], "i int, what string, text string")
    assert prompts.reference_prompt(rows, "i", F.col("what"), F.col("text")).first().prompt == "You are given a grammar, a word list.\n\nG\n\nW"
    df = spark.createDataFrame([("d", list("abcdef"))], "d string, w array<string>")
    assert df.select(prompts.described_window(F.col("d"), F.col("w"), 2, 2, F.lit(0.0), F.lit(0.99)).alias("x")).first().x == "d\n\ne f"
    with pytest.raises(ValueError):
        prompts.varied_prompts(rows, "i", ("nonsense",), 1, 1)
    batches = spark.createDataFrame([(0,), (1,)], "batch_id long")
    told = temporal.batch_prompt(batches, spark.createDataFrame([(0, "ctx")], "batch_id long, text string"), temporal.later_batches(batches))
    assert {r.batch_id: r.prompt for r in told.collect()} == {0: "ctx\n\nWhat comes after batch 0 isn't known yet: 1 more.", 1: "\n\nThis is the last batch."}
    with pytest.raises(Exception, match="unknown haystack"):
        df.select(prompts.haystack_source(F.lit("x"), F.col("w"), F.lit("n"), F.lit("k"), F.lit(1))).collect()


def test_runs(spark):
    assert runs.wide_runs(spark.createDataFrame([("r", None, "{}")], "id string, config string, summary string"), "id", ["config", "summary"]).columns == ["id"]
    with pytest.raises(ValueError):
        runs.wide_runs(spark.createDataFrame([("r", '{"a": 1, "b": 2}')], "id string, config string"), "id", ["config"], most=1)
    versions = spark.createDataFrame([("c", "v2", ["best"]), ("c", "v10", []), ("c", "draft", [])], "c string, version string, aliases array<string>")
    pick = lambda w: [r.version for r in runs.resolve_version(versions, ["c"], "version", w).collect()]
    assert (pick("latest"), pick("best"), pick("v2")) == (["v10"], ["v2"], ["v2"])
    assert runs.loss_eval({"a": spark.createDataFrame([(-1.0, -2.0)], "teacher double, student double")}, step=3, every=2).count() == 0
    rows, means = runs.generation_eval(spark.createDataFrame([(1, "p", "a"), (2, "q", "b")], "id int, prompt string, answer string"), "id", "answer", 3, helpers()[0], lambda p, a: F.contains(p, F.lit("say")), 7)
    m = means.first()
    assert (rows.count(), m.n, m.n_failed, m.mean_score, m.step) == (6, 6, 0, 1.0, 7)


def test_merges_are_uniform(spark):
    """Of two lists of two, all six merges come about equally often."""
    rows = [(k, g, i) for k in range(600) for g in "ab" for i in range(2)]
    df = spark.createDataFrame(rows, "k int, g string, i int")
    counts = {}
    for seed in range(40):
        placed = benchmarks.interleave(df.where(f"k = {seed}"), "g", "i", ["k", "g", "i"], seed).orderBy("place").collect()
        assert [r.i for r in placed if r.g == "a"] == [r.i for r in placed if r.g == "b"] == [0, 1]
        counts["".join(r.g for r in placed)] = counts.get("".join(r.g for r in placed), 0) + 1
    assert len(counts) == 6


def test_late_rows_are_left_out_and_state_is_kept(spark, tmp_path):
    """Four files are four batches: a row later than the watermark of the batch before is dropped; states go on from batch to batch."""
    schema = "event_id long, user_id long, event_type string, ts timestamp"
    times = [[(1, 1, "a", "2024-01-01 00:00:00"), (2, 1, "b", "2024-01-01 01:00:00")], [(3, 1, "b", "2024-01-09 00:00:00"), (4, 2, "a", "2024-01-09 00:00:00")], [(7, 2, "a", "2024-01-09 06:00:00")], [(5, 1, "a", "2024-01-01 02:00:00"), (6, 1, "c", "2024-01-09 05:00:00")]]
    for i, rows in enumerate(times):
        spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts string").selectExpr("event_id", "user_id", "event_type", "timestamp(ts) AS ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/b{i}")
    for i in range(4):  # files are taken by their time
        for f in (tmp_path / "in" / f"b{i}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    counted = events.run_to_table(events.window_counts(source().withColumn("value", F.lit(1.0)), "1 day", "1 day", [], value="value"), f"{tmp_path}/w", "append")
    assert {(r.window_start, r.n) for r in counted.collect()} == {("2024-01-01 00:00:00", 2)}
    told = events.run_to_table(events.streaks(source(), "user_id", "30 days"), f"{tmp_path}/s", "update")
    last = {r.user_id: tuple(r.s) for r in told.groupBy("user_id").agg(F.max_by(F.struct("n", "changes", "last"), "epoch").alias("s")).collect()}
    assert last[2] == (2, 0, "a") and last[1][0] == 5 and told.select("epoch").distinct().count() == 4


def test_many_lines_in_one_document_fill_sections_as_a_loop_would(spark):
    from random import Random

    rng = Random(3)
    sizes = [rng.randrange(1, 60) for _ in range(20_000)]
    lines = spark.createDataFrame([(1, i, f"l{i}", n) for i, n in enumerate(sizes)], "d int, i int, t string, n int").repartition(5)
    want, used = [[]], 0
    for i, n in enumerate(sizes):
        if used + n + 20 > 100:
            want.append([])
            used = 0
        want[-1].append(i)
        used += n
    got = tokens.fill_sections(lines, ["d"], "i", "t", "n", 100).orderBy("section").collect()
    assert [(r.section, r.n_sections, r.content, r.tokens) for r in got] == [(k + 1, len(want), "\n".join(f"l{i}" for i in s), sum(sizes[i] for i in s)) for k, s in enumerate(want)]


def test_documents_are_walked_by_many_tasks(spark):
    """Few row groups don't make few tasks: rows are dealt out before JSON is walked."""
    from corvane.plans import workflows
    from corvane.plans.registry import Tables

    plan = workflows._event_documents(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(event_id" in plan
