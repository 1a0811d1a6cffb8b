import base64
import pickle

import pytest
from pyspark.sql import functions as F

from corvane.schemas import CONVERSATION
from corvane.sources import conversations, files, mail, remote
from corvane.streaming import events


def chats(spark, n=3):
    rows = [([{"content": f"q{i}", "role": "user", "token_ids": None, "top_logprobs": None}, {"content": "a", "role": "assistant", "token_ids": [1], "top_logprobs": {"token_idx": [0], "token_id": [5], "logprobs": [-0.5], "shape": [1, 1]}}], "s", {"k": "v"}, "t") for i in range(n)]
    return spark.createDataFrame(rows, CONVERSATION)


def test_conversations_round_trip(spark, tmp_path):
    path = f"{tmp_path}/c.parquet"
    conversations.write(chats(spark), path)
    back = conversations.read(spark, path)
    assert back.schema == CONVERSATION and sorted(map(str, back.collect())) == sorted(map(str, chats(spark).collect()))
    assert conversations.read_many(spark, [path, {"path": path, "limit": 1}]).count() == 4
    assert conversations.read_many(spark, ["org/repo"], fetch=lambda s: [path]).count() == 3
    with pytest.raises(ValueError):
        conversations.read(spark, "x.csv")
    with pytest.raises(ValueError):
        conversations.read_many(spark, ["org/repo"])


def test_pickles_need_trust(spark, tmp_path):
    rows = [{"messages": [{"content": "q", "role": "user"}], "system_prompt": "s", "metadata": {"n": 1}, "type": None}]
    (tmp_path / "c.pkl").write_bytes(pickle.dumps({"rows": rows}))
    with pytest.raises(ValueError):
        conversations.read(spark, f"{tmp_path}/c.pkl")
    row = conversations.read(spark, f"{tmp_path}/c.pkl", trusted_pickle=True).first()
    assert row.messages[0].content == "q" and row.metadata == {"n": "1"}


def test_preview_and_catalog(spark, tmp_path):
    nested = chats(spark).withColumn("id", F.monotonically_increasing_id())
    p = conversations.preview(nested, "id", "messages", rows=2, width=3).collect()
    assert len(p) == 2 and p[0].message_1 == "a" and p[0].message_2 is None
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.pkl").write_bytes(b"x")
    (tmp_path / "d/empty.parquet").write_bytes(b"")
    (tmp_path / "d/note.txt").write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[1] for r in conversations.catalog(spark, f"{tmp_path}/d").collect()] == ["a.pkl"]


def test_trees(spark, tmp_path):
    for name, data in {"a.py": b"import os, sys.path\nfrom json import x\nfrom . import y\n", "b.txt": "é".encode("latin-1"), "c/d.yaml": "ü: 1".encode(), "e.exe": b"\x00\x01", "p.tex": b"a % c\nb"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path: r.text for r in files.read_tree(spark, str(tmp_path), (".py", ".txt", ".yaml", ".exe")).collect()}
    assert got["b.txt"] == "é" and got["c/d.yaml"] == "ü: 1" and got["e.exe"].startswith("[binary") and set(got) == {"a.py", "b.txt", "c/d.yaml", "e.exe"}
    assert set(r.path for r in files.read_tree(spark, str(tmp_path), (".yaml", ".py"), recursive=False).collect()) == {"a.py"}
    text = files.tree_as_text(files.read_tree(spark, str(tmp_path), (".py", ".yaml"))).first().text
    assert text.index("File: a.py") < text.index("File: c/d.yaml") and "```python" in text
    assert files.read_latex(spark, str(tmp_path)).first().text == "% p.tex\na\nb"
    assert files.imports_of("import os, sys.path\nfrom json import x\nfrom . import y") == ["json", "os", "sys"] and files.imports_of("def") == []


def test_json_readers(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"columns": ["a", "b"], "data": [[1, "x"], [2, null]]}')
    assert [(r.row, r.column, r.value) for r in files.read_table_json(spark, f"{tmp_path}/t.json").collect()] == [(0, "a", "1"), (0, "b", '"x"'), (1, "a", "2"), (1, "b", "null")]
    (tmp_path / "q.json").write_text('{"p": [{"question": "q0", "answer": "a0"}, {"question": "q1", "answer": "a1"}]}')
    assert [r.question for r in files.question_items(spark, f"{tmp_path}/q.json", skip_first=True).collect()] == ["q1"]
    assert files.read_json_documents(spark, f"{tmp_path}/q.json").select(F.try_variant_get("document", "$.p[1].answer", "string").alias("a")).first().a == "a1"


def test_mail(spark, tmp_path):
    for i in range(3):
        (tmp_path / "ann/inbox").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"ann/inbox/{i}").write_text(f"From: a@b.c\nTo: d@e.f\nSubject: s{i}\nDate: Mon, 1 Jan 2001 0{i}:00:00 +0000\n\nbody {i}\n")
    (tmp_path / "bob/sent").mkdir(parents=True)
    (tmp_path / "bob/sent/1").write_text('Content-Type: multipart/mixed; boundary="x"\nDate: never\n\n--x\nContent-Type: text/plain\n\none\n--x\nContent-Type: text/html\n\n<p>no</p>\n--x--\n')
    got = mail.read_maildir(spark, str(tmp_path), per_user=2).orderBy("path").collect()
    assert [(r.user_id, r.folder, r.subject, r.body.strip()) for r in got] == [("ann", "inbox", "s0", "body 0"), ("ann", "inbox", "s1", "body 1"), ("bob", "sent", "", "one")]
    assert got[1].parsed_date.hour == 1 and got[2].parsed_date is None
    assert mail.read_maildir(spark, str(tmp_path), users=["bob"]).count() == 1
    b64 = lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")
    payload = {"parts": [{"mimeType": "text/plain", "body": {"data": b64("short")}}, {"mimeType": "multipart/x", "parts": [{"mimeType": "text/html", "body": {"data": b64("<p>a longer  text</p>")}}]}]}
    assert mail.body_of_payload(payload) == "a longer text" and mail.body_of_payload({}) == ""


def test_remote(spark):
    plan = spark.createDataFrame([("x", 3), ("y", 1)], "label string, n long")
    page = lambda row, token: ([{"label": row["label"], "i": int(token or 0)}], str(int(token or 0) + 1) if int(token or 0) + 1 < row["n"] else None)
    assert sorted(map(tuple, remote.list_pages(plan, page, "label string, i long").drop("error").collect())) == [("x", 0), ("x", 1), ("x", 2), ("y", 0)]

    def get(k):
        if k == 2:
            raise KeyError("gone")
        return f"v{k}"

    assert [(r.id, r.content, r.error) for r in remote.fetch(spark.range(3), "id", get).orderBy("id").collect()] == [(0, "v0", None), (1, "v1", None), (2, None, "'gone'")]
    calls, waits = [], []
    assert remote.with_retry(lambda: calls.append(1) or (1 / (len(calls) - 2 or 0) if len(calls) == 2 else "ok") if len(calls) != 1 else "ok", sleep=waits.append) == "ok"
    now = [0.0]
    limit = remote.RateLimiter(2, 10, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(3):
        limit.wait()
    assert now[0] == 10


def test_stream_upsert(spark, tmp_path):
    for i, rows in enumerate(([(1, "a", 1), (2, "b", 1)], [(1, "c", 2)])):
        spark.createDataFrame(rows, "k long, v string, t long").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    table = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(table.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    events.upsert_each_batch(source, f"{tmp_path}/out", ["k"], [F.desc("t")], f"{tmp_path}/cp")
    assert {r.k: r.v for r in events.read_upserted(spark, f"{tmp_path}/out", table.schema).collect()} == {1: "c", 2: "b"}
    assert len(list((tmp_path / "out" / "v=1").glob("part=*"))) == 1  # only what the second batch touches
    assert events.read_upserted(spark, f"{tmp_path}/none", table.schema).count() == 0


def test_preview_of_all_conversations_has_no_limit(spark):
    from corvane.plans import catalog

    plan = catalog.QUERIES["conversation_preview"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan and "Sort [" not in plan
