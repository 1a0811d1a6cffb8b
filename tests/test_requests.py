"""Requests to slow, failing, hanging and paced clients; replies with log-probabilities."""

import asyncio
import math
import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from corvane.operators import requests as rq, synthesis

CHAT = "id int, chat array<struct<role: string, content: string>>"


def say(*texts):
    return [("system", "s"), *(("user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts))]


def test_each_row_has_its_answer_or_its_own_error(spark):
    class Mixed:
        def __init__(self):
            self.flying = self.most = 0
            self.tries = {}

        async def complete(self, chat):
            self.flying += 1
            self.most = max(self.most, self.flying)
            try:
                text = chat[-1]["content"]
                await asyncio.sleep(0.02)
                n = self.tries[text] = self.tries.get(text, 0) + 1
                if text.startswith("bad"):
                    raise RuntimeError(f"no {text}")
                if text.startswith("hang"):
                    await asyncio.sleep(3600)
                if text.startswith("once") and n == 1:
                    raise ConnectionError("again")
                return rq.Reply(f"{text} {self.most}")
            finally:
                self.flying -= 1

    async def at_once(_):
        return None

    texts = [f"{kind}{i}" for i in range(12) for kind in ("good", "bad", "hang", "once")]
    df = spark.createDataFrame([(i, say(t)) for i, t in enumerate(texts)] + [(98, []), (99, None)], CHAT).coalesce(1)
    began = time.monotonic()
    got = rq.ask(df, Mixed, in_flight=5, timeout=0.5, attempts=2, sleep=at_once).collect()
    assert time.monotonic() - began < 60
    assert [r.id for r in got] == [*range(48), 98, 99]
    for r in got[:48]:
        text = texts[r.id]
        if text.startswith(("bad", "hang")):
            assert r.reply is None and r.attempts == 2 and r.error == (f"no {text}" if text[0] == "b" else "no answer in 0.5 s")
        else:
            assert r.error is None and r.attempts == (2 if text[0] == "o" else 1) and r.reply.content.split(" ")[0] == text
            assert int(r.reply.content.split(" ")[1]) <= 5 and r.reply.role == "assistant" and r.reply.token_ids is None
    assert {(r.error, r.attempts) for r in got[48:]} == {("nothing asked", 0)}


def test_a_long_chat_loses_its_oldest_messages(spark):
    class Short:
        async def complete(self, chat):
            if len(chat) > 3 or "huge" in chat[-1]["content"]:
                raise rq.Overflow
            return "|".join(m["content"] for m in chat)

    df = spark.createDataFrame([(0, say("a", "b", "c", "d")), (1, say("huge")), (2, say("a", "huge"))], CHAT)
    got = {r.id: (r.reply.content if r.reply else None, r.error) for r in rq.ask(df, Short).collect()}
    assert got == {0: ("s|c|d", None), 1: (None, "too long for the model"), 2: (None, "too long for the model")}


def test_all_tasks_together_stay_below_the_limit(spark):
    folder = tempfile.mkdtemp()

    class Logging:
        async def complete(self, chat):
            with open(f"{folder}/{os.getpid()}-{id(self)}", "a") as f:
                print(time.time(), file=f)
            return "x"

    df = spark.range(60).select(F.col("id").cast("int"), F.array(F.struct(F.lit("user").alias("role"), F.lit("q").alias("content"))).alias("chat")).repartition(8)
    limit = rq.Limit(18, window=1.0, tasks=8)
    assert limit.shares() == (8, 2) and rq.Limit(3, tasks=8).shares() == (3, 1)
    assert rq.ask(df, Logging, limit=limit, in_flight=50).where("error IS NULL").count() == 60
    times = sorted(float(x) for name in os.listdir(folder) for x in open(f"{folder}/{name}"))
    assert len(times) == 60
    assert all(times[i + 18] - times[i] > 0.95 for i in range(42))
    with pytest.raises(ValueError):
        rq.Limit(0).shares()


def test_thinning():
    top = [(7, math.log(0.5)), (8, math.log(0.3)), (9, math.log(0.1))]
    assert rq.thinned(top, 0.79) == top[:2] and rq.thinned(top, 0.95) == top[:1] and rq.thinned([], 0.5) == []
    message = rq.as_message(rq.Reply("a b", [1, 2], [top, top[:1]]), 0.79)
    assert message["top_logprobs"]["token_idx"] == [0, 0, 1] and message["top_logprobs"]["token_id"] == [7, 8, 7] and message["top_logprobs"]["shape"] == [2, 2]
    assert rq.as_message("plain", 0.9)["top_logprobs"] is None and rq.as_message(rq.Reply("", [], []), 0.9)["top_logprobs"]["shape"] == [0, 0]


def test_from_reply_to_training_element(spark):
    df = spark.createDataFrame([(1, say("one two three four"), [5, 6]), (2, say("x"), None)], CHAT + ", prompt_ids array<int>")
    asked = rq.ask(df, rq.WordClient, mass=0.9)
    path = tempfile.mkdtemp() + "/talks"
    rq.conversations(asked, "id").join(df.select("id", "prompt_ids"), "id").write.parquet(path)
    got = {r.id: r for r in rq.elements(spark.read.parquet(path), "id", "prompt_ids").collect()}
    assert got[1].input_ids == [5, 6, 3, 3, 5, 4] and got[2].input_ids == [1]
    assert [(t.token_idx, t.token_id) for t in got[1].targets] == [(2, 3), (3, 3), (3, 4), (4, 5), (4, 6), (4, 7), (5, 4)]
    assert got[1].targets[1].logprob == pytest.approx(math.log(0.6), abs=1e-6)


def test_one_bad_talk_leaves_the_others(spark):
    class Picky:
        def chat(self, chats):
            if any("poison" in m["content"] for c in chats for m in c):
                raise RuntimeError("poisoned")
            return ["fine"] * len(chats)

    prompts = spark.createDataFrame([(i, "poison" if i == 3 else "ctx", "p") for i in range(10)], "k int, context string, prompt string").coalesce(1)
    got = synthesis.rollout(prompts, "k", Picky, rounds=2).collect()
    assert {(r.k, r.error) for r in got if r.error} == {(3, "poisoned")}
    assert all(sum(r.k == i and r.text == "fine" for r in got) == 4 for i in range(10) if i != 3)


def test_a_call_without_a_name_is_unreadable(spark):
    class Caller:
        def chat(self, chats):
            return ['<tool_call>{"name": [], "arguments": {}}</tool_call>'] * len(chats)

    assert synthesis.tool_step(Caller(), {"find": ("d", lambda a: ["x"] * len(a))}, ["c"], [[]]) == [[("", False, "unreadable call")]]
