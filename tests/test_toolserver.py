"""Tool servers: allow-lists, checked arguments, sessions that break, tools in rollouts."""

import os
import tempfile

import pytest

from corvane.operators import synthesis
from corvane.sources.toolserver import READING_CHAT_TOOLS, TextServer, ToolServer, call_tools


def test_calls_are_rows_and_broken_sessions_are_opened_again(spark):
    folder, reading, numbers = tempfile.mkdtemp(), READING_CHAT_TOOLS, {"type": "object", "properties": {"n": {"type": "integer"}, "tags": {"type": "array"}}, "required": ["n"]}

    class Breaking:
        """Its sessions die at every second call; opens are logged in a folder."""

        def __init__(self):
            with open(f"{folder}/{os.getpid()}-{id(self)}", "a") as f:
                print("open", file=f)
            self.calls = 0

        def list_tools(self):
            return [{"name": n, "parameters": numbers} for n in (*reading, "slack_post_message", "never")]

        def call(self, name, arguments):
            self.calls += 1
            if self.calls > 1 or name == reading[4]:
                raise ConnectionError("session is gone")
            return {"tool": name, "n": arguments["n"]}

    server = ToolServer(Breaking, READING_CHAT_TOOLS, sleep=lambda _: None)
    assert [r.tool for r in server.catalogue(spark).collect()] == sorted(READING_CHAT_TOOLS)
    first, last = READING_CHAT_TOOLS[0], READING_CHAT_TOOLS[4]
    rows = [
        *((i, first, f'{{"n": {i}}}') for i in range(20)), (20, "slack_post_message", '{"n": 1}'), (21, first, "{}"), (22, first, '{"n": "x"}'), (23, first, '{"n": true}'),
        (24, first, "nope"), (25, first, "[1]"), (26, first, None), (27, None, "{}"), (28, last, '{"n": 1}'), (29, first, '{"n": 1, "tags": 3}'),
    ]
    df = spark.createDataFrame(rows, "id int, tool string, arguments string")
    got = {r.id: (r.response, r.error) for r in call_tools(df, server).collect()}
    assert len(got) == 30 and all(got[i] == (f'{{"tool": "{first}", "n": {i}}}', None) for i in range(20))
    assert [got[i][1] for i in range(20, 30)] == [
        "not an allowed tool", "missing argument: n", "argument n is not of type integer", "argument n is not of type integer", "arguments are not JSON",
        "arguments are not an object", "missing argument: n", "not an allowed tool", "session is gone", "argument tags is not of type array",
    ]
    assert call_tools(df.limit(0), server).columns == ["id", "tool", "arguments", "response", "error"] and call_tools(df.limit(0), server).count() == 0
    assert len(os.listdir(folder)) > 2
    with pytest.raises(ValueError):
        ToolServer(Breaking, ("absent",))


def test_tools_of_a_server_in_a_talk(spark):
    class Caller:
        def chat(self, chats):
            said = []
            for c in chats:
                bad = "bad" in c[0]["content"]
                said.append('<tool_call>{"name": "dashed", "arguments": {"text": %s}}</tool_call><tool_call>{"name": "drop", "arguments": {}}</tool_call>' % ("7" if bad else '"a b"'))
            return said

    tools = ToolServer(TextServer, ("dashed",)).tools()
    assert list(tools) == ["dashed"] and "dashed of a text" in tools["dashed"][0]
    done = synthesis.tool_step(Caller(), tools, ["good", "bad"], [[], []])
    assert done == [[("dashed", True, "a-b"), ("drop", False, "unknown tool")], [("dashed", False, "argument text is not of type string"), ("drop", False, "unknown tool")]]
    prompts = spark.createDataFrame([(i, "bad" if i == 1 else "good", "p") for i in range(3)], "k int, context string, prompt string")
    assert synthesis.rollout(prompts, "k", Caller, rounds=1, tools_b=tools).where("error IS NOT NULL").count() == 0
