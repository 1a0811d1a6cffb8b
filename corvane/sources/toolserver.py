"""Tool servers as sources: calls are rows, answers are rows, and only the tools of an allow-list are reached.

A server is reached through a session that the caller's ``connect`` opens: once
in a worker process, again after a failure.  Sessions never leave their process.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame

from corvane.functions.arithmetic import back_off
from corvane.operators.synthesis import Tool, render_tool
from corvane.runtime import ship

#: The tools of a workspace chat server that only read.
READING_CHAT_TOOLS = ("slack_list_channels", "slack_get_channel_history", "slack_get_thread_replies", "slack_get_users", "slack_get_user_profile")

_KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}
#: Open sessions of this process by server.
_OPEN: dict[str, Any] = {}


class Session(Protocol):
    def list_tools(self) -> list[dict]:
        """[{name, description, parameters}], parameters being a JSON schema."""

    def call(self, name: str, arguments: dict) -> str: ...


class Refused(Exception):
    """A call that is wrong in itself: trying it again doesn't help."""


class ToolServer:
    """The allowed tools of a server; ``allow`` None admits all that it lists.

    A name of the allow-list that the server doesn't have raises ValueError when the server is made.
    """

    def __init__(self, connect: Callable[[], Session], allow: tuple[str, ...] | None = None, attempts: int = 3, sleep: Callable[[float], None] = time.sleep):
        self.connect, self.attempts, self.sleep, self.mark = connect, attempts, sleep, uuid.uuid4().hex
        listed = {t["name"]: t for t in connect().list_tools()}
        if missing := sorted(set(allow or ()) - set(listed)):
            raise ValueError(f"the server has no tool {', '.join(missing)}")
        self.listed = {n: t for n, t in listed.items() if allow is None or n in allow}

    def _session(self) -> Session:
        if self.mark not in _OPEN:
            _OPEN[self.mark] = self.connect()
        return _OPEN[self.mark]

    def checked(self, name: str, arguments: Any) -> dict:
        """The arguments, if the tool is allowed and they are what its schema asks for; else Refused."""
        if name not in self.listed:
            raise Refused("not an allowed tool")
        if not isinstance(arguments, dict):
            raise Refused("arguments are not an object")
        schema = self.listed[name].get("parameters") or {}
        for field in schema.get("required", ()):
            if arguments.get(field) is None:
                raise Refused(f"missing argument: {field}")
        for field, value in arguments.items():
            kind = schema.get("properties", {}).get(field, {}).get("type")
            wanted = _KINDS.get(kind) if isinstance(kind, str) else None
            if wanted and value is not None and (not isinstance(value, wanted) or (kind in ("integer", "number") and isinstance(value, bool))):
                raise Refused(f"argument {field} is not of type {kind}")
        return arguments

    def call(self, name: str, arguments: Any) -> str:
        """The answer; a failing call is made again over a new session, and its last error is raised."""
        arguments = self.checked(name, arguments)
        for i in range(self.attempts):
            try:
                return self._session().call(name, arguments)
            except Exception:  # noqa: BLE001  a server may fail in any way
                _OPEN.pop(self.mark, None)
                if i == self.attempts - 1:
                    raise
                self.sleep(back_off(i))
        raise ValueError("a server needs at least one attempt")

    def tools(self) -> dict[str, Tool]:
        """The tools as ``synthesis.rollout`` takes them; a call that fails is an exception in its own place."""

        def of(name):
            def run(arguments: list) -> list:
                out = []
                for a in arguments:
                    try:
                        out.append(self.call(name, a))
                    except Exception as e:  # noqa: BLE001
                        out.append(e)
                return out

            return run

        return {n: (render_tool(n, t.get("description", ""), t.get("parameters") or {}), of(n)) for n, t in self.listed.items()}

    def catalogue(self, spark) -> DataFrame:
        """(tool, description, parameters): the allowed tools, parameters as JSON."""
        rows = [(n, t.get("description", ""), json.dumps(t.get("parameters") or {}, sort_keys=True)) for n, t in sorted(self.listed.items())]
        return spark.createDataFrame(rows, "tool string, description string, parameters string")


def call_tools(requests: DataFrame, server: ToolServer, tool: str = "tool", arguments: str = "arguments") -> DataFrame:
    """The rows with ``response`` and ``error``: one call a row, arguments as JSON text.

    A tool that isn't allowed, arguments that aren't what its schema asks for,
    and calls that fail for good are rows with an error.  Other columns are kept, and
    must not have these names.
    """
    ship(requests.sparkSession)
    names = requests.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + ", response string, error string"

    def one(name, text):
        try:
            try:
                given = json.loads(text) if text is not None else {}
            except ValueError:
                raise Refused("arguments are not JSON") from None
            answer = server.call(name, given)
            return answer if isinstance(answer, str) else json.dumps(answer), None
        except Exception as e:  # noqa: BLE001
            return None, str(e) or type(e).__name__

    def run(batches):
        for pdf in batches:
            done = [one(n, a) for n, a in zip(pdf[tool], pdf[arguments])]
            yield pdf[names].assign(response=pd.Series([r for r, _ in done], index=pdf.index, dtype=object), error=pd.Series([e for _, e in done], index=pdf.index, dtype=object))

    return requests.mapInPandas(run, schema)


class TextServer:
    """A stand-in with three tools on texts."""

    def list_tools(self) -> list[dict]:
        text = {"type": "object", "properties": {"text": {"type": "string"}}, "required": ["text"]}
        return [{"name": n, "description": f"{n} of a text", "parameters": text} for n in ("dashed", "count", "drop")]

    def call(self, name: str, arguments: dict) -> str:
        return arguments["text"].replace(" ", "-") if name == "dashed" else str(len(arguments["text"]))
