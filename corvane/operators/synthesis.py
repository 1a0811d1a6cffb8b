"""The dataflow around a language model; the model is a client that tasks call."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.functions.sampling import below, uniform


class Client(Protocol):
    """Answers a batch of chats, each a list of {role, content}."""

    def chat(self, chats: list[list[dict[str, str]]]) -> list[str]: ...


class EchoClient:
    """A deterministic stand-in: names the chat's length and a digest of it."""

    def chat(self, chats):
        return [f"reply {len(c)} {hashlib.md5(''.join(m['role'] + ':' + m['content'] for m in c).encode()).hexdigest()[:8]}" for c in chats]


#: What a seed prompt asks for, by kind.
SEED_PROMPTS = (
    ("structuring", "Ask to give a part of the context in a structured format."),
    ("summarization", "Ask for a summary of one section of the context."),
    ("question", "Ask a question whose answer stands in the context."),
    ("use_case", "Ask how the context would be used in practice."),
    ("creative", "Ask for something creative about the context."),
    ("generic", "Start a conversation about the context."),
    ("qa", "Ask one precise question and expect one precise answer."),
)


def plan_batches(spark: SparkSession, n: int, size: int) -> DataFrame:
    """(batch_id, batch_size): ceil(n / size) batches, the last one short."""
    return spark.range(-(-n // size)).select(F.col("id").alias("batch_id"), F.least(F.lit(size), F.lit(n) - F.col("id") * size).cast("bigint").alias("batch_size"))


def draw_seed_prompts(keys: DataFrame, key: str, draws: int, seed: int, kinds: tuple[str, ...] = tuple(k for k, _ in SEED_PROMPTS)) -> DataFrame:
    """(key, draw, kind, prompt): draws with replacement; an unknown kind raises ValueError."""
    table = dict(SEED_PROMPTS)
    if unknown := set(kinds) - set(table):
        raise ValueError(f"unknown kinds: {sorted(unknown)}")
    rows = keys.select(key, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    kind = F.element_at(F.array(*(F.lit(k) for k in kinds)), below(uniform(seed, key, "draw"), len(kinds)) + 1)
    prompts = F.create_map(*(F.lit(x) for k in kinds for x in (k, table[k])))
    return rows.withColumn("kind", kind).withColumn("prompt", prompts[F.col("kind")])


#: A tool: its definition for the prompt, and what answers a list of arguments, one output each.
Tool = tuple[str, Callable[[list[dict]], list[str]]]


def tool_step(model: Client, tools: dict[str, Tool], contexts: list[str], talks: list[list[dict]]) -> list[list[tuple[str, bool, str]]]:
    """(tool, success, output or error) of the calls that the model makes for each talk, in its order.

    The model is asked once for all talks; calls of one tool run as one batch,
    and each output goes to the talk that asked. An unknown tool, arguments that
    aren't JSON, a tool that fails and outputs that are exceptions give errors for those calls alone.
    """
    listed = "\n".join(definition for definition, _ in tools.values())
    asked = [[{"role": "system", "content": f"{c}\n\nTools:\n{listed}\nAnswer with <tool_call>{{\"name\": ..., \"arguments\": ...}}</tool_call>, or without one."}, *t] for c, t in zip(contexts, talks)]
    out: list[list] = [[] for _ in talks]
    by_tool: dict[str, list[tuple[int, int, dict]]] = {}
    for i, reply in enumerate(model.chat(asked)):
        for text in re.findall(r"<tool_call>\s*(.*?)\s*(?:</tool_call>|$)", reply, re.DOTALL):
            place = len(out[i])
            try:
                call = json.loads(text)
                name, arguments = call["name"], call.get("arguments", {})
            except (ValueError, TypeError, KeyError):
                out[i].append(("", False, "unreadable call"))
                continue
            if not isinstance(name, str):
                out[i].append(("", False, "unreadable call"))
                continue
            out[i].append((name, False, "unknown tool"))
            if name in tools:
                by_tool.setdefault(name, []).append((i, place, arguments))
    for name, calls in by_tool.items():
        try:
            found = zip(calls, tools[name][1]([a for *_, a in calls]), strict=True)
            done = [(name, False, str(x) or type(x).__name__) if isinstance(x, Exception) else (name, True, x) for _, x in found]
        except Exception as e:  # noqa: BLE001  a tool may fail in any way
            done = [(name, False, str(e) or type(e).__name__)] * len(calls)
        for (i, place, _), result in zip(calls, done):
            out[i][place] = result
    return out


def rollout(prompts: DataFrame, key: str, client: Callable[[], Client], rounds: int = 1, batch: int = 32, tools_a: dict[str, Tool] | None = None, tools_b: dict[str, Tool] | None = None) -> DataFrame:
    """(key, turn, role, text, error): conversations of two parties about a context.

    prompts: (key, context, prompt). Party A sees the context and the prompt
    and opens; B sees the context and answers; roles flip for each side. Before
    a party with tools speaks, the model may call them; what succeeds is added
    to the talk's context for both parties and is a row of the role ``tool``.
    Where a batch of chats fails, each is asked alone; a talk whose own chat fails
    ends with a row that has the error, and the others go on.
    """
    kind = prompts.schema[key].dataType.simpleString()

    def answers(model, chats):
        try:
            return [(x, None) for _, x in zip(chats, model.chat(chats), strict=True)]
        except Exception:  # noqa: BLE001  a client may fail in any way
            out = []
            for chat in chats:
                try:
                    out.append((model.chat([chat])[0], None))
                except Exception as e:  # noqa: BLE001
                    out.append((None, str(e) or type(e).__name__))
            return out

    def run(batches):
        model = client()
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                keys, talk, errors = list(part[key]), [[] for _ in range(len(part))], [None] * len(part)
                contexts, prompt, shown = list(part["context"]), list(part["prompt"]), [[] for _ in range(len(part))]
                going = lambda: [i for i, e in enumerate(errors) if e is None]
                flipped = lambda t: [{"role": "user" if m["role"] == "assistant" else "assistant", "content": m["content"]} for m in t]

                def look_up(tools, view):
                    at = going()
                    try:
                        found = dict(zip(at, tool_step(model, tools, [contexts[i] for i in at], [view(talk[i]) for i in at])))
                    except Exception:  # noqa: BLE001  each talk alone
                        found = {}
                        for i in at:
                            try:
                                found[i] = tool_step(model, tools, [contexts[i]], [view(talk[i])])[0]
                            except Exception as e:  # noqa: BLE001
                                errors[i] = str(e) or type(e).__name__
                    for i, calls in found.items():
                        text = "\n".join(f"{name}: {x}" for name, good, x in calls if good)
                        if text:
                            contexts[i] += f"\n\n{text}"
                            shown[i].append({"role": "tool", "content": text})

                def say(role, chat):
                    at = going()
                    for i, (text, error) in zip(at, answers(model, [chat(i) for i in at])):
                        errors[i] = error
                        if error is None:
                            talk[i].append({"role": role, "content": text})
                            shown[i].append(talk[i][-1])

                for _ in range(rounds):
                    if tools_a:
                        look_up(tools_a, flipped)
                    say("user", lambda i: [{"role": "system", "content": f"{contexts[i]}\n\n{prompt[i]}"}, *flipped(talk[i])])
                    if tools_b:
                        look_up(tools_b, list)
                    say("assistant", lambda i: [{"role": "system", "content": contexts[i]}, *talk[i]])
                rows = [(k, i, m["role"], m["content"], None) for k, t in zip(keys, shown) for i, m in enumerate(t)]
                rows += [(k, len(t), None, None, e) for k, t, e in zip(keys, shown, errors) if e is not None]
                yield pd.DataFrame(rows, columns=[key, "turn", "role", "text", "error"])

    return prompts.select(key, "context", "prompt").mapInPandas(run, f"`{key}` {kind}, turn int, role string, text string, error string")


def run_tools(requests: DataFrame, tools: dict[str, Callable[[list[str]], list[str]]]) -> DataFrame:
    """(idx, tool, success, error, response): each request (idx, tool, input) by its own tool, batch by batch; each row gets its own output."""

    def run(batches):
        for pdf in batches:
            for name, group in pdf.groupby("tool", sort=True):
                try:
                    out = [(i, name, True, None, r) for i, r in zip(group["idx"], tools[name](list(group["input"])), strict=True)]
                except Exception as e:  # noqa: BLE001
                    out = [(i, name, False, str(e) or type(e).__name__, None) for i in group["idx"]]
                yield pd.DataFrame(out, columns=["idx", "tool", "success", "error", "response"])

    return requests.select("idx", "tool", "input").mapInPandas(run, "idx long, tool string, success boolean, error string, response string")


def render_tool_results(outputs: Column) -> Column:
    """The responses of successful outputs, in order, one a line."""
    return F.array_join(F.transform(F.filter(outputs, lambda o: o["success"]), lambda o: F.concat(o["tool"], F.lit(": "), o["response"])), "\n")


def render_tool(name: str, description: str, parameters: dict) -> str:
    """A tool's definition as JSON for a prompt."""
    return json.dumps({"type": "function", "function": {"name": name, "description": description, "parameters": parameters}}, sort_keys=True)


def tool_schema(definition: dict):
    """The StructType of a tool's JSON-Schema parameters; what isn't required is nullable."""
    from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructType

    def of(spec):
        kind = spec.get("type", "string")
        if kind == "object":
            out, required = StructType(), set(spec.get("required", ()))
            for name, inner in spec.get("properties", {}).items():
                out = out.add(name, of(inner), name not in required)
            return out
        if kind == "array":
            return ArrayType(of(spec.get("items", {})))
        return {"integer": LongType, "number": DoubleType, "boolean": BooleanType}.get(kind, StringType)()

    return of(definition)
