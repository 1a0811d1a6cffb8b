"""A queue of requests to a model: bounded in flight, paced over all tasks, each with its own failure.

Every task runs an event loop over its rows.  Replies may bring token ids and
the likeliest alternatives of each token; these are thinned by probability mass
where they arrive and go into the message, so training needs no second tokenisation.
"""

from __future__ import annotations

import asyncio
import math
import time
from collections import deque
from collections.abc import Awaitable, Callable
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from corvane.functions.arithmetic import back_off
from corvane.runtime import ship
from corvane.schemas import MESSAGE

Chat = list[dict[str, str]]
#: (token id, log-probability) by falling log-probability.
Alternatives = list[tuple[int, float]]


@dataclass
class Reply:
    """``top``: each token's likeliest alternatives, where the client was asked for them."""

    text: str
    token_ids: list[int] | None = None
    top: list[Alternatives] | None = None


class Overflow(Exception):
    """The chat is longer than the model reads."""


class AsyncClient(Protocol):
    async def complete(self, chat: Chat) -> Reply | str: ...


@dataclass
class Limit:
    """At most ``calls`` begin in any ``window`` seconds, over all tasks together.

    Rows are dealt to no more partitions than there are calls, and each takes an
    equal whole share, so whatever runs at once stays below the limit.  A task that
    Spark runs again starts a new count.
    """

    calls: int
    window: float = 60.0
    tasks: int = 8

    def shares(self) -> tuple[int, int]:
        """(partitions, calls of each)."""
        if self.calls < 1:
            raise ValueError("a limit admits at least one call")
        tasks = max(1, min(self.tasks, self.calls))
        return tasks, self.calls // tasks


@dataclass
class _Pace:
    """Begins of the last calls of a task."""

    share: int
    window: float
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], Awaitable] = asyncio.sleep
    begun: deque = field(default_factory=deque)

    async def wait(self) -> None:
        while True:
            now = self.clock()
            while self.begun and now - self.begun[0] >= self.window:
                self.begun.popleft()
            if len(self.begun) < self.share:
                self.begun.append(now)
                return
            await self.sleep(self.window - (now - self.begun[0]))


def shorter(chat: Chat) -> Chat | None:
    """The chat without its oldest message after the system prompt; None where only the last one is left."""
    at = next((i for i, m in enumerate(chat) if m["role"] != "system"), len(chat))
    return chat[:at] + chat[at + 1 :] if at < len(chat) - 1 else None


def thinned(top: Alternatives, mass: float) -> Alternatives:
    """The alternatives up to the one at which their probability reaches ``mass``; the first alone where it never does."""
    total = 0.0
    for i, (_, logprob) in enumerate(top):
        total += math.exp(logprob)
        if total >= mass:
            return top[: i + 1]
    return top[:1]


def as_message(reply: Reply | str, mass: float) -> dict:
    """The reply as a message row."""
    if isinstance(reply, str):
        reply = Reply(reply)
    kept = [thinned(top, mass) for top in reply.top] if reply.top is not None else None
    flat = kept and [(i, token, logprob) for i, top in enumerate(kept) for token, logprob in top]
    logprobs = None if kept is None else {
        "token_idx": [x[0] for x in flat or []], "token_id": [x[1] for x in flat or []], "logprobs": [x[2] for x in flat or []],
        "shape": [len(kept), max(map(len, kept), default=0)],
    }
    return {"content": reply.text, "role": "assistant", "token_ids": reply.token_ids, "top_logprobs": logprobs}


async def _one(client: AsyncClient, chat: Chat, pace: _Pace | None, timeout: float, attempts: int, sleep) -> tuple[Reply | str | None, str | None, int]:
    tried, error = 0, None
    while tried < attempts:
        try:
            if pace:
                await pace.wait()
            return await asyncio.wait_for(client.complete(chat), timeout), None, tried + 1
        except Overflow:
            if (chat := shorter(chat)) is None:
                return None, "too long for the model", tried + 1
            continue
        except TimeoutError:
            error = f"no answer in {timeout:g} s"
        except Exception as e:  # noqa: BLE001  a client may fail in any way
            error = str(e) or type(e).__name__
        tried += 1
        if tried < attempts:
            await sleep(back_off(tried - 1))
    return None, error, tried


def ask(rows: DataFrame, client: Callable[[], AsyncClient], chat: str = "chat", in_flight: int = 16, timeout: float = 60.0, attempts: int = 3, limit: Limit | None = None, mass: float = 0.99, sleep: Callable[[float], Awaitable] = asyncio.sleep) -> DataFrame:
    """The rows with ``reply`` (a message), ``error`` and ``attempts``, in their order within a partition.

    ``chat``: array<struct<role, content>>. A task has at most ``in_flight``
    requests under way. A request that fails or takes longer than ``timeout``
    is made again, up to ``attempts`` times with growing pauses; then its row
    has the error, and others are not touched. A chat that is too long loses its oldest
    messages but for system prompts and the last one. A null or empty chat is an
    error without a request. Other columns are kept, and must not have these names.
    """
    ship(rows.sparkSession)
    tasks, share = limit.shares() if limit else (0, 0)
    out = StructType([*rows.schema.fields]).add("reply", MESSAGE).add("error", StringType()).add("attempts", IntegerType())
    schema, place = to_arrow_schema(out), rows.columns.index(chat)
    message = to_arrow_type(MESSAGE)

    def run(batches):
        model, pace = client(), _Pace(share, limit.window) if limit else None

        async def answers(chats):
            gate = asyncio.Semaphore(in_flight)

            async def one(x):
                if not x:
                    return None, "nothing asked", 0
                async with gate:
                    return await _one(model, x, pace, timeout, attempts, sleep)

            return await asyncio.gather(*(one(x) for x in chats))

        with asyncio.Runner() as loop:
            for batch in batches:
                done = loop.run(answers(batch.column(place).to_pylist()))
                replies = pa.array([None if r is None else as_message(r, mass) for r, _, _ in done], message)
                yield pa.RecordBatch.from_arrays([*batch.columns, replies, pa.array([e for _, e, _ in done], pa.string()), pa.array([n for *_, n in done], pa.int32())], schema=schema)

    dealt = rows.repartition(tasks) if limit else rows
    return dealt.mapInArrow(run, out)


def conversations(asked: DataFrame, key: str, chat: str = "chat") -> DataFrame:
    """(key, messages) of the answered rows of ``ask``: the chat's messages and the reply, as conversation files hold them."""
    plain = F.transform(chat, lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role"), F.lit(None).cast("array<int>").alias("token_ids"), F.lit(None).cast(MESSAGE["top_logprobs"].dataType).alias("top_logprobs")))
    return asked.where("reply IS NOT NULL").select(key, F.concat(plain, F.array("reply")).alias("messages"))


TARGETS = ArrayType(StructType().add("token_idx", IntegerType()).add("token_id", IntegerType()).add("logprob", DoubleType()))


def elements(talks: DataFrame, key: str, prompt_ids: str | None = None) -> DataFrame:
    """(key, input_ids, targets): training elements from conversations whose assistant messages carry ids and log-probabilities.

    input_ids: the caller's prompt ids, then every assistant message's ids;
    targets: their kept alternatives, with places moved behind what comes before. Nothing is tokenised again. Messages without ids add
    nothing; messages without log-probabilities have ids but no targets.
    """
    head = F.coalesce(F.col(prompt_ids), F.array().cast("array<int>")) if prompt_ids else F.array().cast("array<int>")
    spoken = F.filter("messages", lambda m: (m["role"] == "assistant") & m["token_ids"].isNotNull())
    start = F.struct(head.alias("ids"), F.array().cast(TARGETS).alias("targets"))

    def add(state, m):
        top = m["top_logprobs"]
        moved = F.transform(F.arrays_zip(top["token_idx"].alias("a"), top["token_id"].alias("b"), top["logprobs"].alias("c")), lambda x: F.struct((x["a"] + F.size(state["ids"])).cast("int").alias("token_idx"), x["b"].alias("token_id"), x["c"].cast("double").alias("logprob")))
        return F.struct(F.concat(state["ids"], m["token_ids"]).alias("ids"), F.concat(state["targets"], F.coalesce(moved, F.array().cast(TARGETS))).alias("targets"))

    return talks.select(key, F.aggregate(spoken, start, add).alias("e")).select(key, F.col("e.ids").alias("input_ids"), F.col("e.targets").alias("targets"))


class WordClient:
    """A deterministic stand-in: repeats the last message; a word's id is its length, its alternatives follow its place."""

    #: Probabilities of a token's alternatives, by place modulo three.
    SHAPES = ((0.95, 0.04), (0.6, 0.35, 0.04), (0.5, 0.3, 0.15, 0.04))

    async def complete(self, chat: Chat) -> Reply:
        words = [w for w in chat[-1]["content"].split(" ") if w]
        top = [[(len(w) + j, math.log(p)) for j, p in enumerate(self.SHAPES[i % 3])] for i, w in enumerate(words)]
        return Reply(" ".join(words), [len(w) for w in words], top)
