"""Model providers: asking row by row, retries, follow-ups, prompts, timers, and their offline stand-ins."""

from __future__ import annotations

import json
import re
import time
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Messages (role, text) in order -> the reply.
Ask = Callable[[list[tuple[str, str]]], str]


def whole(pieces: Callable[[list[tuple[str, str]]], Iterable[str]]) -> Ask:
    """A provider that sends its reply in pieces, as one that gives it whole."""
    return lambda messages: "".join(pieces(messages))


def with_retry(ask: Ask, attempts: int = 3, first: float = 1.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep, seed: int = 0) -> Ask:
    """Asks again after a random wait that doubles; the last failure is raised."""
    rng = np.random.default_rng(seed)

    def run(messages: list[tuple[str, str]]) -> str:
        for attempt in range(attempts):
            try:
                return ask(messages)
            except Exception:
                if attempt + 1 == attempts:
                    raise
                sleep(float(rng.uniform(0, min(most, first * 2**attempt))))
        raise ValueError("attempts must be positive")

    return run


def http_ask(url: str, model: str, timeout: float = 60.0, headers: dict[str, str] | None = None) -> Ask:
    """A provider behind an HTTP endpoint that takes and gives chat messages as JSON."""

    def run(messages: list[tuple[str, str]]) -> str:
        body = json.dumps({"model": model, "messages": [{"role": r, "content": t} for r, t in messages]}).encode()
        request = urllib.request.Request(url, body, {"Content-Type": "application/json", **(headers or {})})
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return json.load(reply)["choices"][0]["message"]["content"]

    return run


def in_turns(ask: Ask, prompts: list[str], system: str = "") -> list[str]:
    """Replies to prompts asked one after the other in one conversation."""
    messages, replies = [("system", system)] if system else [], []
    for prompt in prompts:
        messages.append(("user", prompt))
        replies.append(ask(messages))
        messages.append(("assistant", replies[-1]))
    return replies


class Prompt(str):
    """A template whose named places can be filled in steps; places without a value stay."""

    @property
    def names(self) -> set[str]:
        return set(re.findall(r"\{(\w+)\}", self))

    def fill(self, **values: object) -> "Prompt":
        return Prompt(re.sub(r"\{(\w+)\}", lambda m: str(values[m[1]]) if m[1] in values else m[0], self))


class StageTimer:
    """Seconds and calls of named stages."""

    def __init__(self, clock: Callable[[], float] = time.perf_counter) -> None:
        self.clock, self.spent = clock, {}

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        start = self.clock()
        try:
            yield
        finally:
            seconds, calls = self.spent.get(name, (0.0, 0))
            self.spent[name] = (seconds + self.clock() - start, calls + 1)

    def mean(self, name: str) -> float:
        seconds, calls = self.spent.get(name, (0.0, 0))
        return seconds / calls if calls else 0.0


def ask_rows(rows: DataFrame, ask: Ask, key: str, prompt: str, system: str = "", gleanings: int = 0, more: str = "Is there more? Answer yes or no.", follow: str = "Go on.") -> DataFrame:
    """(key, reply, error) of every row: a failed row has a null reply and says why, it is never lost.

    gleanings: how often the provider is asked to go on after it said that there is more; what
    it adds is appended on a new line.
    """
    kind = rows.schema[key].dataType.simpleString()

    def one(text: str) -> str:
        messages = ([("system", system)] if system else []) + [("user", text)]
        reply = ask(messages)
        messages.append(("assistant", reply))
        for _ in range(gleanings):
            if ask([*messages, ("user", more)]).strip().strip(".!").lower() != "yes":
                break
            messages.append(("user", follow))
            added = ask(messages)
            messages.append(("assistant", added))
            reply = f"{reply}\n{added}"
        return reply

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies, errors = [], []
            for text in batch.column(1).to_pylist():
                try:
                    replies.append(one(text or ""))
                    errors.append(None)
                except Exception as error:
                    replies.append(None)
                    errors.append(f"{type(error).__name__}: {error}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(replies, pa.string()), pa.array(errors, pa.string())], [key, "reply", "error"])

    return rows.select(key, F.col(prompt).cast("string").alias("prompt")).mapInArrow(run, f"`{key}` {kind}, reply string, error string")


def echo(messages: list[tuple[str, str]]) -> str:
    """The offline provider: the last message, trimmed."""
    return messages[-1][1].strip()


def longest_words(messages: list[tuple[str, str]], step: int = 3) -> str:
    """An offline extractor: the longest words of the first message, three at a time, 'yes' while there are more."""
    first = next(t for r, t in messages if r == "user")
    found = sorted(set(re.findall(r"[a-z]{6,}", first.lower())), key=lambda w: (-len(w), w))
    said = sum(len(t.split()) for r, t in messages if r == "assistant")
    if messages[-1][1].startswith("Is there more"):
        return "yes" if said < len(found) else "no"
    return " ".join(found[said : said + step])
