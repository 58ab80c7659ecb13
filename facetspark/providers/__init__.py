"""Calls to language and embedding models: an interface, a registry, deterministic stand-ins, and batched use in Spark."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class EngineError(Exception):
    code = 1


class ConfigError(EngineError):
    code = 2


class InputError(EngineError):
    code = 3


class ProviderError(EngineError):
    code = 4


class StorageError(EngineError):
    code = 5


@dataclass
class Reply:
    text: str = ""
    stop_reason: str = "end"
    tool_calls: list[dict] = field(default_factory=list)
    input_tokens: int | None = None
    output_tokens: int | None = None


class TextModel(Protocol):
    def complete(self, messages: list[dict], tools: list[dict] | None = None) -> Reply: ...


class EmbeddingModel(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass
class Scripted:
    """A text model that replies from a list, then repeats the last."""

    replies: list[Reply]
    seen: list[list[dict]] = field(default_factory=list)

    def complete(self, messages, tools=None) -> Reply:
        self.seen.append(list(messages))
        return self.replies[min(len(self.seen), len(self.replies)) - 1]


@dataclass
class HashedEmbedding:
    """An embedding that needs no network: signed hashes of the words."""

    dim: int = 64

    def embed(self, texts):
        out = []
        for t in texts:
            v = [0.0] * self.dim
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.dim] += 1.0 if h >> 63 else -1.0
            out.append(v)
        return out


_REGISTRY: dict[str, Callable[..., object]] = {"scripted": Scripted, "hashed": HashedEmbedding}


def register(name: str, make: Callable[..., object]) -> None:
    _REGISTRY[name] = make


def create(name: str, **options):
    """A provider by name; a network provider must be registered by the caller, with its key."""
    if name not in _REGISTRY:
        raise ConfigError(f"unknown provider: {name}")
    return _REGISTRY[name](**options)


def run_tools(model: TextModel, messages: list[dict], tools: dict[str, Callable[[dict], str]], final: str, rounds: int = 5) -> Reply | dict:
    """Let a model call tools until it calls ``final`` (its arguments are returned) or answers in text.

    A tool's failure is told to the model as text. If the model fails with tools, it is asked once without them.
    """
    talk = list(messages)
    for _ in range(rounds):
        try:
            reply = model.complete(talk, [{"name": n} for n in [*tools, final]])
        except ProviderError:
            return model.complete(talk, None)
        if not reply.tool_calls:
            return reply
        talk.append({"role": "assistant", "content": reply.text, "tool_calls": reply.tool_calls})
        for call in reply.tool_calls:
            if call["name"] == final:
                return call["arguments"]
            try:
                said = tools[call["name"]](call["arguments"]) if call["name"] in tools else f"unknown tool {call['name']}"
            except Exception as e:  # noqa: BLE001 - told to the model
                said = f"error: {e}"
            talk.append({"role": "tool", "name": call["name"], "content": said})
    return model.complete(talk, None)


def embedded(df: DataFrame, column: str, out: str, make: Callable[[], EmbeddingModel], batch: int = 64) -> DataFrame:
    """``df`` with the embedding of a text column; a client is made once per task and asked ``batch`` texts at a time."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in batches:
            texts = s.tolist()
            yield pd.Series([v for a in range(0, len(texts), batch) for v in model.embed(texts[a : a + batch])], dtype=object)

    return df.withColumn(out, run.asNondeterministic()(F.col(column)))


def completed(df: DataFrame, prompt: str, make: Callable[[], TextModel]) -> DataFrame:
    """``df`` with reply and error: a failed call fills error and loses no row."""

    @F.pandas_udf("reply string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()
        for s in batches:
            rows = []
            for p in s:
                try:
                    rows.append((model.complete([{"role": "user", "content": p}]).text, None))
                except Exception as e:  # noqa: BLE001 - kept with the row
                    rows.append((None, str(e)))
            yield pd.DataFrame(rows, columns=["reply", "error"])

    return df.withColumn("__r", run.asNondeterministic()(F.col(prompt))).select("*", "__r.reply", "__r.error").drop("__r")


def sliding_context(df: DataFrame, order: str, line: str, before: int = 60, by: list[str] | None = None) -> DataFrame:
    """``df`` with prompt: up to ``before`` earlier lines of the document told by the columns ``by``, this one and '='.

    Without ``by`` all rows are one document, which one task then orders.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*(by or [])).orderBy(order).rowsBetween(-before, 0)
    return df.withColumn("prompt", F.concat(F.array_join(F.collect_list(line).over(w), "\n"), F.lit("=")))


def translated(lines: list[str], model: TextModel, before: int = 60) -> list[str]:
    """tag=translation lines in order; a line's prompt holds earlier translations, so lines follow one another."""
    out: list[str] = []
    for text in lines:
        tag = text.split("=", 1)[0]
        said = model.complete([{"role": "user", "content": "\n".join([*out[-before:], tag]) + "="}]).text
        out.append(f"{tag}={said.split(chr(10), 1)[0].strip()}")
    return out
