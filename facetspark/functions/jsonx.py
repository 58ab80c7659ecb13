"""Structured results from a model's text, tolerant of what surrounds them."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = r"(?s)```(?:json)?\s*(.*?)```"


def first_json(text: Column) -> Column:
    """The first that is JSON of: the whole text, the content of a code fence, the outermost braces. As text, else null."""
    whole = F.trim(text)
    options = [whole, F.trim(F.regexp_extract(text, _FENCE, 1)), F.regexp_extract(text, r"(?s)(\{.*\})", 1)]
    return F.coalesce(*[F.when((o != "") & F.try_parse_json(o).isNotNull(), o) for o in options])


def parsed_valuation(text: Column) -> Column:
    """struct(min_value, max_value, rationale, confidence, error). The first JSON decides; a violation is an error."""
    v = F.try_parse_json(first_json(text))
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    low, high = get("$.min_value", "double"), get("$.max_value", "double")
    said, sure = get("$.rationale", "string"), get("$.confidence", "string")
    numbers = F.schema_of_variant(F.try_variant_get(v, "$.min_value", "variant")).rlike("BIGINT|DOUBLE|DECIMAL") & F.schema_of_variant(F.try_variant_get(v, "$.max_value", "variant")).rlike("BIGINT|DOUBLE|DECIMAL")
    error = (
        F.when(v.isNull(), "no JSON")
        .when(~F.coalesce(numbers, F.lit(False)), "values missing")
        .when((low < 0) | (high < 0), "negative value")
        .when(high < low, "max below min")
        .when(said.isNull(), "rationale missing")
        .when(~F.coalesce(sure.isin("low", "medium", "high"), F.lit(False)), "confidence unknown")
    )
    ok = error.isNull()
    return F.struct(*[F.when(ok, c).alias(n) for n, c in (("min_value", low), ("max_value", high), ("rationale", said), ("confidence", sure))], error.alias("error"))


def questions_of(text: str | None, tool_arguments: str | None = None) -> tuple[list[tuple[str, str]], str | None]:
    """(question, rationale) pairs and an error: a tool call's arguments, the text as JSON, a code fence, else quoted fields."""

    def valid(raw: str) -> list[tuple[str, str]] | None:
        data = json.loads(raw)
        items = data.get("questions") if isinstance(data, dict) else None
        if not isinstance(items, list) or not items:
            return None
        pairs = [(x.get("question"), x.get("rationale", "")) for x in items if isinstance(x, dict)]
        return pairs if len(pairs) == len(items) and all(isinstance(q, str) and q and isinstance(r, str) for q, r in pairs) else None

    text = text or ""
    if tool_arguments:
        try:
            if got := valid(tool_arguments):
                return got, None
        except ValueError:
            pass
    try:
        got = valid(text.strip())
        return (got, None) if got else ([], "invalid questions")
    except ValueError:
        pass
    if m := re.search(r"```(?:json)?\s*(.*?)```", text, re.S):
        try:
            if got := valid(m.group(1).strip()):
                return got, None
        except ValueError:
            pass
    pairs = re.findall(r'"question"\s*:\s*"([^"]+)"(?:\s*,\s*"rationale"\s*:\s*"([^"]*)")?', text)
    return ([tuple(p) for p in pairs], None) if pairs else ([], "no questions")


def _question_batches(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for text, args in batches:
        rows = [questions_of(t, a) for t, a in zip(text, args)]
        yield pd.DataFrame({"questions": [[{"question": q, "rationale": r} for q, r in p] for p, _ in rows], "error": [e for _, e in rows]})


def parsed_questions(text: Column, tool_arguments: Column) -> Column:
    """struct(questions, error): questions_of over columns."""
    return F.pandas_udf(_question_batches, "questions array<struct<question:string,rationale:string>>, error string")(text, tool_arguments)
