"""History search: structured predicates, a small query language and their dispatch."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import isnan

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fulltext import bm25_search

#: Rows returned if no number is asked for, and at most.
DEFAULT_LIMIT, MOST = 20, 50


@dataclass(frozen=True)
class Search:
    """A structured search; what is None or empty isn't asked for. Dates compare as text, as they are stored."""

    min_value: float | None = None
    max_value: float | None = None
    standard: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    formats: tuple[str, ...] = ()
    limit: int | None = None

    def __post_init__(self):
        if self.limit is not None and self.limit < 0:
            raise ValueError("limit must not be negative")

    @property
    def is_empty(self) -> bool:
        return self == Search(limit=self.limit)

    def predicates(self) -> list[Column]:
        out = []
        for name, value, test in (("min_value", self.min_value, lambda c, v: c >= v), ("max_value", self.max_value, lambda c, v: c <= v)):
            if value is not None:
                out.append(F.lit(False) if isnan(value) else test(F.col(name), value) & ~F.isnan(name))
        if self.standard:
            out.append(F.col("standard_name") == self.standard)
        if self.date_from:
            out.append(F.col("valued_at") >= self.date_from)
        if self.date_to:
            out.append(F.col("valued_at") <= self.date_to)
        if self.formats:
            out.append(F.col("image_format").isin(*self.formats))
        return out


def limited(df: DataFrame, limit: int | None) -> DataFrame:
    return df.limit(min(DEFAULT_LIMIT if limit is None else limit, MOST))


def latest(df: DataFrame, limit: int | None = None) -> DataFrame:
    return limited(df.orderBy(F.desc("valued_at"), F.desc("id")), limit)


def structured(df: DataFrame, s: Search) -> DataFrame:
    """All predicates hold; the newest first, the larger id on a tie."""
    return latest(df.filter(reduce(lambda a, b: a & b, s.predicates(), F.lit(True))), s.limit)


def parse_query(text: str) -> tuple[dict[str, str], str]:
    """(key:value parts, free text) of a query; unknown keys are free text."""
    keys = {"min", "max", "standard", "from", "to", "format"}
    found, free = {}, []
    for word in text.split():
        key, colon, value = word.partition(":")
        if colon and key in keys and value:
            found[key] = value
        else:
            free.append(word)
    return found, " ".join(free)


def parse_filters(filters: list[str]) -> dict[str, str]:
    """key=value items; a later one of a key wins."""
    out = {}
    for f in filters:
        key, eq, value = f.partition("=")
        if not eq:
            raise ValueError(f"not key=value: {f}")
        out[key.strip()] = value.strip()
    return out


def _number(text: str | None) -> float | None:
    import re

    m = re.match(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", text or "")
    return float(m.group(1)) if m else None


def to_search(parts: dict[str, str], limit: int | None = None) -> Search:
    formats = tuple(f.strip() for f in parts.get("format", "").split(",") if f.strip())
    return Search(_number(parts.get("min")), _number(parts.get("max")), parts.get("standard"), parts.get("from"), parts.get("to"), formats, limit)


def run(df: DataFrame, query: str = "", filters: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """A query text and filters: structured if any part is, else full text, else the latest rows."""
    parts, free = parse_query(query)
    s = to_search(parts | parse_filters(filters or []), limit)
    if not s.is_empty:
        return structured(df, s)
    if free:
        hits = bm25_search(df, "id", "description", free)
        return limited(df.join(hits, "id").orderBy(F.desc(F.round("bm25", 9)), "id"), limit).drop("bm25")
    return latest(df, limit)


def tool_view(df: DataFrame) -> DataFrame:
    """The few fields that a model's search tool returns. NaN is no value: null."""
    value = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return df.select("id", value("min_value"), value("max_value"), "standard_name", "image_format", "valued_at", F.substring("description", 1, 120).alias("description"))


def record_view(df: DataFrame) -> DataFrame:
    """Records under the names of the programming interface: camelCase, without the model's raw answer; NaN is null."""
    camel = lambda n: n.split("_")[0] + "".join(w.title() for w in n.split("_")[1:])
    value = lambda f: F.when(~F.isnan(f.name), F.col(f.name)) if f.dataType.typeName() == "double" else F.col(f.name)
    return df.select(*[value(f).alias(camel(f.name)) for f in df.schema if f.name != "raw_llm_text"])
