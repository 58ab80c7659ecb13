"""First matching size rule, as a higher-order expression: no join."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _holds(rule: Column, width: Column, height: Column) -> Column:
    test = lambda bound, ok: rule[bound].isNull() | ok(rule[bound])
    some = F.coalesce(rule["min_width"], rule["max_width"], rule["min_height"], rule["max_height"]).isNotNull()
    return some & test("min_width", lambda b: width >= b) & test("max_width", lambda b: width <= b) & test("min_height", lambda b: height >= b) & test("max_height", lambda b: height <= b)


def size_multiplier(rules: Column, width: Column, height: Column) -> Column:
    """Multiplier of the first rule whose inclusive bounds hold and which isn't 1; 1 without one. A null size meets no bound."""
    hits = F.filter(rules, lambda r: F.coalesce(_holds(r, width, height), F.lit(False)) & (r["multiplier"] != 1.0))
    return F.coalesce(F.get(hits, F.lit(0))["multiplier"], F.lit(1.0))


def size_reason(rule: Column, width: Column, height: Column) -> Column:
    """Text of the bound that a rule met, the lower one if it has both; empty for none."""
    part = lambda name, low, high: F.when(rule[low].isNotNull(), F.concat(F.lit(f"{name} >= "), rule[low].cast("string"))).when(rule[high].isNotNull(), F.concat(F.lit(f"{name} <= "), rule[high].cast("string")))
    return F.when(_holds(rule, width, height), F.array_join(F.array_compact(F.array(part("width", "min_width", "max_width"), part("height", "min_height", "max_height"))), ", ")).otherwise("")
