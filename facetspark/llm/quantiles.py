"""Percentiles of very large numeric columns from mergeable, deterministic rank-interval summaries.

A summary of n numbers is a sorted list of (value, rmin, rmax): the value's rank among all n lies in [rmin, rmax].
Each partition keeps one summary per group, compressed to the permitted uncertainty; summaries merge pairwise or
in trees, rank bounds adding up, and ``err`` tracks the largest rank error any percentile read from them can have.
Summaries are ordinary rows, so those of other partitions, days or loads can be stored and merged later.

Defined cases: null and NaN values (and those the caller filters) take no part; a group without a value has no
summary; ties are counted as they are; a null group key is a group; an empty table gives no rows; other columns
are not read. Infinite values are ordinary extremes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read, small, usable_number

#: Fixed by the format of a summary row.
_FIELDS = "__n long, __err long, __v array<double>, __lo array<long>, __hi array<long>"
_BUFFER = 1 << 16
#: Numbers a task holds before it sends its summaries on.
_HELD = 8_000_000


class Summary:
    """Rank-interval tuples in value order; lo and hi hold rmin and rmax, counted from 1."""

    __slots__ = ("n", "v", "lo", "hi")

    def __init__(self, n: int, v: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.n, self.v, self.lo, self.hi = n, v, lo, hi

    @classmethod
    def exact(cls, values: np.ndarray) -> Summary:
        v = np.sort(np.asarray(values, np.float64))
        r = np.arange(1, len(v) + 1, dtype=np.int64)
        return cls(len(v), v, r, r.copy())

    @property
    def err(self) -> int:
        """Largest distance of a wanted rank from the rank of the tuple that answers it."""
        if self.n == 0:
            return 0
        return int(np.max(self.hi[1:] - self.lo[:-1], initial=0) + 1) // 2

    def merge(self, other: Summary) -> Summary:
        if self.n == 0 or other.n == 0:
            return other if self.n == 0 else self

        def shifted(a: Summary, b: Summary, side: str) -> tuple[np.ndarray, np.ndarray]:
            at = np.searchsorted(b.v, a.v, side=side)  # tuples of b that stand before each of a
            lo = a.lo + np.where(at > 0, b.lo[np.maximum(at - 1, 0)], 0)
            hi = a.hi + np.where(at < len(b.v), b.hi[np.minimum(at, len(b.v) - 1)] - 1, b.n)
            return lo, hi

        (la, ha), (lb, hb) = shifted(self, other, "left"), shifted(other, self, "right")
        v = np.concatenate([self.v, other.v])
        order = np.argsort(v, kind="stable")
        return Summary(self.n + other.n, v[order], np.concatenate([la, lb])[order], np.concatenate([ha, hb])[order])

    def compress(self, size: int) -> Summary:
        """At most about ``size`` tuples; least and greatest stay. Adds at most n / (2 size) to the error."""
        if len(self.v) <= size + 2:
            return self
        want = np.linspace(1, self.n, size)
        mid = (self.lo + self.hi) / 2
        at = np.unique(np.concatenate([[0], np.clip(np.searchsorted(mid, want), 0, len(mid) - 1), [len(mid) - 1]]))
        return Summary(self.n, self.v[at], self.lo[at], self.hi[at])

    def at(self, p: float) -> tuple[float, float, float]:
        """Estimate, lower and upper bound of the value at rank max(1, ceil(p n))."""
        return self.rank(max(1, int(np.ceil(p * self.n - 1e-9))))

    def rank(self, r: int) -> tuple[float, float, float]:
        best = int(np.argmin(np.maximum(r - self.lo, self.hi - r)))
        below, above = np.flatnonzero(self.hi <= r), np.flatnonzero(self.lo >= r)
        return float(self.v[best]), float(self.v[below[-1]] if len(below) else self.v[0]), float(self.v[above[0]] if len(above) else self.v[-1])


def _row(s: Summary) -> list:
    return [s.n, s.err, s.v, s.lo, s.hi]


def _summaries(pdf: pd.DataFrame) -> list[Summary]:
    return [Summary(int(n), np.asarray(v, np.float64), np.asarray(lo, np.int64), np.asarray(hi, np.int64)) for n, v, lo, hi in zip(pdf["__n"], pdf["__v"], pdf["__lo"], pdf["__hi"])]


def summarise(df: DataFrame, keys: dict[str, Column], value: Column, size: int = 1000, fan_in: int = 8) -> DataFrame:
    """One summary row per group: the keys, __n, __err and the tuples. A summary holds about 2 * size tuples at most.

    Each task keeps per group one summary and a buffer of 65,536 values, and sends all of them on when they come to
    _HELD numbers, however many groups there are; then summaries meet in a tree of the given fan-in, so no task ever
    holds more than a few of one group, however hot the group.
    """
    names = list(keys)
    ks = [f"__k{i}" for i in range(len(names))]
    src = df.select(*[c.alias(k) for k, c in zip(ks, keys.values())], value.cast("double").alias("__x")).filter("__x is not null and not isnan(__x)")
    kinds = ", ".join(f"{k} {src.schema[k].dataType.simpleString()}" for k in ks)
    columns = [*ks, "__node", "__n", "__err", "__v", "__lo", "__hi"]

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        node = TaskContext.get().partitionId()
        held: dict[tuple, tuple[Summary, list, int]] = {}

        def fold(state: tuple[Summary, list, int]) -> Summary:
            return state[0].merge(Summary.exact(np.concatenate(state[1])).compress(2 * size)).compress(2 * size) if state[1] else state[0]

        def rows() -> Iterator[pd.DataFrame]:
            out = [[*k, node, *_row(fold(state))] for k, state in held.items()]
            for i in range(0, len(out), 256):
                yield pd.DataFrame(out[i : i + 256], columns=columns)

        load = 0
        for pdf in batches:
            for key, g in pdf.groupby(ks, dropna=False, sort=False)["__x"]:
                key = tuple(None if pd.isna(k) else k for k in key)
                s, buffer, n = held.get(key, (Summary.exact(np.empty(0)), [], 0))
                buffer.append(g.to_numpy())
                n += len(g)
                before = 3 * len(s.v) + n - len(g)
                held[key] = (fold((s, buffer, n)), [], 0) if n >= _BUFFER else (s, buffer, n)
                load += 3 * len(held[key][0].v) + held[key][2] - before
            if load > _HELD:
                yield from rows()
                held, load = {}, 0
        yield from rows()

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        total = Summary.exact(np.empty(0))
        for s in _summaries(pdf):
            total = total.merge(s)
        total = total.compress(2 * size)
        first = pdf.iloc[0]
        return pd.DataFrame([[*[first[k] for k in ks], int(first["__node"]), *_row(total)]], columns=columns)

    schema = f"{kinds}, __node long, {_FIELDS}"
    return _tree(src.mapInPandas(local, schema), ks, joined, schema, fan_in).select(*[F.col(k).alias(n) for k, n in zip(ks, names)], "__n", "__err", "__v", "__lo", "__hi")


def _tree(nodes: DataFrame, ks: list[str], joined, schema: str, fan_in: int) -> DataFrame:
    """Merge the summaries of each group level by level until each group has one."""
    level = cut(nodes)
    while True:
        most = level.agg(F.max("__node")).first()[0] or 0
        level = level.withColumn("__node", F.expr(f"__node div {fan_in}"))
        level = level.groupBy(*ks, "__node").applyInPandas(joined, schema)
        if most < fan_in:
            return level
        level = cut(level)


def merge_summaries(a: DataFrame, b: DataFrame, keys: list[str], size: int = 1000) -> DataFrame:
    """The summaries of two loads combined group by group; both as ``summarise`` returns them."""
    both = a.unionByName(b)
    schema = ", ".join(f"{k} {both.schema[k].dataType.simpleString()}" for k in keys) + ", " + _FIELDS

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        total = Summary.exact(np.empty(0))
        for s in _summaries(pdf):
            total = total.merge(s)
        return pd.DataFrame([[*[pdf.iloc[0][k] for k in keys], *_row(total.compress(2 * size))]], columns=[*keys, "__n", "__err", "__v", "__lo", "__hi"])

    return both.groupBy(*keys).applyInPandas(joined, schema)


def percentiles(summaries: DataFrame, keys: list[str], at: list[float]) -> DataFrame:
    """Per group and p: n, the estimate, value bounds that hold the true percentile, and the possible rank error."""
    schema = ", ".join(f"{k} {summaries.schema[k].dataType.simpleString()}" for k in keys) + ", p double, n long, estimate double, lower double, upper double, rank_error long"

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, s in zip(pdf[keys].itertuples(index=False, name=None), _summaries(pdf)):
                rows += [[*key, p, s.n, *s.at(p), s.err] for p in at]
            yield pd.DataFrame(rows, columns=[*keys, "p", "n", "estimate", "lower", "upper", "rank_error"])

    return summaries.mapInPandas(each, schema)


def medians(df: DataFrame, key: str, value: str, size: int = 1000) -> DataFrame:
    """(key, median): the exact median (mean of the two middle values) of each group.

    The summaries bracket both middle values; one more pass counts what lies below the bracket and ranks the few
    distinct values inside it.
    """
    spans = summarise(df, {key: F.col(key)}, F.col(value), size)
    schema = f"__key {spans.schema[key].dataType.simpleString()}, __r1 long, __r2 long, __from double, __to double"

    def bracket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, s in zip(pdf[key], _summaries(pdf)):
                r1, r2 = (s.n + 1) // 2, (s.n + 2) // 2
                rows.append([k, r1, r2, s.rank(r1)[1], s.rank(r2)[2]])
            yield pd.DataFrame(rows, columns=["__key", "__r1", "__r2", "__from", "__to"])

    spans = small(cut(spans.mapInPandas(bracket, schema)))
    x = df.select(F.col(key).alias("__group"), F.col(value).alias("__x")).filter("__x is not null and not isnan(__x)")
    near = x.join(spans, F.col("__group").eqNullSafe(F.col("__key"))).filter("__x <= __to")
    # all that lies below the bracket counts as one value, so a group sends few rows on
    counts = near.groupBy("__key", "__r1", "__r2", F.when(F.col("__x") >= F.col("__from"), F.col("__x")).alias("__x")).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy("__key").orderBy(F.asc_nulls_first("__x"))
    ranked = counts.withColumn("__end", F.sum("__c").over(w))
    middle = [F.min(F.when(F.col("__end") >= F.col(r), F.col("__x"))) for r in ("__r1", "__r2")]
    return ranked.groupBy("__key").agg(((middle[0] + middle[1]) / 2).alias("median")).select(F.col("__key").alias(key), "median")


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "valuation").select("id", "standard_name", "max_value").filter(usable_number(F.col("max_value")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valuations of more than 20 times the median of their standard."""
    v = _values(spark, sf_dir)
    m = small(cut(medians(v, "standard_name", "max_value").select(F.col("standard_name").alias("__s"), "median")))
    return v.join(m, F.col("standard_name").eqNullSafe(F.col("__s"))).filter("max_value > 20 * median").select("id")


def p6_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of max_value per standard with bounds."""
    s = summarise(_values(spark, sf_dir), {"standard_name": F.col("standard_name")}, F.col("max_value"))
    return percentiles(s, ["standard_name"], [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])


SQL = {
    "p6_found": """
WITH v AS (SELECT id, standard_name, max_value FROM valuation WHERE max_value IS NOT NULL AND NOT isnan(max_value) AND max_value >= 0),
m AS (SELECT standard_name, median(max_value) AS med FROM v GROUP BY 1)
SELECT id FROM v JOIN m USING (standard_name) WHERE max_value > 20 * med"""
}
QUERIES = {"p6_found": p6_found, "p6_percentiles": p6_percentiles}
