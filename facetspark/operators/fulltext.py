"""Full-text search: an index of postings with positions, a query language, BM25.

A query is made of words; words side by side are ANDed. OR, AND, NOT (in capitals), brackets, prefixes (win*), phrases
(old + mill), the first word of a text (^old) and NEAR(old mill, 5) are understood, NOT binding closest and OR least.
Quotes count as blanks.

Compared with SQLite's FTS5 on random queries, rows are always the same. So are ranks, but for one form: where a NEAR
that holds a phrase of several words is ORed with something else, SQLite also counts words of that NEAR in some
documents in which it doesn't match, and here they don't count.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the ranking function.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
_MARKED = [c for c in map(chr, range(0xC0, 0x250)) if (d := unicodedata.normalize("NFD", c))[0] != c and len(d) > 1]


def folded(c: Column) -> Column:
    """Lower case without diacritics."""
    return F.regexp_replace(F.translate(F.lower(c), "".join(_MARKED), "".join(unicodedata.normalize("NFD", c)[0].lower() for c in _MARKED)), r"\p{M}", "")


def tokens(c: Column) -> Column:
    """Longest runs of letters and digits."""
    return F.regexp_extract_all(F.coalesce(folded(c), F.lit("")), F.lit(r"([\p{L}\p{N}]+)"), 1)


def postings(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(token, id, dl, tf, pos): one row per token of a document; a document of equal id counts once per row."""
    docs = df.select(F.col(doc_id).alias("id"), tokens(F.col(text)).alias("ts"))
    return docs.select("id", F.size("ts").alias("dl"), F.posexplode("ts").alias("at", "token")).groupBy("token", "id", "dl").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("at")).alias("pos"))


def statistics(df: DataFrame, text: str) -> DataFrame:
    """One row (n, total): documents and tokens of a corpus."""
    size = F.regexp_count(F.coalesce(folded(F.col(text)), F.lit("")), F.lit(r"[\p{L}\p{N}]+"))
    return df.agg(F.count(F.lit(1)).cast("double").alias("n"), F.coalesce(F.sum(size), F.lit(0)).cast("double").alias("total"))


@dataclass(frozen=True)
class Index:
    """Postings and statistics of a corpus; stored by token, so that a query reads its own tokens' parts of the files."""

    postings: DataFrame
    statistics: DataFrame

    @classmethod
    def of(cls, df: DataFrame, doc_id: str, text: str) -> Index:
        return cls(postings(df, doc_id, text), statistics(df, text))

    def save(self, folder: str) -> None:
        self.postings.repartitionByRange("token").sortWithinPartitions("token", "id").write.parquet(f"{folder}/postings")
        self.statistics.write.parquet(f"{folder}/statistics")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Index:
        return cls(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/statistics"))

    def search(self, query: str) -> DataFrame:
        """(id, bm25) of the documents that match. Only postings of the query's words are read, and grouped by document."""
        tree, phrases = parse(query)
        if tree is None:
            return self.postings.select("id", F.lit(0.0).alias("bm25")).limit(0)
        exact = sorted({w for p in phrases for w in p.words[: len(p.words) - p.prefix]})
        starts = sorted({p.words[-1] for p in phrases if p.prefix})
        wanted = reduce(lambda a, b: a | b, [F.col("token").startswith(w) for w in starts], F.col("token").isin(exact))
        docs = self.postings.filter(wanted).groupBy("id", F.col("dl").cast("double").alias("dl")).agg(F.collect_list(F.struct("token", "pos")).alias("held"))
        docs = docs.select("id", "dl", *[p.found().alias(f"p{i}") for i, p in enumerate(phrases)])
        total = docs.agg(*[F.count_if(F.size(f"p{i}") > 0).alias(f"n{i}") for i in range(len(phrases))])
        hits = docs.filter(matches(tree, phrases)).crossJoin(F.broadcast(total)).crossJoin(F.broadcast(self.statistics))  # one row each
        score = F.lit(0.0)
        for i, f in counted(tree, phrases).items():
            idf = F.greatest(F.lit(LEAST_IDF), F.ln((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5)))
            score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") * F.col("n") / F.col("total")))
        return hits.select("id", score.alias("bm25"))


@dataclass(frozen=True)
class Phrase:
    """Words in a row; the last may be the start of one, and the first the text's first."""

    words: tuple[str, ...]
    prefix: bool = False
    first: bool = False

    def found(self) -> Column:
        """Places of its first word in a document's held (token, pos) structs."""

        def places(word: str, start: bool) -> Column:
            same = lambda h: h["token"].startswith(word) if start else h["token"] == word
            return F.flatten(F.transform(F.filter("held", same), lambda h: h["pos"]))

        def followed(at: Column, by: Column, k: int) -> Column:
            return F.filter(at, lambda p: F.array_contains(by, p + k))

        last = len(self.words) - 1
        out = places(self.words[0], self.prefix and not last)
        for k in range(1, len(self.words)):
            out = followed(out, places(self.words[k], self.prefix and k == last), k)
        return F.filter(out, lambda p: p == 0) if self.first else out


_PART = re.compile(r"\s*(?:(NEAR)\s*\(|([()*^+,])|([^\s()*^+,]+))")


def parse(query: str) -> tuple[tuple | None, list[Phrase]]:
    """(tree, phrases): nodes are (word AND, OR, NOT or NEAR, arguments); a leaf is a phrase's number. ValueError where brackets don't match."""
    parts = [m.groups() for m in _PART.finditer(re.sub("[\"']", " ", query))]
    phrases: list[Phrase] = []
    at = 0

    def peek(k: int = 0) -> str | None:
        return None if at + k >= len(parts) else parts[at + k][0] or parts[at + k][1] or parts[at + k][2]

    def take() -> str:
        nonlocal at
        at += 1
        return parts[at - 1][0] or parts[at - 1][1] or parts[at - 1][2]

    def words(text: str) -> list[str]:
        plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
        return re.findall(r"[^\W_]+", plain)

    def phrase() -> tuple | None:
        first = peek() == "^" and bool(take())
        said: list[str] = []
        while peek() is not None and peek() not in ("(", ")", "NEAR", "^", ","):
            said += words(take())
            if peek() != "+":
                break
            take()
        prefix = peek() == "*" and bool(take())
        if not said:
            return None
        phrases.append(Phrase(tuple(said), prefix, first))
        return ("PHRASE", len(phrases) - 1)

    def unit() -> tuple | None:
        if peek() == "(":
            take()
            out = either()
            if peek() != ")":
                raise ValueError(f"a bracket is missing: {query}")
            take()
            return out
        if peek() == "NEAR":
            take()
            near, reach = [], 10
            while peek() not in (")", ",", None):
                near.append(phrase())
            if peek() == ",":
                take()
                reach = int(take())
            if peek() != ")":
                raise ValueError(f"a bracket is missing: {query}")
            take()
            near = [n for n in near if n]
            return ("NEAR", *[n[1] for n in near], reach) if near else None
        if peek() in ("+", "*", ","):
            take()
            return None
        return phrase()

    def many() -> tuple | None:
        got = []
        while peek() not in (None, ")", "AND", "OR", "NOT"):
            got.append(unit())
        return joined("AND", got)

    def joined(name: str, got: list) -> tuple | None:
        got = [g for g in got if g]
        return None if not got else got[0] if len(got) == 1 else (name, *got)

    def without() -> tuple | None:
        out = many()
        while peek() == "NOT":
            take()
            out = joined("NOT", [out, many()]) if out else many()
        return out

    def both() -> tuple | None:
        got = [without()]
        while peek() == "AND":
            take()
            got.append(without())
        return joined("AND", got)

    def either() -> tuple | None:
        got = [both()]
        while peek() == "OR":
            take()
            got.append(both())
        return joined("OR", got)

    tree = either()
    if at < len(parts):
        raise ValueError(f"a bracket too many: {query}")
    return tree, phrases


def matches(tree: tuple, phrases: list[Phrase]) -> Column:
    """Does a document whose columns p0, p1, ... hold the phrases' places match?"""
    name, *args = tree
    if name == "PHRASE":
        return F.size(f"p{args[0]}") > 0
    if name == "NEAR":
        *of, reach = args
        return reduce(lambda a, b: a | b, [F.exists(f"p{i}", _clump(of, reach, phrases)) for i in of])
    sides = [matches(a, phrases) for a in args]
    if name == "NOT":
        return sides[0] & ~sides[1]
    return reduce((lambda a, b: a & b) if name == "AND" else (lambda a, b: a | b), sides)


def _clump(of: list[int], reach: int, phrases: list[Phrase]):
    """Is a place the last of a clump, that is, has every phrase a place at or before it, ending at most ``reach`` words before?"""

    def last(m: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.exists(f"p{j}", _within(m, len(phrases[j].words) + reach)) for j in of])

    return last


def _within(m: Column, back: int):
    return lambda q: (q <= m) & (q >= m - back)


def counted(tree: tuple, phrases: list[Phrase], under: Column | None = None) -> dict[int, Column]:
    """How often each phrase counts for a document's rank: where all of the query around it matches, in NEAR only inside clumps."""
    name, *args = tree
    here = matches(tree, phrases) if under is None else under & matches(tree, phrases)
    often = lambda places: F.when(here, F.size(places)).otherwise(0).cast("double")
    if name == "PHRASE":
        return {args[0]: often(F.col(f"p{args[0]}"))}
    if name == "NEAR":
        *of, reach = args
        lasts = F.flatten(F.array(*[F.filter(f"p{j}", _clump(of, reach, phrases)) for j in of]))

        def inside(i: int) -> Column:
            return F.filter(f"p{i}", lambda q: F.exists(lasts, lambda m: (q <= m) & (q >= m - len(phrases[i].words) - reach)))

        return {i: often(inside(i)) for i in of}
    out = {}
    for side in args[:1] if name == "NOT" else args:
        out |= counted(side, phrases, here)
    return out


def bm25_search(df: DataFrame, doc_id: str, text: str, query: str) -> DataFrame:
    """(id, bm25) of the rows that match, without a stored index."""
    return Index.of(df, doc_id, text).search(query)


def updated_postings(old: DataFrame, changed: DataFrame, removed: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Postings after rows changed (old and new ones) and ids were removed."""
    gone = changed.select(F.col(doc_id).alias("id")).union(removed.select(F.col(doc_id).alias("id"))).distinct()
    return old.join(gone, "id", "left_anti").unionByName(postings(changed, doc_id, text))
