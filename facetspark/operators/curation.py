"""Per-file maxima, lowest files, counts, and the plan of moving files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename, file_path, matches_any


def file_values(df: DataFrame) -> DataFrame:
    """(url, image_hash, max_value, record_count): each file's highest value, with the hash of that record."""
    best = F.max(F.struct(F.col("max_value").alias("v"), (-F.col("id")).alias("o"), "image_hash")).alias("b")
    return df.filter("max_value is not null and not isnan(max_value)").groupBy("url").agg(best, F.count(F.lit(1)).alias("record_count")).select("url", F.col("b.image_hash").alias("image_hash"), F.col("b.v").alias("max_value"), "record_count")


def below(df: DataFrame, threshold: float, globs: list[str] | None = None) -> DataFrame:
    """Files whose highest value is under the threshold, the lowest first."""
    return file_values(df.filter(matches_any(F.col("url"), globs or []))).filter(F.col("max_value") < threshold).orderBy("max_value", "url")


def lowest(df: DataFrame, n: int, globs: list[str] | None = None) -> DataFrame:
    return file_values(df.filter(matches_any(F.col("url"), globs or []))).orderBy("max_value", "url").limit(n)


def lowest_percent(df: DataFrame, percent: float, globs: list[str] | None = None) -> DataFrame:
    """The lowest ceil(files * percent / 100) files."""
    files = file_values(df.filter(matches_any(F.col("url"), globs or [])))
    return files.orderBy("max_value", "url").limit(-(-int(files.count() * percent * 1e6) // 100_000_000))


def parse_threshold(text: str) -> tuple[str, float]:
    """('value', x) with x > 0 or ('percent', p) with 0 < p <= 100."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*(%?)\s*", text)
    value = float(m.group(1)) if m else 0
    if not m or value <= 0 or (m.group(2) and value > 100):
        raise ValueError(f"no threshold: {text}")
    return ("percent" if m.group(2) else "value"), value


def file_count(df: DataFrame, globs: list[str] | None = None) -> DataFrame:
    return df.filter(matches_any(F.col("url"), globs or [])).agg(F.count_distinct("url").alias("files"))


def max_value_of(df: DataFrame, url: str) -> DataFrame:
    return df.filter(F.col("url") == url).agg(F.max(F.when(~F.isnan("max_value"), F.col("max_value"))).alias("max_value"))


def plan_move(files: DataFrame, existing: DataFrame, on_collision: str = "skip") -> DataFrame:
    """(url, name, target, action) for files (url, max_value) into a folder that holds existing (name, max_value).

    skip leaves a file whose name is taken, rename numbers it (see ``with_free_names``), abort marks all if one
    collides, keep-max replaces a lower one (an unknown value is never replaced). URLs that are no files are skipped.
    """
    if on_collision not in ("skip", "rename", "abort", "keep-max"):
        raise ValueError(f"unknown collision mode: {on_collision}")
    named = files.select("url", "max_value", basename(file_path(F.col("url"))).alias("name"))
    first = F.row_number().over(Window.partitionBy("name").orderBy("url"))
    have = existing.groupBy("name").agg(F.max("max_value").alias("held"), F.lit(1).alias("taken"))
    rows = named.withColumn("copy", first).join(have, "name", "left").withColumn("known", F.col("taken").isNotNull()).withColumn("taken", F.col("known") | (F.col("copy") > 1))
    if on_collision == "rename":
        number = F.col("copy") - F.when(F.col("known"), 0).otherwise(1)
        rows = with_free_names(rows.withColumn("number", number), existing.select("name"), [], "name", "number", "renamed")
    action: Column = F.when(F.col("name").isNull(), "skipped").when(~F.col("taken"), "moved")
    if on_collision == "rename":
        action = action.otherwise("moved")
    elif on_collision == "keep-max":
        action = action.otherwise(F.when((F.col("copy") == 1) & (F.col("max_value") > F.col("held")), "replaced").otherwise("skipped"))
    elif on_collision == "abort":
        collides = rows.agg(F.coalesce(F.bool_or(F.col("taken") & F.col("name").isNotNull()), F.lit(False)).alias("collides"))
        rows = rows.crossJoin(F.broadcast(collides))  # one row
        action = F.when(F.col("collides"), "aborted").otherwise(action.otherwise("skipped"))
    else:
        action = action.otherwise("skipped")
    target = F.when(action.isin("moved", "replaced"), F.col("renamed" if on_collision == "rename" else "name"))
    return rows.select("url", "name", target.alias("target"), action.alias("action"))


def with_free_names(df: DataFrame, existing: DataFrame, folder: list[str], name: str, number: str, out: str, mark: str = "_") -> DataFrame:
    """``df`` with ``out``: the name itself where ``number`` is 0, else its number-th free form name_1, name_2 and so on.

    A form is free if no row of ``df`` or ``existing`` bears it in that folder, so nothing is overwritten in whatever
    order files move. The k-th free number is k plus the taken numbers below it: one running count per name.
    """
    parts = lambda k: F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?$", k)
    born = df.select(*folder, name).unionByName(existing.select(*folder, name)).filter(F.col(name).isNotNull()).distinct()
    form = rf"(?s)^(.+){mark}([1-9][0-9]{{0,8}})$"
    taken = born.select(*folder, F.concat(F.regexp_extract(parts(1), form, 1), parts(2)).alias(name), F.regexp_extract(parts(1), form, 2).try_cast("long").alias("__v")).filter("__v is not null")
    wanted = df.filter(F.col(number) > 0).groupBy(*folder, name).agg(F.max(number).alias("__most"))
    taken = taken.join(wanted, [*folder, name])
    w = Window.partitionBy(*folder, name)
    below = taken.withColumn("__v", F.col("__v") - F.row_number().over(w.orderBy("__v"))).filter(F.col("__v") < F.col("__most")).select(*folder, name, "__v", F.lit(1).alias("__t"))
    rows = df.withColumn("__v", F.when(F.col(number) > 0, F.col(number)).cast("long")).withColumn("__t", F.lit(0))
    rows = rows.unionByName(below, allowMissingColumns=True)
    rows = rows.withColumn("__n", F.col("__v") + F.sum("__t").over(w.orderBy("__v", "__t"))).filter("__t = 0")
    return rows.withColumn(out, F.when(F.col("__v").isNull(), F.col(name)).otherwise(F.concat(parts(1), F.lit(mark), F.col("__n").cast("string"), parts(2)))).drop("__v", "__t", "__n")


def unique_names(df: DataFrame, folder: str, name: str, order: str, mark: str = "_") -> DataFrame:
    """``df`` with unique_name: repeated names of a folder get free forms _1, _2 and so on before their ending."""
    k = F.row_number().over(Window.partitionBy(folder, name).orderBy(order)) - 1
    named = with_free_names(df.withColumn("__k", k), df.select(folder, name).limit(0), [folder], name, "__k", "unique_name", mark)
    return named.drop("__k")
