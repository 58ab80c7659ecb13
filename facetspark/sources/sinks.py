"""Where results go: JSON lines, failed rows, moved files, line texts."""

from __future__ import annotations

import json
import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_path, file_url, iso_time, stamp


def json_lines(df: DataFrame) -> DataFrame:
    """(json): every row as one JSON object, nulls kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def pretty_json(df: DataFrame, limit: int) -> str:
    """At most ``limit`` rows as an indented JSON list, for a console."""
    return json.dumps([json.loads(r.json) for r in json_lines(df.limit(limit)).collect()], indent=2, ensure_ascii=False)


def log_failures(df: DataFrame, error: str, folder: str, hash_col: str = "image_hash") -> DataFrame:
    """Rows without an error, as they are; those with one are appended to ``folder`` as JSON with their time and a name
    fail-<time>-<first 8 digits>. Without a folder nothing is written."""
    bad = F.col(error).isNotNull() & (F.col(error) != "")
    if folder:
        now = F.current_timestamp()
        named = F.concat(F.lit("fail-"), stamp(now), F.lit("-"), F.left(F.coalesce(F.col(hash_col), F.lit("")), F.lit(8)))
        df.filter(bad).withColumns({"failed_at": iso_time(now), "name": named}).write.mode("append").json(folder)
    return df.filter(~bad | F.col(error).isNull())


def move_files(plan: DataFrame, folder: str, dry_run: bool = True) -> DataFrame:
    """(url, new_url, moved) of a move plan (url, target, action) whose files lie on one machine's disks, the driver's.

    Files are moved one partition of the plan at a time, only if ``dry_run`` is false; a file that is gone, or whose
    target has come into being meanwhile (unless it is to be replaced), stays where it is.
    """
    spark = plan.sparkSession
    todo = plan.filter(F.col("target").isNotNull() & F.col("action").isin("moved", "replaced"))
    todo = todo.select("url", file_path(F.col("url")).alias("path"), "target", "action", file_url(F.concat(F.lit(folder.rstrip("/") + "/"), "target")).alias("new_url"))
    done = []
    for r in todo.toLocalIterator():
        to = os.path.join(folder, r.target)
        ok = r.path is not None and os.path.exists(r.path) and (r.action == "replaced" or not os.path.exists(to))
        if ok and not dry_run:
            os.makedirs(folder, exist_ok=True)
            shutil.move(r.path, to)
        done.append((r.url, r.new_url, bool(ok and not dry_run)))
    return spark.createDataFrame(done, "url string, new_url string, moved boolean")


def moved_urls(records: DataFrame, moved: DataFrame) -> DataFrame:
    """``records`` with the new URL of files that were moved."""
    new = moved.filter("moved").select(F.col("url").alias("__old"), "new_url")
    return records.join(new, records.url == F.col("__old"), "left").withColumn("url", F.coalesce("new_url", "url")).drop("__old", "new_url")


def write_lines(df: DataFrame, order: str, line: str, path: str) -> None:
    """A text file a partition, in order of ``order`` over all of them."""
    df.select(order, F.coalesce(F.col(line), F.lit("")).alias("value")).repartitionByRange(order).sortWithinPartitions(order).select("value").write.text(path)


def translated_path(path: str) -> str:
    """The name beside a file for its translation: a-tr.txt for a.txt."""
    stem, ending = os.path.splitext(path)
    return f"{stem}-tr{ending}"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, line): lines in order of their place; no file is one row."""
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("n"), F.regexp_replace("value", "\r$", "").alias("line"))
    return rows
