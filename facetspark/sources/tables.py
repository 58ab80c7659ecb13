"""A table store over Parquet with a log of commits.

A write adds files in a folder of its own and then a commit: a small JSON file of the next number, created only if
there is none, so of two writers one fails and tries again on what the other wrote. A commit replaces the table, adds
rows, or puts rows in place of those of equal key. A reader puts together what the log names: rows of a part are
hidden by later parts that put their keys anew. ``compact`` writes that down as one part, ``vacuum`` deletes folders
no longer named.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import TABLES


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Conflict(RuntimeError):
    """Another writer committed first, again and again."""


class Store:
    """Tables under one root, on any file system that Spark writes to."""

    #: Parts that put rows anew before a write compacts the table, and how often a write is tried.
    PARTS, TRIES = 16, 8

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commits(self, name: str) -> list[int]:
        at, fs = self._path(name, "log"), self._fs()
        return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(at) if f.getPath().getName().endswith(".json")) if fs.exists(at) else []

    def _entry(self, name: str, no: int) -> dict:
        for left in range(50, -1, -1):
            stream = self._fs().open(self._path(name, "log", f"{no:08d}.json"))
            try:
                return json.loads(bytes(stream.readAllBytes()))
            except ValueError:  # its writer has made it but not yet filled it
                if not left:
                    raise
                time.sleep(0.1)
            finally:
                stream.close()

    def _parts(self, name: str) -> tuple[int, list[dict]]:
        """(last commit, parts from the last one that replaced the table on)."""
        numbers, parts = self._commits(name), []
        for no in reversed(numbers):
            parts.insert(0, self._entry(name, no))
            if parts[0]["kind"] == "replace":
                break
        return (numbers[-1] if numbers else 0), parts

    def _commit(self, name: str, after: int, entry: dict) -> bool:
        """False if another writer made the commit that follows ``after``."""
        try:
            stream = self._fs().create(self._path(name, "log", f"{after + 1:08d}.json"), False)
        except Exception as e:  # noqa: BLE001
            if "exist" in str(e).lower():
                return False
            raise
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        return True

    def _write(self, name: str, kind: str, make, key: str | None = None) -> None:
        """make: the rows to write, given the present table (None if there is none); it runs again after a conflict."""
        for _ in range(self.TRIES):
            last, parts = self._parts(name)
            folder = uuid.uuid4().hex
            make(self._table(name, parts) if parts else None).write.parquet(f"{self.root}/{name}/{folder}")
            if self._commit(name, last, {"kind": kind, "folder": folder, "key": key}):
                return
        raise Conflict(name)

    def _table(self, name: str, parts: list[dict]) -> DataFrame:
        out, hidden = [], []
        for part in reversed(parts):
            rows = self.spark.read.parquet(f"{self.root}/{name}/{part['folder']}")
            for key, keys in hidden:
                rows = rows.join(keys, key, "left_anti").select(*rows.columns)
            if part["kind"] == "upsert":
                hidden.append((part["key"], self.spark.read.parquet(f"{self.root}/{name}/{part['folder']}").select(part["key"]).distinct()))
            out.append(rows)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reversed(out))

    def exists(self, name: str) -> bool:
        return bool(self._commits(name))

    def names(self) -> list[str]:
        fs = self._fs()
        return sorted(f.getPath().getName() for f in fs.listStatus(self._path()) if self.exists(f.getPath().getName())) if fs.exists(self._path()) else []

    def reachable(self) -> bool:
        """Can the root's file system be asked?"""
        try:
            self._fs().exists(self._path())
            return True
        except Exception:  # noqa: BLE001
            return False

    def count(self, name: str) -> int:
        """Rows of a table; 0 if there is none."""
        return self.read(name).count() if self.exists(name) else 0

    def ensure(self, name: str, schema: str | None = None) -> None:
        """An empty typed table unless there is one."""
        if not self.exists(name):
            self.write(name, self.spark.createDataFrame([], schema or TABLES[name]))

    def read(self, name: str) -> DataFrame:
        parts = self._parts(name)[1]
        if not parts:
            raise FileNotFoundError(f"no table {name} in {self.root}")
        return self._table(name, parts)

    def write(self, name: str, df: DataFrame) -> None:
        self._write(name, "replace", lambda _: df)

    def append(self, name: str, rows: DataFrame, row_id: str = "id") -> None:
        """Insert rows without ids: they are numbered on from the greatest. Only they are written."""
        self._write(name, "append", lambda old: _like(numbered(rows, row_id, old.agg(F.max(row_id)).first()[0] or 0), old))

    def insert_or_ignore(self, name: str, rows: DataFrame, key: str) -> None:
        self._write(name, "append", lambda old: _like(new_rows(old, rows, key), old))

    def upsert(self, name: str, rows: DataFrame, key: str = "id") -> None:
        """Only the rows are written; they hide older ones of their keys. Many such parts are compacted first."""
        if sum(p["kind"] == "upsert" for p in self._parts(name)[1]) >= self.PARTS:
            self.compact(name)
        self._write(name, "upsert", lambda old: _like(rows, old), key)

    def patch(self, name: str, changes: DataFrame, key: str = "id", stamp: str | None = None) -> None:
        """Columns of ``changes`` that aren't null replace those of the row of equal key; stamp: a text column set to now."""

        def changed(old: DataFrame) -> DataFrame:
            hit = patched(old.join(F.broadcast(changes.select(key)) if changes.count() <= 100_000 else changes.select(key), key, "left_semi"), changes, key)
            return _like(hit.withColumn(stamp, F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")) if stamp else hit, old)

        self._write(name, "upsert", changed, key)

    def compact(self, name: str) -> None:
        self._write(name, "replace", lambda old: old)

    def vacuum(self, name: str) -> int:
        """Delete folders and commits that the table's newest state doesn't need; readers of older states fail. Gives the folders' number."""
        last, parts = self._parts(name)
        fs, named, gone = self._fs(), {p["folder"] for p in parts}, 0
        for f in fs.listStatus(self._path(name)):
            if f.getPath().getName() not in named | {"log"}:
                gone += bool(fs.delete(f.getPath(), True))
        for no in self._commits(name)[: -len(parts)]:
            fs.delete(self._path(name, "log", f"{no:08d}.json"), False)
        return gone

    def migrate(self, steps: dict[str, object]) -> list[str]:
        """Run the steps {"001_name": function of the store} not yet run, by their number; the names of those now run."""
        self.ensure("migrations", "id long, name string, applied_at string")
        done = {r.name for r in self.read("migrations").select("name").collect()}
        order = sorted((n for n in steps if n not in done), key=lambda n: (int(n.split("_")[0]), n))
        for n in order:
            steps[n](self)
            row = self.spark.createDataFrame([(n,)], "name string").withColumn("applied_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))
            self.append("migrations", row)
        return order


def _like(rows: DataFrame, old: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``old``, those it lacks null."""
    return rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in old.schema])


def numbered(rows: DataFrame, row_id: str, after: int) -> DataFrame:
    """Rows with consecutive ids after a number, counted by partition so that no task sees them all."""
    part = rows.drop(row_id).withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id())
    sizes = {r["__p"]: r["n"] for r in part.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], after
    for p in sorted(sizes):
        starts += [F.lit(p), F.lit(total)]
        total += sizes[p]
    if not starts:
        return rows.withColumn(row_id, F.lit(None).cast("long")).limit(0)
    in_part = F.row_number().over(Window.partitionBy("__p").orderBy("__m"))
    return part.withColumn(row_id, (F.create_map(*starts)[F.col("__p")] + in_part).cast("long")).drop("__p", "__m")


def new_rows(old: DataFrame, rows: DataFrame, key: str, order: str = "id") -> DataFrame:
    """Rows whose key ``old`` lacks; of several with one key the first by ``order``."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.join(old.select(key), key, "left_anti").withColumn("__n", first).filter("__n = 1").drop("__n")


def insert_or_ignore(old: DataFrame, rows: DataFrame, key: str, order: str = "id") -> DataFrame:
    """``old`` and those new rows whose key is new."""
    return old.unionByName(new_rows(old, rows, key, order), allowMissingColumns=True)


def upsert(old: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    return old.join(rows.select(key), key, "left_anti").unionByName(rows)


def patched(old: DataFrame, patch: DataFrame, key: str = "id") -> DataFrame:
    """Columns of ``patch`` that aren't null replace those of the row of equal key."""
    names = [c for c in patch.columns if c != key]
    p = patch.select(key, *[F.col(c).alias(f"__{c}") for c in names])
    return old.join(p, key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in names}).drop(*[f"__{c}" for c in names])


def replaced(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) == old, F.lit(new)).otherwise(F.col(column)))


def by_key(df: DataFrame, column: str, value, order: list[Column | str] | None = None, limit: int | None = None) -> DataFrame:
    """Point lookup; the filter reaches the scan."""
    out = df.filter(F.col(column) == value).orderBy(*(order or ["id"]))
    return out if limit is None else out.limit(limit)


def vectors_of(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("id"), "id", "left_semi")
