"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a per-group table may be broadcast; it is counted before the hint is given.
BROADCAST_ROWS = 200_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the folder of spark.checkpoint.dir, which all executors share, and cut its lineage.

    The files are deleted once nothing refers to the rows any more, unless the session says otherwise. A folder of this
    machine is used only on a local master that names none, as in tests; on a cluster that is an error.
    """
    sc = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="facetspark-checkpoint-"))
    sc._jsc.sc().conf().setIfMissing("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return df.checkpoint(eager=True)


def slots(spark: SparkSession, n: int) -> list[int]:
    """n int numbers, the k-th of which ``repartition(n, column)`` puts into partition k: tasks without collisions."""
    tried = 16 * n + 64
    while True:
        at = spark.range(tried).select(F.col("id").cast("int").alias("v")).groupBy(F.pmod(F.hash("v"), F.lit(n)).alias("p")).agg(F.min("v").alias("v")).collect()
        if len(at) == n:
            return [r.v for r in sorted(at)]
        tried *= 2


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (already materialised) with a broadcast hint if it has at most ``limit`` rows, else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def hex64(c: Column) -> Column:
    """The 64 hex digits of a SHA-256, however written (case, blanks, separators, sha256: or 0x in front), else null."""
    bare = F.regexp_replace(F.lower(c), r"^\s*(?:sha-?256\s*[-:_=]?\s*|0x)", "")
    digits = F.regexp_replace(bare, "[^0-9a-f]", "")
    return F.when(F.length(digits) == 64, digits)


def usable_number(c: Column) -> Column:
    """True for a number that is not null, not NaN and not negative."""
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (c >= 0), F.lit(False))


def unit_rows(vectors, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, unit vectors in float32) of the usable entries: ``dim`` finite numbers that are not all zero."""
    keep = [i for i, v in enumerate(vectors) if v is not None and len(v) == dim]
    if not keep:
        return np.empty(0, np.int64), np.empty((0, dim), np.float32)
    x = np.stack([np.asarray(vectors[i], np.float64) for i in keep])
    norm = np.linalg.norm(x, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return np.asarray(keep, np.int64)[good], (x[good] / norm[good, None]).astype(np.float32)
