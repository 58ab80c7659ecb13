"""Imports: what to skip, status counts, the pending queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import STATUSES


def status_counts(df: DataFrame) -> DataFrame:
    """(status, n) over the whole domain, zeros included."""
    domain = df.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    n = df.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return domain.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def pending(df: DataFrame, limit: int = 100) -> DataFrame:
    return df.filter(F.col("status").isin("pending", "processing", "failed")).orderBy("id").limit(limit)


def classified(new: DataFrame, old: DataFrame) -> DataFrame:
    """``new`` (id, source_path, hash, ...) with outcome: duplicate (hash known), indexed (path done) or import.

    Of several new rows of one hash the first by id is imported.
    """
    hashes = old.filter("hash is not null").select("hash").distinct().withColumn("__h", F.lit(True))
    paths = old.filter("status = 'indexed' and source_path is not null").select("source_path").distinct().withColumn("__p", F.lit(True))
    first = F.row_number().over(Window.partitionBy("hash").orderBy("id"))
    rows = new.join(hashes, "hash", "left").join(paths, "source_path", "left").withColumn("__n", first)
    outcome = F.when(F.col("__h") | ((F.col("__n") > 1) & F.col("hash").isNotNull()), "duplicate").when(F.col("__p"), "indexed").otherwise("import")
    return rows.withColumn("outcome", outcome).drop("__h", "__p", "__n")


def outcome_counts(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("import", "duplicate", "indexed")])


def not_valued(images: DataFrame, valued: DataFrame) -> DataFrame:
    """Images without a record of the same hash and standard."""
    return images.join(valued.select("image_hash", "standard_name"), ["image_hash", "standard_name"], "left_anti")
