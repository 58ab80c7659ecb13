"""Incremental imports from a drop folder; an extension, since imports elsewhere are batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.imports import classified
from ..schemas import IMAGE_IMPORT
from ..sources.tables import Store


def arrivals(spark: SparkSession, folder: str, late: str = "1 day") -> DataFrame:
    """New rows of a Parquet folder, repeats of a hash within the watermark dropped. A row without a hash repeats none but itself."""
    rows = spark.readStream.schema(IMAGE_IMPORT).parquet(folder)
    at = F.to_timestamp("imported_at")
    what = F.coalesce(F.concat(F.lit("hash "), "hash"), F.concat(F.lit("row "), "id"), F.concat(F.lit("path "), "source_path"), F.uuid())
    return rows.withColumn("at", at).withColumn("what", what).withWatermark("at", late).dropDuplicatesWithinWatermark(["what"]).drop("at", "what")


def import_stream(rows: DataFrame, store: Store, table: str, checkpoint: str) -> StreamingQuery:
    """Add what isn't a duplicate, batch by batch. A batch run again changes nothing: its ids are replaced by themselves."""

    def batch(df: DataFrame, _: int) -> None:
        old = store.read(table)
        new = classified(df, old.join(df.select("id"), "id", "left_anti")).filter("outcome = 'import'").drop("outcome")
        store.upsert(table, new.select(*old.columns))

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_windows(rows: DataFrame, size: str = "10 minutes") -> DataFrame:
    """Counts by status and event-time window of (imported_at, status) rows, streamed or not."""
    at = rows.withColumn("at", F.to_timestamp("imported_at"))
    at = at.withWatermark("at", "1 day") if rows.isStreaming else at
    return at.groupBy(F.window("at", size).alias("w"), "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "status", "n")
