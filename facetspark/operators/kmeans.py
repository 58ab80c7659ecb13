"""k-means with D^2-weighted seeding over features array<double>; centroids, k of them, live on the driver."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import aspect_label
from ..functions.vectors import dist2
from ..providers import embedded

#: Fixed value: most passes over the data.
MOST_PASSES = 1000


def _centre_columns(centres: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])


def assigned(df: DataFrame, features: str, centres: list[list[float]]) -> DataFrame:
    """``df`` with cluster (the lowest index on a tie) and its squared distance d2; no join, the centres are literals."""
    options = F.transform(_centre_columns(centres), lambda c, j: F.struct(dist2(F.col(features), c).alias("d"), j.alias("j")))
    best = F.array_min(options)
    return df.withColumn("__b", best).withColumns({"cluster": F.col("__b.j"), "d2": F.col("__b.d")}).drop("__b")


def centroids(df: DataFrame, features: str) -> DataFrame:
    """(cluster, n, centre): mean of each cluster's members."""
    parts = df.select("cluster", F.posexplode(features)).groupBy("cluster", "pos").agg(F.avg("col").alias("m"), F.count(F.lit(1)).alias("n"))
    return parts.groupBy("cluster").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("c")).select("cluster", "n", F.col("c.m").alias("centre"))


def with_features(df: DataFrame, metric: str, out: str = "f", name: str = "name", model: Callable | None = None) -> DataFrame:
    """``df`` with the features to group its files by: resolution, aspect-ratio (of width and height; unknown ones are 0), or name (embedded by ``model``)."""
    side = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    if metric == "resolution":
        return df.withColumn(out, F.array(side("width"), side("height")))
    if metric == "aspect-ratio":
        return df.withColumn(out, F.array(F.when((side("width") > 0) & (side("height") > 0), side("width") / side("height")).otherwise(0.0)))
    if metric == "name" and model is not None:
        return embedded(df, name, out, model)
    raise ValueError(f"no features for {metric}")


def seeds(df: DataFrame, row_id: str, features: str, k: int, seed: int) -> list[list[float]]:
    """k-means++: each next centre is drawn with weight d2, by one pass that takes the largest ln(u) / d2."""
    rng = random.Random(seed)
    draw = lambda: F.pmod(F.xxhash64(row_id, F.lit(rng.getrandbits(31))), F.lit(1 << 52)).cast("double") / float(1 << 52) + 1e-17
    first = df.orderBy(F.xxhash64(row_id, F.lit(seed)), row_id).select(features).first()
    out = [list(first[0])]
    while len(out) < k:
        key = F.when(F.col("d2") > 0, F.ln(draw()) / F.col("d2")).otherwise(F.lit(float("-inf")))
        out.append(list(assigned(df, features, out).orderBy(F.desc(key), row_id).select(features).first()[0]))
    return out


def kmeans(df: DataFrame, row_id: str, features: str, k: int, seed: int = 1, start: list[list[float]] | None = None, passes: int = MOST_PASSES) -> tuple[DataFrame, list[list[float]]]:
    """(rows with cluster, centres), repeated until the centres stay. k <= 0: no clusters; k >= rows: one each."""
    if k <= 0:
        return df.withColumns({"cluster": F.lit(None).cast("int"), "d2": F.lit(None).cast("double")}).limit(0), []
    few = df.select(row_id, features).orderBy(row_id).limit(k + 1).collect()
    if k >= len(few):
        centres = [list(r[features]) for r in few]
        return assigned(df, features, centres) if centres else df.withColumns({"cluster": F.lit(None).cast("int"), "d2": F.lit(None).cast("double")}), centres
    df = df.cache()
    centres = start or seeds(df, row_id, features, k, seed)
    for p in range(passes):
        got = {r.cluster: list(r.centre) for r in centroids(assigned(df, features, centres), features).collect()}
        spare = df.orderBy(F.xxhash64(row_id, F.lit(seed + p)), row_id).select(features).limit(k).collect() if len(got) < k else []
        new = [got.get(j) or list(spare[j % len(spare)][0]) for j in range(k)]
        if new == centres:
            break
        centres = new
    return assigned(df, features, centres), centres


def size_names(df: DataFrame) -> DataFrame:
    """(cluster, name): mean width x height of the members (cluster, width, height)."""
    half = lambda c: F.floor(F.avg(c) + 0.5).cast("string")
    return df.groupBy("cluster").agg(F.concat(half("width"), F.lit("x"), half("height")).alias("name"))


def aspect_names(df: DataFrame) -> DataFrame:
    """(cluster, name): aspect_1.50 of the mean ratio (cluster, ratio), else category_i."""
    label = aspect_label(F.avg("ratio"), F.lit(1.0))
    return df.groupBy("cluster").agg(label.alias("name")).withColumn("name", F.when(F.col("name") != "", F.col("name")).otherwise(F.concat(F.lit("category_"), F.col("cluster").cast("string"))))


def samples(df: DataFrame, name: str, n: int = 50) -> DataFrame:
    """(cluster, names): the first n member names of each cluster."""
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("cluster").orderBy(name))
    return df.withColumn("__r", r).filter(F.col("__r") <= n).groupBy("cluster").agg(F.array_sort(F.collect_list(name)).alias("names"))
