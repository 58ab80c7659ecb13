"""Best representative of each duplicate group by skyline selection.

Each record is judged on completeness, recency and trust. Within a group the Pareto-undominated records form
layer 1, those undominated among the rest layer 2, and so on. The survivor is the best record of layer 1 under a
lexicographic policy, and its null fields are filled from the first later record, by layer and then by policy,
that has them.

Nothing gathers a whole group. Records alike in completeness, in the set of fields they could fill and in trust
differ only in recency, so one of them, the most recent (the larger id on a tie), dominates the others and fills
the same fields: partial aggregation reduces a group to these class representatives, a window drops those below
the (trust, recency) staircase of their class set, and only that staircase meets in one row. Layers are defined
over these representatives.

Defined cases: a group with a null key part forms a group of its own; null trust or recency ranks lowest; an
empty input gives an empty result; repeated rows count in ``n_rows`` and the larger id wins; columns of any other
name, clashing ones too, are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hex64, read, usable_number


def version_key(c: Column) -> Column:
    """Text that sorts as dotted numbers do; missing numbers count as 0, a leading v is ignored, anything else is ''."""
    v = F.regexp_replace(F.trim(c), "^[vV]", "")
    parts = F.transform(F.split(v, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    text = F.regexp_replace(F.array_join(F.transform(parts, lambda p: F.concat(F.lpad(F.length(p).cast("string"), 5, "0"), p)), "."), r"(^|\.)00000(\.00000)*$", "")
    return F.when(v.rlike(r"^\d+(\.\d+)*$"), F.concat(F.lit("v"), text)).otherwise(F.lit(""))


def instant_seconds(c: Column) -> Column:
    """Whole seconds since 1970 of a written instant: ISO forms, slashes, an offset or UTC, epoch (milli)seconds; else null."""
    s = F.regexp_replace(F.trim(c), "/", "-")
    zoned = s.rlike(r"([zZ]|[+-]\d{2}:?\d{2})$") & (F.length(s) > 10)
    full = F.when(zoned, s).otherwise(F.concat(s, F.lit("Z")))
    stamp = F.unix_seconds(full.try_cast("timestamp"))
    return (
        F.when(s.rlike(r"^\d{13}$"), F.floor(s.try_cast("long") / 1000))
        .when(s.rlike(r"^\d{9,10}$"), s.try_cast("long"))
        .when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([ T]|$)"), stamp)
    )


def _has(field: str):
    return lambda q: q["p"]["x"][field].isNotNull()


def best_representatives(
    df: DataFrame,
    keys: dict[str, Column],
    row_id: Column,
    completeness: list[Column],
    trust: Column,
    recency: Column,
    fill: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per group: the keys, n_rows, first_id, best_id, n_layers, the filled fields and, per field, its source id.

    completeness: booleans, of which a record has more or fewer; trust: an orderable column; recency: a long.
    Policy: completeness, trust, recency, id, each the larger first.
    """
    fill = fill or {}
    none = F.lit(0)
    full = F.coalesce(sum((F.coalesce(c, F.lit(False)).cast("int") for c in completeness), none), none)
    mask = sum((F.when(c.isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(fill.values())), F.lit(0))
    ks = [f"__k{i}" for i in range(len(keys))]
    base = df.select(
        *[c.alias(k) for k, c in zip(ks, keys.values())],
        full.alias("__c"),
        mask.alias("__m"),
        trust.alias("__t"),
        F.struct(F.coalesce(recency, F.lit(-(1 << 62)).cast("long")).alias("r"), row_id.alias("id"), *[c.alias(f"f{i}") for i, c in enumerate(fill.values())]).alias("__x"),
    )
    classes = base.groupBy(*ks, "__c", "__m", "__t").agg(F.max("__x").alias("__x"), F.min("__x.id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*ks)
    above = w.partitionBy(*ks, "__c", "__m").orderBy(F.desc_nulls_last("__t")).rowsBetween(Window.unboundedPreceding, -1)
    stairs = classes.select(
        "*",
        F.sum("__n").over(w).alias("__rows"),
        F.min("__first").over(w).alias("__least"),
        F.max("__x.r").over(above).alias("__above"),
    ).filter(F.col("__above").isNull() | (F.col("__x.r") > F.col("__above")))
    point = F.struct(F.col("__c").alias("c"), F.col("__t").alias("t"), F.col("__x.r").alias("r"), F.col("__x.id").alias("id"), F.col("__x").alias("x"))
    groups = stairs.groupBy(*ks).agg(F.sort_array(F.collect_list(point), asc=False).alias("__p"), F.first("__rows").alias("n_rows"), F.first("__least").alias("first_id"))

    def dominates(a: Column, b: Column) -> Column:
        """a is at least as good in each respect and better in one (equal in all three: neither)."""
        at, bt = a["t"], b["t"]
        t_ge = bt.isNull() | F.coalesce(at >= bt, F.lit(False))
        t_gt = (bt.isNull() & at.isNotNull()) | F.coalesce(at > bt, F.lit(False))
        return (a["c"] >= b["c"]) & t_ge & (a["r"] >= b["r"]) & ((a["c"] > b["c"]) | t_gt | (a["r"] > b["r"]))

    # in policy order every dominator stands before what it dominates, so one pass numbers the layers
    def number(done: Column, p: Column) -> Column:
        higher = F.transform(F.filter(done, lambda q: dominates(q["p"], p)), lambda q: q["layer"])
        return F.concat(done, F.array(F.struct((F.coalesce(F.array_max(higher), F.lit(0)) + 1).alias("layer"), p.alias("p"))))

    kind = groups.schema["__p"].dataType.simpleString()[len("array<") : -1]
    start = F.array().cast(f"array<struct<layer:int,p:{kind}>>")
    layered = groups.withColumn("__l", F.aggregate("__p", start, number))
    first_layer = F.filter("__l", lambda q: q["layer"] == 1)
    by_layer = F.array_sort("__l", lambda a, b: a["layer"] - b["layer"])  # stable: the policy order stays within a layer
    out = layered.select(
        *[F.col(k).alias(name) for k, name in zip(ks, keys)],
        "n_rows",
        "first_id",
        F.get(first_layer, F.lit(0))["p"]["id"].alias("best_id"),
        F.array_max(F.transform("__l", lambda q: q["layer"])).alias("n_layers"),
        *([by_layer.alias("__l")] if fill else []),
    )
    for i, name in enumerate(fill):
        source = F.get(F.filter("__l", _has(f"f{i}")), F.lit(0))["p"]["x"]
        out = out.withColumns({name: source[f"f{i}"], f"{name}_from": source["id"]})
    return out.drop("__l")


def _valuation_groups(spark: SparkSession, sf_dir: str, fill: bool) -> DataFrame:
    v = read(spark, sf_dir, "valuation").select("id", "image_hash", "standard_name", "standard_version", "valued_at", "max_value").withColumn("__h", hex64(F.col("image_hash"))).filter("__h is not null")
    ok = usable_number(F.col("max_value"))
    version, at = version_key(F.col("standard_version")), instant_seconds(F.col("valued_at"))
    fields = {"max_value": F.when(ok, F.col("max_value")), "standard_version": F.when(version != "", F.trim("standard_version")), "valued_second": at}
    return best_representatives(v, {"image": F.col("__h"), "standard_name": F.col("standard_name")}, F.col("id"), [ok], version, at, fields if fill else None)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(first_id, best_id) of every group of two or more valuations of one image under one standard."""
    return _valuation_groups(spark, sf_dir, False).filter("n_rows >= 2").select("first_id", "best_id")


def p1_best_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record of every image and standard, nulls filled from later dominance layers."""
    return _valuation_groups(spark, sf_dir, True)


_SQL_KEYS = """
WITH v0 AS (
  SELECT id, standard_name, max_value,
    regexp_replace(regexp_replace(lower(image_hash), '^\\s*(sha-?256\\s*[-:_=]?\\s*|0x)', ''), '[^0-9a-f]', '', 'g') AS h,
    regexp_replace(trim(standard_version), '^[vV]', '') AS v,
    replace(trim(valued_at), '/', '-') AS s
  FROM valuation),
v1 AS (
  SELECT id, standard_name, h,
    CASE WHEN max_value IS NULL OR isnan(max_value) OR max_value < 0 THEN 0 ELSE 1 END AS ok,
    CASE WHEN regexp_full_match(v, '\\d+(\\.\\d+)*')
      THEN list_transform(range(0, 12), lambda i: coalesce(TRY_CAST(string_split(v, '.')[i + 1] AS BIGINT), 0)) END AS ver,
    CASE WHEN regexp_full_match(s, '\\d{13}') THEN CAST(floor(TRY_CAST(s AS BIGINT) / 1000) AS BIGINT)
      WHEN regexp_full_match(s, '\\d{9,10}') THEN TRY_CAST(s AS BIGINT)
      WHEN regexp_matches(s, '^\\d{4}-\\d{1,2}-\\d{1,2}([ T]|$)') THEN CAST(floor(epoch(TRY_CAST(
        CASE WHEN regexp_matches(s, '([zZ]|[+-]\\d{2}:?\\d{2})$') AND length(s) > 10 THEN s ELSE s || 'Z' END AS TIMESTAMPTZ))) AS BIGINT) END AS seen_at
  FROM v0 WHERE length(h) = 64),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY h, standard_name ORDER BY ok DESC, ver DESC NULLS LAST, seen_at DESC NULLS LAST, id DESC) AS rn,
    count(*) OVER (PARTITION BY h, standard_name) AS n, min(id) OVER (PARTITION BY h, standard_name) AS first_id
  FROM v1)
"""

SQL = {"p1_found": _SQL_KEYS + "SELECT first_id, id AS best_id FROM ranked WHERE rn = 1 AND n >= 2"}
QUERIES = {"p1_found": p1_found, "p1_best_records": p1_best_records}
