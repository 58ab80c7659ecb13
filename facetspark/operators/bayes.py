"""Bayesian search over candidates: scoring, updates, entropy, information gain, diversity, beams.

Beams are DataFrames (id, prob); several searches at once are told apart by partition columns given as ``by``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import sim01

#: Bins of expected answers, and the defaults of a search.
BINS = [round(0.05 + 0.1 * i, 2) for i in range(10)]
ALPHA, LAMBDA, BEAM, TOP, LEAST_GAIN = 0.5, 8.0, 500, 50, 0.05
COLLAPSED, PENALTY, ALIKE, CERTAIN, HOMOGENEOUS, PRESENT = 0.01, 0.3, 0.7, 0.9, 0.1, 0.5


def scores(vectors: DataFrame, questions: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(question_id, id, score) of every vector (id, text_vec, visual_vec) for the few questions (question_id, vec).

    alpha parts the score between the two vectors. Null and all-zero vectors and those of another length score 0.
    """
    kind = questions.schema["question_id"].dataType.simpleString()
    asked = questions.select("question_id", F.col("vec").cast("array<double>")).collect()  # a round asks a handful of questions
    held = vectors.sparkSession.sparkContext.broadcast([(r[0], np.asarray(r[1] if r[1] is not None and None not in r[1] else [], np.float64)) for r in asked])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = [(w, _by_length(b.column(i))) for i, w in ((1, alpha), (2, 1 - alpha))]
            for no, q in held.value:
                score = np.zeros(b.num_rows)
                for weight, groups in sides:
                    at, x = groups.get(len(q), (None, None))
                    if at is not None and len(q) and (norm := np.linalg.norm(q)) > 0:
                        there = x.any(axis=1)
                        score[at] += weight * np.where(there, (x @ (q / norm) + 1) / 2, 0)
                yield pa.record_batch([pa.array([no] * b.num_rows, {"int": pa.int32(), "bigint": pa.int64()}[kind]), b.column(0), pa.array(score)], names=["question_id", "id", "score"])

    return vectors.select(F.col("id").cast("long"), F.col("text_vec").cast("array<double>"), F.col("visual_vec").cast("array<double>")).mapInArrow(each, f"question_id {kind}, id long, score double")


def _by_length(col: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{length: (rows, unit vectors, or zeros)} of a list column, without nulls and vectors that hold one."""
    length = col.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(length[length > 0]):
        at = np.flatnonzero(length == n)
        x = col.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
        good = np.isfinite(x).all(axis=1)
        out[int(n)] = at[good], _unit(x[good])
    return out


def top_by_cosine(vectors: DataFrame, column: str, query: list[float], k: int) -> DataFrame:
    """(id, score): the k vectors most like the query, the smaller id on a tie. Exact."""
    one = vectors.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id long, vec array<double>")
    return most_similar(vectors, column, one, k).select("id", "score").orderBy(F.desc("score"), "id")


def most_similar(vectors: DataFrame, column: str, queries: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """(query_id, id, score): for each of the queries (query_id, vec) the k vectors of ``vectors`` (id, ``column``) most like it.

    Exact: every query meets every vector of its length, in matrix products, a block of queries at a time; a task sends
    on at most k rows a query. Scores are rounded to 12 digits, the smaller id comes first on a tie. Null and all-zero
    vectors score 0, those of another length take no part; an empty side gives no rows.
    """
    spark, out = vectors.sparkSession, None
    blocks = max(1, -(-queries.count() // block))
    for n in range(blocks):
        rows = (queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n)).select("query_id", "vec").collect()
        rows = [r for r in rows if r.vec is not None and None not in r.vec]
        for dim in sorted({len(r.vec) for r in rows}):
            some = [r for r in rows if len(r.vec) == dim]
            held = spark.sparkContext.broadcast((np.asarray([r.query_id for r in some], np.int64), _unit(np.asarray([r.vec for r in some], np.float64))))
            part = vectors.filter(F.size(column) == dim).select(F.col("id").cast("long"), F.col(column).cast("array<double>")).mapInArrow(_best_of(held, k, dim), "query_id long, id long, score double")
            out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, id long, score double")
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("__r", r).filter(F.col("__r") <= k).drop("__r")


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _best_of(held, k: int, dim: int):
    """A task's k best (id, score) of each query of a block."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, q = held.value
        there = np.linalg.norm(q, axis=1) > 0
        score, best = np.full((len(q), 0), -1.0), np.empty((len(q), 0), np.int64)
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for a in range(0, len(x), 4096):
                y = _unit(x[a : a + 4096])
                got = np.round((q @ y.T + 1) / 2, 12)
                got[:, ~y.any(axis=1)], got[~there] = 0.0, 0.0
                score = np.concatenate([score, got], axis=1)
                best = np.concatenate([best, np.broadcast_to(ids[a : a + 4096], got.shape)], axis=1)
                if score.shape[1] > k:
                    bar = np.partition(score, -k, axis=1)[:, -k]
                    keep = [np.flatnonzero(s >= t) for s, t in zip(score, bar)]
                    keep = [c[np.lexsort((best[i, c], -score[i, c]))[:k]] for i, c in enumerate(keep)]
                    score, best = np.take_along_axis(score, np.stack(keep), 1), np.take_along_axis(best, np.stack(keep), 1)
        if score.size:
            yield pa.record_batch([pa.array(np.repeat(asked, score.shape[1])), pa.array(best.ravel()), pa.array(score.ravel())], names=["query_id", "id", "score"])

    return each


def update(probs: DataFrame, scored: DataFrame, answer: float, lam: float = LAMBDA) -> DataFrame:
    """prob * exp(-lam (answer - score)^2); without a score prob stays. Not normalised."""
    likelihood = F.coalesce(F.exp(-F.lit(lam) * (F.lit(answer) - F.col("score")) * (F.lit(answer) - F.col("score"))), F.lit(1.0))
    return probs.join(scored.select("id", "score"), "id", "left").select("id", (F.col("prob") * likelihood).alias("prob"))


def normalised(probs: DataFrame) -> DataFrame:
    """Divided by their sum; unchanged if that is 0. The sum is one row, so nothing is gathered."""
    total = probs.agg(F.sum("prob").alias("__total"))
    return probs.crossJoin(F.broadcast(total)).withColumn("prob", F.when(F.col("__total") > 0, F.col("prob") / F.col("__total")).otherwise(F.col("prob"))).drop("__total")


def entropy(probs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Shannon entropy in nats; 0 for none."""
    h = F.coalesce(-F.sum(F.when(F.col("prob") > 0, F.col("prob") * F.ln("prob"))), F.lit(0.0))
    return probs.groupBy(*(by or [])).agg(h.alias("entropy"))


def information_gain(probs: DataFrame, scored: DataFrame, lam: float = LAMBDA, bins: list[float] | None = None) -> DataFrame:
    """(question_id, expected_entropy, info_gain): one aggregation per bin through H = ln T - sum(w ln w) / T."""
    h0 = entropy(probs)
    rows = scored.join(probs, "id").withColumn("bin", F.explode(F.array(*[F.lit(b) for b in bins or BINS])))
    w = F.col("prob") * F.exp(-F.lit(lam) * (F.col("bin") - F.col("score")) * (F.col("bin") - F.col("score")))
    per_bin = rows.select("question_id", "bin", w.alias("w")).groupBy("question_id", "bin").agg(F.sum("w").alias("t"), F.sum(F.when(F.col("w") > 0, F.col("w") * F.ln("w")).otherwise(0.0)).alias("wlw"))
    h = F.when(F.col("t") > 0, F.ln("t") - F.col("wlw") / F.col("t")).otherwise(F.col("entropy"))
    each = per_bin.crossJoin(F.broadcast(h0)).withColumn("h", h)
    mean = F.when(F.sum("t") > 0, F.sum(F.col("t") * F.col("h")) / F.sum("t")).otherwise(F.avg("h"))
    return each.groupBy("question_id").agg(mean.alias("expected_entropy"), F.first("entropy").alias("entropy")).select("question_id", "expected_entropy", (F.col("entropy") - F.col("expected_entropy")).alias("info_gain"))


def bin_probabilities(probs: DataFrame, scored: DataFrame, lam: float = LAMBDA, bins: list[float] | None = None) -> DataFrame:
    """(question_id, bin, prob): how likely each answer is; equal if nothing is likely."""
    rows = scored.join(probs, "id").withColumn("bin", F.explode(F.array(*[F.lit(b) for b in bins or BINS])))
    w = F.col("prob") * F.exp(-F.lit(lam) * (F.col("bin") - F.col("score")) * (F.col("bin") - F.col("score")))
    t = rows.groupBy("question_id", "bin").agg(F.sum(w).alias("t"))
    whole = F.sum("t").over(Window.partitionBy("question_id"))
    return t.select("question_id", "bin", F.when(whole > 0, F.col("t") / whole).otherwise(F.lit(1.0 / len(bins or BINS))).alias("prob"))


def described(beam: DataFrame, captions: DataFrame) -> DataFrame:
    """(ordinal, id, prob, description) of a beam, the likeliest first; captions: (id, description)."""
    rows = beam.join(captions.select("id", "description"), "id", "left")
    said = F.coalesce(F.nullif(F.trim("description"), F.lit("")), F.concat(F.lit("Image "), F.col("id").cast("string")))
    ordinal = F.row_number().over(Window.orderBy(F.desc("prob"), "id"))  # a beam is small
    return rows.select(ordinal.alias("ordinal"), "id", "prob", said.alias("description"))


def save_beam(beam: DataFrame, path: str) -> None:
    beam.select("id", "prob").sortWithinPartitions(F.desc("prob"), "id").write.mode("overwrite").parquet(path)


def load_beam(spark: SparkSession, path: str, size: int = BEAM) -> DataFrame:
    return pruned(spark.read.schema("id long, prob double").parquet(path), size)


def penalised(gains: DataFrame, questions: DataFrame, skipped: DataFrame) -> DataFrame:
    """Gains of questions much like a skipped one (question vectors) are cut to a part."""
    s = skipped.select(F.col("vec").alias("other"))
    near = questions.crossJoin(F.broadcast(s)).groupBy("question_id").agg(F.max(sim01(F.col("vec"), F.col("other"))).alias("most"))
    return gains.join(near, "question_id", "left").withColumn("info_gain", F.when(F.col("most") > ALIKE, F.col("info_gain") * PENALTY).otherwise(F.col("info_gain"))).drop("most")


def best_question(gains: DataFrame) -> DataFrame:
    return gains.orderBy(F.desc("info_gain"), "question_id").limit(1)


def diversity(vectors: DataFrame, column: str) -> DataFrame:
    """Mean of 1 - sim01 over all pairs, without forming pairs: from the length of the sum of unit vectors.

    A vector that is null or all zero is like none; 0 for fewer than two vectors. Only sums leave a task.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, nz, sums = 0, 0, {}
        for b in batches:
            n += b.num_rows
            for d, (_, x) in _by_length(b.column(0)).items():
                nz += int(x.any(axis=1).sum())
                sums[d] = sums.get(d, 0) + x.sum(axis=0)
        rows = [(n, nz, None, None, 0.0)] + [(0, 0, d, i, float(v)) for d, s in sums.items() for i, v in enumerate(s)]
        yield pa.RecordBatch.from_pylist([dict(zip(("n", "nz", "d", "pos", "s"), r)) for r in rows], pa.schema([("n", pa.int64()), ("nz", pa.int64()), ("d", pa.int32()), ("pos", pa.int32()), ("s", pa.float64())]))

    parts = vectors.select(F.col(column).cast("array<double>")).mapInArrow(each, "n long, nz long, d int, pos int, s double")
    parts = parts.groupBy("d", "pos").agg(F.sum("n").alias("n"), F.sum("nz").alias("nz"), F.sum("s").alias("s"))
    whole = parts.agg(F.sum("n").cast("double").alias("n"), F.sum("nz").cast("double").alias("nz"), F.coalesce(F.sum(F.when(F.col("pos").isNotNull(), F.col("s") * F.col("s"))), F.lit(0.0)).alias("len2"))
    pairs, alike = F.col("n") * (F.col("n") - 1) / 2, F.col("nz") * (F.col("nz") - 1) / 2
    value = 1 - ((F.col("len2") - F.col("nz")) / 2 + alike) / (2 * pairs)
    return whole.select(F.when(F.coalesce(F.col("n"), F.lit(0.0)) < 2, 0.0).otherwise(value).alias("diversity"))


def tempered(posterior: DataFrame, prior: DataFrame, beta: float) -> DataFrame:
    """(1 - beta) posterior + beta prior; a missing prior is 0."""
    p = prior.select("id", F.col("prob").alias("__prior"))
    return posterior.join(p, "id", "left").select("id", ((1 - F.lit(beta)) * F.col("prob") + F.lit(beta) * F.coalesce("__prior", F.lit(0.0))).alias("prob"))


def pruned(beam: DataFrame, size: int = BEAM) -> DataFrame:
    return beam.orderBy(F.desc("prob"), "id").limit(size)


def beam_stats(beam: DataFrame, threshold: float = COLLAPSED) -> DataFrame:
    """(size, max_prob, collapsed): collapsed if no probability reaches the threshold."""
    return beam.agg(F.count(F.lit(1)).alias("size"), F.coalesce(F.max("prob"), F.lit(0.0)).alias("max_prob"), (~F.coalesce(F.bool_or(F.col("prob") >= threshold), F.lit(False))).alias("collapsed"))


def uniform(ids: DataFrame) -> DataFrame:
    """(id, prob) with equal probabilities."""
    n = ids.agg(F.count(F.lit(1)).alias("__n"))
    return ids.crossJoin(F.broadcast(n)).select("id", (F.lit(1.0) / F.col("__n")).alias("prob"))


def scroll(vectors: DataFrame, limit: int, offset: int = 0, seed: int | None = None) -> DataFrame:
    """Ids in order from an offset on, or in a seeded shuffled order."""
    rows = vectors.filter(F.col("id") >= offset).select("id")
    return rows.orderBy("id" if seed is None else F.xxhash64("id", F.lit(seed))).limit(limit)


def termination(states: DataFrame, least_rounds: int = 2, most_rounds: int = 8, least_gain: float = LEAST_GAIN) -> DataFrame:
    """``states`` (round, diversity, best_gain, max_prob) with the reason to stop, null to go on."""
    late = F.col("round") >= least_rounds
    reason = (
        F.when((F.col("diversity") < HOMOGENEOUS) & late, "homogeneous")
        .when(F.col("best_gain").isNull() | ((F.col("best_gain") < least_gain) & late), "low_ig")
        .when(F.col("max_prob") >= CERTAIN, "confidence")
        .when(F.col("round") >= most_rounds, F.when(F.col("max_prob") < PRESENT, "not_in_library").otherwise("max_rounds"))
    )
    return states.withColumn("reason", reason)


def ranked_by_session(beams: DataFrame, k: int, by: str = "session_id") -> DataFrame:
    """Top k of every session's beam."""
    r = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("prob"), "id"))
    return beams.withColumn("rank", r).filter(F.col("rank") <= k)
