"""A varied subset of a given size by tournament-pivoted, rank-revealing QR.

A record's row of features is its unit vector and, at a lower weight, its hashed description. In a round every
partition nominates the rows a column-pivoted QR of its transposed rows would take first: each time the row with
the largest part outside the span of those taken. Nominees meet pairwise in a tree and are pivoted again, and the
last node's rows are chosen. Before the next round all rows are deflated by the span of those chosen: what counts is
the part outside it. When no row reaches LOW of the first pivot outside the span, the rank is used up; a new pass over
the dimensions then begins, in which a row counts only as far as it differs from the row most like it of those chosen
in former passes, so copies and bursts stay out. Rounds repeat until the subset is full; memory per task is one batch
and one round's nominees, and only the chosen rows reach the driver. Nodes are dealt by a hash of the id, so the
subset doesn't depend on how the input was partitioned.

Defined cases: unusable vectors take no part; a null or empty description adds nothing; equal rows are taken once
(the least id), and again only when nothing else is left; fewer usable rows than asked for are all taken; an empty
table gives no rows; ties go to the smaller id; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read
from .leakage import words
from .vectors import DIM, matrix, to_binary, units_of

TEXT_DIM, TEXT_WEIGHT = 64, 0.5
PER_ROUND, BATCH, NODE = 64, 4096, 16_384
#: Part of the first pivot's length below which the rank counts as used up.
LOW = 0.25
#: Below this squared sine a row equals a chosen one but for rounding.
SAME = 1e-5
_NOMINEE = "node int, id long, residual double, vec binary"


def features(df: DataFrame, row_id: str, vector: str, text: str, dim: int = DIM) -> DataFrame:
    """(id, vec): the float32 bytes of the unit vector and the weighted hashed text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = units_of(b.column(1), dim)
            if not len(at):
                continue
            said = b.column(2).take(pa.array(at)).to_pylist()
            t = np.zeros((len(at), TEXT_DIM), np.float32)
            for i, s in enumerate(said):
                for w in words(s):
                    h = crc32(w.encode())
                    t[i, h % TEXT_DIM] += 1 if h & 0x80000000 else -1
            t *= TEXT_WEIGHT / np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-12)
            yield pa.record_batch([b.column(0).take(pa.array(at)), to_binary(np.concatenate([x, t], axis=1))], names=["id", "vec"])

    return df.select(F.col(row_id).cast("long"), F.col(vector).cast("array<float>"), F.col(text).cast("string")).mapInArrow(each, "id long, vec binary")


def pivots(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order a pivoted QR takes them, and the length of each outside the span of those before it."""
    rest = x.astype(np.float64)
    size = np.einsum("ij,ij->i", rest, rest)
    taken, lengths = [], []
    for _ in range(min(most, len(x))):
        i = int(np.argmax(size))
        if size[i] <= 1e-10:
            break
        q = rest[i] / np.sqrt(size[i])
        taken.append(i)
        lengths.append(float(np.sqrt(size[i])))
        rest -= np.outer(rest @ q, q)
        size = np.einsum("ij,ij->i", rest, rest)
        size[taken] = 0
    return np.asarray(taken, int), np.asarray(lengths)


def varied_subset(rows: DataFrame, k: int, dim: int = DIM + TEXT_DIM) -> DataFrame:
    """(rank, id, round, residual): k varied rows of ``rows`` (id, vec), the most telling first."""
    rows = cut(rows)
    nodes = max(1, -(-rows.count() // NODE))
    rows = cut(rows.repartition(nodes, "id").sortWithinPartitions("id", "vec")) if nodes > 1 else cut(rows.coalesce(1).sortWithinPartitions("id", "vec"))
    spark, chosen, no, first = rows.sparkSession, [], 0, None
    former, here = np.empty((0, dim), np.float32), np.empty((0, dim), np.float32)
    while len(chosen) < k:
        no += 1
        basis = np.linalg.qr(here.astype(np.float64).T)[0].T.astype(np.float32) if len(here) else here
        held = spark.sparkContext.broadcast(({c[0] for c in chosen}, basis, former))
        got = _round(rows, held, min(PER_ROUND, k - len(chosen)), dim, nodes)
        first = got[0].residual if got and first is None else first
        good = [g for g in got if g.residual >= LOW * first]
        chosen += [(g.id, no, g.residual) for g in good]
        here = np.concatenate([here, *[matrix([bytes(g.vec)], dim) for g in good]])
        if len(good) == len(got) and got:
            continue
        if not len(here):  # nothing new in a whole pass: what is left equals chosen rows, take the least ids
            left = rows.select("id").join(spark.createDataFrame([(c[0],) for c in chosen] or [(None,)], "id long"), "id", "left_anti")
            chosen += [(r.id, -1, 0.0) for r in left.orderBy("id").limit(k - len(chosen)).collect()]
            break
        former, here, first = np.concatenate([former, here]), here[:0], None
    return spark.createDataFrame([(i + 1, *c) for i, c in enumerate(chosen)], "rank int, id long, round int, residual double")


def _round(rows: DataFrame, held, most: int, dim: int, width: int) -> list:
    """One tournament: the rows that win, in pivot order."""

    def frame(node: int, ids: np.ndarray, x: np.ndarray) -> pd.DataFrame:
        at, length = pivots(x[:, :dim], most)
        return pd.DataFrame({"node": node, "id": ids[at], "residual": length, "vec": [v.tobytes() for v in x[at]]})

    def nominate(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        node = TaskContext.get().partitionId()
        done, basis, former = held.value
        own = former / np.maximum(np.linalg.norm(former, axis=1, keepdims=True), 1e-12)
        best = None
        for b in batches:
            ids, x = b.column(0).to_numpy(zero_copy_only=False), matrix(b.column(1).to_pylist(), dim)
            order = np.argsort(ids, kind="stable")
            for a in range(0, len(ids), BATCH):
                at = order[a : a + BATCH]
                at = at[[i not in done for i in ids[at].tolist()]] if done else at
                y, raw = x[at], x[at]
                if len(own) and len(at):
                    cos = (y / np.linalg.norm(y, axis=1, keepdims=True)) @ own.T
                    new = 1 - np.square(cos.max(axis=1))
                    y = y * np.sqrt(np.where(new < SAME, 0, new))[:, None]
                if len(basis):
                    y = y - (y @ basis.T) @ basis
                both = np.concatenate([y, raw], axis=1)
                best = (ids[at], both) if best is None else (np.concatenate([best[0], ids[at]]), np.concatenate([best[1], both]))
                keep, _ = pivots(best[1][:, :dim], most)
                best = best[0][keep], best[1][keep]
        if best is not None and len(best[0]):
            yield pa.RecordBatch.from_pandas(frame(node, *best).astype({"node": np.int32}), preserve_index=False)

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        return frame(int(pdf["node"].iloc[0]), pdf["id"].to_numpy(), matrix(pdf["vec"], 2 * dim))

    level = rows.mapInArrow(nominate, _NOMINEE)
    while width > 1:
        level = level.withColumn("node", F.expr("node div 2")).groupBy("node").applyInPandas(again, _NOMINEE)
        width = -(-width // 2)
    won = level.orderBy(F.desc("residual"), "id").collect()
    return [type("Won", (), {"id": r.id, "residual": r.residual, "vec": bytes(r.vec)[dim * 4 :]}) for r in won]


def p3_varied_subset(spark: SparkSession, sf_dir: str, k: int = 256) -> DataFrame:
    """256 points that cover the variety of images, by visual vector and description."""
    points = read(spark, sf_dir, "vector_point").select("id", "visual_vec")
    said = read(spark, sf_dir, "image_import").select("id", "text_description")
    return varied_subset(features(points.join(said, "id", "left"), "id", "visual_vec", "text_description"), k)


SQL: dict[str, str] = {}
QUERIES = {"p3_varied_subset": p3_varied_subset}
