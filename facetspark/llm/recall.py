"""Figures no SQL gives: recall of p4_neighbours against brute force, what its trees do, and how varied p3's subset is.

python -m facetspark.llm.recall SF_DIR
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from .neighbours import CELL, FACTOR, SPACES, Router, Top, VantageTree, p4_neighbours
from .subset import p3_varied_subset
from .vectors import units_of


def recall(found: dict[int, list[tuple[int, float]]], x: np.ndarray, ids: np.ndarray, k: int) -> tuple[int, int]:
    """(found, wanted) neighbours of the queries that ``found`` has; one as similar as the k-th counts as wanted."""
    at, good, wanted = {i: n for n, i in enumerate(ids.tolist())}, 0, 0
    for q, near in found.items():
        cos = x @ x[at[q]]
        cos[at[q]] = -2
        bar = np.partition(cos, -k)[-k] - 1e-6
        good += min(k, sum(cos[at[n]] >= bar for n, _ in near))
        wanted += k
    return good, wanted


def tree_work(x: np.ndarray, ids: np.ndarray, k: int = 10) -> tuple[int, int, int, int]:
    """(cells, inner nodes, pairs compared, pairs ruled out) when each vector searches its own cell's tree."""
    router = Router.fit(x[np.linspace(0, len(x) - 1, min(len(x), 4096)).astype(int)], len(x))
    cell, _ = router.homes(x)
    splits = compared = pruned = 0
    for c in np.unique(cell):
        at = np.flatnonzero(cell == c)
        tree = VantageTree(x[at], ids[at])
        tree.search(x[at], ids[at], Top(len(at), k, -1.0), np.arange(len(at)), FACTOR)
        splits, compared, pruned = splits + tree.splits, compared + tree.compared, pruned + tree.pruned
    return len(router.vantage), splits, compared, pruned


def main(sf_dir: str) -> None:
    spark = SparkSession.builder.appName("recall").getOrCreate()
    near: dict[str, dict[int, list]] = {s: {} for s in SPACES}
    for r in p4_neighbours(spark, sf_dir).collect():
        near[r.space].setdefault(r.id, []).append((r.neighbour, r.cos))
    table = spark.read.parquet(f"{sf_dir}/vector_point.parquet").select("id", *SPACES.values()).toArrow()
    for s, c in SPACES.items():
        at, x = units_of(table[c].combine_chunks().cast(pa.list_(pa.float32())), 128)
        ids = table["id"].to_numpy()[at]
        good, wanted = recall(near[s], x, ids, 10)
        cells, splits, compared, pruned = tree_work(x, ids)
        print(f"{s}: recall {good} of {wanted}; {cells} cells of about {CELL}, {splits} inner nodes, {compared} pairs compared in them, {pruned} ruled out")
        if s == "visual":
            picked = np.isin(ids, [r.id for r in p3_varied_subset(spark, sf_dir).select("id").collect()])
            drawn = np.isin(np.arange(len(ids)), np.random.default_rng(0).choice(len(ids), picked.sum(), replace=False))
            for name, some in (("p3_varied_subset", picked), ("drawn at random", drawn)):
                among = x[some] @ x[some].T
                np.fill_diagonal(among, -1)
                best = (x @ x[some].T).max(axis=1)
                print(f"{name}: {some.sum()} points, largest cosine among them {among.max():.2f}, pairs above 0.65 {int((among >= 0.65).sum()) // 2}, points within cosine 0.65 of one {float((best >= 0.65).mean()):.3f}")


if __name__ == "__main__":
    main(sys.argv[1])
