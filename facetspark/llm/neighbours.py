"""The k most similar vectors of every vector, by vantage-point trees in shards.

The root of the tree has many vantage points, drawn from a bounded sample: each vector belongs to the cell of its
nearest one, and cells are grouped into shards. Within a cell a binary vantage-point tree splits at the median
distance down to leaves of at most LEAF vectors; leaves are compared by matrix products. A query of current radius t (the distance
of its k-th neighbour so far, or of the least cosine asked for) must enter a cell only if its distance to the cell's
vantage point exceeds that to the nearest by at most 2 t, and the far side of a split only if it lies within t of
the boundary: both follow from the triangle inequality. ``factor`` scales t in these tests: 1 is exact, less prunes
more and may lose neighbours. Where a least cosine fixes the radius, trees are searched with factor 1 and only the root
is relaxed. Every vector is indexed; only vantage points come from the sample.

Equal vectors are one point of the tree and are expanded to at most k of their ids at the end (of equally similar
ones the least ids count), so a hot group of copies costs one point. Cells too large for one task, and queries too
many for one, are split by a hash.

Defined cases: unusable vectors (see vectors.usable) take no part; fewer than k others give fewer rows; ties go to
the smaller id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read, slots, small
from .vectors import DIM, chord, matrix, sample_units, to_binary, usable

#: Most vectors of a leaf, and vectors tried as the vantage point of a split.
LEAF, TRIED = 32, 5
#: Vectors a cell should have, most vantage points at the root, vectors of a shard, queries a task takes at once.
CELL, MOST_VANTAGE, SHARD, ASKED = 200, 4096, 32_768, 65_536
FACTOR = 0.12


class VantageTree:
    """Binary vantage-point tree over unit vectors; searched by many queries at once.

    A node keeps the vantage point and the radius of the ball of its nearer half. ``splits`` counts its inner nodes,
    ``compared`` and ``pruned`` pairs of a query and a vector that a search compared and that it ruled out.
    """

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids, self.splits, self.compared, self.pruned = x, ids, 0, 0, 0
        self.root = self._build(np.arange(len(x)))

    def _build(self, at: np.ndarray):
        if len(at) <= LEAF:
            return at
        tried = self.x[at[np.linspace(0, len(at) - 1, TRIED).astype(int)]]
        d = chord(self.x[at] @ tried.T)
        best = int(np.argmax(d.std(axis=0)))  # the wider distances spread, the more a boundary tells apart
        vantage, d = tried[best], d[:, best]
        middle = float(np.median(d))
        near = d <= middle
        if near.all():  # half of them or more are equally far: no boundary tells them apart
            return at
        self.splits += 1
        return vantage, middle, self._build(at[near]), self._build(at[~near]), int(near.sum()), int((~near).sum())

    def search(self, q: np.ndarray, qid: np.ndarray, top: Top, rows: np.ndarray, factor: float, node=None) -> None:
        node = self.root if node is None else node
        if not len(rows):
            return
        if isinstance(node, np.ndarray):
            self.compared += len(rows) * len(node)
            for a in range(0, len(node), 2048):
                part = node[a : a + 2048]
                top.add(rows, q[rows] @ self.x[part].T, self.ids[part], qid[rows])
            return
        vantage, middle, near, far, n_near, n_far = node
        d = chord(q[rows] @ vantage)
        inside = d <= middle
        self.search(q, qid, top, rows[inside], factor, near)
        self.search(q, qid, top, rows[~inside], factor, far)
        reach = (np.abs(d - middle) <= factor * top.radius(rows)) | top.short(rows)
        self.pruned += int((inside & ~reach).sum()) * n_far + int((~inside & ~reach).sum()) * n_near
        self.search(q, qid, top, rows[inside & reach], factor, far)
        self.search(q, qid, top, rows[~inside & reach], factor, near)


class Top:
    """The k best (cosine, id) found so far for each query."""

    def __init__(self, n: int, k: int, least: float):
        self.k, self.least = k, least
        self.cos = np.full((n, k), -np.inf, np.float32)
        self.id = np.full((n, k), -1, np.int64)

    def radius(self, rows: np.ndarray) -> np.ndarray:
        return chord(np.maximum(self.cos[rows, -1], self.least))

    def short(self, rows: np.ndarray) -> np.ndarray:
        """Has fewer than k and no least cosine that would say how far to look: nothing may be pruned yet."""
        return np.isneginf(self.cos[rows, -1]) & (self.least <= 0)

    def add(self, rows: np.ndarray, cos: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """cos: one row per query of ``rows``, one column per id. A point isn't its own neighbour."""
        floor = np.maximum(self.cos[rows, -1], self.least)
        some = np.flatnonzero(cos.max(axis=1) >= floor)
        if not len(some):
            return
        r, c = np.nonzero(cos[some] >= floor[some, None])
        keep = ids[c] != own[some[r]]
        r, c = r[keep], c[keep]
        if not len(r):
            return
        hit = np.unique(r)
        old = rows[some[hit]]
        k = self.k
        row = np.concatenate([np.repeat(np.arange(len(hit)), k), np.searchsorted(hit, r)])
        val = np.concatenate([self.cos[old].ravel(), cos[some[r], c]])
        nid = np.concatenate([self.id[old].ravel(), ids[c]])
        order = np.lexsort((nid, -val, row))
        row, val, nid = row[order], val[order], nid[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        first = place < k
        self.cos[old[row[first]], place[first]] = val[first]
        self.id[old[row[first]], place[first]] = nid[first]


@dataclass
class Router:
    """The root of the tree: vantage points, the shard of each cell, and how many tasks share a shard's vectors."""

    vantage: np.ndarray
    shard: np.ndarray
    parts: np.ndarray = field(default_factory=lambda: np.ones(1, np.int64))
    chunks: np.ndarray = field(default_factory=lambda: np.ones(1, np.int64))

    @classmethod
    def fit(cls, sample: np.ndarray, n: int) -> Router:
        m = int(np.clip(n // CELL, 1, min(MOST_VANTAGE, len(sample))))
        vantage = sample[np.linspace(0, len(sample) - 1, m).astype(int)]
        shards = max(1, -(-n // SHARD))
        # cells are numbered along a projection, so a shard holds cells that lie near each other
        line = np.argsort(vantage @ vantage[0], kind="stable")
        shard = np.empty(m, np.int64)
        shard[line] = np.arange(m) * shards // m
        return cls(vantage, shard, np.ones(shards, np.int64), np.ones(shards, np.int64))

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its vantage point) of each vector."""
        cos = x @ self.vantage.T
        cell = cos.argmax(axis=1)
        return cell, chord(cos[np.arange(len(x)), cell])

    def visits(self, x: np.ndarray, radius: np.ndarray, factor: float) -> np.ndarray:
        """For each vector and cell: may the cell hold something within radius?"""
        d = chord(x @ self.vantage.T)
        return d <= d.min(axis=1, keepdims=True) + 2 * factor * radius[:, None]


def nearest(points: DataFrame, queries: DataFrame | None, spaces: list[str], k: int, factor: float = FACTOR, least_cos: float = -1.0) -> DataFrame:
    """(space, id, neighbour, cos): up to k most similar others of each query of cosine least_cos or more.

    points, queries: (space, id, vec) as vectors.usable returns them; queries None: every point is one.
    Without a useful least_cos the queries first look into their own cell to learn a radius. points is read several
    times: pass it materialised.
    """
    members = cut(_copies(points))
    extra = cut(members.filter("id <> lead").select("space", "id"))
    classes = points.select("space", "id", "vec")
    if not extra.isEmpty():
        held = small(extra)
        classes = classes.join(held, ["space", "id"], "left_anti").select("space", "id", "vec")
        classes = classes if held is not extra else cut(classes)
    sizes = {r.space: r.n for r in classes.groupBy("space").agg(F.count(F.lit(1)).alias("n")).collect()}
    routers = {s: Router.fit(sample_units(classes, s, sizes[s]), sizes[s]) for s in spaces if s in sizes}
    start, askers, asked = float(chord(np.float64(max(least_cos, -1.0)))), None, classes
    if queries is not None:
        askers = cut(queries.select("space", "id"))
        leads = askers.join(members, ["space", "id"], "left").select("space", F.coalesce("lead", "id").alias("id")).distinct()
        asked = cut(classes.join(small(cut(leads)), ["space", "id"], "left_semi"))
    if least_cos <= 0:
        first = cut(_search(classes, asked.withColumn("radius", F.lit(0.0)), routers, k, factor, least_cos))
        far = first.groupBy("space", "id").agg(F.count(F.lit(1)).alias("n"), F.min("cos").alias("worst"))
        radius = F.when(F.col("n") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("worst")))).otherwise(start / factor)  # too few at home: look everywhere
        asked = asked.join(small(cut(far)), ["space", "id"], "left").select("space", "id", "vec", radius.alias("radius"))
    else:
        asked = asked.withColumn("radius", F.lit(start))
    found = _search(classes, asked, routers, k, factor, least_cos, itself=start if queries is None and least_cos > 0 else None)
    w = Window.partitionBy("space", "id").orderBy(F.desc("cos"), "neighbour")
    found = found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")
    return _expanded(found, members, askers, k)


def _copies(points: DataFrame) -> DataFrame:
    """(space, lead, id) of all points that share their vector with others; told by 128 bits, so no vector moves."""
    keyed = points.select("space", "id", F.xxhash64("vec").alias("a"), F.xxhash64(F.lit(1), "vec").alias("b"))
    several = keyed.groupBy("space", "a", "b").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return keyed.join(small(cut(several)), ["space", "a", "b"]).select("space", "lead", "id")


def _search(classes: DataFrame, asked: DataFrame, routers: dict[str, Router], k: int, factor: float, least: float, itself: float | None = None) -> DataFrame:
    """Up to k best of each class per task that held some of its cells.

    itself: the radius if every point asks; the vectors of a task are then among its queries and aren't sent twice.
    """

    for router in routers.values():
        router.parts[:], router.chunks[:] = 1, 1

    def place(role: int, count: bool = False):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loads: dict[str, np.ndarray] = {}
            for b in batches:
                for a in range(0, b.num_rows, 4096):
                    part = b.slice(a, 4096)
                    names = part.column(0).to_pylist()
                    ids = part.column(1).to_numpy(zero_copy_only=False)
                    x = matrix(part.column(2).to_pylist())
                    radius = part.column(3).to_numpy(zero_copy_only=False) if role else None
                    for s, router in routers.items():
                        rows = np.flatnonzero(np.asarray(names) == s)
                        if not len(rows):
                            continue
                        if role:
                            hit = router.visits(x[rows], radius[rows], factor)
                            shards = np.zeros((len(rows), len(router.parts)), bool)
                            np.logical_or.at(shards.T, router.shard, hit.T)
                            r, shard = np.nonzero(shards)
                            # a query meets every part of a shard's vectors, in one chunk of the shard's queries
                            times, chunk = router.parts[shard], ids[rows[r]] % router.chunks[shard]
                            r, shard, chunk = np.repeat(r, times), np.repeat(shard, times), np.repeat(chunk, times)
                            part_no = np.arange(len(r)) - np.repeat(np.cumsum(times) - times, times)
                            if itself is not None:
                                home = router.shard[router.homes(x[rows])[0]]
                                away = (shard != home[r]) | (part_no != ids[rows[r]] % router.parts[shard])
                                r, shard, part_no, chunk = r[away], shard[away], part_no[away], chunk[away]
                        else:
                            cell, _ = router.homes(x[rows])
                            shard = router.shard[cell]
                            times, part_no = router.chunks[shard], ids[rows] % router.parts[shard]
                            r = np.repeat(np.arange(len(rows)), times)
                            shard, part_no = shard[r], part_no[r]
                            chunk = np.arange(len(r)) - np.repeat(np.cumsum(times) - times, times)
                        if count:
                            loads[s] = loads.get(s, 0) + np.bincount(shard, minlength=len(router.parts))
                            continue
                        at, slot = rows[r], slot_of[s][first[s][shard] + part_no * router.chunks[shard] + chunk]
                        yield pa.record_batch([pa.array(slot), pa.array(ids[at]), to_binary(x[at]), pa.array(radius[at] if role else np.zeros(len(at)))], names=["slot", "id", "vec", "radius"])
            for s, n in loads.items():
                yield pa.record_batch([pa.array([s] * len(n)), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(np.full(len(n), role, np.int32)), pa.array(n.astype(np.int64))], names=["space", "shard", "role", "n"])

        return each

    first: dict[str, np.ndarray] = {}
    slot_of: dict[str, np.ndarray] = {}
    sides = [classes.withColumn("radius", F.lit(0.0)), asked.select("space", "id", "vec", "radius")]
    load = [d.mapInArrow(place(i, True), "space string, shard int, role int, n long") for i, d in enumerate(sides)]
    for r in load[0].unionByName(load[1]).groupBy("space", "shard", "role").agg(F.sum("n").alias("n")).collect():  # two rows a shard
        router = routers[r.space]
        if r.role == 0:
            router.parts[r.shard] = max(1, -(-r.n // (2 * SHARD)))
        else:
            router.chunks[r.shard] = max(1, -(-r.n // ASKED))
    sizes = {s: r.parts * r.chunks for s, r in routers.items()}
    # a task for every part of a shard's vectors and chunk of its queries, however many there are: none meets another's rows
    tasks = sum(int(n.sum()) for n in sizes.values())
    free, held = slots(classes.sparkSession, max(tasks, 1)), {}
    for s, n in sizes.items():
        first[s] = np.cumsum(n) - n
        slot_of[s], free = np.asarray(free[: n.sum()], np.int32), free[n.sum() :]
        for shard, (at, m) in enumerate(zip(first[s], n)):
            held |= {int(v): (s, k % int(routers[s].chunks[shard])) for k, v in enumerate(slot_of[s][at : at + m])}

    def one(key, data: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"space": [], "id": [], "neighbour": [], "cos": []})
        (space, chunk), inner = held[key[0]], 1.0 if least > 0 else factor
        router = routers[space]
        x, ids = matrix(data["vec"]), data["id"].to_numpy(np.int64)
        q, qid, radius = matrix(ask["vec"]), ask["id"].to_numpy(np.int64), ask["radius"].to_numpy(np.float64)
        if itself is not None and chunk == 0:
            q, qid, radius = np.concatenate([q, x]), np.concatenate([qid, ids]), np.concatenate([radius, np.full(len(x), itself)])
        if not len(x) or not len(q):
            return none
        top = Top(len(q), k, least)
        cell, _ = router.homes(x)
        here, trees = np.unique(cell), {}
        for a in range(0, len(q), 8192):
            rows = np.arange(a, min(a + 8192, len(q)))
            goes = router.visits(q[rows], radius[rows], factor)[:, here]
            own, _ = router.homes(q[rows])
            for first in (True, False):  # the query's own cell first: it narrows the radius for the others
                for j, c in enumerate(here):
                    mine = rows[goes[:, j] & ((own == c) == first)]
                    if len(mine):
                        if c not in trees:
                            at = np.flatnonzero(cell == c)
                            trees[c] = VantageTree(x[at], ids[at])
                        trees[c].search(q, qid, top, mine, inner)
        good = top.id >= 0
        r, _ = np.nonzero(good)
        return pd.DataFrame({"space": space, "id": qid[r], "neighbour": top.id[good], "cos": top.cos[good].astype(np.float64)})

    schema = "slot int, id long, vec binary, radius double"
    left, right = (d.mapInArrow(place(i), schema).repartition(max(tasks, 1), "slot").groupBy("slot") for i, d in enumerate(sides))
    return left.cogroup(right).applyInPandas(one, "space string, id long, neighbour long, cos double")


def _expanded(found: DataFrame, members: DataFrame, askers: DataFrame | None, k: int) -> DataFrame:
    """From one point per vector back to all its copies."""
    least = members.withColumn("r", F.row_number().over(Window.partitionBy("space", "lead").orderBy("id"))).filter(F.col("r") <= k + 1).select("space", "lead", F.col("id").alias("member"))
    near = found.join(least, (found.space == least.space) & (found.neighbour == least.lead), "left").select(found.space, found.id, F.coalesce("member", "neighbour").alias("neighbour"), "cos")
    rows = members.select("space", "lead", F.col("id").alias("own"))
    near = near.join(rows, (near.space == rows.space) & (near.id == rows.lead), "left").select(near.space, F.coalesce("own", near.id).alias("id"), "neighbour", "cos")
    twins = rows.join(least, ["space", "lead"]).filter("own <> member").select("space", F.col("own").alias("id"), F.col("member").alias("neighbour"), F.lit(1.0).alias("cos"))
    both = near.unionByName(twins)
    if askers is not None:
        both = both.join(askers, ["space", "id"], "left_semi")
    w = Window.partitionBy("space", "id").orderBy(F.desc("cos"), "neighbour")
    return both.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).drop("__r")


SPACES = {"text": "text_vec", "visual": "visual_vec"}


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of points of a cosine of at least 0.95 among each other's five nearest."""
    points = cut(usable(read(spark, sf_dir, "vector_point"), SPACES))
    near = nearest(points, None, list(SPACES), 5, least_cos=0.95)
    return near.select("space", F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every point whose id is divisible by 100, against all points."""
    points = cut(usable(read(spark, sf_dir, "vector_point"), SPACES))
    return nearest(points, points.filter("id % 100 = 0"), list(SPACES), 10)


SQL: dict[str, str] = {}
QUERIES = {"p4_found": p4_found, "p4_neighbours": p4_neighbours}
