"""Similarity clusters from mergeable cluster features.

A cluster feature of unit vectors is their number and their sum; two add up. Each partition grows the leaves of a
tree: batches of its points go to the leaf of nearest centroid if that is close enough, else they found leaves. The
leaves are one flat list under the root, compared by matrix products, with no nodes between; a full list is sent on.
The partitions' leaves are reduced in rounds: each round draws vantage points from the leaves, sends every leaf to
its nearest one and merges what is close there, so parts of a cluster meet while no task receives all leaves. Ward
agglomeration joins the remaining leaves of two or more points, cheapest merge first. One full pass then assigns
every point to its nearest centroid, if that is close enough.

``linked`` follows with the exact check: two points belong together if and only if a chain of pairs of the given
cosine joins them, whatever their groups. The members near a centroid are a ball; all other points are the rest.
Balls are put into blocks of about BLOCK points, so is the rest, and every block meets every other in one task a pair of
them. There a point is compared with a ball's members only if the triangle inequality lets it reach them: its distance
to the ball's mean decides. Labels joined by links across groups are then made one by star rounds. Balls make the check
cheap in products; in moved vectors, and among the rest, it is quadratic: (points / BLOCK) / 2 copies of the points.

Defined cases: unusable vectors (see vectors.usable) take no part; equal vectors fall into one leaf; a ball larger
than BLOCK points is checked in hashed parts, every part against every other; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read, slots, small
from .neighbours import SPACES
from .vectors import DIM, MOST_LEAVES, least_hashed, matrix, to_binary, usable

#: Least cosine to a leaf's centroid, between centroids that Ward joins, and to a centroid for assignment.
ABSORB, JOIN, ASSIGN = 0.7, 0.6, 0.5
ROUNDS, CELL, MOST_VANTAGE = 3, 2500, 4096
#: Leaves agglomerated in one task, centroids broadcast at once, points held (and asking) in one task of the exact check.
WARD, CENTROIDS, BLOCK = 20_000, 20_000, 131_072
#: Beyond CENTROIDS: cells a centroid is sent to, and tasks that share the points of a cell.
WAYS, SALTS = 3, 4
#: Least cosine of a ball's points to their centroid.
CORE = 0.86


class Leaves:
    """Leaf entries (number, vector sum, least id) of one tree."""

    def __init__(self, dim: int = DIM):
        self.k, self.n, self.lead = 0, np.zeros(256, np.int64), np.zeros(256, np.int64)
        self.sum, self.mid = np.zeros((256, dim), np.float32), np.zeros((256, dim), np.float32)

    def add(self, sums: np.ndarray, n: np.ndarray, lead: np.ndarray, least: float) -> None:
        x = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        left = np.arange(len(x))
        if self.k:
            cos = x @ self.mid[: self.k].T
            best = cos.argmax(axis=1)
            near = cos[left, best] >= least
            self._absorb(best[near], sums[near], n[near], lead[near])
            left = left[~near]
        while len(left):  # the heaviest first founds a leaf and takes what is near
            head = left[np.argmax(n[left])]
            near = x[left] @ x[head] >= least
            near |= left == head
            mine = left[near]
            if self.k == len(self.n):
                self.n, self.lead = np.resize(self.n, 2 * self.k), np.resize(self.lead, 2 * self.k)
                self.sum, self.mid = (np.concatenate([a, np.zeros_like(a)]) for a in (self.sum, self.mid))
            self.n[self.k], self.sum[self.k], self.lead[self.k] = 0, 0, lead[mine].min()
            self.k += 1
            self._absorb(np.full(len(mine), self.k - 1), sums[mine], n[mine], lead[mine])
            left = left[~near]

    def _absorb(self, at: np.ndarray, sums: np.ndarray, n: np.ndarray, lead: np.ndarray) -> None:
        np.add.at(self.sum, at, sums)
        np.add.at(self.n, at, n)
        np.minimum.at(self.lead, at, lead)
        at = np.unique(at)
        self.mid[at] = self.sum[at] / np.maximum(np.linalg.norm(self.sum[at], axis=1, keepdims=True), 1e-12)

    def batch(self, space: str) -> pa.RecordBatch:
        k = self.k
        return pa.record_batch([pa.array([space] * k), pa.array(self.n[:k]), pa.array(self.lead[:k]), to_binary(self.sum[:k])], names=["space", "n", "lead", "sum"])


_LEAF = "space string, n long, lead long, sum binary"


def grow(points: DataFrame) -> DataFrame:
    """Leaves of each partition's trees. A tree of MOST_LEAVES leaves is sent on and a new one begun."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, Leaves] = {}
        for b in batches:
            names, ids = np.asarray(b.column(0).to_pylist()), b.column(1).to_numpy(zero_copy_only=False)
            x = matrix(b.column(2).to_pylist())
            for s in np.unique(names):
                rows = np.flatnonzero(names == s)
                for a in range(0, len(rows), 1024):
                    at = rows[a : a + 1024]
                    tree = trees.setdefault(str(s), Leaves())
                    tree.add(x[at], np.ones(len(at), np.int64), ids[at], ABSORB)
                    if tree.k >= MOST_LEAVES:
                        yield trees.pop(str(s)).batch(str(s))
        for s, tree in trees.items():
            yield tree.batch(s)

    return points.select("space", "id", "vec").mapInArrow(each, _LEAF)


def reduce_leaves(leaves: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Merge close leaves in rounds of regrouping by vantage points."""
    leaves = cut(leaves)
    for r in range(rounds):
        vantage, salts = {}, {}
        for row in leaves.groupBy("space").agg(F.count(F.lit(1)).alias("n")).collect():
            m = int(np.clip(row.n // CELL, 1, MOST_VANTAGE))
            top = least_hashed(leaves.filter(F.col("space") == row.space), row.n, m, "lead", r).select("sum").collect()
            v = matrix([bytes(t["sum"]) for t in top]) if top else np.eye(1, DIM, dtype=np.float32)
            vantage[row.space] = v / np.linalg.norm(v, axis=1, keepdims=True)
            salts[row.space] = max(1, row.n // (4 * CELL * m))
        leaves = cut(_cells(leaves, vantage, salts, r).groupBy("space", "cell").applyInPandas(_merged, _LEAF))
    return leaves


def _cells(leaves: DataFrame, vantage: dict, salts: dict, r: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = np.asarray(b.column(0).to_pylist())
            x, lead = matrix(b.column(3).to_pylist()), b.column(2).to_numpy(zero_copy_only=False)
            cell = np.zeros(len(names), np.int64)
            for s, v in vantage.items():
                rows = np.flatnonzero(names == s)
                if len(rows):
                    cell[rows] = (x[rows] @ v.T).argmax(axis=1) * salts[s] + (lead[rows] + r * (lead[rows] // 7)) % salts[s]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=["space", "n", "lead", "sum", "cell"])

    return leaves.mapInArrow(each, _LEAF + ", cell long")


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    tree, x, n, lead = Leaves(), matrix(pdf["sum"]), pdf["n"].to_numpy(), pdf["lead"].to_numpy()
    order = np.argsort(-n, kind="stable")
    for a in range(0, len(order), 1024):
        at = order[a : a + 1024]
        tree.add(x[at], n[at], lead[at], ABSORB)
    return tree.batch(pdf["space"].iloc[0]).to_pandas()


def ward(leaves: DataFrame) -> DataFrame:
    """Join leaves of two or more points whose centroids are close, in order of Ward's increase of the squared error."""
    heavy = leaves.filter("n >= 2")
    vantage, salts = {}, {}
    for row in heavy.groupBy("space").agg(F.count(F.lit(1)).alias("n")).collect():
        top = least_hashed(heavy.filter(F.col("space") == row.space), row.n, -(-row.n // WARD), "lead").select("sum").collect()
        v = matrix([bytes(t["sum"]) for t in top]) if top else np.eye(1, DIM, dtype=np.float32)
        vantage[row.space], salts[row.space] = v / np.linalg.norm(v, axis=1, keepdims=True), 1

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        total, n, lead = matrix(pdf["sum"]).copy(), pdf["n"].to_numpy().copy(), pdf["lead"].to_numpy().copy()
        unit = lambda i: total[i] / max(np.linalg.norm(total[i]), 1e-12)
        mid = np.stack([unit(i) for i in range(len(n))])
        near: list[set[int]] = [set() for _ in n]
        for a in range(0, len(n), 2048):
            for i, j in zip(*np.nonzero(mid[a : a + 2048] @ mid.T >= JOIN)):
                if a + i != j:
                    near[a + i].add(int(j))
        alive, stamp = np.ones(len(n), bool), np.zeros(len(n), np.int64)

        def cost(i: int, j: int) -> float:
            return float(n[i] * n[j] / (n[i] + n[j]) * (2 - 2 * mid[i] @ mid[j]))

        heap = [(cost(i, j), i, j, 0, 0) for i in range(len(n)) for j in near[i] if i < j]
        heapq.heapify(heap)
        while heap:
            _, i, j, si, sj = heapq.heappop(heap)
            if not (alive[i] and alive[j] and stamp[i] == si and stamp[j] == sj) or mid[i] @ mid[j] < JOIN:
                continue
            total[i] += total[j]
            n[i] += n[j]
            lead[i], mid[i], alive[j] = min(lead[i], lead[j]), unit(i), False
            stamp[i] += 1
            near[i] |= near[j]
            for o in near[i] - {i, j}:
                if alive[o]:
                    near[o].add(i)
                    heapq.heappush(heap, (cost(i, o), i, o, stamp[i], stamp[o]))
        at = np.flatnonzero(alive)
        return pd.DataFrame({"space": pdf["space"].iloc[0], "n": n[at], "lead": lead[at], "sum": [total[i].tobytes() for i in at]})

    return _cells(heavy, vantage, salts, 0).groupBy("space", "cell").applyInPandas(joined, _LEAF)


def assign(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """(space, id, vec, cluster, cos): every point with a centroid near it; cluster is null if none is at cosine ASSIGN.

    Up to CENTROIDS centroids (counted) are broadcast. More are met in cells: a point goes to its nearest vantage point,
    a centroid to its WAYS nearest, so a few points get a centroid that isn't the very nearest or none; ``linked`` makes up for it.
    """
    clusters = cut(clusters)
    if clusters.limit(CENTROIDS + 1).count() <= CENTROIDS:
        mids = {}
        for r in clusters.select("space", "lead", "sum").collect():
            mids.setdefault(r.space, []).append((r.lead, bytes(r["sum"])))
        held = points.sparkSession.sparkContext.broadcast({s: _units(m) for s, m in mids.items()})

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            none = np.zeros((1, DIM), np.float32), np.zeros(1, np.int64)
            for b in batches:
                names, x = np.asarray(b.column(0).to_pylist()), matrix(b.column(2).to_pylist())
                for s in np.unique(names):
                    yield from _nearest(b.take(pa.array(np.flatnonzero(names == s))), x[names == s], *held.value.get(str(s), none))

        return points.select("space", "id", "vec").mapInArrow(each, _ASSIGNED)
    vantage = {}
    for row in clusters.groupBy("space").agg(F.count(F.lit(1)).alias("n")).collect():
        top = least_hashed(clusters.filter(F.col("space") == row.space), row.n, int(np.clip(row.n // 64, 1, MOST_VANTAGE)), "lead").select("sum").collect()
        v = matrix([bytes(t["sum"]) for t in top])
        vantage[row.space] = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    held = points.sparkSession.sparkContext.broadcast(vantage)

    def placed(ways: int):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                names, x = np.asarray(b.column(0).to_pylist()), matrix(b.column(2).to_pylist())
                for s in np.unique(names):
                    rows, v = np.flatnonzero(names == s), held.value.get(str(s), np.eye(1, DIM, dtype=np.float32))
                    for a in range(0, len(rows), 2048):
                        at = rows[a : a + 2048]
                        k = min(ways, len(v))
                        cell = np.argpartition(-(x[at] @ v.T), k - 1, axis=1)[:, :k]
                        yield pa.RecordBatch.from_arrays([*b.take(pa.array(np.repeat(at, k))).columns, pa.array(cell.ravel())], names=["space", "id", "vec", "cell"])

        return each

    keys, row = ["space", "cell", "chunk"], "space string, id long, vec binary, cell long"
    mine = points.select("space", "id", "vec").mapInArrow(placed(1), row).select("*", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("long").alias("chunk"))
    near = clusters.select("space", F.col("lead").alias("id"), F.col("sum").alias("vec")).mapInArrow(placed(WAYS), row).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))

    def meet(key: tuple, pdf: pd.DataFrame, mid: pd.DataFrame) -> pd.DataFrame:
        v, lead = _units([(0, bytes(np.zeros(DIM, np.float32)))]) if mid.empty else _units(list(zip(mid["id"], mid["vec"])))
        b = pa.RecordBatch.from_pandas(pdf[["space", "id", "vec"]], preserve_index=False)
        parts = [p.to_pandas() for p in _nearest(b, matrix(pdf["vec"]), v, lead)]
        return pd.concat(parts) if parts else pd.DataFrame({c: [] for c in ("space", "id", "vec", "cluster", "cos")})

    return mine.groupBy(*keys).cogroup(near.groupBy(*keys)).applyInPandas(meet, _ASSIGNED)


_ASSIGNED = "space string, id long, vec binary, cluster long, cos double"


def _units(rows: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, numbers) of (number, sum) rows."""
    v = matrix([bytes(b) for _, b in rows])
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12), np.asarray([i for i, _ in rows], np.int64)


def _nearest(b: pa.RecordBatch, x: np.ndarray, v: np.ndarray, lead: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(x), 2048):
        cos = x[a : a + 2048] @ v.T
        best = cos.argmax(axis=1)
        top = cos[np.arange(len(best)), best].astype(np.float64)
        yield pa.RecordBatch.from_arrays([*b.slice(a, len(best)).columns, pa.array(lead[best], mask=top < ASSIGN), pa.array(top)], names=["space", "id", "vec", "cluster", "cos"])


def cluster_points(points: DataFrame) -> DataFrame:
    """Every point with its cluster (the least id among its cluster's summarised points; null if none is near) and its cosine."""
    return assign(points, ward(reduce_leaves(grow(points))))


def components(x: np.ndarray, least: float) -> np.ndarray:
    """Component number of each row, pairs of cosine ``least`` or more being linked."""
    part, left, k = np.full(len(x), -1), np.arange(len(x)), 0
    while len(left):
        front, left = left[:1], left[1:]
        part[front] = k
        while len(front) and len(left):
            step, front = front[:256], front[256:]
            hit = np.zeros(len(left), bool)
            for a in range(0, len(left), 16384):
                hit[a : a + 16384] = (x[left[a : a + 16384]] @ x[step].T).max(axis=1) >= least
            part[left[hit]] = k
            front, left = np.concatenate([front, left[hit]]), left[~hit]
        k += 1
    return part


def linked(assigned: DataFrame, least: float) -> DataFrame:
    """(space, lead_id, id): the exact components of all points, lead_id being a component's least id."""
    assigned = cut(assigned.select("space", "id", "vec", F.when(F.col("cos") >= CORE, F.col("cluster")).alias("cell")))
    sizes = assigned.groupBy("space", "cell").agg(F.count(F.lit(1)).alias("n"))
    each = F.when(F.col("cell").isNull(), "rest").when(F.col("n") > BLOCK, "hot").otherwise("core").alias("kind")
    totals = sizes.groupBy("space", each).agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("n") > BLOCK, F.struct("cell", "n"))).alias("hot")).collect()
    rows = None
    for space in sorted({t.space for t in totals}):
        mine = {t.kind: t for t in totals if t.space == space}
        blocks = {k: -(-mine[k].n // BLOCK) if k in mine else 0 for k in ("rest", "core")}
        of_id = lambda m: F.pmod(F.xxhash64("id"), F.lit(max(m, 1)))
        block = F.when(F.col("cell").isNull(), of_id(blocks["rest"]))
        at = blocks["rest"] + blocks["core"]
        for ball in mine["hot"].hot if "hot" in mine else []:  # at most n / BLOCK of them
            block, at = block.when(F.col("cell") == ball.cell, at + of_id(-(-ball.n // BLOCK))), at + -(-ball.n // BLOCK)
        block = block.otherwise(blocks["rest"] + F.pmod(F.xxhash64("cell"), F.lit(max(blocks["core"], 1))))
        part = assigned.filter(F.col("space") == space).withColumn("block", block.cast("int"))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return assigned.select("space", F.col("id").alias("lead_id"), "id")
    counts = {}
    for r in rows.groupBy("space", "block").agg(F.count(F.lit(1)).alias("n")).collect():  # one row a block
        counts.setdefault(r.space, {})[r.block] = r.n
    plan = []
    for space, n in counts.items():
        lower = 0
        for block in sorted(n):
            plan.append((space, block, max(1, -(-lower // BLOCK)), sum(p[2] for p in plan)))
            lower += n[block]
    tasks = sum(p[2] for p in plan)
    slot = slots(rows.sparkSession, tasks)
    task_of = {slot[first + c]: (space, c) for space, _, chunks, first in plan for c in range(chunks)}
    plan = F.broadcast(rows.sparkSession.createDataFrame([(*p[:3], slot[p[3] : p[3] + p[2]]) for p in plan], "space string, block int, chunks int, slots array<int>"))
    cols = ["slot", "ask", "id", "vec", "cell"]
    held = rows.join(plan, ["space", "block"]).withColumn("ask", F.lit(False)).withColumn("slot", F.explode("slots"))
    asks = rows.select("space", "id", "vec", "cell", F.col("block").alias("own")).join(plan, ["space"]).filter("block > own").withColumn("ask", F.lit(True)).withColumn("slot", F.get("slots", F.pmod(F.xxhash64("id"), "chunks").cast("int")))
    meet = held.select(*cols).unionByName(asks.select(*cols))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ask = pdf["ask"].to_numpy()
        pdf, q = pdf[~ask], pdf[ask]
        space, chunk = task_of[key[0]]
        got = _block_links(matrix(pdf["vec"]), pdf["id"].to_numpy(np.int64), pdf["cell"], matrix(q["vec"]), q["id"].to_numpy(np.int64), least, chunk == 0)
        return got.assign(space=space)[["space", "id", "lead_id", "own"]]

    found = cut(meet.repartition(tasks, "slot").groupBy("slot").applyInPandas(one, "space string, id long, lead_id long, own boolean"))
    own = found.filter("own")
    label = lambda name, to: own.select("space", F.col("id").alias(name), F.col("lead_id").alias(to))
    links = found.filter("not own").select("space", "id", "lead_id").join(label("id", "u"), ["space", "id"]).join(label("lead_id", "v"), ["space", "lead_id"])
    whole = stars(links.select("space", "u", "v")).select("space", F.col("u").alias("lead_id"), F.col("v").alias("whole"))
    return own.join(small(whole), ["space", "lead_id"], "left").select("space", F.coalesce("whole", "lead_id").alias("lead_id"), "id")


def _block_links(x: np.ndarray, ids: np.ndarray, cells: pd.Series, q: np.ndarray, qid: np.ndarray, least: float, first: bool) -> pd.DataFrame:
    """(id, lead_id, own) of a task: the component of each held row in its block (own, if ``first``) and links of asking rows."""
    out, lead = [], ids.copy()
    rest = np.flatnonzero(cells.isna())
    if len(rest):  # a block is either of balls or of the rest
        if first:
            lead = _leads(_loose(x, least), ids)
            out.append(pd.DataFrame({"id": ids, "lead_id": lead, "own": True}))
        comp = None
        for a in range(0, len(q), 512):
            hit = q[a : a + 512] @ x.T >= least
            r, c = np.nonzero(hit)
            if comp is None and len(r) > 64 * len(hit):  # densely linked: name each component once
                comp = _loose(x, least)
                order = np.argsort(comp, kind="stable")
                starts = np.flatnonzero(np.diff(comp[order], prepend=-1))
            if comp is not None:
                r, c = np.nonzero(np.logical_or.reduceat(hit[:, order], starts, axis=1))
                c = order[starts[c]]
            out.append(pd.DataFrame({"id": qid[a + r], "lead_id": ids[c], "own": False}))
    else:
        order = np.argsort(cells.to_numpy(np.int64), kind="stable")
        x, ids = x[order], ids[order]
        starts = np.flatnonzero(np.diff(cells.to_numpy(np.int64)[order], prepend=np.int64(-(2**63)))) if len(ids) else np.empty(0, int)
        ends = np.append(starts[1:], len(ids)).astype(int)
        mid = np.add.reduceat(x, starts) if len(ids) else x
        mid = mid / np.maximum(np.linalg.norm(mid, axis=1, keepdims=True), 1e-12)
        ball = np.repeat(np.arange(len(starts)), ends - starts)
        reach = np.minimum.reduceat(np.einsum("ij,ij->i", x, mid[ball]), starts) if len(ids) else np.empty(0)
        # 1e-4: rounding of the cosines
        bound = np.cos(np.minimum(np.pi, np.arccos(np.clip(reach, -1, 1)) + np.arccos(least))) - 1e-4
        both, names, lowest = (np.concatenate([q, x]), np.concatenate([qid, ids]), np.concatenate([np.full(len(q), -1), ball])) if first else (q, qid, np.full(len(q), -1))
        goes: list[list[np.ndarray]] = [[] for _ in starts]
        for a in range(0, len(both), 2048):
            r, b = np.nonzero((both[a : a + 2048] @ mid.T >= bound) & (lowest[a : a + 2048, None] < np.arange(len(starts))))
            for b, rows in _by_key(b, a + r):
                goes[b].append(rows)
        lead = np.empty(len(ids), np.int64)
        for b, (s, e) in enumerate(zip(starts, ends)):
            comp = components(x[s:e], least)
            at = np.argsort(comp, kind="stable")
            heads = np.flatnonzero(np.diff(comp[at], prepend=-1))
            name = np.minimum.reduceat(ids[s:e][at], heads)
            lead[s:e] = name[comp]
            rows = np.concatenate(goes[b]) if goes[b] else np.empty(0, int)
            for a in range(0, len(rows), 2048):
                hit = both[rows[a : a + 2048]] @ x[s:e][at].T >= least
                some = np.flatnonzero(hit.any(axis=1))
                if len(some):
                    r, c = np.nonzero(np.logical_or.reduceat(hit[some], heads, axis=1))
                    out.append(pd.DataFrame({"id": names[rows[a + some[r]]], "lead_id": name[c], "own": False}))
        if first:
            out.append(pd.DataFrame({"id": ids, "lead_id": lead, "own": True}))
    return pd.concat(out) if out else pd.DataFrame({"id": [], "lead_id": [], "own": []})


def _by_key(key: np.ndarray, value: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    return ((int(key[at[0]]), value[at]) for at in np.split(order, cuts) if len(at))


def _leads(comp: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id of each row's component."""
    least = np.full(comp.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, comp, ids)
    return least[comp]


def _loose(x: np.ndarray, least: float) -> np.ndarray:
    """As ``components``, for rows most of which have no link: those are told apart by whole products first."""
    lone = np.ones(len(x), bool)
    for a in range(0, len(x), 512):
        hit = x[a : a + 512] @ x[a:].T >= least
        at = np.arange(len(hit))
        hit[at, at] = False
        lone[a : a + 512] &= ~hit.any(axis=1)
        lone[a:] &= ~hit.any(axis=0)
    part = np.empty(len(x), np.int64)
    part[~lone] = components(x[~lone], least)
    part[lone] = part[~lone].max(initial=-1) + 1 + np.arange(lone.sum())
    return part


def _means(members: DataFrame) -> DataFrame:
    """(space, cluster, sum): the vector sum of each group's members."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, group = np.asarray(b.column(0).to_pylist()), b.column(1).to_numpy(zero_copy_only=False)
            x = matrix(b.column(2).to_pylist())
            for s in np.unique(names):
                rows = np.flatnonzero(names == s)
                rows = rows[np.argsort(group[rows], kind="stable")]
                starts = np.flatnonzero(np.r_[True, np.diff(group[rows]) != 0])
                yield pa.record_batch([pa.array([str(s)] * len(starts)), pa.array(group[rows[starts]]), to_binary(np.add.reduceat(x[rows], starts))], names=["space", "cluster", "sum"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"space": pdf["space"].iloc[:1], "cluster": pdf["cluster"].iloc[:1], "sum": [matrix(pdf["sum"]).sum(axis=0).tobytes()]})

    schema = "space string, cluster long, sum binary"
    return members.select("space", "cluster", "vec").mapInArrow(each, schema).groupBy("space", "cluster").applyInPandas(total, schema)


def stars(edges: DataFrame) -> DataFrame:
    """(space, u, v): for every node u but the least of its component, that least node v; by large and small stars in turn."""
    edges = cut(edges.filter("u <> v").select("space", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select("space", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("space", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, ["space", "u"]).filter("v > u").select("space", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("space", "u").agg(F.min("v").alias("m"))
        near = large.join(least, ["space", "u"]).filter("v <> m").select("space", F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(near.unionByName(least.select("space", "u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("space", "u", "v"))).first()
        if now == state:
            return edges
        state = now


def _clusters(points: DataFrame) -> DataFrame:
    found = cut(linked(cluster_points(points), 0.65))
    sizes = found.groupBy("space", "lead_id").agg(F.count(F.lit(1)).alias("size")).filter("size >= 8")
    return found.join(sizes, ["space", "lead_id"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(space, lead_id, id) of every member of a cluster of eight or more."""
    return _clusters(usable(read(spark, sf_dir, "vector_point"), SPACES)).select("space", "lead_id", "id")


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cluster of eight or more with its size and the five members nearest its centroid."""
    return typical(usable(read(spark, sf_dir, "vector_point"), SPACES))


def typical(points: DataFrame) -> DataFrame:
    """(space, lead_id, size, typical_ids) of the clusters of eight or more; the centroid is the mean of all members."""
    members = cut(points.join(_clusters(points), ["space", "id"]).select("space", "id", "vec", F.col("lead_id").alias("cluster"), "size"))
    near = members.join(small(cut(_means(members))), ["space", "cluster"])

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, m = matrix(b.column(4).to_pylist()), matrix(b.column(5).to_pylist())
            cos = np.einsum("ij,ij->i", x, m) / np.maximum(np.linalg.norm(m, axis=1), 1e-12)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(cos.astype(np.float64))], names=["space", "lead_id", "id", "size", "cos"])

    near = near.select("space", "cluster", "id", "size", "vec", "sum").mapInArrow(cosines, "space string, lead_id long, id long, size long, cos double")
    w = Window.partitionBy("space", "lead_id").orderBy(F.desc("cos"), "id")
    top = near.withColumn("r", F.row_number().over(w)).filter("r <= 5")
    return top.groupBy("space", "lead_id", "size").agg(F.array_sort(F.collect_list(F.struct("r", "id"))).alias("t")).select("space", "lead_id", "size", F.col("t.id").alias("typical_ids"))


SQL: dict[str, str] = {}
QUERIES = {"p5_found": p5_found, "p5_clusters": p5_clusters}
