"""Operators on records and vectors against brute force on small fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetspark.llm import clusters, history, neighbours, quantiles, recall, subset, survivor
from facetspark.llm.vectors import usable

H = "ab" * 32


def test_version_and_instant(spark):
    rows = [("1.2", "1.2.0"), ("v1.10", "1.9"), ("draft", ""), (None, ""), ("1.0.0", "1"), ("0", "")]
    df = spark.createDataFrame(rows, "a string, b string").select(survivor.version_key(F.col("a")).alias("a"), survivor.version_key(F.col("b")).alias("b")).collect()
    assert df[0].a == df[0].b and df[1].a > df[1].b and df[2].a == df[2].b == "" and df[4].a == df[4].b and df[5].a > df[5].b
    at = ["2023-01-02 03:04:05", "2023-01-02T03:04:05Z", "2023/01/02 03:04:05", "2023-01-02T11:04:05+08:00", "1672628645000", "1672628645", "2023-01-02 03:04:05.900", "unknown", "", None, "0000-00-00 00:00:00"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in at], "s string").select(survivor.instant_seconds(F.col("s"))).collect()]
    assert got == [1672628645] * 7 + [None] * 4


def test_survivor_layers_and_fill(spark):
    rows = [(1, "g", None, 3, 10), (2, "g", "x", 2, 9), (3, "g", "y", 1, 5), (4, "g", "z", 1, 5), (5, None, "q", None, None), (6, None, "q", None, None), (7, "one", None, 1, 1)]
    df = spark.createDataFrame(rows, "id long, k string, f string, t int, r long").withColumn("__x", F.lit("clash")).withColumn("n_rows", F.lit(1))
    run = lambda d: {x.k: x for x in survivor.best_representatives(d, {"k": F.col("k")}, F.col("id"), [F.lit(True)], F.col("t"), F.col("r"), {"f": F.col("f")}).collect()}
    got = run(df)
    g = got["g"]
    assert (g.n_rows, g.first_id, g.best_id) == (4, 1, 1)  # 1 dominates all; 3 and 4 stand below 2, which fills as much
    assert (g.f, g.f_from) == ("x", 2) and g.n_layers == 2
    assert (got[None].n_rows, got[None].best_id, got[None].f) == (2, 6, "q")
    assert got["one"].f is None and run(df.limit(0)) == {}


def _path(i, frame, tail=".jpg", place="salt pier"):
    return f"/library/2021/{place}/roll-{i:08d}/IMG_{frame:05d}{tail}"


def test_history_spellings_and_order(spark):
    old = [(1, _path(1, 1), "a" * 64), (2, _path(1, 2), "b" * 64), (3, None, None), (4, "  ", "0" * 64)]
    batch = [
        (1, 11, "file:///library/2021/salt%20pier/roll-00000001/IMG_00001.jpeg", "1" * 64),
        (1, 12, "D:\\library\\2021\\Salt_Pier\\roll-00000001\\img_00002 - Copy.jpg", None),
        (1, 13, _path(1, 2, place="slat pier"), ""),  # letters changed over
        (1, 14, _path(1, 3), "SHA256-" + "A" * 64),
        (1, 15, _path(1, 4), "c" * 64),
        (2, 16, _path(1, 5), ":".join(["cc"] * 32)),  # repeats 15
        (2, 17, _path(1, 5), None),  # same file as 16, which was not accepted
        (2, 18, _path(1, 6), history.EMPTY_CONTENT),
        (3, 19, _path(1, 7), "0" * 64),
        (3, 20, None, None),
        (3, 20, None, None),
        (3, 21, _path(1, 5, place="salt piers"), None),  # repeats 17
        (3, 22, "/library/2021/x/../salt-pier/./roll-00000001//IMG_00004 (2).jpg", None),
    ]
    h = spark.createDataFrame(old, "id long, source_path string, hash string").withColumn("image", F.lit("clash"))
    b = spark.createDataFrame(batch, "batch_no int, id long, source_path string, hash string")
    table = history.PivotTable.build(h, "id", "hash", "source_path", "library")
    cases, grown = table.absorb(table.keys_of(b, "batch_no", "id", "hash", "source_path"))
    want = {(1, 11), (2, 12), (2, 13), (1, 14), (15, 16), (17, 21), (15, 22)}
    assert {(r.accepted_id, r.id) for r in cases.collect()} == want
    # batch by batch, on the grown table, gives the same
    one, found = table, set()
    for k in (1, 2, 3):
        c, one = one.absorb(one.keys_of(b.filter(F.col("batch_no") == k), "batch_no", "id", "hash", "source_path"))
        found |= {(r.accepted_id, r.id) for r in c.collect()}
    assert found == want and one.rows.count() == grown.rows.count() == 4 + 13 - 7
    empty = history.PivotTable.build(h.limit(0), "id", "hash", "source_path", "library")
    assert empty.absorb(empty.keys_of(b.limit(0), "batch_no", "id", "hash", "source_path"))[0].count() == 0


def test_stored_pivot_table(spark, tmp_path):
    schema = "batch_no int, id long, source_path string, hash string"
    h = spark.createDataFrame([(0, i, _path(i, i), f"{i:064x}") for i in range(1, 40)] + [(0, 40, None, None)], schema)
    b1 = spark.createDataFrame([(1, 101, _path(3, 3, place="salt peir"), None), (1, 102, _path(200, 1), "d" * 64)], schema)
    b2 = spark.createDataFrame([(2, 201, _path(200, 1, place="salt pierr"), None), (2, 202, _path(300, 1), "D" * 64), (2, 203, _path(9, 9).upper(), None), (2, 204, _path(400, 1), None)], schema)
    folder = str(tmp_path / "table")
    names = ("batch_no", "id", "source_path", "hash")
    keys = lambda t, b: t.keys_of(b, "batch_no", "id", "hash", "source_path")
    table = history.PivotTable.build(h.select(*names), "id", "hash", "source_path", "library").create(folder)
    cases, grown = table.absorb(keys(table, b1))
    assert {(r.accepted_id, r.id) for r in cases.collect()} == {(3, 101)} and grown.append(folder).rows.count() == 41
    later = history.PivotTable.load(spark, folder)
    plan = later.rows._jdf.queryExecution().toString()
    assert "levenshtein" not in plan and "regexp" not in plan  # what is stored is neither measured nor taken apart again
    cases, grown = later.absorb(keys(later, b2))
    assert {(r.accepted_id, r.id) for r in cases.collect()} == {(102, 201), (102, 202), (9, 203)}
    assert grown.fresh.count() == 1 and grown.append(folder).rows.count() == 42
    with pytest.raises(Exception):
        table.create(folder)


def test_paths_are_resolved_at_any_depth(spark):
    deep = "/library/" + "/".join(f"d{i}" for i in range(30)) + "/.." * 30 + "/x/IMG_1.jpg"
    rows = ["/library/a/b/c/d/e/f/../../../../../../x/IMG_1.jpg", deep, "/library//./x/IMG_0001.jpeg", "/library/q/../../library/x/IMG_1.jpg", "/library/x/IMG_1.jpg"]
    df = spark.createDataFrame([(r,) for r in rows], "p string")
    got = {(r.numbers, r.letters) for r in history.with_path_parts(df, "p", "library").collect()}
    assert got == {("1", "/library/x/img#.jpg")}
    got = [r.letters for r in history.with_path_parts(spark.createDataFrame([("/mnt/../../b/c.png",), ("/m/library/c.png",), ("..",)], "p string"), "p").collect()]
    assert got[0] == "/b/c.png" and got[1] == "/m/library/c.png" and got[2] is None


def _table(spark, x, ids=None):
    ids = range(1, len(x) + 1) if ids is None else ids
    return spark.createDataFrame([(int(i), None if v is None else [float(a) for a in v]) for i, v in zip(ids, x)], "id long, v array<float>").withColumn("space", F.lit("clash")).withColumn("vec", F.lit(1))


def _clustered(seed=0, groups=12, each=12, alone=60):
    r = np.random.default_rng(seed)
    c = r.normal(size=(groups, 128))
    x = np.concatenate([np.repeat(c, each, axis=0) + 0.45 * r.normal(size=(groups * each, 128)), r.normal(size=(alone, 128))])
    return x * r.uniform(0.5, 2, size=(len(x), 1))


def test_neighbours_exact_and_relaxed(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 20)
    monkeypatch.setattr(neighbours, "LEAF", 8)
    x = _clustered()
    x[5] = x[4]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = u @ u.T
    np.fill_diagonal(cos, -9)
    points = usable(_table(spark, [*x, None, np.zeros(128), np.ones(96)]), {"s": "v"})
    want = {(i + 1, j + 1) for i in range(len(x)) for j in np.argsort(-cos[i], kind="stable")[:4]}
    for factor, least in ((1.0, 1.0), (neighbours.FACTOR, 0.9)):
        got = {(r.id, r.neighbour) for r in neighbours.nearest(points, None, ["s"], 4, factor).collect()}
        assert len(got) == 4 * len(x) and len(got & want) / len(want) >= least
    near = {(r.id, r.neighbour) for r in neighbours.nearest(points, None, ["s"], 4, 1.0, least_cos=0.8).collect()}
    assert near == {(i, j) for i, j in want if cos[i - 1, j - 1] >= 0.8}
    asked = {(r.id, r.neighbour) for r in neighbours.nearest(points, points.filter("id % 10 = 5"), ["s"], 4, 1.0).collect()}
    assert asked == {(i, j) for i, j in want if i % 10 == 5}


def test_neighbours_of_copies_and_nothing(spark):
    v = np.arange(128) + 1.0
    points = usable(_table(spark, [v] * 9 + [-v]), {"s": "v"})
    got = neighbours.nearest(points, None, ["s"], 3, 1.0, least_cos=0.9).collect()
    assert len(got) == 27 and {r.neighbour for r in got if r.id == 9} == {1, 2, 3}
    assert neighbours.nearest(points.limit(0), None, ["s"], 3).count() == 0


def test_shards_split_for_hot_cells(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 16)
    monkeypatch.setattr(neighbours, "ASKED", 24)
    x = _clustered(3, groups=2, each=60, alone=20)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    points = usable(_table(spark, x), {"s": "v"})
    got = {(r.id, r.neighbour) for r in neighbours.nearest(points, None, ["s"], len(x), 1.0, least_cos=0.75).collect()}
    cos = u @ u.T
    np.fill_diagonal(cos, -9)
    assert got == {(int(i) + 1, int(j) + 1) for i, j in zip(*np.nonzero(cos >= 0.75))}


@pytest.mark.parametrize("group", [10_000, 40])
def test_clusters(spark, monkeypatch, group):
    monkeypatch.setattr(clusters, "BLOCK", group)
    x = _clustered(1, groups=5, each=60, alone=50)
    points = usable(_table(spark, [*x, None]).repartition(4), {"s": "v"})
    got = clusters.linked(clusters.cluster_points(points), 0.65).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    part = clusters.components(u.astype(np.float32), 0.65)
    want = {}
    for i, p in enumerate(part):
        want.setdefault(p, set()).add(i + 1)
    mine = {}
    for r in got:
        mine.setdefault(r.lead_id, set()).add(r.id)
    assert sorted(map(sorted, (w for w in want.values() if len(w) >= 8))) == sorted(map(sorted, (m for m in mine.values() if len(m) >= 8)))
    assert all(min(m) == lead for lead, m in mine.items())
    assert clusters.linked(clusters.cluster_points(points.limit(0)), 0.65).count() == 0


def test_varied_subset(spark):
    x = np.concatenate([np.repeat(np.eye(128)[:1], 40, axis=0) + 0.01 * np.random.default_rng(2).normal(size=(40, 128)), np.eye(128)[1:6]])
    df = _table(spark, [*x, None]).withColumn("said", F.when(F.col("id") % 2 == 0, "").otherwise(F.lit(None).cast("string"))).withColumn("node", F.lit(1))
    rows = subset.features(df.repartition(5), "id", "v", "said")
    got = subset.varied_subset(rows, 6).collect()
    assert {r.id for r in got} >= {41, 42, 43, 44, 45} and len({r.id for r in got}) == 6
    assert subset.varied_subset(rows, 100).count() == 45  # fewer than asked for: all
    same = subset.features(_table(spark, [x[0]] * 5).withColumn("said", F.lit("a")), "id", "v", "said")
    assert [r.id for r in subset.varied_subset(same, 3).collect()] == [1, 2, 3]
    assert subset.varied_subset(rows.limit(0), 3).count() == 0
    assert subset.varied_subset(rows.repartition(2), 30).collect() == subset.varied_subset(rows.repartition(7), 30).collect()


def test_varied_subset_by_span_of_the_chosen(spark, monkeypatch):
    monkeypatch.setattr(subset, "NODE", 12)
    monkeypatch.setattr(subset, "PER_ROUND", 3)
    e = np.eye(128)
    x = np.concatenate([e[:8], (e[:7] + e[1:8]) / np.sqrt(2)])  # the sums lie in the span of the first eight
    got = subset.varied_subset(subset.features(_table(spark, x).withColumn("said", F.lit("")), "id", "v", "said"), 12).orderBy("rank").collect()
    u = np.stack([x[r.id - 1] for r in got[:8]])
    assert np.linalg.matrix_rank(u, tol=1e-3) == 8 and len({r.id for r in got}) == 12  # first a base, then the rest


def test_quantiles(spark):
    r = random.Random(4)
    rows = [("a" if i % 3 else "b", r.choice([r.gauss(0, 1), 1.0, float(i)])) for i in range(20000)] + [(None, 1.0), (None, 2.0), ("c", None), ("c", float("nan"))]
    df = spark.createDataFrame(rows, "k string, x double").repartition(6).withColumn("p", F.lit(1)).withColumn("__n", F.lit(2))
    s = quantiles.summarise(df, {"k": F.col("k")}, F.col("x"), 100)
    days = [quantiles.summarise(df.filter(F.pmod(F.hash("x"), F.lit(2)) == d), {"k": F.col("k")}, F.col("x"), 100) for d in (0, 1)]
    for summary in (s, quantiles.merge_summaries(*days, ["k"], 100)):
        got = quantiles.percentiles(summary, ["k"], [0.0, 0.1, 0.5, 0.99, 1.0]).collect()
        assert {g.k for g in got} == {"a", "b", None}
        for g in got:
            v = sorted(x for k, x in rows if k == g.k)
            rank = max(1, math.ceil(g.p * len(v)))
            assert g.n == len(v) and g.lower <= v[rank - 1] <= g.upper and g.rank_error <= 0.03 * len(v) + 1
            at = [i + 1 for i, x in enumerate(v) if x == g.estimate]
            assert min(abs(i - rank) for i in at) <= g.rank_error
    med = {m.k: m["median"] for m in quantiles.medians(df, "k", "x", 50).collect()}
    for k in ("a", "b", None):
        v = sorted(x for q, x in rows if q == k)
        assert med[k] == pytest.approx((v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2)
    assert quantiles.summarise(df.limit(0), {"k": F.col("k")}, F.col("x")).count() == 0


def _whole(x, least=0.65):
    """Components of at least eight rows, by brute force; ids count from 1."""
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    part = clusters.components(u, least)
    return sorted(sorted((np.flatnonzero(part == p) + 1).tolist()) for p in np.unique(part) if (part == p).sum() >= 8)


def _linked(spark, x):
    found = {}
    for r in clusters.linked(clusters.cluster_points(usable(_table(spark, x).repartition(4), {"s": "v"})), 0.65).collect():
        found.setdefault(r.lead_id, []).append(r.id)
    assert all(min(m) == lead for lead, m in found.items())
    return sorted(sorted(m) for m in found.values() if len(m) >= 8)


def _chain(clumps=9, each=6, step=0.8, seed=4):
    """Clumps along an arc, neighbours linked, ends at right angles or more: no one centroid is near all."""
    r = np.random.default_rng(seed)
    a = np.repeat(np.arange(clumps) * step, each)
    x = np.zeros((len(a), 128))
    x[:, 0], x[:, 1] = np.cos(a), np.sin(a)
    return x + 0.01 * r.normal(size=x.shape)


def test_chain_across_groups_is_one_cluster(spark):
    x = np.concatenate([_chain(clumps=7), _clustered(5, groups=4, each=12, alone=30)])
    want = _whole(x)
    assert max(map(len, want)) == 42
    assert _linked(spark, x) == want


def test_group_split_in_parts_keeps_all_links(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 40)
    x = np.stack([np.eye(128)[k : k + 3].sum(axis=0) for k in range(126)])  # each linked only to the next
    want = _whole(x)
    assert list(map(len, want)) == [126]
    assigned = usable(_table(spark, x), {"s": "v"}).selectExpr("space", "id", "vec", "1L AS cluster", "1.0D AS cos")
    got = clusters.linked(assigned, 0.65).collect()
    assert sorted(r.id for r in got) == want[0] and {r.lead_id for r in got} == {1}
    x = _clustered(6, groups=2, each=150, alone=10)
    assert _linked(spark, x) == _whole(x)


def test_loose_cluster_without_leaves_is_found(spark):
    e = np.eye(128)
    loose = np.sqrt(0.67) * e[0] + np.sqrt(0.33) * e[1:10]  # pairs of cosine 0.67: linked, but never one leaf
    for x in (loose, np.concatenate([loose, _clustered(7, groups=2, each=12, alone=20)])):
        want = _whole(x)
        assert list(range(1, 10)) in want
        assert _linked(spark, x) == want
    found = clusters.linked(clusters.cluster_points(usable(_table(spark, x), {"s": "v"})), 0.65)
    assert found.count() == len(x)


def test_many_centroids_meet_points_in_cells(spark, monkeypatch):
    monkeypatch.setattr(clusters, "CENTROIDS", 3)
    x = np.concatenate([_clustered(8, groups=9, each=14, alone=25), _chain(clumps=4)])
    assert _linked(spark, x) == _whole(x)
    monkeypatch.setattr(clusters, "BLOCK", 30)
    assert _linked(spark, x) == _whole(x)


def test_rest_with_many_links(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 100)
    monkeypatch.setattr(clusters, "CORE", 2.0)  # nothing is a ball
    x = np.concatenate([_clustered(9, groups=1, each=250, alone=20), _chain(clumps=3)])
    assert _linked(spark, x) == _whole(x)


def test_trees_split_and_prune():
    x = _clustered(11, groups=10, each=40, alone=100)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    ids, cos = np.arange(len(x)), x @ x.T
    np.fill_diagonal(cos, -2)
    want = {(i, j) for i in ids for j in np.argsort(-cos[i], kind="stable")[:5]}
    for factor, least in ((1.0, 1.0), (neighbours.FACTOR, 0.9)):
        tree, top = neighbours.VantageTree(x, ids), neighbours.Top(len(x), 5, -1.0)
        tree.search(x, ids, top, ids, factor)
        got = {(int(i), int(j)) for i in ids for j in top.id[i]}
        assert tree.splits >= len(x) // neighbours.LEAF - 1 and len(got & want) >= least * len(want)
        assert tree.compared + tree.pruned == len(x) ** 2
    assert tree.pruned > len(x) ** 2 // 2


def test_recall_with_a_third_in_one_group(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 64)
    monkeypatch.setattr(neighbours, "ASKED", 100)
    x = np.concatenate([_clustered(12, groups=1, each=200, alone=0), _clustered(13, groups=20, each=12, alone=160)])
    points = usable(_table(spark, x), {"s": "v"})
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    found = {}
    for r in neighbours.nearest(points, None, ["s"], 10).collect():
        found.setdefault(r.id, []).append((r.neighbour, r.cos))
    good, wanted = recall.recall(found, u, np.arange(1, len(x) + 1), 10)
    assert wanted == 10 * len(x) and good >= 0.9 * wanted


def test_quantiles_of_very_many_groups(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "_HELD", 500)
    rows = [(i % 700, float(i)) for i in range(7000)]
    df = spark.createDataFrame(rows, "k int, x double").coalesce(1)
    s = quantiles.summarise(df, {"k": F.col("k")}, F.col("x"), 50)
    got = {r.k: (r.n, r.estimate) for r in quantiles.percentiles(s, ["k"], [0.5]).collect()}
    assert s.count() == 700 and got == {k: (10, float(k + 700 * 4)) for k in range(700)}
