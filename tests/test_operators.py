"""Operators of the core on small fixtures, with nulls, ties, repeats and empty tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetspark import providers
from facetspark.functions import text
from facetspark.operators import bayes, curation, fulltext, imports, kmeans, search
from facetspark.operators.session import SearchSession
from facetspark.plans import catalog, standards
from facetspark.sources import sinks
from facetspark.sources.tables import Store, insert_or_ignore, numbered, patched, upsert
from facetspark.streaming.imports import arrivals, import_stream


def values(spark, rows):
    return spark.createDataFrame([(i, u, f"h{i}", v) for i, (u, v) in enumerate(rows)], "id long, url string, image_hash string, max_value double")


def test_low_value_files(spark):
    df = values(spark, [("file:///a", 50.0), ("file:///a", 90.0), ("file:///b", 500.0), ("file:///c", 20.0), ("file:///d", 100.0), ("file:///n", None), ("file:///n", float("nan")), ("x", 1.0), ("x", 1.0)])
    got = [(r.url, r.image_hash, r.max_value, r.record_count) for r in curation.below(df, 100).collect()]
    assert got == [("x", "h7", 1.0, 2), ("file:///c", "h3", 20.0, 1), ("file:///a", "h1", 90.0, 2)]
    assert [r.url for r in curation.below(df, 100, ["/c", "/**"]).collect()] == ["file:///c", "file:///a"]
    ten = values(spark, [(f"file:///{i}", 10.0 * i) for i in range(1, 11)])
    assert curation.lowest_percent(ten, 1).count() == 1 and curation.lowest_percent(ten, 20).count() == 2 and curation.lowest_percent(ten, 100).count() == 10
    assert curation.below(df.limit(0), 100).count() == 0 and curation.max_value_of(df, "none").first()[0] is None
    assert curation.parse_threshold("5%") == ("percent", 5.0)
    for bad in ("101%", "0", "-1", "x", ""):
        with pytest.raises(ValueError):
            curation.parse_threshold(bad)


@pytest.mark.parametrize("mode, want", [("skip", {"a": "moved", "b": "skipped", "c": "skipped"}), ("keep-max", {"a": "moved", "b": "replaced", "c": "skipped"}), ("abort", {"a": "aborted", "b": "aborted", "c": "aborted"}), ("rename", {"a": "moved", "b": "moved", "c": "moved"})])
def test_move_plan(spark, mode, want):
    f = spark.createDataFrame([("file:///x/a.jpg", 1.0), ("file:///x/b.jpg", 9.0), ("file:///x/c.jpg", None), ("http://x/d.jpg", 1.0)], "url string, max_value double")
    have = spark.createDataFrame([("b.jpg", 5.0), ("c.jpg", None)], "name string, max_value double")
    got = {r.url[-5]: r for r in curation.plan_move(f, have, mode).collect()}
    assert {k: got[k].action for k in "abc"} == want and got["d"].action in ("skipped", "aborted")
    if mode == "rename":
        assert got["b"].target == "b_1.jpg"
    with pytest.raises(ValueError):
        curation.plan_move(f, have, "maybe")


def test_search_language():
    assert search.parse_query("min:5 red max:x colour:blue") == ({"min": "5", "max": "x"}, "red colour:blue")
    s = search.to_search({"min": "5abc", "max": "x", "format": "png, webp"})
    assert (s.min_value, s.max_value, s.formats) == (5.0, None, ("png", "webp")) and search.Search(limit=3).is_empty and not s.is_empty
    with pytest.raises(ValueError):
        search.Search(limit=-1)
    with pytest.raises(ValueError):
        search.parse_filters(["format"])


def test_full_text(spark):
    df = spark.createDataFrame([(1, "beautiful landscape photo"), (2, "city architecture"), (3, "Landscape LÁNDSCAPE"), (4, ""), (5, None)], "id long, description string").withColumn("dl", F.lit("clash"))
    got = [r.id for r in fulltext.bm25_search(df, "id", "description", "'landscape'").orderBy(F.desc("bm25"), "id").collect()]
    assert got == [3, 1] and fulltext.bm25_search(df, "id", "description", " ' ").count() == 0
    old = fulltext.postings(df, "id", "description")
    new = fulltext.updated_postings(old, df.filter("id = 2").withColumn("description", F.lit("town")), df.filter("id = 1").select("id"), "id", "description")
    assert {(r.token, r.id) for r in new.collect()} == {("town", 2), ("landscape", 3)}


def test_full_text_language(spark, tmp_path):
    said = ["red mill near the old bridge", "old mill", "the mill is old", "windmill and red wind", "Old, old MILL!", "bridge", "", None]
    df = spark.createDataFrame(list(enumerate(said)), "id long, t string")
    fulltext.Index.of(df, "id", "t").save(str(tmp_path / "i"))
    index = fulltext.Index.load(spark, str(tmp_path / "i"))
    want = {
        "old mill": [0, 1, 2, 4], "old + mill": [1, 4], "mill OR bridge": [0, 1, 2, 4, 5], "mill NOT red": [1, 2, 4], "win*": [3], "^old": [1, 4], "^old mill NOT bridge": [1, 4],
        "red (bridge OR wind)": [0, 3], "NEAR(mill bridge, 2)": [], "NEAR(mill bridge, 3)": [0], "NEAR(red + mill bridge)": [0], "bridge NOT mill OR wind*": [3, 5], "red AND old": [0], "'": [], "or": [], "mill + ol*": [], "is + ol*": [2],
    }
    for q, ids in want.items():
        assert sorted(r.id for r in index.search(q).collect()) == ids, q
        assert sorted(r.id for r in fulltext.bm25_search(df, "id", "t", q).collect()) == ids, q
    for bad in ("(mill", "mill)", "NEAR(a b"):
        with pytest.raises(ValueError):
            index.search(bad)


def test_full_text_against_sqlite(spark):
    sqlite3 = pytest.importorskip("sqlite3")
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    r = random.Random(7)
    words = "mill old bridge red windmill river".split()
    docs = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 6, 12])))) for i in range(1, 60)] + [(60, "Élan ÉLAN, naïve_mill"), (61, None)]
    con.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", docs)
    df = spark.createDataFrame(docs, "id long, t string").coalesce(1)
    index = fulltext.Index(fulltext.postings(df, "id", "t").cache(), fulltext.statistics(df, "t").cache())
    for q in ["elan", "mill old", "old + mill OR bri*", "old OR mill AND red", "red NOT old NOT mill", "NEAR(mill red, 1)", "NEAR(old mill red, 3) OR river", "NEAR(old + mill red, 3)", "(old old) NOT red OR wi*", "^old river OR red NOT ^mill"]:
        want = dict(con.execute("SELECT rowid, -bm25(f) FROM f WHERE f MATCH ?", (q,)).fetchall())
        assert {x.id: x.bm25 for x in index.search(q).collect()} == pytest.approx(want), q
    q = "NEAR(old + mill red bridge, 3) OR river"  # ranks differ in this form, as the module says; rows don't
    assert {x.id for x in index.search(q).collect()} == {i for i, in con.execute("SELECT rowid FROM f WHERE f MATCH ?", (q,))}


def probs(spark, *p):
    return spark.createDataFrame(list(enumerate(map(float, p))), "id long, prob double")


def test_bayes(spark):
    third = probs(spark, 1 / 3, 1 / 3, 1 / 3)
    s = spark.createDataFrame([(0, 0.2), (1, 0.5)], "id long, score double")
    got = {r.id: r.prob * 3 for r in bayes.update(third, s, 0.5).collect()}
    assert got[0] == pytest.approx(0.4868, abs=1e-4) and got[1] == pytest.approx(1) and got[2] == pytest.approx(1)
    assert [r.prob for r in bayes.normalised(probs(spark, 2, 3, 5)).orderBy("id").collect()] == pytest.approx([0.2, 0.3, 0.5])
    assert [r.prob for r in bayes.normalised(probs(spark, 0, 0)).collect()] == [0, 0] and bayes.normalised(probs(spark, 1).limit(0)).count() == 0
    assert bayes.entropy(probs(spark, 0.25, 0.25, 0.25, 0.25)).first()[0] == pytest.approx(math.log(4)) and bayes.entropy(probs(spark, 0, 1)).first()[0] == 0
    same = spark.createDataFrame([(1, i, 0.5) for i in range(3)] + [(2, i, x) for i, x in enumerate((0.1, 0.5, 0.9))], "question_id int, id long, score double")
    gain = {r.question_id: r.info_gain for r in bayes.information_gain(third, same).collect()}
    assert abs(gain[1]) < 1e-9 and gain[2] > 0.01 and bayes.best_question(bayes.information_gain(third, same)).first().question_id == 2
    t = {r.id: r.prob for r in bayes.tempered(probs(spark, 0.9, 0.1), probs(spark, 0.5), 0.2).collect()}
    assert t[0] == pytest.approx(0.82) and t[1] == pytest.approx(0.08)
    assert [r.id for r in bayes.pruned(probs(spark, 0.1, 0.3, 0.3), 2).collect()] == [1, 2]
    stats = bayes.beam_stats(probs(spark, 1).limit(0)).first()
    assert (stats.size, stats.max_prob, stats.collapsed) == (0, 0.0, True)


def test_diversity(spark):
    v = lambda *x: spark.createDataFrame([(list(map(float, a)),) for a in x], "v array<float>")
    d = lambda *x: bayes.diversity(v(*x), "v").first()[0]
    assert d((1, 0), (2, 0)) == pytest.approx(0) and d((1, 0), (0, 1)) == pytest.approx(0.5) and d((1, 0)) == 0 and d((0, 0), (1, 0)) == pytest.approx(1)


def test_session_finds_the_target(spark):
    vec = lambda i: [1.0 if j == i else 0.1 for j in range(6)]
    df = spark.createDataFrame([(i, vec(i), vec(i)) for i in range(6)], "id long, text_vec array<double>, visual_vec array<double>")
    s = SearchSession(df, lambda q: vec(int(q[-1])), most_rounds=8).start()
    asked = [f"like {i}" for i in range(6)]
    while (q := s.next_question(asked)) is not None and s.answer(q, 1.0 if q[-1] == "4" else 0.1 if q != "like 0" else None) is None:
        asked.remove(q) if q in asked else None
    assert s.results(1).first().id == 4 and s.reason in ("confidence", "max_rounds", "not_in_library", "low_ig")


def test_kmeans(spark):
    df = spark.createDataFrame([(i, [float(x), 0.0]) for i, x in enumerate((0, 1, 2, 10, 11, 12))], "id long, f array<double>")
    got, centres = kmeans.kmeans(df, "id", "f", 2, seed=3)
    assert sorted(c[0] for c in centres) == [1.0, 11.0] and len({r.cluster for r in got.collect()}) == 2
    assert kmeans.kmeans(df, "id", "f", 0)[0].count() == 0 and len({r.cluster for r in kmeans.kmeans(df, "id", "f", 9)[0].collect()}) == 6
    assert kmeans.kmeans(df.limit(0), "id", "f", 2)[0].count() == 0


def test_features_to_group_files_by(spark):
    df = spark.createDataFrame([("a", 4, 2), ("b", 0, 3), ("c", None, None)], "name string, width int, height int")
    got = lambda *a, **k: [r.f for r in kmeans.with_features(df, *a, **k).orderBy("name").collect()]
    assert got("resolution") == [[4.0, 2.0], [0.0, 3.0], [0.0, 0.0]] and got("aspect-ratio") == [[2.0], [0.0], [0.0]]
    assert [len(f) for f in got("name", model=lambda: providers.HashedEmbedding(8))] == [8, 8, 8]
    for bad in ("name", "colour"):
        with pytest.raises(ValueError):
            kmeans.with_features(df, bad)


def test_imports_and_tables(spark, tmp_path):
    row = "id long, source_path string, hash string, status string"
    old = spark.createDataFrame([(1, "a", "h1", "indexed"), (2, "b", "h2", "failed")], row)
    new = spark.createDataFrame([(3, "c", "h1", "pending"), (4, "a", "h4", "pending"), (5, "d", "h5", "pending"), (6, "e", "h5", "pending"), (7, "f", None, "pending"), (8, "g", None, "pending")], row)
    assert {r.id: r.outcome for r in imports.classified(new, old).collect()} == {3: "duplicate", 4: "indexed", 5: "import", 6: "duplicate", 7: "import", 8: "import"}
    assert {r.status: r.n for r in imports.status_counts(old).collect()} == {"pending": 0, "processing": 0, "embedded": 0, "indexed": 1, "failed": 1}
    assert sorted(r.id for r in insert_or_ignore(old, new.withColumn("source_path", F.when(F.col("id") > 4, "z").otherwise(F.col("source_path"))), "source_path").collect()) == [1, 2, 3, 5]
    assert {r.id: r.status for r in patched(old, spark.createDataFrame([(2, "indexed", None)], "id long, status string, hash string")).collect()} == {1: "indexed", 2: "indexed"}
    assert upsert(old, new.limit(0)).count() == 2 and sorted(r.id for r in numbered(new.repartition(3), "id", 10).collect()) == list(range(11, 17))
    store = Store(spark, str(tmp_path))
    store.ensure("image_import")
    store.ensure("image_import")
    store.append("image_import", new.drop("id"))
    store.upsert("image_import", store.read("image_import").filter("id = 1").withColumn("status", F.lit("indexed")))
    assert store.read("image_import").count() == 6 and store.read("image_import").filter("status = 'indexed'").count() == 1
    with pytest.raises(FileNotFoundError):
        store.read("none")


def test_import_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    store.ensure("image_import")
    schema = store.read("image_import").schema
    rows = [(i, f"p{i}", f"h{i % 3}" if i < 6 else None, "pending", None, None, None, None, "2023-01-01 00:00:00", None) for i in range(8)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        import_stream(arrivals(spark, str(tmp_path / "in")), store, "image_import", str(tmp_path / "c")).awaitTermination(120)
    assert sorted(str(r.hash) for r in store.read("image_import").collect()) == ["None", "None", "h0", "h1", "h2"]


def test_standards(spark, tmp_path):
    text = "---\nname: n\ndescription: d\nsize_correction:\n  min_width: 4000\n  multiplier: 2\n---\nBody\n"
    got = standards.parse(text)
    assert got["currency"] == "CNY" and got["size_correction"] == [(4000, None, None, None, 2.0)] and got["body"] == "Body"
    for bad in ("no head", "---\nname: n\n---\n", "---\ndescription: d\n---\n", "---\n: [\n---\n"):
        with pytest.raises(ValueError):
            standards.parse(bad)
    for d in "ab":
        (tmp_path / d).mkdir()
        (tmp_path / d / "n.md").write_text(text.replace("description: d", f"description: {d}"))
    df = standards.load(spark, {"builtin": str(tmp_path / "a"), "filesystem": str(tmp_path / "b"), "none": str(tmp_path / "c")})
    assert [r.description for r in standards.overridden(df).collect()] == ["b"]


def test_providers(spark):
    talk = [{"role": "user", "content": "x"}]
    call = lambda n, **a: providers.Reply(tool_calls=[{"name": n, "arguments": a}])
    model = providers.Scripted([call("look"), call("bad"), call("submit", v=1)])
    assert providers.run_tools(model, talk, {"look": lambda a: "seen"}, "submit") == {"v": 1} and "unknown tool" in model.seen[-1][-1]["content"]
    with pytest.raises(providers.ConfigError):
        providers.create("nowhere")
    df = spark.createDataFrame([("a b",), (None,)], "t string")
    assert [len(r.e) for r in providers.embedded(df, "t", "e", lambda: providers.HashedEmbedding(8), 1).collect()] == [8, 8]
    got = providers.completed(df, "t", lambda: providers.Scripted([providers.Reply("yes")])).collect()
    assert [r.reply for r in got] == ["yes", "yes"]
    assert providers.translated(["t=", "u="], providers.Scripted([providers.Reply("one\nx"), providers.Reply("two")])) == ["t=one", "u=two"]


def test_catalog_is_consistent():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and len(catalog.queries()) > 60


def test_bayes_over_all_points(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, [r.gauss(0, 1) for _ in range(128)], [r.gauss(0, 1) for _ in range(128)]) for i in range(1, 251)] + [(251, None, [1.0] * 128)]
    spark.createDataFrame(rows, "id long, text_vec array<float>, visual_vec array<float>").write.parquet(f"{tmp_path}/vector_point.parquet")
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    weight = {i: i % 7 + 1 for i in range(1, 251)}
    got = {x.id: x.prob for x in run("bayes_normalise")}
    assert set(got) == set(weight) and all(abs(got[i] - w / sum(weight.values())) < 1e-8 for i, w in weight.items())
    assert len(run("blended_score")) == 750 and run("beam_stats")[0].size == 250
    assert len(run("beam_prune")) == 50 and len(run("search_session_replay")) == 5


def test_most_similar(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(90, 8))
    x[7], x[8], x[9] = x[6], 0, -x[6]
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(90, None), (91, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").withColumn("query_id", F.lit(1))
    q = df.filter("id % 10 = 6 or id = 8").select(F.col("id").alias("query_id"), F.col("v").alias("vec"))
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    score = np.where((np.abs(x).sum(1) > 0)[:, None] & (np.abs(x).sum(1) > 0), np.round((u @ u.T + 1) / 2, 12), 0)
    for block in (2048, 3):
        got = {}
        for g in bayes.most_similar(df.repartition(3), "v", q, 5, block).orderBy(F.desc("score"), "id").collect():
            got.setdefault(g.query_id, []).append(g.id)
        assert got == {i: sorted(range(90), key=lambda j: (-score[i][j], j))[:5] for i in (6, 8, 16, 26, 36, 46, 56, 66, 76, 86)}
    assert bayes.most_similar(df, "v", q.limit(0), 5).count() == 0 and bayes.most_similar(df.limit(0), "v", q, 5).count() == 0


def test_free_names(spark):
    f = spark.createDataFrame([("file:///x/a.jpg", 1.0), ("file:///y/a.jpg", 1.0), ("file:///z/a.jpg", 2.0), ("file:///x/a_3.jpg", 1.0), ("file:///x/.b", 1.0), ("file:///x/c", 1.0)], "url string, max_value double")
    have = spark.createDataFrame([("a.jpg", 5.0), ("a_1.jpg", 1.0), (".b", 1.0), (None, 1.0)], "name string, max_value double")
    got = {r.url[8:]: r.target for r in curation.plan_move(f, have, "rename").collect()}
    assert got == {"x/a.jpg": "a_2.jpg", "y/a.jpg": "a_4.jpg", "z/a.jpg": "a_5.jpg", "x/a_3.jpg": "a_3.jpg", "x/.b": ".b_1", "x/c": "c"}
    df = spark.createDataFrame([(1, "d", "a.png"), (2, "d", "a.png"), (3, "d", "a_1.png"), (4, "e", "a.png"), (5, "d", "a.png"), (6, None, "a.png"), (7, None, "a.png"), (8, "d", None)], "id long, folder string, name string")
    assert {r.id: r.unique_name for r in curation.unique_names(df, "folder", "name", "id").collect()} == {1: "a.png", 2: "a_2.png", 3: "a_1.png", 4: "a.png", 5: "a_3.png", 6: "a.png", 7: "a_1.png", 8: None}
    assert curation.unique_names(df.limit(0), "folder", "name", "id").count() == 0


def test_values_that_are_no_number(spark):
    df = spark.createDataFrame([(1, 1.005, float("nan"))], "id long, min_value double, max_value double").select("*", *[F.lit("x").alias(c) for c in ("standard_name", "image_format", "valued_at", "description")])
    assert search.tool_view(df).first().max_value is None and search.tool_view(df).first().min_value == 1.005
    long = "file:///" + "a" * 3_000_000
    assert df.select(text.file_path(F.lit(long)).alias("p")).selectExpr("length(p)").first()[0] == 3_000_001


def test_store_writes_deltas(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.count("image_import") == 0 and store.names() == [] and store.reachable()
    store.ensure("image_import")
    row = lambda i, s, p: spark.createDataFrame([(i, p, s)], "id long, source_path string, status string")
    for i in range(1, 5):
        store.append("image_import", row(0, "pending", f"p{i}").drop("id"))
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "s" / "image_import").rglob("*.parquet")}
    before = files()
    store.upsert("image_import", row(2, "indexed", "p2"))
    store.upsert("image_import", row(2, "failed", "p2"))
    store.insert_or_ignore("image_import", row(9, "new", "p1").unionByName(row(8, "new", "p8")).unionByName(row(7, "new", "p8")), "source_path")
    store.patch("image_import", spark.createDataFrame([(3, "indexed", None)], "id long, status string, error string"), stamp="processed_at")
    assert all(files()[p] == t for p, t in before.items())  # nothing is written again
    want = {1: "pending", 2: "failed", 3: "indexed", 4: "pending", 7: "new"}
    got = lambda: {r.id: r.status for r in store.read("image_import").collect()}
    assert got() == want and store.count("image_import") == 5
    at = {r.id: r.processed_at for r in store.read("image_import").collect()}
    assert at[3] is not None and at[1] is None
    store.compact("image_import")
    assert store.vacuum("image_import") == 9 and got() == want and store.names() == ["image_import"]
    # a writer that comes second tries again on what the first wrote
    tried = []

    def late(old):
        if not tried:
            store.upsert("image_import", row(1, "first", "p1"))
        tried.append(old.count())
        return row(1, "second", "p1").select(*[F.col(c) if c in ("id", "source_path", "status") else F.lit(None).cast("string").alias(c) for c in old.columns])

    store._write("image_import", "upsert", late, "id")
    assert len(tried) == 2 and got()[1] == "second"


def test_many_upserts_are_compacted_and_migrations_run_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Store, "PARTS", 3)
    store = Store(spark, str(tmp_path))
    store.ensure("t", "id long, v string")
    for i in range(8):
        store.upsert("t", spark.createDataFrame([(i % 2, str(i))], "id long, v string"))
    assert {(r.id, r.v) for r in store.read("t").collect()} == {(0, "6"), (1, "7")} and len(store._parts("t")[1]) <= 4
    ran = []
    steps = {"010_b": lambda s: ran.append("b"), "2_a": lambda s: ran.append("a")}
    assert store.migrate(steps) == ["2_a", "010_b"] and store.migrate(steps | {"011_c": lambda s: ran.append("c")}) == ["011_c"] and ran == ["a", "b", "c"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "ab" * 32, "broke"), (2, "cd" * 32, None), (3, None, "")], "id long, image_hash string, error string")
    assert sinks.json_lines(df).filter("id = 2").first().json == '{"id":2,"image_hash":"' + "cd" * 32 + '","error":null}'
    assert sinks.pretty_json(df.filter("id = 3"), 5).startswith('[\n  {\n    "id": 3') and sinks.pretty_json(df.limit(0), 5) == "[]"
    assert sorted(r.id for r in sinks.log_failures(df, "error", str(tmp_path / "f")).collect()) == [2, 3]
    logged = spark.read.json(str(tmp_path / "f")).collect()
    assert len(logged) == 1 and logged[0].name.startswith("fail-2") and logged[0].name.endswith("-abababab")
    (tmp_path / "a.jpg").write_text("a")
    (tmp_path / "b c.jpg").write_text("b")
    urls = [f"file://{tmp_path}/a.jpg", f"file://{tmp_path}/b%20c.jpg", f"file://{tmp_path}/gone.jpg"]
    plan = curation.plan_move(spark.createDataFrame([(u, 1.0) for u in urls], "url string, max_value double"), spark.createDataFrame([], "name string, max_value double"), "rename")
    to = str(tmp_path / "to")
    assert not any(r.moved for r in sinks.move_files(plan, to).collect()) and not (tmp_path / "to").exists()
    moved = sinks.move_files(plan, to, dry_run=False)
    assert {r.new_url[-9:]: r.moved for r in moved.collect()} == {"/to/a.jpg": True, "b%20c.jpg": True, "/gone.jpg": False} and (tmp_path / "to" / "b c.jpg").exists()
    records = spark.createDataFrame([(u,) for u in [*urls, "http://x", None]], "url string")
    assert sorted(str(r.url) for r in sinks.moved_urls(records, moved).collect()) == sorted([f"file://{to}/a.jpg", f"file://{to}/b%20c.jpg", urls[2], "http://x", "None"])
    said = spark.createDataFrame([(3, "c=3"), (1, "a=1"), (2, None)], "n long, line string")
    sinks.write_lines(said, "n", "line", str(tmp_path / "l"))
    assert [r.line for r in sinks.read_lines(spark, str(tmp_path / "l")).orderBy("file", "n").collect()] == ["a=1", "", "c=3"] and sinks.translated_path("/x/tags.txt") == "/x/tags-tr.txt"


def test_beams_are_saved_and_described(spark, tmp_path):
    beam = probs(spark, 0.2, 0.5, 0.3)
    bayes.save_beam(beam, str(tmp_path / "b"))
    assert [(r.id, r.prob) for r in bayes.load_beam(spark, str(tmp_path / "b"), 2).collect()] == [(1, 0.5), (2, 0.3)]
    said = spark.createDataFrame([(1, " "), (2, "a crane")], "id long, description string")
    assert [(r.ordinal, r.description) for r in bayes.described(beam, said).collect()] == [(1, "Image 1"), (2, "a crane"), (3, "Image 0")]
    nothing = spark.createDataFrame([(1, 0, 0.5)], "question_id int, id long, score double")
    assert {r.prob for r in bayes.bin_probabilities(probs(spark, 0.0), nothing).collect()} == {0.1}
