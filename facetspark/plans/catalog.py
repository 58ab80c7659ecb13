"""All registered queries of the core, each beside its SQL. Floats are rounded to 6 digits at the very end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx, numbers, text
from ..operators import bayes, curation, fulltext, imports, kmeans, rules, search
from ..sources import tables
from ..sources.tables import read
from ..streaming.imports import status_windows
from . import standards

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
V, I, B, P, S = "valuation", "image_import", "import_batch", "vector_point", "standard_ref"


def query(sql: str | None = None):
    """Register a function (table reader) -> DataFrame under its name, with its SQL."""

    def add(f):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: read(spark, sf_dir, name))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _r(c, digits: int = 6):
    return F.round(c, digits)


# files and their values

_FILES = """WITH f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY max_value DESC, id) AS rn, count(*) OVER (PARTITION BY url) AS record_count
  FROM valuation WHERE max_value IS NOT NULL AND NOT isnan(max_value)), files AS (SELECT url, image_hash, max_value, record_count FROM f WHERE rn = 1) """
GLOBS = ["/library/20[1", "**/IMG_*.jp*g", "/library/2021/*/**/scan_0?9*.png"]
_GLOB_SQL = r"url LIKE 'file://%' AND regexp_full_match(replace(url_decode(substr(url, 8)), '\', '/'), '.*/IMG_[^/]*\.jp[^/]*g|/library/2021/[^/]*/.*/scan_0[^/]9[^/]*\.png')"


@query(_FILES + "SELECT * FROM files WHERE max_value < 20")
def low_value_files(t):
    return curation.below(t(V), 20.0)


@query(_FILES + "SELECT * FROM files ORDER BY max_value, url LIMIT 25")
def lowest_files(t):
    return curation.lowest(t(V), 25)


@query(_FILES + "SELECT * FROM files ORDER BY max_value, url LIMIT (SELECT CAST(ceil(count(*) * 5 / 100.0) AS BIGINT) FROM files)")
def lowest_percent_files(t):
    return curation.lowest_percent(t(V), 5)


@query(_FILES.replace("AND NOT isnan(max_value)", f"AND NOT isnan(max_value) AND {_GLOB_SQL}") + "SELECT * FROM files ORDER BY max_value, url LIMIT 30")
def lowest_files_of_globs(t):
    return curation.lowest(t(V), 30, GLOBS[1:])


@query(f"SELECT count(DISTINCT url) AS files FROM valuation WHERE {_GLOB_SQL}")
def path_glob_file_count(t):
    return curation.file_count(t(V), GLOBS)


@query("SELECT count(DISTINCT url) AS files FROM valuation")
def count_distinct_files(t):
    return curation.file_count(t(V))


@query("SELECT max(CASE WHEN NOT isnan(max_value) THEN max_value END) AS max_value FROM valuation WHERE url = 'file:///library/inbox/latest.jpg'")
def max_value_by_url(t):
    return curation.max_value_of(t(V), "file:///library/inbox/latest.jpg")


@query("SELECT count(*) AS n FROM valuation")
def record_count(t):
    return t(V).agg(F.count(F.lit(1)).alias("n"))


# the number-th free form of a name: numbers that some file bears are passed over
_FREE = r"""stem AS (SELECT {f}name, regexp_extract(name, '^(.+?)(\.[^.]*)?$', 1) AS s, regexp_extract(name, '^(.+?)(\.[^.]*)?$', 2) AS e FROM (SELECT DISTINCT {f}name FROM born)),
taken AS (SELECT {f}regexp_extract(s, '^(.+)_([1-9][0-9]{{0,8}})$', 1) || e AS name, TRY_CAST(regexp_extract(s, '^(.+)_([1-9][0-9]{{0,8}})$', 2) AS BIGINT) AS b FROM stem),
gap AS (SELECT {f}name, b - row_number() OVER (PARTITION BY {f}name ORDER BY b) AS o FROM taken WHERE b IS NOT NULL)"""
_FORM = r"regexp_extract(x.name, '^(.+?)(\.[^.]*)?$', 1) || '_' || (x.k + (SELECT count(*) FROM gap WHERE gap.name = x.name{f} AND gap.o < x.k)) || regexp_extract(x.name, '^(.+?)(\.[^.]*)?$', 2)"
_MOVE_SQL = _FILES + r""", n AS (SELECT url, max_value, regexp_extract(url_decode(substr(url, 8)), '([^/\\]*)$', 1) AS name FROM files WHERE max_value < 20),
have AS (SELECT name, max(max_value) AS held FROM (SELECT regexp_extract(source_path, '([^/\\]*)$', 1) AS name, CAST(id % 50 AS DOUBLE) AS max_value FROM image_import) GROUP BY name),
j AS (SELECT n.*, held, have.name IS NOT NULL AS known, row_number() OVER (PARTITION BY n.name ORDER BY url) AS k FROM n LEFT JOIN have ON n.name = have.name) """


@query(_MOVE_SQL + "SELECT url, name, CASE WHEN NOT known AND k = 1 THEN name WHEN k = 1 AND max_value > held THEN name END AS target, CASE WHEN NOT known AND k = 1 THEN 'moved' WHEN k = 1 AND max_value > held THEN 'replaced' ELSE 'skipped' END AS action FROM j")
def move_plan_keep_max(t):
    existing = t(I).select(text.basename(F.col("source_path")).alias("name"), (F.col("id") % 50).cast("double").alias("max_value"))
    return curation.plan_move(curation.below(t(V), 20.0), existing, "keep-max")


@query(
    _MOVE_SQL
    + ", born AS (SELECT name FROM n UNION ALL SELECT name FROM have), "
    + _FREE.format(f="")
    + ", x AS (SELECT url, name, CASE WHEN known THEN k ELSE k - 1 END AS k FROM j) SELECT url, name, CASE WHEN k = 0 THEN name ELSE "
    + _FORM.format(f="")
    + " END AS target, 'moved' AS action FROM x"
)
def move_plan_rename(t):
    existing = t(I).select(text.basename(F.col("source_path")).alias("name"), (F.col("id") % 50).cast("double").alias("max_value"))
    plan = curation.plan_move(curation.below(t(V), 20.0), existing, "rename")
    return plan


@query(
    r"""WITH born AS (SELECT id, regexp_extract(source_path, '^(.*)/[^/]*/[^/]*$', 1) AS folder, regexp_extract(source_path, '([^/\\]*)$', 1) AS name FROM image_import),
x AS (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY id) - 1 AS k FROM born), """
    + _FREE.format(f="folder, ")
    + " SELECT id, CASE WHEN k = 0 THEN name ELSE "
    + _FORM.format(f=" AND gap.folder = x.folder")
    + " END AS unique_name FROM x"
)
def unique_names(t):
    named = t(I).select("id", F.regexp_extract("source_path", r"^(.*)/[^/]*/[^/]*$", 1).alias("folder"), text.basename(F.col("source_path")).alias("name"))
    return curation.unique_names(named, "folder", "name", "id").select("id", "unique_name")


# history search

_FIELDS = "id, standard_name, image_format, valued_at"


def _brief(df: DataFrame) -> DataFrame:
    return df.select("id", "standard_name", "image_format", "valued_at")


@query(f"SELECT {_FIELDS} FROM valuation WHERE min_value >= 10 AND NOT isnan(min_value) AND max_value <= 200 AND NOT isnan(max_value) AND standard_name = 'street-archive' ORDER BY valued_at DESC, id DESC LIMIT 30")
def search_structured(t):
    return _brief(search.structured(t(V), search.Search(10, 200, "street-archive", limit=30)))


@query(f"SELECT {_FIELDS} FROM valuation WHERE image_format IN ('png', 'webp') ORDER BY valued_at DESC, id DESC LIMIT 20")
def search_formats(t):
    return _brief(search.structured(t(V), search.Search(formats=("png", "webp"))))


@query(f"SELECT {_FIELDS} FROM valuation ORDER BY valued_at DESC, id DESC LIMIT 50")
def search_latest(t):
    return _brief(search.latest(t(V), 80))


@query(f"SELECT {_FIELDS} FROM valuation WHERE valued_at >= '2023-01-01' AND valued_at <= '2023-01-31' ORDER BY valued_at DESC, id DESC LIMIT 50")
def search_date_text(t):
    return _brief(search.structured(t(V), search.Search(date_from="2023-01-01", date_to="2023-01-31", limit=50)))


@query(f"SELECT {_FIELDS} FROM valuation WHERE min_value >= 5 AND NOT isnan(min_value) AND max_value <= 80 AND NOT isnan(max_value) AND image_format IN ('jpeg', 'webp') ORDER BY valued_at DESC, id DESC LIMIT 20")
def search_query_language(t):
    return _brief(search.run(t(V), "min:5 windmill max:400 format:png", ["max=80", "format=jpeg,webp"]))


_BM25 = r"""WITH d AS (SELECT id, regexp_extract_all(strip_accents(lower(coalesce(description, ''))), '[\p{{L}}\p{{N}}]+') AS ts FROM valuation),
s AS (SELECT id, CAST(len(ts) AS DOUBLE) AS dl, {tf} FROM d),
a AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl, {df} FROM s)
SELECT id, round({score}, 6) AS bm25 FROM s, a WHERE {all}"""


def _bm25_sql(*terms: str) -> str:
    k = range(len(terms))
    return _BM25.format(
        tf=", ".join(f"CAST(len(list_filter(ts, lambda x: x = '{w}')) AS DOUBLE) AS tf{i}" for i, w in enumerate(terms)),
        df=", ".join(f"count(*) FILTER (tf{i} > 0) AS n{i}" for i in k),
        score=" + ".join(f"greatest(1e-6, ln((n - n{i} + 0.5) / (n{i} + 0.5))) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in k),
        all=" AND ".join(f"tf{i} > 0" for i in k),
    )


@query(_bm25_sql("light", "rain"))
def fts_bm25(t):
    return fulltext.bm25_search(t(V), "id", "description", "Light 'RAIN'").select("id", _r("bm25").alias("bm25"))


@query(_bm25_sql("windmill", "near") + " ORDER BY bm25 DESC, id LIMIT 15")
def fts_top(t):
    hits = fulltext.bm25_search(t(V), "id", "description", "windmill near").select("id", _r("bm25").alias("bm25"))
    return hits.orderBy(F.desc("bm25"), "id").limit(15)


_SAID = r"WITH d AS (SELECT id, ' ' || array_to_string(regexp_extract_all(strip_accents(lower(coalesce(description, ''))), '[\p{L}\p{N}]+'), ' ') || ' ' AS t FROM valuation) SELECT id FROM d WHERE "


@query(_SAID + "(t LIKE '% windmill %' OR t LIKE '% rain %') AND t NOT LIKE '% light %'")
def fts_or_not(t):
    return fulltext.bm25_search(t(V), "id", "description", "(windmill OR rain) NOT light").select("id")


@query(_SAID + "regexp_matches(t, ' in light ra')")
def fts_phrase_prefix(t):
    return fulltext.bm25_search(t(V), "id", "description", "in + light + ra*").select("id")


@query(_SAID + r"regexp_matches(t, ' windmill (\S+ ){0,3}near ') OR regexp_matches(t, ' near (\S+ ){0,3}windmill ')")
def fts_near(t):
    return fulltext.bm25_search(t(V), "id", "description", "NEAR(windmill near, 3)").select("id")


@query(_bm25_sql("rain", "near").replace("SELECT id, round(", "SELECT v.id, v.standard_name, v.valued_at FROM (SELECT id, (", 1).replace(", 6) AS bm25 FROM s", ") AS bm25 FROM s", 1) + ") h JOIN valuation v USING (id) ORDER BY round(h.bm25, 9) DESC, id LIMIT 20")
def search_text_branch(t):
    return search.run(t(V), "rain near").select("id", "standard_name", "valued_at")


@query(r"""WITH d AS (SELECT id, unnest(regexp_extract_all(strip_accents(lower(coalesce(description, ''))), '[\p{L}\p{N}]+')) AS token FROM valuation)
SELECT token, count(DISTINCT id) AS documents, count(*) AS occurrences FROM d GROUP BY token""")
def fts_vocabulary(t):
    return fulltext.postings(t(V), "id", "description").groupBy("token").agg(F.count(F.lit(1)).alias("documents"), F.sum("tf").alias("occurrences"))


@query("SELECT id, CASE WHEN NOT isnan(min_value) THEN min_value END AS min_value, CASE WHEN NOT isnan(max_value) THEN max_value END AS max_value, standard_name, image_format, valued_at, substr(description, 1, 120) AS description FROM valuation")
def tool_view(t):
    return search.tool_view(t(V))


@query("SELECT id, url, max_value FROM valuation WHERE id = 5")
def by_id(t):
    return tables.by_key(t(V), "id", 5, limit=1).select("id", "url", "max_value")


@query("SELECT id, image_hash, valued_at FROM valuation WHERE image_hash = (SELECT image_hash FROM valuation WHERE id = (SELECT min(id) FROM valuation)) ORDER BY valued_at DESC, id")
def by_hash(t):
    h = t(V).agg(F.min_by("image_hash", "id")).first()[0]
    return tables.by_key(t(V), "image_hash", h, [F.desc("valued_at"), "id"]).select("id", "image_hash", "valued_at")


@query("SELECT id, hash, status FROM image_import WHERE hash = (SELECT hash FROM image_import WHERE id = (SELECT min(id) FROM image_import)) ORDER BY id")
def import_by_hash(t):
    h = t(I).agg(F.min_by("hash", "id")).first()[0]
    return tables.by_key(t(I), "hash", h).select("id", "hash", "status")


@query("SELECT id, source_path, status FROM image_import WHERE source_path = (SELECT max(source_path) FROM image_import)")
def by_source_path(t):
    top = t(I).agg(F.max("source_path").alias("source_path"))
    return t(I).join(F.broadcast(top), "source_path").select("id", "source_path", "status")


# imports

@query("SELECT status, count(id) AS n FROM (SELECT unnest(['pending', 'processing', 'embedded', 'indexed', 'failed']) AS status) LEFT JOIN image_import USING (status) GROUP BY status")
def import_status_counts(t):
    return imports.status_counts(t(I))


@query("SELECT id, status FROM image_import WHERE status IN ('pending', 'processing', 'failed') ORDER BY id LIMIT 100")
def import_pending(t):
    return imports.pending(t(I)).select("id", "status")


_OUTCOME = """WITH c AS (SELECT id, CASE WHEN hash IN (SELECT hash FROM image_import WHERE hash IS NOT NULL) OR (hash IS NOT NULL AND row_number() OVER (PARTITION BY hash ORDER BY id) > 1) THEN 'duplicate'
  WHEN source_path IN (SELECT source_path FROM image_import WHERE status = 'indexed') THEN 'indexed' ELSE 'import' END AS outcome FROM import_batch) """


@query(_OUTCOME + "SELECT id, outcome FROM c")
def import_dedup(t):
    return imports.classified(t(B), t(I)).select("id", "outcome")


@query(_OUTCOME + "SELECT count(*) FILTER (outcome = 'import') AS import, count(*) FILTER (outcome = 'duplicate') AS duplicate, count(*) FILTER (outcome = 'indexed') AS indexed FROM c")
def batch_outcome_counts(t):
    return imports.outcome_counts(imports.classified(t(B), t(I)))


@query("""WITH n AS (SELECT id, source_path, hash, status, row_number() OVER (PARTITION BY source_path ORDER BY id) AS k FROM import_batch WHERE source_path NOT IN (SELECT source_path FROM image_import))
SELECT id, source_path, status FROM image_import UNION ALL SELECT id, source_path, status FROM n WHERE k = 1""")
def insert_or_ignore(t):
    return tables.insert_or_ignore(t(I).select("id", "source_path", "status"), t(B).select("id", "source_path", "status"), "source_path")


@query("SELECT id, 'default-photo' AS standard_name FROM image_import WHERE hash NOT IN (SELECT image_hash FROM valuation WHERE standard_name = 'default-photo')")
def skip_valued_anti(t):
    images = t(I).select("id", F.col("hash").alias("image_hash"), F.lit("default-photo").alias("standard_name"))
    return imports.not_valued(images, t(V)).select("id", "standard_name")


@query("SELECT id, source_path, CASE WHEN id % 5 = 0 AND id % 2 = 0 THEN 'failed' ELSE status END AS status, CASE WHEN id % 5 = 0 THEN 'patched' ELSE error END AS error FROM image_import")
def status_patch(t):
    patch = t(I).filter("id % 5 = 0").select("id", F.when(F.col("id") % 2 == 0, "failed").alias("status"), F.lit("patched").alias("error"))
    return tables.patched(t(I).select("id", "source_path", "status", "error"), patch)


@query("SELECT CASE WHEN url = 'file:///library/inbox/latest.jpg' THEN 'file:///library/inbox/old.jpg' ELSE url END AS url, count(*) AS n FROM valuation GROUP BY 1")
def url_update(t):
    return tables.replaced(t(V), "url", "file:///library/inbox/latest.jpg", "file:///library/inbox/old.jpg").groupBy("url").agg(F.count(F.lit(1)).alias("n"))


@query("WITH u AS (SELECT id, CASE WHEN id % 3 = 0 THEN visual_vec ELSE text_vec END AS v FROM vector_point) SELECT id, CAST(len(v) AS BIGINT) AS size, round(CAST(v[1] AS DOUBLE), 6) AS first, round(CAST(v[len(v)] AS DOUBLE), 6) AS last FROM u")
def vector_upsert(t):
    new = t(P).filter("id % 3 = 0").select("id", F.col("visual_vec").alias("text_vec"))
    v, size = F.col("text_vec"), F.when(F.col("text_vec").isNotNull(), F.size("text_vec"))
    at = lambda i, name: _r(F.try_element_at(v, i).cast("double")).alias(name)
    return tables.upsert(t(P).select("id", "text_vec"), new).select("id", size.cast("long").alias("size"), at(F.lit(1), "first"), at(F.nullif(size, F.lit(0)), "last"))


@query("SELECT time_bucket(INTERVAL 10 MINUTE, CAST(imported_at AS TIMESTAMP)) AS start, status, count(*) AS n FROM image_import WHERE TRY_CAST(imported_at AS TIMESTAMP) IS NOT NULL GROUP BY 1, 2")
def import_windows(t):
    return status_windows(t(I).filter(F.col("imported_at").try_cast("timestamp").isNotNull())).select("start", "status", "n")


# vectors and Bayesian search

_UNIT = "WITH p AS (SELECT id, CAST(text_vec AS DOUBLE[]) AS tv, CAST(visual_vec AS DOUBLE[]) AS vv FROM vector_point WHERE len(text_vec) = 128 AND len(visual_vec) = 128), q AS (SELECT tv AS qt, vv AS qv FROM p WHERE id = (SELECT min(id) FROM p)) "
_SIM = "CASE WHEN list_dot_product({a}, {a}) * list_dot_product({b}, {b}) > 0 THEN (list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) + 1) / 2 ELSE 0 END"


def _points(t) -> DataFrame:
    return t(P).filter("size(text_vec) = 128 and size(visual_vec) = 128").select("id", "text_vec", "visual_vec")


def _top(v: str) -> str:
    sim = _SIM.format(a="a.v", b="b.v")
    return f"""WITH p AS (SELECT id, CAST({v} AS DOUBLE[]) AS v FROM vector_point WHERE len({v}) = 128),
s AS (SELECT a.id AS query_id, b.id AS id, round({sim}, 12) AS score FROM p a, p b WHERE a.id % 100 = 0)
SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM s) WHERE k <= 20"""


def _asked(t, column: str) -> DataFrame:
    """The 20 most similar points of every point whose id is divisible by 100, by one of the two vectors alone."""
    queries = t(P).filter(f"id % 100 = 0 and size({column}) = 128").select(F.col("id").alias("query_id"), F.col(column).alias("vec"))
    return bayes.most_similar(t(P).filter(f"size({column}) = 128"), column, queries, 20).select("query_id", "id", _r("score").alias("score"))


@query(_top("text_vec"))
def vector_topk_text(t):
    return _asked(t, "text_vec")


@query(_top("visual_vec"))
def vector_topk_visual(t):
    return _asked(t, "visual_vec")


@query("SELECT id FROM vector_point WHERE id >= 100 ORDER BY id LIMIT 500")
def vector_scroll(t):
    return bayes.scroll(t(P), 500, 100)


# a beam of all points with both vectors, three questions (the text vectors of points of the beam) and their scores
_BEAM = (
    _UNIT
    + f""", b0 AS (SELECT *, row_number() OVER (ORDER BY id) AS o FROM p), beam AS (SELECT id, tv, vv, o, CAST(id % 7 + 1 AS DOUBLE) / sum(CAST(id % 7 + 1 AS DOUBLE)) OVER () AS prob FROM b0),
qs AS (SELECT CAST(o AS INTEGER) AS question_id, tv AS qvec FROM beam WHERE o <= 3),
sc AS (SELECT question_id, id, 0.5 * ({_SIM.format(a="qvec", b="tv")}) + 0.5 * ({_SIM.format(a="qvec", b="vv")}) AS score FROM beam, qs) """
)


def _beam(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(beam vectors, probabilities, questions)."""
    members = _points(t)
    weights = members.select("id", (F.col("id") % 7 + 1).cast("double").alias("prob"))
    spark = members.sparkSession
    q = spark.createDataFrame([(i + 1, [float(x) for x in r.text_vec]) for i, r in enumerate(members.orderBy("id").limit(3).collect())], "question_id int, vec array<double>")
    return members, bayes.normalised(weights), q


@query(_BEAM + "SELECT question_id, id, round(score, 6) AS score FROM sc")
def blended_score(t):
    members, _, q = _beam(t)
    return bayes.scores(members, q).select("question_id", "id", _r("score").alias("score"))


@query(_BEAM + "SELECT id, round(prob * exp(-8 * (0.5 - score) * (0.5 - score)), 9) AS prob FROM sc JOIN beam USING (id) WHERE question_id = 1")
def bayes_update(t):
    members, probs, q = _beam(t)
    return bayes.update(probs, bayes.scores(members, q).filter("question_id = 1"), 0.5).select("id", _r("prob", 9).alias("prob"))


@query(_BEAM + "SELECT id, round(prob, 9) AS prob FROM beam")
def bayes_normalise(t):
    return _beam(t)[1].select("id", _r("prob", 9).alias("prob"))


@query(_BEAM + "SELECT round(-sum(prob * ln(prob)), 6) AS entropy FROM beam")
def posterior_entropy(t):
    return bayes.entropy(_beam(t)[1]).select(_r("entropy").alias("entropy"))


@query(_BEAM + ", u AS (SELECT id, prob * exp(-8 * (0.5 - score) * (0.5 - score)) AS w, prob FROM sc JOIN beam USING (id) WHERE question_id = 1) SELECT id, round(0.8 * w / (SELECT sum(w) FROM u) + 0.2 * prob, 9) AS prob FROM u")
def temper_posterior(t):
    members, probs, q = _beam(t)
    after = bayes.normalised(bayes.update(probs, bayes.scores(members, q).filter("question_id = 1"), 0.5))
    return bayes.tempered(after, probs, 0.2).select("id", _r("prob", 9).alias("prob"))


_GAIN = (
    _BEAM
    + """, bins AS (SELECT unnest([0.05, 0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 0.95])::DOUBLE AS bin),
w AS (SELECT question_id, bin, prob * exp(-8 * (bin - score) * (bin - score)) AS w FROM sc JOIN beam USING (id), bins),
tt AS (SELECT question_id, bin, sum(w) AS t FROM w GROUP BY 1, 2),
hh AS (SELECT question_id, bin, t, -sum(w / t * ln(w / t)) AS h FROM w JOIN tt USING (question_id, bin) GROUP BY 1, 2, 3),
g AS (SELECT question_id, sum(t * h) / sum(t) AS expected_entropy, (SELECT -sum(prob * ln(prob)) FROM beam) - sum(t * h) / sum(t) AS info_gain FROM hh GROUP BY 1) """
)


@query(_GAIN + "SELECT question_id, round(expected_entropy, 6) AS expected_entropy, round(info_gain, 6) AS info_gain FROM g")
def expected_info_gain(t):
    members, probs, q = _beam(t)
    g = bayes.information_gain(probs, bayes.scores(members, q))
    return g.select("question_id", _r("expected_entropy").alias("expected_entropy"), _r("info_gain").alias("info_gain"))


@query(_GAIN + "SELECT question_id, round(info_gain, 6) AS info_gain FROM g ORDER BY g.info_gain DESC, question_id LIMIT 1")
def best_question(t):
    members, probs, q = _beam(t)
    return bayes.best_question(bayes.information_gain(probs, bayes.scores(members, q))).select("question_id", _r("info_gain").alias("info_gain"))


@query(_GAIN + f", near AS (SELECT a.question_id, max({_SIM.format(a='a.qvec', b='b.qvec')}) AS m FROM qs a, qs b WHERE b.question_id = 2 GROUP BY 1) SELECT question_id, round(CASE WHEN m > 0.7 THEN info_gain * 0.3 ELSE info_gain END, 6) AS info_gain FROM g JOIN near USING (question_id)")
def ig_penalty(t):
    members, probs, q = _beam(t)
    g = bayes.penalised(bayes.information_gain(probs, bayes.scores(members, q)), q, q.filter("question_id = 2"))
    return g.select("question_id", _r("info_gain").alias("info_gain"))


@query(_BEAM + f"SELECT round(avg(1 - ({_SIM.format(a='a.vv', b='b.vv')})), 6) AS diversity FROM beam a, beam b WHERE a.id < b.id")
def candidate_diversity(t):
    return bayes.diversity(_beam(t)[0], "visual_vec").select(_r("diversity").alias("diversity"))


@query(_BEAM + "SELECT id, round(prob, 9) AS prob FROM beam ORDER BY beam.prob DESC, id LIMIT 50")
def beam_prune(t):
    return bayes.pruned(_beam(t)[1], 50).select("id", _r("prob", 9).alias("prob"))


@query(_BEAM + "SELECT count(*) AS size, round(max(prob), 9) AS max_prob, NOT coalesce(bool_or(prob >= 0.01), false) AS collapsed FROM beam")
def beam_stats(t):
    return bayes.beam_stats(_beam(t)[1]).select("size", _r("max_prob", 9).alias("max_prob"), "collapsed")


@query(_GAIN + "SELECT question_id, bin, round(t / sum(t) OVER (PARTITION BY question_id), 6) AS prob FROM tt")
def answer_probabilities(t):
    members, probs, q = _beam(t)
    return bayes.bin_probabilities(probs, bayes.scores(members, q)).select("question_id", "bin", _r("prob").alias("prob"))


@query(_BEAM + ", k AS (SELECT id, beam.prob AS prob FROM beam ORDER BY beam.prob DESC, id LIMIT 50) SELECT CAST(row_number() OVER (ORDER BY k.prob DESC, id) AS INTEGER) AS ordinal, id, round(k.prob, 9) AS prob, coalesce(nullif(trim(i.text_description), ''), 'Image ' || id) AS description FROM k LEFT JOIN image_import i USING (id)")
def beam_descriptions(t):
    beam = bayes.pruned(_beam(t)[1], 50)
    return bayes.described(beam, t(I).select("id", F.col("text_description").alias("description"))).select("ordinal", "id", _r("prob", 9).alias("prob"), "description")


@query("""WITH s AS (SELECT id, CAST(id % 9 + 1 AS INTEGER) AS round, (id % 11) / 20.0::DOUBLE AS diversity, CASE WHEN id % 6 > 0 THEN (id % 6) / 40.0::DOUBLE END AS best_gain, (id % 13) / 12.0::DOUBLE AS max_prob FROM image_import)
SELECT id, CASE WHEN diversity < 0.1 AND round >= 2 THEN 'homogeneous' WHEN best_gain IS NULL OR (best_gain < 0.05 AND round >= 2) THEN 'low_ig' WHEN max_prob >= 0.9 THEN 'confidence'
WHEN round >= 8 AND max_prob < 0.5 THEN 'not_in_library' WHEN round >= 8 THEN 'max_rounds' END AS reason FROM s""")
def termination_reason(t):
    i = F.col("id")
    s = t(I).select("id", (i % 9 + 1).cast("int").alias("round"), (i % 11 / 20.0).alias("diversity"), F.when(i % 6 > 0, i % 6 / 40.0).alias("best_gain"), (i % 13 / 12.0).alias("max_prob"))
    return bayes.termination(s).select("id", "reason")


@query(_BEAM + f""", s1 AS (SELECT id, prob * exp(-8 * (0.9 - score) * (0.9 - score)) AS w FROM sc JOIN beam USING (id) WHERE question_id = 1), b1 AS (SELECT id, w / sum(w) OVER () AS prob FROM s1),
s2 AS (SELECT id, b1.prob * exp(-8 * (0.2 - score) * (0.2 - score)) AS w FROM sc JOIN b1 USING (id) WHERE question_id = 2), b2 AS (SELECT id, w / sum(w) OVER () AS prob FROM s2)
SELECT id, round(prob, 9) AS prob FROM b2 ORDER BY b2.prob DESC, id LIMIT 5""")
def search_session_replay(t):
    members, probs, q = _beam(t)
    scored = bayes.scores(members, q)
    for question, value in ((1, 0.9), (2, 0.2)):
        probs = bayes.normalised(bayes.update(probs, scored.filter(F.col("question_id") == question), value))
    return bayes.pruned(probs, 5).select("id", _r("prob", 9).alias("prob"))


# clusters

CENTRES = [[1024.0, 768.0], [3000.0, 2000.0], [4000.0, 5000.0]]
_KM = "WITH f AS (SELECT id, width, height FROM valuation), d AS (SELECT id, width, height, [(width - 1024.0)**2 + (height - 768.0)**2, (width - 3000.0)**2 + (height - 2000.0)**2, (width - 4000.0)**2 + (height - 5000.0)**2]::DOUBLE[] AS ds FROM f), a AS (SELECT *, CAST(list_position(ds, list_min(ds)) - 1 AS INTEGER) AS cluster FROM d) "


def _sizes(t) -> DataFrame:
    f = t(V).select("id", "width", "height", F.array(F.col("width").cast("double"), F.col("height").cast("double")).alias("f"))
    return kmeans.assigned(f, "f", CENTRES)


@query(_KM + "SELECT id, cluster, list_min(ds) AS d2 FROM a")
def kmeans_assign(t):
    return _sizes(t).select("id", "cluster", "d2")


@query(_KM + "SELECT cluster, count(*) AS n, [round(avg(width), 6), round(avg(height), 6)] AS centre FROM a GROUP BY cluster")
def kmeans_update(t):
    return kmeans.centroids(_sizes(t), "f").select("cluster", "n", F.transform("centre", lambda x: F.round(x, 6)).alias("centre"))


@query("WITH f AS (SELECT id, CASE WHEN width > 0 AND height > 0 THEN CAST(width AS DOUBLE) / height ELSE 0 END AS r FROM valuation), d AS (SELECT id, [(r - 0.7)**2, (r - 1.0)**2, (r - 1.5)**2]::DOUBLE[] AS ds FROM f) SELECT id, CAST(list_position(ds, list_min(ds)) - 1 AS INTEGER) AS cluster, round(list_min(ds), 9) AS d2 FROM d")
def kmeans_assign_aspect(t):
    f = kmeans.with_features(t(V).select("id", "width", "height"), "aspect-ratio")
    return kmeans.assigned(f, "f", [[0.7], [1.0], [1.5]]).select("id", "cluster", _r("d2", 9).alias("d2"))


@query()
def kmeans_fixpoint(t):
    f = t(V).select("id", F.array(F.col("width").cast("double"), F.col("height").cast("double")).alias("f"))
    return kmeans.kmeans(f, "id", "f", 3, start=CENTRES)[0].groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query(_KM + "SELECT cluster, CAST(CAST(floor(avg(width) + 0.5) AS BIGINT) AS VARCHAR) || 'x' || CAST(CAST(floor(avg(height) + 0.5) AS BIGINT) AS VARCHAR) AS name FROM a GROUP BY cluster")
def cluster_names_resolution(t):
    return kmeans.size_names(_sizes(t))


@query(_KM + "SELECT cluster, 'aspect_' || printf('%.2f', avg(width / CAST(height AS DOUBLE))) AS name FROM a WHERE height > 0 GROUP BY cluster")
def cluster_names_aspect(t):
    return kmeans.aspect_names(_sizes(t).filter("height > 0").withColumn("ratio", F.col("width") / F.col("height").cast("double")))


@query(_KM + "SELECT cluster, list(CAST(id AS VARCHAR) ORDER BY CAST(id AS VARCHAR)) AS names FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY CAST(id AS VARCHAR)) AS k FROM a) WHERE k <= 50 GROUP BY cluster")
def cluster_samples(t):
    return kmeans.samples(_sizes(t).withColumn("name", F.col("id").cast("string")), "name")


# rules, texts, numbers

@query("SELECT id, CASE WHEN width >= 4000 THEN 1.2 WHEN width <= 900 AND height <= 900 THEN 0.7 WHEN height >= 3000 THEN 1.1 ELSE 1.0 END::DOUBLE AS multiplier FROM valuation")
def size_correction(t):
    size = "struct<min_width:int,max_width:int,min_height:int,max_height:int,multiplier:double>"
    rule = lambda *b: F.struct(*[F.lit(x) for x in b]).cast(size)
    table = F.array(rule(4000, None, None, None, 1.2), rule(None, None, None, None, 9.0), rule(None, 900, None, 900, 0.7), rule(None, None, 3000, None, 1.1))
    return t(V).select("id", rules.size_multiplier(table, F.col("width"), F.col("height")).alias("multiplier"))


@query()
def parse_valuation_json(t):
    return t(V).select("id", jsonx.parsed_valuation(F.col("raw_llm_text")).alias("v")).select("id", "v.*")


@query()
def parse_questions_json(t):
    return t(V).filter("raw_llm_text is not null").select("id", jsonx.parsed_questions(F.col("raw_llm_text"), F.lit(None).cast("string")).alias("q")).select("id", F.size("q.questions").alias("n"), "q.error")


@query("SELECT id, url_decode(substr(url, 8)) AS path FROM valuation WHERE url LIKE 'file://%'")
def url_decode_path(t):
    return t(V).filter(F.col("url").startswith("file://")).select("id", text.file_path(F.col("url")).alias("path"))


@query(r"""SELECT id, regexp_replace(regexp_replace(trim(regexp_replace(description, '[<>:"/\\|?*\x00-\x1f]', '', 'g')), '\s+', '_', 'g'), '[. ]+$', '') AS name FROM valuation""")
def sanitize_names(t):
    return t(V).select("id", text.sanitize_name(F.col("description")).alias("name"))


@query("SELECT id, CASE WHEN width > 0 AND height > 0 THEN 'aspect_' || printf('%.2f', CAST(width AS DOUBLE) / height) ELSE '' END AS label FROM valuation")
def aspect_labels(t):
    return t(V).select("id", numbers.aspect_label(F.col("width"), F.col("height")).alias("label"))


@query(r"WITH n AS (SELECT id, TRY_CAST(regexp_extract(standard_version, '^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)', 1) AS DOUBLE) AS v FROM valuation) SELECT id, v AS number, CASE WHEN v BETWEEN 0 AND 1 THEN v END AS answer FROM n")
def parse_float_answers(t):
    c = F.col("standard_version")
    return t(V).select("id", numbers.parse_float(c).alias("number"), numbers.answer(c).alias("answer"))


@query("SELECT id, floor(min_value * 100 + 0.5) / 100 AS low, CASE WHEN NOT isnan(max_value) THEN floor(max_value * 100 + 0.5) / 100 END AS high FROM valuation")
def rounded_values(t):
    return t(V).select("id", numbers.round_half_up(F.col("min_value")).alias("low"), numbers.round_half_up(F.col("max_value")).alias("high"))


@query("SELECT id, round(undecodable_pixels / CAST(greatest(1, CAST(width AS BIGINT) * height) AS DOUBLE) * 100, 6) AS damage, round(least(1.0::DOUBLE, 2048.0::DOUBLE / greatest(width, height)), 6) AS scale FROM valuation")
def damage_and_scale(t):
    return t(V).select("id", _r(numbers.damage_percent(F.col("undecodable_pixels"), F.col("width"), F.col("height"))).alias("damage"), _r(numbers.fit_scale(F.col("width"), F.col("height"), 2048)).alias("scale"))


@query(r"""SELECT id, CASE WHEN lower(image_format) IN ('png', 'webp') THEN lower(image_format) ELSE 'jpeg' END AS kind, '#' || left(image_hash, 8) AS version, split_part(description, chr(10), 1) AS first_line, split_part(url, '=', 1) AS tag,
array_to_string(list_filter(list_transform(string_split(description, ','), lambda x: lower(trim(x))), lambda x: x <> ''), '|') AS parts, array_to_string(regexp_extract_all(description, '(?s).{1,44}'), '|') AS wrapped,
'data:image/jpeg;base64,' || to_base64(encode(description)) AS uri, CASE WHEN length(regexp_replace(regexp_replace(description, '\.[a-zA-Z0-9]{1,6}$', ''), '\s+', '_', 'g')) <= 35 THEN regexp_replace(regexp_replace(description, '\.[a-zA-Z0-9]{1,6}$', ''), '\s+', '_', 'g') END AS name FROM valuation""")
def text_parts(t):
    d = F.col("description")
    return t(V).select(
        "id",
        text.normal_format(F.col("image_format")).alias("kind"),
        text.short_version(F.col("image_hash")).alias("version"),
        text.first_line(d).alias("first_line"),
        text.tag_of_line(F.col("url")).alias("tag"),
        F.array_join(text.parse_list(d), "|").alias("parts"),
        F.array_join(text.wrap(d), "|").alias("wrapped"),
        text.data_uri(d.cast("binary")).alias("uri"),
        text.clean_model_name(d).alias("name"),
    )


@query("SELECT id, 'file://' || array_to_string(list_transform(string_split(replace(source_path, chr(92), '/'), '/'), lambda x: url_encode(x)), '/') AS url FROM image_import")
def file_urls(t):
    return t(I).select("id", text.file_url(F.col("source_path")).alias("url"))


@query("SELECT p.id, CAST(len(text_vec) AS BIGINT) AS size FROM vector_point p WHERE p.id IN (SELECT id FROM image_import WHERE status = 'indexed')")
def vectors_by_ids(t):
    return tables.vectors_of(t(P), t(I).filter("status = 'indexed'")).select("id", F.when(F.col("text_vec").isNotNull(), F.size("text_vec")).cast("long").alias("size"))


@query("SELECT id, sha256(description) AS digest, CASE WHEN NOT isnan(max_value) THEN '¥' || printf('%.2f', max_value) END AS price, printf('%.1f', floor(size_bytes / 1024.0::DOUBLE * 10 + 0.5) / 10) || ' KB' AS size, format('{:,}', size_bytes) AS bytes FROM valuation")
def text_formats(t):
    money = numbers.fixed(F.col("max_value"), 2, "¥")
    return t(V).select("id", text.sha256_hex(F.col("description")).alias("digest"), money.alias("price"), numbers.kilobytes(F.col("size_bytes")).alias("size"), numbers.grouped(F.col("size_bytes")).alias("bytes"))


@query("SELECT id, strftime(CAST(imported_at AS TIMESTAMP), '%Y%m%d%H%M%S') AS stamp, strftime(CAST(imported_at AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') || '.000Z' AS iso FROM image_import WHERE TRY_CAST(imported_at AS TIMESTAMP) IS NOT NULL")
def time_stamps(t):
    at = F.date_trunc("second", F.col("imported_at").try_cast("timestamp"))
    return t(I).filter(at.isNotNull()).select("id", text.stamp(at).alias("stamp"), text.iso_time(at).alias("iso"))


@query("SELECT id AS \"id\", image_hash AS \"imageHash\", url, image_format AS \"imageFormat\", width, height, channels, size_bytes AS \"sizeBytes\", undecodable_pixels AS \"undecodablePixels\", CASE WHEN NOT isnan(min_value) THEN min_value END AS \"minValue\", CASE WHEN NOT isnan(max_value) THEN max_value END AS \"maxValue\", currency, standard_name AS \"standardName\", standard_version AS \"standardVersion\", llm_model AS \"llmModel\", description, array_to_string(notes, '|') AS notes, tool_used AS \"toolUsed\", tool_fallback AS \"toolFallback\", input_tokens AS \"inputTokens\", output_tokens AS \"outputTokens\", valued_at AS \"valuedAt\" FROM valuation")
def record_view(t):
    return search.record_view(t(V)).withColumn("notes", F.array_join("notes", "|"))


@query(r"SELECT id, regexp_extract(source_path, '([^/\\]*)$', 1) AS name, lower(regexp_extract(source_path, '[^./\\]\.([^./\\]+)$', 1)) AS ending FROM image_import")
def file_names(t):
    return t(I).select("id", text.basename(F.col("source_path")).alias("name"), text.extension(F.col("source_path")).alias("ending"))


@query("""WITH u AS (SELECT standard_name AS name, 'builtin' AS source, description, '/b/' || standard_name AS file_path FROM standard_ref
UNION ALL SELECT standard_name, 'filesystem', upper(description), '/f/' || standard_name FROM standard_ref WHERE value_limit > 900000),
k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN source = 'filesystem' THEN 0 ELSE 1 END, file_path) AS k FROM u) SELECT source, name, description, file_path FROM k WHERE k = 1""")
def standards_override(t):
    row = lambda source, said, root: [F.col("standard_name").alias("name"), F.lit(source).alias("source"), said.alias("description"), F.concat(F.lit(root), "standard_name").alias("file_path")]
    both = t(S).select(*row("builtin", F.col("description"), "/b/")).unionByName(t(S).filter("value_limit > 900000").select(*row("filesystem", F.upper("description"), "/f/")))
    return standards.listing(standards.overridden(both))


@query("SELECT standard_name, string_agg(description, chr(10) ORDER BY standard_name) OVER (ORDER BY standard_name ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) || '=' AS prompt FROM standard_ref")
def sliding_context(t):
    from ..providers import sliding_context as context

    return context(t(S).select("standard_name", "description"), "standard_name", "description", 3).select("standard_name", "prompt")
