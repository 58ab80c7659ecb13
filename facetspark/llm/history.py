"""New batches against all accepted history, by a table of distances to fixed pivots.

A stored file name is split into its numbers, which must agree, and its letters, compared by edit distance: the
metric of a path is the Levenshtein distance of the letters where the numbers agree, and infinite elsewhere. The
pivot table holds for each accepted row its hash, numbers, letters and the letters' distances to a few pivots
fixed when the table was made. A new row within distance r of a stored one differs by at most r from it in every
pivot distance, so bands of the first pivots' distances (beside the numbers) are join keys, the other pivots
prune, and only what is left is measured. The table is stored with ``create`` and taken up with ``load`` by later
sessions; ``append`` adds the rows a batch had accepted, with their distances. History is never measured again: a
batch reads the stored columns, in the parts of the table that its first bands name.

Texts equal after normalising form one class and are joined as one, so copies are never paired with each other.
Rows are taken in the order (batch, id) and a repeat is not accepted, so later rows are judged against accepted
rows only; this is settled in rounds over class minima, each of which decides every row without an undecided
earlier relative.

Defined cases: a null, all-zero or empty-content hash says nothing; a null or blank path says nothing; a row that
has neither is accepted; repeated rows are repeats of the first; an empty history or batch works; very long paths
are compared whole; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hex64, read, small

#: SHA-256 of no bytes; words that file managers add to a copy's name; endings that mean the same.
EMPTY_CONTENT = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
COPY_WORDS = "copy|copia|copie|kopie|kopia|copia de|duplicate|副本|拷贝"
SAME_ENDINGS = {"jpeg": "jpg", "jpe": "jpg", "tiff": "tif"}

N_PIVOTS, KEY_PIVOTS, BAND, REACH = 4, 3, 5, 2
PIVOT_SAMPLE = 500

_ACCENTED = [c for c in map(chr, range(0xC0, 0x250)) if unicodedata.normalize("NFD", c)[0] != c]
_PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)


def image_key(c: Column) -> Column:
    """The hash's digits, or null where they say nothing."""
    h = hex64(c)
    return F.when((h != "0" * 64) & (h != EMPTY_CONTENT), h)


def _resolved(path: Column) -> Column:
    """An absolute path without . and .. and empty steps, however deep."""
    step = lambda a, x: F.when(x.isin("", "."), a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    walked = F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))
    return F.when(path.rlike(r"/\.{0,2}/"), walked).otherwise(path)


def with_path_parts(df: DataFrame, path: str, root: str | None = None) -> DataFrame:
    """``df`` with numbers and letters of a path, however escaped, cased or marked as a copy; given ``root``, from the folder of that name on, wherever it is mounted."""
    c = F.col(path)
    s = F.when(c.contains("%"), F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)).otherwise(c)
    s = F.translate(F.lower(s), "".join(_ACCENTED), _PLAIN)
    s = F.regexp_replace(s, r"\p{M}|^\s+|\s+$", "")
    s = F.replace(s, F.lit("\\"), F.lit("/"))
    s = F.concat(F.lit("/"), F.regexp_replace(s, r"^(?:[a-z]+://[^/]*|[a-z]:)", ""))
    df = df.withColumn("__s", s)
    s = _resolved(F.col("__s"))
    if root:
        s = F.regexp_replace(s, rf"^.*?/{root}/", f"/{root}/")
    ending = F.regexp_extract("__s", r"\.([a-z0-9]{1,5})$", 1)
    for a, b in SAME_ENDINGS.items():
        ending = F.regexp_replace(ending, f"^{a}$", b)
    stem = F.regexp_replace("__s", r"\.[a-z0-9]{1,5}$", "")
    stem = F.regexp_replace(stem, rf"(?<=[^/ _-])(?:[ _-]*\(?(?:{COPY_WORDS})[ _-]*\d*\)?|\s*\(\d+\))+\s*$", "")
    stem = F.regexp_replace(stem, rf"/(?:{COPY_WORDS})(?: \(?\d+\)?)? (?:of|de|von) ([^/]*)$", "/$1")
    numbers = F.array_join(F.transform(F.regexp_extract_all("__stem", F.lit(r"(\d+)"), 1), lambda d: F.regexp_replace(d, r"^0+(?=\d)", "")), "|")
    letters = F.concat(F.regexp_replace(F.regexp_replace("__stem", r"\d+", "#"), r"[^\p{L}#/]+", ""), F.lit("."), "__ending")
    # one step a projection: an expression used twice is then computed once
    out = df.withColumn("__s", s).withColumns({"__ending": ending, "__stem": stem}).withColumns({"__numbers": numbers, "__letters": letters})
    said = F.regexp_replace("__letters", r"[/.]", "") != ""
    return out.withColumns({"numbers": F.when(said, F.col("__numbers")), "letters": F.when(said, F.col("__letters"))}).drop("__s", "__ending", "__stem", "__numbers", "__letters")


@dataclass
class PivotTable:
    """Accepted rows: batch, id, hash, numbers, letters and the distances to the pivots; ``fresh``: those not yet stored."""

    rows: DataFrame
    pivots: list[str]
    root: str | None = None
    fresh: DataFrame | None = None

    @classmethod
    def build(cls, history: DataFrame, row_id: str, hash_col: str, path_col: str, root: str | None = None) -> PivotTable:
        """Pivots are chosen far apart among at most PIVOT_SAMPLE letter classes (those of least hash)."""
        rows = cut(_keys(history, F.lit(-1), row_id, hash_col, path_col, root))
        sample = [r.letters for r in rows.select("letters").filter("letters is not null").distinct().orderBy(F.xxhash64("letters"), "letters").limit(PIVOT_SAMPLE).collect()]
        pivots = _far_apart(sample) or [""]
        rows = cut(_measured(rows, pivots))
        return cls(rows, pivots, root, rows)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> PivotTable:
        """The stored table. Its distances are read, not measured."""
        about = spark.read.schema("pivots array<string>, root string").parquet(f"{folder}/about").first()
        rows = spark.read.schema(_STORED).parquet(f"{folder}/rows").drop("band")
        return cls(rows, list(about.pivots), about.root)

    def create(self, folder: str) -> PivotTable:
        """Store the whole table, in parts of the first pivot's band; an existing one is an error."""
        spark = self.rows.sparkSession
        _banded(self.rows).write.partitionBy("band").parquet(f"{folder}/rows")
        spark.createDataFrame([(self.pivots, self.root)], "pivots array<string>, root string").write.parquet(f"{folder}/about")
        return PivotTable.load(spark, folder)

    def append(self, folder: str) -> PivotTable:
        """Add the rows that batches brought since the table was loaded to the stored one; nothing else is written."""
        if self.fresh is not None:
            _banded(self.fresh).write.mode("append").partitionBy("band").parquet(f"{folder}/rows")
        return PivotTable.load(self.rows.sparkSession, folder)

    def keys_of(self, batch: DataFrame, batch_no: str, row_id: str, hash_col: str, path_col: str) -> DataFrame:
        return _measured(_keys(batch, F.col(batch_no), row_id, hash_col, path_col, self.root), self.pivots)

    def absorb(self, new: DataFrame) -> tuple[DataFrame, PivotTable]:
        """(repeats with their accepted row, the table with the accepted rows appended). new: from keys_of."""
        new = cut(new)
        cases = self._repeats(new)
        fresh = new.join(cases.select("id"), "id", "left_anti")
        return cases, PivotTable(self.rows.unionByName(fresh), self.pivots, self.root, fresh if self.fresh is None else self.fresh.unionByName(fresh))

    def _repeats(self, new: DataFrame) -> DataFrame:
        near = self._near(new)
        path = F.concat(F.lit("p"), "numbers", F.lit("\t"), "letters")
        image = F.concat(F.lit("h"), "image")
        own = F.filter(F.array(image, path), lambda k: k.isNotNull())

        def contributed(rows: DataFrame) -> DataFrame:
            return rows.select("batch", "id", F.explode(own).alias("key"))

        def earliest(rows: DataFrame, name: str) -> DataFrame:
            return rows.groupBy("key").agg(F.min(F.struct("batch", "id")).alias(name))

        sees = contributed(new)
        through = new.select("batch", "id", path.alias("__p")).join(near, F.col("__p") == F.col("near_from")).select("batch", "id", F.col("near_to").alias("key"))
        sees = cut(sees.unionByName(through))
        gives = contributed(new)

        def matched(sees: DataFrame, accepted: DataFrame) -> DataFrame:
            hits = sees.join(earliest(accepted, "a"), "key").filter(F.struct("a.batch", "a.id") < F.struct("batch", "id"))
            # of several accepted rows the one with the same image is named, else the smallest id
            return hits.groupBy("id").agg(F.min(F.struct((~F.col("key").startswith("h")).alias("by"), F.col("a.id").alias("a"))).alias("m")).select(F.col("m.a").alias("accepted_id"), "id")

        touched = contributed(self.rows.select("batch", "id", "image", "numbers", "letters")).join(small(cut(sees.select("key").distinct())), "key", "left_semi")
        cases = cut(matched(sees, touched))
        open_rows = cut(new.select("batch", "id").join(cases.select("id"), "id", "left_anti"))
        while not open_rows.isEmpty():
            keep = lambda rows: rows.join(open_rows.select("id"), "id", "left_semi")  # noqa: B023, E731
            sees, gives = cut(keep(sees)), cut(keep(gives))
            first = sees.join(earliest(gives, "u"), "key").groupBy("batch", "id").agg(F.min("u").alias("u"))
            lead = open_rows.join(first, ["batch", "id"], "left").filter("u is null or struct(u.batch, u.id) >= struct(batch, id)").select("batch", "id")
            lead = cut(lead)
            more = cut(matched(sees, gives.join(lead.select("id"), "id", "left_semi")))
            cases = cases.unionByName(more)
            open_rows = cut(open_rows.join(lead.select("id"), "id", "left_anti").join(more.select("id"), "id", "left_anti"))
        return cases

    def _near(self, new: DataFrame) -> DataFrame:
        """(near_from, near_to): path classes of new rows and other classes one slip away."""
        cols = ["numbers", "letters", *[f"d{i}" for i in range(N_PIVOTS)]]
        mine = cut(new.select(*cols).filter("letters is not null").distinct())
        bands = [f"b{i}" for i in range(KEY_PIVOTS)]
        probe = mine.select(*[F.col(c).alias(f"n_{c}") for c in cols])
        for i, b in enumerate(bands):
            probe = probe.withColumn(b, F.explode(F.sequence(F.floor((F.col(f"n_d{i}") - REACH) / BAND), F.floor((F.col(f"n_d{i}") + REACH) / BAND))))
        probe = small(cut(probe.withColumnRenamed("n_numbers", "numbers")))
        # history is read where it lies: one row for each stored row, copies are met and dropped after the join
        theirs = self.rows.select(*cols).filter("letters is not null").unionByName(mine)
        theirs = theirs.withColumns({b: F.floor(F.col(f"d{i}") / BAND) for i, b in enumerate(bands)})
        pairs = theirs.join(probe, ["numbers", *bands])
        pairs = pairs.filter(reduce(lambda a, b: a & b, [F.abs(F.col(f"d{i}") - F.col(f"n_d{i}")) <= REACH for i in range(N_PIVOTS)]))
        pairs = pairs.filter(F.col("letters") != F.col("n_letters")).filter(one_slip(F.col("letters"), F.col("n_letters")))
        return pairs.select(F.concat(F.lit("p"), "numbers", F.lit("\t"), "n_letters").alias("near_from"), F.concat(F.lit("p"), "numbers", F.lit("\t"), "letters").alias("near_to")).distinct()


def one_slip(a: Column, b: Column) -> Column:
    """One letter more, less, other, or two neighbours changed over."""
    d = F.levenshtein(a, b)
    swapped = lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b
    return (d <= 1) | ((d == 2) & (F.length(a) == F.length(b)) & F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), swapped))


_STORED = "batch int, id long, image string, numbers string, letters string, " + "".join(f"d{i} int, " for i in range(N_PIVOTS)) + "band int"


def _banded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("band", F.floor(F.col("d0") / BAND).cast("int"))


def _keys(df: DataFrame, batch: Column, row_id: str, hash_col: str, path_col: str, root: str | None) -> DataFrame:
    rows = df.select(batch.cast("int").alias("batch"), F.col(row_id).cast("long").alias("id"), image_key(F.col(hash_col)).alias("image"), F.col(path_col).alias("__path"))
    return with_path_parts(rows, "__path", root).drop("__path")


def _measured(rows: DataFrame, pivots: list[str]) -> DataFrame:
    pivots = [pivots[i % len(pivots)] for i in range(N_PIVOTS)]
    return rows.select("*", *[F.levenshtein(F.col("letters"), F.lit(p)).alias(f"d{i}") for i, p in enumerate(pivots)])


def _far_apart(sample: list[str]) -> list[str]:
    """Farthest-first choice of N_PIVOTS of the sample."""
    if not sample:
        return []
    chosen = [sample[0]]
    far = [_levenshtein(sample[0], s) for s in sample]
    while len(chosen) < min(N_PIVOTS, len(sample)):
        chosen.append(sample[far.index(max(far))])
        far = [min(d, _levenshtein(chosen[-1], s)) for d, s in zip(far, sample)]
    return chosen


def _levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(accepted_id, id): arrivals whose image or file was accepted before."""
    history = read(spark, sf_dir, "image_import").filter("status is null or status <> 'failed'")
    table = PivotTable.build(history, "id", "hash", "source_path", root="library")  # these paths' own top folder
    new = table.keys_of(read(spark, sf_dir, "import_batch"), "batch_no", "id", "hash", "source_path")
    return table.absorb(new)[0]


SQL: dict[str, str] = {}
QUERIES = {"p2_found": p2_found}
