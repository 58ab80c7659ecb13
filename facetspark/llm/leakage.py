"""Evaluation passages inside training texts, by a distributed positional inverted index.

The index is sharded by document: a block holds, for some documents, the sorted posting list (word positions) of every
term in them, whatever will be asked of it. It is built once, can be written as a table, and answers for any test set
without reading a document again. A query passage of n words becomes its windows of n words. In every block the lists
of a window's terms, moved by the term's offset, are intersected from the globally rarest term on, all windows at
once: what is left of the rarer terms' positions is looked up in the next list. Almost all windows end at the first or
second list.

A word is a longest run of letters and digits in lower case. Defined cases: a null or empty text has no words; an
item of fewer than n words can't be held; repeated rows and documents under other ids are reported each; very long
texts are indexed whole; an empty table on either side gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read

WORD = re.compile(r"[^\W_]+")
_BLOCK = "docs array<long>, bases array<long>, terms binary, counts binary, post binary, n_terms long, n_post long, n_chars long"
#: Characters of text after which a block is closed, and test items searched in one pass over the index.
BLOCK_CHARS, ITEMS_A_PASS = 8_000_000, 50_000
#: Positions left free between documents of a block (a window and its slack are shorter), and candidates tried at once.
GAP, TRIED = 1024, 4_000_000


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Items:
    """The windows of a set of test items, as rows of term numbers; the vocabulary numbers the set's words."""

    def __init__(self, rows: list[tuple[int, str | None]], n: int):
        self.n, self.vocabulary = n, {}
        self.ids, wins, owner, at = [], [], [], []
        for item, text in rows:
            t = np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)), np.int32)
            if len(t) >= n:
                w = np.lib.stride_tricks.sliding_window_view(t, n)
                wins.append(w)
                owner.append(np.full(len(w), len(self.ids)))
                at.append(np.arange(len(w)))
                self.ids.append(item)
        self.windows = np.concatenate(wins) if wins else np.empty((0, n), np.int32)
        self.owner = np.concatenate(owner) if owner else np.empty(0, np.int64)
        self.at = np.concatenate(at) if at else np.empty(0, np.int64)


def build_index(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Blocks of the index: documents with the number of their first word, terms, and the positions of each term in order.

    It may be written as a table and read back; ``find_leaks`` asks it.
    """

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[int] = []
        bases: list[int] = []
        parts: list[np.ndarray] = []
        number: dict[str, int] = {}
        chars = at = 0

        def close() -> pd.DataFrame:
            term = np.concatenate(parts)
            pos = np.concatenate([np.arange(b, b + len(p)) for b, p in zip(bases, parts)])
            order = np.argsort(term, kind="stable")
            post = np.diff(pos[order], prepend=0).astype(np.int32)
            counts = np.bincount(term, minlength=len(number)).astype(np.int32)
            terms = "\n".join(number).encode()
            row = [ids, bases, _packed(terms), _packed(counts), _packed(post), len(number), len(post), len(terms)]
            return pd.DataFrame([row], columns=[c.split()[0] for c in _BLOCK.split(", ")])

        for pdf in batches:
            for i, t in zip(pdf["__id"], pdf["__text"]):
                w = words(t)
                if not w:
                    continue
                ids.append(int(i))
                bases.append(at)
                parts.append(np.fromiter((number.setdefault(x, len(number)) for x in w), np.int32, len(w)))
                at += len(w) + GAP
                chars += len(t)
                if chars >= BLOCK_CHARS:
                    yield close()
                    ids, bases, parts, number, chars, at = [], [], [], {}, 0, 0
        if parts:
            yield close()

    return docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text")).mapInPandas(blocks, _BLOCK)


def _packed(data) -> bytes:
    return pa.compress(np.ascontiguousarray(data).tobytes() if isinstance(data, np.ndarray) else data, "zstd", asbytes=True)


def _numbers(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.int32) if n else np.empty(0, np.int32)


def _terms(data: bytes, n_chars: int) -> list[str]:
    return pa.decompress(data, n_chars, "zstd", asbytes=True).decode().split("\n")


def term_counts(index: DataFrame, vocabulary: dict[str, int]) -> np.ndarray:
    """Postings of each term in the whole corpus. Its size is that of the test set's vocabulary."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(vocabulary), np.int64)
        for pdf in batches:
            for terms, n_chars, counts, n in zip(pdf["terms"], pdf["n_chars"], pdf["counts"], pdf["n_terms"]):
                asked = np.fromiter((vocabulary.get(t, -1) for t in _terms(terms, n_chars)), np.int64, n)
                total[asked[asked >= 0]] += _numbers(counts, n)[asked >= 0]
        at = np.flatnonzero(total)
        yield pd.DataFrame({"term": at, "n": total[at]})

    out = np.zeros(len(vocabulary), np.int64)
    for r in index.select("terms", "n_chars", "counts", "n_terms").mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    return out


def _intersected(windows: np.ndarray, offsets: np.ndarray, starts: np.ndarray, post: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, position of its first word) of every place where the windows' lists meet.

    windows: rows of the block's term numbers, rarest first; offsets: their places in the window.
    """
    width = int(post.max()) + 1 + GAP
    keys = np.repeat(np.arange(len(starts) - 1, dtype=np.int64), np.diff(starts)) * width + post  # ordered: by term, then position
    many = (starts[1:] - starts[:-1])[windows[:, 0]]
    out_w, out_p = [], []
    done = np.cumsum(many)
    a = 0
    while a < len(windows):
        b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + TRIED, side="right")))
        w = np.repeat(np.arange(a, b), many[a:b])
        at = np.arange(len(w)) - np.repeat(np.cumsum(many[a:b]) - many[a:b], many[a:b]) + starts[windows[w, 0]]
        p = post[at] - offsets[w, 0]
        w, p = w[p >= 0], p[p >= 0]
        for k in range(1, windows.shape[1]):
            want = windows[w, k].astype(np.int64) * width + p + offsets[w, k]
            # positions below a list's first and above its last lie in other lists' ranges, never nearer than GAP
            i = np.minimum(np.searchsorted(keys, want - slack), len(keys) - 1)
            good = (keys[i] >= want - slack) & (keys[i] <= want + slack)
            w, p = w[good], p[good]
            if not len(w):
                break
        out_w.append(w)
        out_p.append(p)
        a = b
    return np.concatenate(out_w), np.concatenate(out_p)


def search(index: DataFrame, items: Items, slack: int = 0) -> DataFrame:
    """(doc_id, item_id, run_words, doc_word, item_word): the longest matching passage of every document and item.

    slack 0: the words of a window stand in the document as in the item. slack s: each stands within s words of its
    place relative to the window's rarest word; run_words is then the length covered by consecutive windows.
    """
    n, vocabulary = items.n, items.vocabulary
    if n + 2 * slack >= GAP:
        raise ValueError(f"a window and its slack must be shorter than {GAP} words")
    freq = term_counts(index, vocabulary)
    offsets = np.argsort(freq[items.windows], axis=1, kind="stable") if len(items.windows) else items.windows
    ordered = np.take_along_axis(items.windows, offsets, axis=1) if len(items.windows) else items.windows
    owner, at, ids = items.owner, items.at, np.asarray(items.ids, np.int64)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                slot = np.full(len(vocabulary), -1, np.int64)
                for i, t in enumerate(_terms(row.terms, row.n_chars)):
                    if (v := vocabulary.get(t)) is not None:
                        slot[v] = i
                here = np.flatnonzero((slot[ordered] >= 0).all(axis=1))
                if not len(here):
                    continue
                starts = np.append(0, np.cumsum(_numbers(row.counts, row.n_terms), dtype=np.int64))
                post = np.cumsum(_numbers(row.post, row.n_post), dtype=np.int64)
                w, p = _intersected(slot[ordered[here]], offsets[here], starts, post, slack)
                if not len(w):
                    continue
                w, bases = here[w], np.asarray(row.bases, np.int64)
                d = np.searchsorted(bases, p, side="right") - 1
                h = pd.DataFrame({"d": d, "i": owner[w], "j": at[w], "p": p - bases[d]})
                h["diag"] = h["p"] - h["j"]
                h = h.sort_values(["d", "i", "diag", "j"], kind="stable")
                new = (h[["d", "i", "diag"]].diff() != 0).any(axis=1) | (h["j"].diff() != 1)
                runs = h.assign(run=new.cumsum()).groupby("run").agg(d=("d", "first"), i=("i", "first"), p=("p", "first"), j=("j", "first"), m=("j", "size"))
                best = runs.sort_values(["m", "p", "j"], ascending=[False, True, True], kind="stable").drop_duplicates(["d", "i"])
                yield pd.DataFrame({"doc_id": np.asarray(row.docs)[best["d"]], "item_id": ids[best["i"]], "run_words": best["m"] + n - 1, "doc_word": best["p"], "item_word": best["j"]})

    return index.mapInPandas(find, "doc_id long, item_id long, run_words long, doc_word long, item_word long")


def find_leaks(index: DataFrame, items: DataFrame, item_id: str, item_text: str, n: int = 12, slack: int = 0) -> DataFrame:
    """Documents of an index that hold n or more consecutive words of an item, each with the items and the longest passage.

    The test set is the stated query set: it is brought to the driver in passes of ITEMS_A_PASS items.
    """
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    passes = max(1, -(-rows.count() // ITEMS_A_PASS))
    out = None
    for k in range(passes):
        part = rows if passes == 1 else rows.filter(F.pmod(F.xxhash64("i"), F.lit(passes)) == k)
        found = search(index, Items([(r.i, r.t) for r in part.collect()], n), slack)
        out = found if out is None else out.unionByName(found)
    return out


def leaked(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, n: int = 12, slack: int = 0) -> DataFrame:
    """``find_leaks`` of an index built for this one call."""
    return find_leaks(cut(build_index(docs, doc_id, text)), items, item_id, item_text, n, slack)


def _leaks(spark: SparkSession, sf_dir: str, slack: int) -> DataFrame:
    return leaked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_item"), "doc_id", "text", "item_id", "item_text", slack=slack)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id): the document holds at least 12 consecutive words of the item."""
    return _leaks(spark, sf_dir, 0).select("doc_id", "item_id").distinct()


def p8_near_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proximity matches: every word of a 12-word window within two words of its place."""
    return _leaks(spark, sf_dir, 2)


SQL = {
    "p8_found": """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(item_text), '[\\p{L}\\p{N}]+') AS w FROM eval_item),
dw AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)"""
}
QUERIES = {"p8_found": p8_found, "p8_near_passages": p8_near_passages}
