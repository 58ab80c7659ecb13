"""Personal information in free text, found by a linear-chain conditional random field and masked.

Every line of every text is cut into tokens, which the field labels B or I of a kind, or O, from features of the token
and its neighbours: the word, its shape and ending, whether a public vocabulary holds it in lower case or only as a
name, the gap before it, and the shape of the unbroken run it stands in. It is trained in numpy from a small labelled
table and decoded by Viterbi in batches. Digits count by their number only, so lines that differ in digits alone are
decoded once a batch. Lines near one with an address are decoded again together with it, since addresses run over
lines. A mention's ends are the field's; a check that follows only drops what can't be one (a phone number of five
digits, a name of one part) and marks at its edges.

Defined cases: a null or empty text has no mention and stays as it is; positions count characters; repeated rows
are searched each; very long texts and lines are searched whole; an empty table gives no rows; ``mask`` keeps all
other columns, whatever their names.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .packing import TOKENIZER
from .pii_labels import KINDS, labelled_rows

LABELS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]
N_LABELS, BITS, ROWS = len(LABELS), 17, 12_000
TOKEN = re.compile(r"[A-Za-z0-9+/=]{60,}|[一-鿿]|[^\W\d_一-鿿]+|\d+|[^\w\s]|_")
RUN = re.compile(r"\S+|\n")
#: Tokens, padding included, that are decoded together; a longer stretch is decoded alone.
PADDED = 1 << 18
#: Characters of text searched at once: lines that repeat there are decoded once.
CHARS = 8_000_000
#: Lines above and below one with an address that are decoded with it.
ABOVE, BELOW = 2, 3
_DIGITS = str.maketrans("0123456789", "9" * 10)


@cache
def common_words(path: str = TOKENIZER) -> tuple[frozenset[str], frozenset[str]]:
    """(words in lower case, words with a capital) of a public vocabulary; empty if there is no such file."""
    if not os.path.exists(path):
        return frozenset(), frozenset()
    with open(path, "rb") as lines:
        entries = [base64.b64decode(line.split()[0]) for line in lines]
    said = [e[1:].decode() for e in entries if len(e) > 2 and e[:1] == b" " and e[1:].isalpha() and e.isascii()]
    return frozenset(w for w in said if w.islower()), frozenset(w for w in said if w.istitle())


def _mix(x: np.ndarray, k: int) -> np.ndarray:
    """Feature k of the hashed values x, as a column of the weights."""
    z = (x.astype(np.uint64) + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(8)).astype(np.int64) & ((1 << BITS) - 1)


def _hash(s: str) -> int:
    return zlib.crc32(s.encode())


class Lexer:
    """Tokens of a stretch and their hashed properties; unbroken runs that were seen before cost one look-up."""

    #: Runs kept before all are forgotten.
    KEPT = 300_000

    def __init__(self, lower: frozenset[str], capital: frozenset[str]):
        self.lower, self.capital = lower, capital
        self.clear()

    def clear(self) -> None:
        self.seen: dict[str, tuple[list[int], list[int], list[int]]] = {}
        self.table, self.n = np.empty((1024, 5), np.int64), 0

    def _token(self, w: str) -> tuple[int, int, int, int]:
        if w[0].isdigit():
            word = shape = "9" * min(len(w), 20)
            tail, known = "", "d"
        elif not w[0].isalpha():
            word = shape = w
            tail, known = "", "z"
        elif len(w) >= 60:
            word = shape = "blob"
            tail, known = "", "b"
        else:
            low = w.lower()
            known = f"{low in self.lower:d}{low.title() in self.capital:d}"
            shape = "z" if "一" <= w[0] <= "鿿" else ("U" if w.isupper() else "M" if not w[1:].islower() and len(w) > 1 else "C" if w[0].isupper() else "l") + str(min(len(w), 4))
            word = low if known[0] == "1" or shape[0] in "lz" or len(w) == 1 else f"<{known}>"
            tail = low[-3:] if len(w) > 3 else ""
        return _hash("w" + word), _hash("s" + shape), _hash("t" + tail), _hash("k" + known + shape[0])

    def _run(self, run: str) -> tuple[list[int], list[int], list[int]]:
        """(rows of the table, starts, ends) of a run's tokens."""
        if run == "\n":
            spans, rows = [(0, 1)], [tuple(_hash(k + "\n") for k in "wstkr")]
        else:
            spans = [m.span() for m in TOKEN.finditer(run)]
            bare = run.strip("'\"<>[]{}*|:;=,.，。：；、“”「」")
            bare = bare[1:-1] if bare[:1] == "(" and bare[-1:] == ")" else bare.lstrip("(") if ")" not in bare else bare.rstrip(")") if "(" not in bare else bare
            form = re.sub(r"[^\W\d_]+", lambda m: "A" if m.group()[0].isupper() else "a", bare) if len(bare) < 60 and re.search(r"[\d@\[(&%]", bare) else ""
            first, later = _hash(f"r{form}<"), _hash(f"r{form}-")
            rows = [(*self._token(run[a:b]), later if i else first) for i, (a, b) in enumerate(spans)]
        if self.n + len(rows) > len(self.table):
            self.table = np.concatenate([self.table, np.empty((max(len(self.table), len(rows)), 5), np.int64)])
        if rows:
            self.table[self.n : self.n + len(rows)] = rows
        got = list(range(self.n, self.n + len(rows))), [a for a, _ in spans], [b for _, b in spans]
        self.n += len(rows)
        self.seen[run] = got
        return got

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(spans, properties, the last of which is the gap before a token)."""
        at, starts, ends, gaps, end, seen = [], [], [], [], 0, self.seen
        if len(seen) > self.KEPT:
            self.clear()
            seen = self.seen
        for m in RUN.finditer(text):
            a, b = m.span()
            got = seen.get(m.group()) or self._run(m.group())
            rows, s, e = got
            if rows:
                gaps.append(1 if not a else 3 if a - end > 1 else a - end + 1)
                if len(rows) == 1:
                    at.append(rows[0])
                    starts.append(a + s[0])
                    ends.append(a + e[0])
                else:
                    at += rows
                    starts += [a + x for x in s]
                    ends += [a + x for x in e]
                    gaps += [0] * (len(rows) - 1)
                end = b
        where = np.asarray([starts, ends], np.int64).T.reshape(-1, 2)
        return where, np.concatenate([self.table[at], np.asarray(gaps, np.int64)[:, None]], axis=1) if at else np.empty((0, 6), np.int64)


def features(props: list[np.ndarray]) -> np.ndarray:
    """Feature columns of all tokens of several stretches, (tokens, features); neighbours stop at a stretch's ends."""
    base = np.concatenate(props) if props else np.empty((0, 6), np.int64)
    n, part = len(base), np.repeat(np.arange(len(props)), [len(p) for p in props])
    w, s, u, c, r, g = base.T

    def at(x: np.ndarray, d: int) -> np.ndarray:
        out = np.full(n, 7 + d, np.int64)
        if n > abs(d):
            same = part[abs(d) :] == part[: -abs(d)]
            if d < 0:
                out[-d:] = np.where(same, x[:d], 7 - d)
            else:
                out[:-d] = np.where(same, x[d:], 7 + d)
        return out

    w1, w2, v1, v2 = at(w, -1), at(w, -2), at(w, 1), at(w, 2)
    s1, s2, t1, t2 = at(s, -1), at(s, -2), at(s, 1), at(s, 2)
    c1, d1, r1, q1, h1 = at(c, -1), at(c, 1), at(r, -1), at(r, 1), at(g, 1)
    columns = [w, s, u, c, w1, v1, w2, v2, s1 * 31 + s, s * 31 + t1, s2 * 61 + s1 * 31 + s, s * 61 + t1 * 31 + t2, w1 * 31 + s, v1 * 37 + s, w2 * 31 + w1, v1 * 31 + v2]
    columns += [c1 * 31 + c, c * 31 + d1, c1 * 61 + c * 31 + d1, c * 61 + d1 * 31 + at(c, 2), r, r * 31 + r1, r * 31 + q1, r * 31 + w1, u * 31 + c, at(u, -1) * 31 + c, at(u, 1) * 31 + c, s * 61 + g * 7 + h1, g * 31 + c1 * 61 + c, at(w, -3), at(s, 3) * 31 + s]
    return np.stack([_mix(np.abs(x), k) for k, x in enumerate(columns)], axis=1)


class Field:
    """Weights of the field: per feature and label, and per pair of neighbouring labels."""

    def __init__(self, weights: np.ndarray, step: np.ndarray):
        self.weights, self.step = weights, step

    def decode(self, tokens: list[np.ndarray]) -> list[np.ndarray]:
        """Best label sequence of each stretch, given its tokens' properties; stretches of like length are decoded together."""
        if not tokens:
            return []
        x = features(tokens)
        length = np.asarray([len(t) for t in tokens])
        score = np.zeros((len(x), N_LABELS), np.float32)
        for k in range(x.shape[1]):
            score += self.weights[x[:, k]]
        start, out = np.cumsum(length) - length, [np.empty(0, np.int64)] * len(tokens)
        order = np.argsort(length, kind="stable")
        a = 0
        while a < len(order):
            rows = order[a : a + 256]
            rows = rows[: max(1, int((length[rows] * np.arange(1, len(rows) + 1) <= PADDED).sum()))]
            a += len(rows)
            t_max = int(length[rows].max())
            if not t_max:
                continue
            at = np.minimum(start[rows, None] + np.arange(t_max), len(x) - 1)
            e = score[at]
            v, back = e[:, 0], np.zeros((len(rows), t_max, N_LABELS), np.int8)
            ends = np.zeros((len(rows), N_LABELS), np.float32)
            ends[length[rows] == 1] = v[length[rows] == 1]
            for t in range(1, t_max):
                both = v[:, :, None] + self.step
                back[:, t] = both.argmax(axis=1)
                v = both.max(axis=1) + e[:, t]
                done = length[rows] == t + 1
                ends[done] = v[done]
            label = ends.argmax(axis=1)
            path = np.zeros((len(rows), t_max), np.int64)
            for t in range(t_max - 1, -1, -1):
                live = length[rows] > t
                last = length[rows] == t + 1
                if t + 1 < t_max:
                    label = np.where(live & ~last, back[np.arange(len(rows)), min(t + 1, t_max - 1), label], label)
                path[live, t] = label[live]
            for i, r in enumerate(rows):
                out[r] = path[i, : length[r]]
        return out

    @classmethod
    def train(cls, lexer: Lexer, rows: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = 6, rate: float = 0.15, decay: float = 1e-5, seed: int = 3) -> Field:
        """Stochastic gradient of the conditional log-likelihood (forward-backward) with per-weight step sizes."""
        tokens, gold = [], []
        for text, marks in rows:
            where, ts = lexer(text.translate(_DIGITS))
            y = np.zeros(len(ts), np.int64)
            for kind, a, b in marks:
                inside = np.flatnonzero((where[:, 0] >= a) & (where[:, 1] <= b))
                y[inside] = 2 * KINDS.index(kind) + 2
                y[inside[:1]] -= 1
            if len(ts):
                tokens.append(ts)
                gold.append(y)
        x = features(tokens)
        length = np.asarray([len(t) for t in tokens])
        start, y_all = np.cumsum(length) - length, np.concatenate(gold)
        nf, rng = x.shape[1], np.random.default_rng(seed)
        w, step = np.zeros((1 << BITS, N_LABELS)), np.zeros((N_LABELS, N_LABELS))
        gw, gs = np.full_like(w, 1e-2), np.full_like(step, 1e-2)
        order = np.argsort(length, kind="stable")
        batches = [order[a : a + 48] for a in range(0, len(order), 48)]
        for _ in range(epochs):
            for k in rng.permutation(len(batches)):
                b = batches[k]
                t_max = int(length[b].max())
                at = np.minimum(start[b, None] + np.arange(t_max), len(x) - 1)
                mask = np.arange(t_max) < length[b, None]
                e = w[x[at]].sum(axis=2)
                alpha, beta = np.zeros_like(e), np.zeros_like(e)
                alpha[:, 0] = e[:, 0]
                ex = np.exp(step)
                for t in range(1, t_max):
                    top = alpha[:, t - 1].max(axis=1, keepdims=True)
                    new = np.log(np.exp(alpha[:, t - 1] - top) @ ex) + top + e[:, t]
                    alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
                for t in range(t_max - 2, -1, -1):
                    z = beta[:, t + 1] + e[:, t + 1]
                    top = z.max(axis=1, keepdims=True)
                    new = np.log(np.exp(z - top) @ ex.T) + top
                    beta[:, t] = np.where(mask[:, t + 1, None], new, 0)
                last = alpha[:, -1]
                top = last.max(axis=1, keepdims=True)
                log_z = np.log(np.exp(last - top).sum(axis=1, keepdims=True)) + top
                p = np.exp(alpha + beta - log_z[:, None]) * mask[:, :, None]
                y = y_all[at]
                p[np.arange(len(b))[:, None], np.arange(t_max), y] -= mask
                pair = np.zeros_like(step)
                for t in range(1, t_max):
                    m = mask[:, t]
                    if m.any():
                        j = np.exp(alpha[m, t - 1][:, :, None] + step + (e[m, t] + beta[m, t] - log_z[m])[:, None, :])
                        pair += j.sum(axis=0)
                        np.subtract.at(pair, (y[m, t - 1], y[m, t]), 1)
                cols = x[at[mask]]
                grad = np.repeat(p[mask], nf, axis=0)
                ids, inv = np.unique(cols.ravel(), return_inverse=True)
                g = np.stack([np.bincount(inv, grad[:, c], len(ids)) for c in range(N_LABELS)], axis=1) + decay * w[ids]
                gw[ids] += g * g
                w[ids] -= rate * g / np.sqrt(gw[ids])
                gs += pair * pair
                step -= rate * pair / np.sqrt(gs)
        return cls(w.astype(np.float32), step.astype(np.float32))


@cache
def field(n_rows: int = ROWS, path: str = TOKENIZER) -> tuple[Field, Lexer]:
    """The field trained from the labelled table of n_rows rows, the documented bound of its training set, and its lexer."""
    lower, capital = common_words(path)
    lexer = Lexer(lower, capital)
    some = sorted(w for w in lower if 3 < len(w) < 10)
    model = Field.train(lexer, labelled_rows(n_rows, words=some))
    lexer.clear()
    return model, lexer


def _spans(where: np.ndarray, labels: np.ndarray) -> Iterator[tuple[str, int, int]]:
    t, n = 0, len(labels)
    while t < n:
        if labels[t] == 0:
            t += 1
            continue
        kind, u = (labels[t] - 1) // 2, t + 1
        while u < n and labels[u] == 2 * kind + 2:
            u += 1
        yield KINDS[kind], int(where[t, 0]), int(where[u - 1, 1])
        t = u


_AT = re.compile(r"@|%40|&#(?:64|x40);|[\[( ]at[\]) ]", re.I)
_DOT = re.compile(r"\.|[\[( ]dot[\]) ]", re.I)
_EDGE = " \t\n'\"“”‘’«»<>[]{}*|:;=，。：；、,"


def trimmed(text: str, kind: str, s: int, e: int) -> tuple[int, int] | None:
    """The field's span without marks at its edges, or null if it can't be a mention of its kind."""
    while s < e and text[s] in _EDGE + ".-":
        s += 1
    while e > s and text[e - 1] in _EDGE + "-":
        e -= 1
    if e > s and text[e - 1] == "." and not (kind == "person" and re.search(r"\b[^\W\d_]\.$", text[s:e])):
        e -= 1
    if text[s:e].count("(") != text[s:e].count(")"):
        s, e = (s + 1, e) if text[s:e].startswith("(") else (s, e - 1) if text[s:e].endswith(")") else (s, e)
    said = text[s:e]
    digits = sum(map(str.isdigit, said))
    if kind == "email":
        m = _AT.search(said)
        ok = m is not None and m.start() > 0 and _DOT.search(said, m.end()) is not None
    elif kind == "phone":
        ok = 7 <= digits <= 15 and not re.fullmatch(r"[1-9]\d?(?:[\s,]\d{3}){2,}", said)  # that is a grouped number
    elif kind == "idnum":
        ok = digits >= 6 and len(said) <= 24
    elif kind == "address":
        ok = digits > 0 and bool(re.search(r"[^\W\d_]{2}", said))
    else:
        ok = digits == 0 and not re.search(r"[|=\n]", said) and bool(re.search(r"[^\W\d_]\W+[^\W\d_]|^[一-鿿]{2,5}$", said))
    return (s, e) if ok and s < e else None


def _labelled(stretches: list[str], model: Field, lexer: Lexer) -> dict[str, list[tuple[str, int, int]]]:
    """The field's spans of distinct stretches (digits already alike)."""
    out, held, size = {}, [], 0

    def run() -> None:
        for (text, where, _), labels in zip(held, model.decode([p for _, _, p in held])):
            out[text] = list(_spans(where, labels)) if labels.any() else []

    for text in stretches:
        where, props = lexer(text)
        if len(props):
            held.append((text, where, props))
            size += len(props)
        else:
            out[text] = []
        if size > PADDED:
            run()
            held, size = [], 0
    run()
    return out


def mentions(texts: list[str | None], trained: tuple[Field, Lexer]) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of every mention of each text, in order."""
    model, lexer = trained
    lines = [t.translate(_DIGITS).split("\n") if t else [] for t in texts]
    found = _labelled(list(dict.fromkeys(x for ls in lines for x in ls)), model, lexer)
    placed = {x for x, spans in found.items() if any(k == "address" for k, _, _ in spans)}
    windows: list[list[tuple[int, int]]] = []
    for ls in lines:
        mine: list[tuple[int, int]] = []
        for i, x in enumerate(ls):
            if x in placed:
                a, b = i, i + 1
                while a > max(0, i - ABOVE) and ls[a - 1].strip():
                    a -= 1
                while b < min(len(ls), i + 1 + BELOW) and ls[b].strip():
                    b += 1
                if mine and a < mine[-1][1]:
                    a = mine.pop()[0]
                mine.append((a, b))
        windows.append(mine)
    joint = lambda ls, a, b: "\n".join(ls[a:b])
    again = _labelled(list(dict.fromkeys(joint(ls, a, b) for ls, mine in zip(lines, windows) for a, b in mine)), model, lexer)
    out: list[list[tuple[str, int, int]]] = []
    for text, ls, mine in zip(texts, lines, windows):
        got, i, at, todo = [], 0, 0, iter([*mine, (len(ls), len(ls))])
        a, b = next(todo)
        while i < len(ls):
            if i == a:
                piece, spans = joint(ls, a, b), again[joint(ls, a, b)]
                i, (a, b) = b, next(todo)
            else:
                piece, spans = ls[i], found[ls[i]]
                i += 1
            for kind, s, e in spans:
                if (cut := trimmed(text, kind, at + s, at + e)) is not None and not (got and cut[0] < got[-1][2]):
                    got.append((kind, *cut))
            at += len(piece) + 1
        out.append(got)
    return out


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHARS characters, or of one longer text."""
    a = size = 0
    for b, t in enumerate(texts):
        if size and size + len(t or "") > CHARS:
            yield a, b
            a, size = b, 0
        size += len(t or "")
    if a < len(texts):
        yield a, len(texts)


def find(df: DataFrame, row_id: str, text: str, n_rows: int = ROWS) -> DataFrame:
    """(id, pii_kind, start_pos, end_pos): one row for each mention."""
    held = df.sparkSession.sparkContext.broadcast(field(n_rows))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, texts = pdf["__id"].tolist(), pdf["__text"].tolist()
            for a, b in _chunks(texts):
                rows = [(i, *m) for i, ms in zip(ids[a:b], mentions(texts[a:b], held.value)) for m in ms]
                yield pd.DataFrame(rows, columns=["id", "pii_kind", "start_pos", "end_pos"])

    return df.select(F.col(row_id).cast("long").alias("__id"), F.col(text).alias("__text")).mapInPandas(each, "id long, pii_kind string, start_pos int, end_pos int")


def mask_text(text: str | None, found: list[tuple[str, int, int]]) -> str | None:
    """The text with each mention replaced by <KIND>."""
    if text is None:
        return None
    out, last = [], 0
    for kind, a, b in sorted(found, key=lambda m: m[1]):
        out += [text[last:a], f"<{kind.upper()}>"]
        last = b
    return "".join([*out, text[last:]])


def mask(df: DataFrame, text: str, out: str, n_rows: int = ROWS) -> DataFrame:
    """``df`` with column ``out``: the text with typed placeholders, all else unchanged."""
    held = df.sparkSession.sparkContext.broadcast(field(n_rows))

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = s.tolist()
            yield pd.Series([m for a, b in _chunks(texts) for m in map(mask_text, texts[a:b], mentions(texts[a:b], held.value))], dtype=object)

    return df.withColumn(out, masked(F.col(text)))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pii_kind, start_pos, end_pos) of every mention."""
    return find(read(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p9_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notebooks with typed placeholders in place of mentions."""
    return mask(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", "masked_text").select("doc_id", "masked_text")


SQL: dict[str, str] = {}
QUERIES = {"p9_found": p9_found, "p9_masked": p9_masked}
