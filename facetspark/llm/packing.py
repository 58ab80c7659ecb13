"""Containers of fixed capacity filled with documents, by hierarchical residual packing.

Sizes are tokens of a public tokenizer. A document larger than the capacity is cut into full pieces and a rest; any
other stays whole. Each task packs its items best-fit, largest first, and closes the containers that are nearly
full. The others go on as items of their own: groups of tasks' leftovers are packed again in a tree until one node
is left. Where more than CARRY open containers are left for each node, they are dealt anew over as many nodes as they
fill, round after round, until a round saves less than one container in SAVES; only then are they closed. So no task
meets an unbounded number and none is closed early. Every piece is in exactly one container.

Defined cases: a null or empty text has size 0 and is packed like any other; repeated rows are items each; very
long texts become several pieces; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary's tokenizer splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CAPACITY, NEARLY, FAN_IN, CARRY, HELD, SAVES = 8192, 0.995, 4, 16_384, 100_000, 200
_BIN = "node long, bin string, open boolean, used int, docs array<long>, pieces array<int>, starts array<long>, sizes array<int>"
_COLUMNS = [c.split()[0] for c in _BIN.split(", ")]


@cache
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def best_fit(items: list[tuple[int, list]], capacity: int) -> list[tuple[int, list]]:
    """(used, members) containers of (size, members) items: the largest first, each into the fullest that still takes it."""
    room: list[tuple[int, int]] = []  # (free, container), sorted
    out: list[list] = []
    for size, members in sorted(items, key=lambda x: -x[0]):
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, b = room.pop(at)
            out[b][0] += size
            out[b][1] += members
        else:
            free, b = capacity, len(out)
            out.append([size, list(members)])
        insort(room, (free - size, b))
    return [(used, members) for used, members in out]


def _rows(bins: list[tuple[int, list]], node: int, name: str, capacity: int, last: bool) -> tuple[list[list], list[tuple[int, list]]]:
    """(rows of closed containers, containers still open)."""
    bins = sorted(bins, key=lambda b: -b[0])
    keep = [] if last else [b for b in bins if b[0] < NEARLY * capacity]
    shut = bins[: len(bins) - len(keep)]
    return [[node, f"{name}-{i}", False, u, *map(list, zip(*m))] for i, (u, m) in enumerate(shut)], keep


def containers(docs: DataFrame, doc_id: str, text: str, capacity: int = CAPACITY, tokenizer_path: str = TOKENIZER) -> DataFrame:
    """(bin, doc_id, piece, start_token, n_tokens, bin_tokens): where every piece of every document lies."""

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        node, enc, turn, no = TaskContext.get().partitionId(), tokenizer(tokenizer_path), 0, 0
        held: list[tuple[int, list]] = []
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["__id"], pdf["__text"]):
                n = len(enc.encode_ordinary(t)) if t else 0
                full = max(0, -(-n // capacity) - 1)
                for p in range(full):
                    rows.append([node, f"{node}-{no}-{p}", False, capacity, [i], [p], [p * capacity], [capacity]])
                no += 1
                held.append((n - full * capacity, [(i, full, full * capacity, n - full * capacity)]))
            if len(held) >= HELD:
                shut, held = _rows(best_fit(held, capacity), node, f"{node}.{turn}", capacity, False)
                rows += shut
            turn += 1
            if rows:
                yield pd.DataFrame(rows, columns=_COLUMNS)
        shut, held = _rows(best_fit(held, capacity), node, f"{node}.{turn}", capacity, False)
        rows = shut + [[node, "", True, u, *map(list, zip(*m))] for u, m in held]
        if rows:
            yield pd.DataFrame(rows, columns=_COLUMNS)

    def again(level: int, last: bool):
        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            node = int(pdf["node"].iloc[0])
            items = [(int(u), list(zip(*m))) for u, *m in zip(pdf["used"], pdf["docs"], pdf["pieces"], pdf["starts"], pdf["sizes"])]
            shut, held = _rows(best_fit(items, capacity), node, f"L{level}.{node}", capacity, last)
            return pd.DataFrame(shut + [[node, "", True, u, *map(list, zip(*m))] for u, m in held], columns=_COLUMNS)

        return pack

    level, no = cut(docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text")).mapInPandas(local, _BIN)), 0
    done = level.filter("not open")
    width, left = (level.agg(F.max("node"), F.count_if("open")).first() or (None, 0))
    width, last = (width or 0) + 1, False
    while left and not last:
        no, least = no + 1, -(-left // CARRY)
        merged = -(-width // FAN_IN)
        dealt = merged < least  # too many for the nodes of the tree
        width = least if dealt else merged
        node = F.pmod(F.xxhash64("docs", "pieces", F.lit(no)), F.lit(width)) if dealt else F.expr(f"node div {FAN_IN}")
        last = width == 1
        level = cut(level.filter("open").withColumn("node", node).groupBy("node").applyInPandas(again(no, last), _BIN))
        done, before = done.unionByName(level.filter("not open")), left
        left = level.filter("open").count()
        if left and dealt and before - left < before / SAVES:
            done, left = done.unionByName(level.filter("open").groupBy("node").applyInPandas(again(no + 1, True), _BIN)), 0
    each = F.explode(F.arrays_zip("docs", "pieces", "starts", "sizes")).alias("m")
    return done.select("bin", F.col("used").alias("bin_tokens"), each).select("bin", F.col("m.docs").alias("doc_id"), F.col("m.pieces").alias("piece"), F.col("m.starts").alias("start_token"), F.col("m.sizes").alias("n_tokens"), "bin_tokens")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every notebook in containers of 8,192 tokens."""
    return containers(read(spark, sf_dir, "documents"), "doc_id", "text")


SQL: dict[str, str] = {}
QUERIES = {"p7_containers": p7_containers}
