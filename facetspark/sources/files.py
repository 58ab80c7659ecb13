"""Image files: directory scans, sizes from headers, EXIF, damaged rows, line texts."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension, glob_regex
from ..schemas import EXIF

#: EXIF tags read.
TAGS = {0x010F: "make", 0x0110: "model", 0x0131: "software", 0x9003: "taken", 0x829A: "exposure", 0x829D: "aperture", 0x8827: "iso", 0x920A: "focal_length", 0xA434: "lens", 0x0112: "orientation", 0xA002: "width", 0xA003: "height"}
_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def scan(spark: SparkSession, folder: str, recursive: bool = False, extensions: list[str] | None = None, depth: int | None = None, include: list[str] | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of a folder's files of the given endings; content is read only if used.

    Folders deeper than ``depth`` (0: the folder itself) are not listed at all, those that can't be read are passed
    over. include: globs of paths. No endings or globs: all files, those of no bytes too.
    """
    folders, empty = _walk(spark, folder, depth if depth is not None else None if recursive else 0)
    rows = spark.createDataFrame(empty, "path string, modificationTime timestamp, length long, content binary")
    if folders:  # each is listed without those below it
        rows = spark.read.format("binaryFile").load(folders).select("path", "modificationTime", "length", "content").filter("length > 0").unionByName(rows)
    if extensions:
        rows = rows.filter(extension(F.col("path")).isin(*[e.lower().lstrip(".") for e in extensions]))
    if include:
        bare = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
        rows = rows.filter(bare.rlike("|".join(f"(?:{glob_regex(g)})" for g in include)))
    return rows


def _walk(spark: SparkSession, folder: str, depth: int | None) -> tuple[list[str], list[tuple]]:
    """(folders down to ``depth`` that hold files, files of no bytes), level by level."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    level, no, folders, empty = [hadoop.Path(folder)], 0, [], []
    while level:
        below = []
        for at in level:
            try:
                here = list(fs.listStatus(at))
            except Exception as e:  # noqa: BLE001
                if not no:
                    raise FileNotFoundError(folder) from e
                continue
            below += [f.getPath() for f in here if f.isDirectory()]
            files = [f for f in here if not f.isDirectory()]
            folders += [str(at)] if any(f.getLen() for f in files) else []
            empty += [(str(f.getPath()), datetime.fromtimestamp(f.getModificationTime() / 1000), 0, bytearray()) for f in files if not f.getLen() and not f.getPath().getName().startswith(("_", "."))]
        level, no = (below if depth is None or no < depth else []), no + 1
    return folders, empty


def image_header(b: bytes | None) -> tuple[str | None, int, int]:
    """(format, width, height) of PNG, JPEG, GIF or WebP bytes; (None, 0, 0) for anything else."""
    try:
        if b[:8] == b"\x89PNG\r\n\x1a\n" and b[12:16] == b"IHDR":
            return "png", *struct.unpack(">II", b[16:24])
        if b[:6] in (b"GIF87a", b"GIF89a"):
            return "gif", *struct.unpack("<HH", b[6:10])
        if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
            kind = b[12:16]
            if kind == b"VP8X":
                return "webp", 1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little")
            if kind == b"VP8L":
                n = int.from_bytes(b[21:25], "little")
                return "webp", (n & 0x3FFF) + 1, (n >> 14 & 0x3FFF) + 1
            return "webp", int.from_bytes(b[26:28], "little") & 0x3FFF, int.from_bytes(b[28:30], "little") & 0x3FFF
        if b[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(b):
                if b[at] != 0xFF:
                    at += 1
                    continue
                mark = b[at + 1]
                if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", b[at + 5 : at + 9])
                    return "jpeg", w, h
                at += 2 if mark == 0xFF or 0xD0 <= mark <= 0xD9 else 2 + int.from_bytes(b[at + 2 : at + 4], "big")
    except (TypeError, struct.error, IndexError):
        pass
    return None, 0, 0


def _headers(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        yield pd.DataFrame([image_header(b) for b in s], columns=["format", "width", "height"])


def header_of(content: Column) -> Column:
    """struct(format, width, height) of file bytes."""
    return F.pandas_udf(_headers, "format string, width int, height int")(content)


def exif(b: bytes | None) -> dict | None:
    """The tags of a JPEG's EXIF part; None without one. Never raises."""
    try:
        start = b.index(b"Exif\x00\x00") + 6
        t = b[start:]
        end = {b"II": "<", b"MM": ">"}[t[:2]]

        def value(kind: int, n: int, raw: bytes):
            data = raw if _SIZE[kind] * n <= 4 else t[struct.unpack(end + "I", raw)[0] :]
            if kind == 2:
                return data[:n].split(b"\0")[0].decode("utf-8", "replace").strip()
            form = {1: "B", 3: "H", 4: "I", 7: "B", 9: "i"}.get(kind)
            if form:
                got = struct.unpack_from(f"{end}{n}{form}", data)
            else:
                pairs = struct.unpack_from(f"{end}{2 * n}{'I' if kind == 5 else 'i'}", data)
                got = tuple(a / c if c else 0.0 for a, c in zip(pairs[::2], pairs[1::2]))
            return got[0] if n == 1 else got

        def directory(at: int) -> dict:
            out = {}
            for k in range(struct.unpack_from(end + "H", t, at)[0]):
                tag, kind, n = struct.unpack_from(end + "HHI", t, at + 2 + 12 * k)
                if kind in _SIZE:
                    out[tag] = value(kind, n, t[at + 10 + 12 * k : at + 14 + 12 * k])
            return out

        main = directory(struct.unpack_from(end + "I", t, 4)[0])
        main |= directory(main[0x8769]) if 0x8769 in main else {}
        out = {name: main.get(tag) for tag, name in TAGS.items()}
        gps = directory(main[0x8825]) if 0x8825 in main else {}
        degrees = lambda v, ref, minus: (v[0] + v[1] / 60 + v[2] / 3600) * (-1 if ref == minus else 1)
        out["gps"] = {"latitude": degrees(gps[2], gps.get(1), "S"), "longitude": degrees(gps[4], gps.get(3), "W")} if 2 in gps and 4 in gps else None
        return out
    except (AttributeError, TypeError, ValueError, KeyError, IndexError, struct.error):
        return None


_EXIF_FIELDS = [*TAGS.values(), "gps"]


def _exifs(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        yield pd.DataFrame([exif(b) or dict.fromkeys(_EXIF_FIELDS) for b in s], columns=_EXIF_FIELDS)[[f.split()[0] for f in EXIF.split(", ")]]


def exif_of(content: Column) -> Column:
    """struct of EXIF tags of file bytes, its fields null without any."""
    return F.pandas_udf(_exifs, EXIF)(content)


def uniform_bottom_rows(pixels: bytes, width: int, channels: int) -> int:
    """How many rows at the bottom have one colour all over, as a cut-off decode leaves them."""
    import numpy as np

    rows = np.frombuffer(pixels, np.uint8)
    if not width or not channels or len(rows) < width * channels:
        return 0
    rows = rows[: len(rows) // (width * channels) * (width * channels)].reshape(-1, width, channels)
    flat = (rows == rows[:, :1]).all(axis=(1, 2)) & (rows[:, 0] == rows[-1, 0]).all(axis=1)
    return len(flat) if flat.all() else int(np.argmin(flat[::-1]))


def within_size(df: DataFrame, most: int = 10 * 1024 * 1024) -> DataFrame:
    return df.filter(F.col("length") <= most)
