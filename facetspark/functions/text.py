"""String functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

REPLACEMENT = "�"


def glob_regex(glob: str) -> str:
    """Anchored regular expression of a path glob: ** crosses folders, * and ? stay within one, all else is literal."""
    parts = re.split(r"(\*\*|\*|\?)", glob.replace("\\", "/"))
    return "^" + "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts) + "$"


def decode_url(c: Column) -> Column:
    """Percent-decoding; the input itself where it is malformed or its bytes are no UTF-8. Null stays null."""
    out = F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    return F.coalesce(F.when(~out.contains(REPLACEMENT), out), c)


def file_path(url: Column) -> Column:
    """Path of a file:// URL, decoded; null for another kind of URL."""
    return F.when(url.startswith("file://"), decode_url(F.substring(url, F.lit(8), F.length(url))))


def file_url(path: Column) -> Column:
    """file:// URL of a path: each segment percent-encoded."""
    segments = F.transform(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")))
    return F.concat(F.lit("file://"), F.array_join(segments, "/"))


def matches_any(url: Column, globs: list[str]) -> Column:
    """True where the file of a URL matches one of the globs; without globs always true, for other URLs then false."""
    if not globs:
        return F.lit(True)
    path = F.replace(file_path(url), F.lit("\\"), F.lit("/"))
    return F.coalesce(path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)), F.lit(False))


def extension(name: Column) -> Column:
    """Lower-case ending without its dot; empty for none and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(basename(name), r"[^.]\.([^.]+)$", 1))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def sanitize_name(c: Column) -> Column:
    """A name fit for a file: forbidden and control characters dropped, blanks to _, no dots or blanks at the end."""
    s = F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "")
    return F.regexp_replace(F.regexp_replace(F.trim(s), r"\s+", "_"), r"[. ]+$", "")


def clean_model_name(c: Column, longest: int = 35) -> Column:
    """A file name proposed by a model: no ending, blanks to _; null if it is longer than allowed."""
    s = F.regexp_replace(F.regexp_replace(c, r"\.[a-zA-Z0-9]{1,6}$", ""), r"\s+", "_")
    return F.when(F.length(s) <= longest, s)


def strip_thinking(c: Column) -> Column:
    """Without the first <think> part, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?s)^(.*?)<think>.*?</think>", "$1"))


def parse_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def fts_query(c: Column) -> Column:
    """A search text with its quotes turned to blanks."""
    return F.trim(F.regexp_replace(c, "[\"']", " "))


def data_uri(content: Column, kind: str = "jpeg") -> Column:
    return F.concat(F.lit(f"data:image/{kind};base64,"), F.regexp_replace(F.base64(content), r"[\r\n]", ""))


def split_data_uri(c: Column) -> Column:
    """struct(kind, data) of an image's data URI, else null."""
    form = r"^data:image/(\w+);base64,(.+)$"
    return F.when(c.rlike(form), F.struct(F.regexp_extract(c, form, 1).alias("kind"), F.regexp_extract(c, form, 2).alias("data")))


def wrap(c: Column, width: int = 44) -> Column:
    return F.regexp_extract_all(c, F.lit(f"(?s)(.{{1,{width}}})"), 1)


def first_line(c: Column) -> Column:
    return F.substring_index(c, "\n", 1)


def tag_of_line(c: Column) -> Column:
    return F.substring_index(c, "=", 1)


def normal_format(c: Column) -> Column:
    """jpeg, png or webp; jpg and anything else count as jpeg."""
    f = F.lower(c)
    return F.when(f.isin("png", "webp"), f).otherwise(F.lit("jpeg"))


def short_version(c: Column) -> Column:
    return F.concat(F.lit("#"), F.left(c, F.lit(8)))


def sha256_hex(content: Column) -> Column:
    """SHA-256 of bytes or of a text's UTF-8 as 64 hex digits."""
    return F.sha2(content.cast("binary"), 256)


def stamp(at: Column) -> Column:
    """yyyyMMddHHmmss in the session's time zone."""
    return F.date_format(at, "yyyyMMddHHmmss")


def iso_time(at: Column) -> Column:
    """ISO 8601 in UTC with milliseconds."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def exif_time(c: Column) -> Column:
    """An EXIF date (2024:01:31 08:09:10) as ISO 8601; null where it is none."""
    return F.date_format(F.try_to_timestamp(c, F.lit("yyyy:MM:dd HH:mm:ss")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def is_path(c: Column) -> Column:
    """Is a rubric named by a path rather than by its name?"""
    return c.contains("/") | c.contains("\\") | c.rlike(r"[^/\\]\.md$")


def from_file_url(url: Column) -> Column:
    """Path of a file:// URL; anything else stays as it is."""
    return F.coalesce(file_path(url), url)
