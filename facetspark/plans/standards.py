"""Rubrics: Markdown files with a head of YAML; own files win over built-in ones of the same name."""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import STANDARD

_FIELDS = ("min_width", "max_width", "min_height", "max_height", "multiplier")


def parse(text: str, source: str = "filesystem", file_path: str | None = None) -> dict:
    """A rubric; ValueError if its head is missing, no YAML, or lacks name or description."""
    import yaml

    m = re.match(r"^---\r?\n(.*?)\r?\n---\r?\n?(.*)$", text, re.S)
    try:
        head = yaml.safe_load(m.group(1)) if m else None
    except yaml.YAMLError as e:
        raise ValueError(f"bad head: {e}") from None
    if not isinstance(head, dict):
        raise ValueError("no head")
    for need in ("name", "description"):
        if not isinstance(head.get(need), str) or not head[need]:
            raise ValueError(f"{need} is missing")
    rules = head.get("size_correction") or []
    rules = [rules] if isinstance(rules, dict) else rules
    version = head.get("version")
    return {
        "name": head["name"],
        "description": head["description"],
        "version": None if version is None else str(version),
        "currency": head.get("currency") or "CNY",
        "max_value": None if head.get("max_value") is None else float(head["max_value"]),
        "image_formats": head.get("image_formats"),
        "tags": head.get("tags"),
        "size_correction": [tuple(float(r[k]) if k == "multiplier" and r.get(k) is not None else r.get(k) for k in _FIELDS) for r in rules],
        "body": m.group(2).strip(),
        "content_hash": hashlib.sha256(text.encode()).hexdigest(),
        "source": source,
        "file_path": file_path,
    }


def load(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """Rubrics of {source: folder}; a missing folder has none."""
    rows = [parse(p.read_text("utf-8"), s, str(p)) for s, d in folders.items() for p in sorted(Path(d).glob("*.md"))]
    return spark.createDataFrame([tuple(r[f.split(" ")[0]] for f in re.split(r", (?=\w+ )", STANDARD)) for r in rows], STANDARD)


def overridden(standards: DataFrame) -> DataFrame:
    """One row per name: the file system before built-in, then the first file."""
    w = Window.partitionBy("name").orderBy(F.when(F.col("source") == "filesystem", 0).otherwise(1), "file_path")
    return standards.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def listing(standards: DataFrame) -> DataFrame:
    return standards.select("source", "name", "description", "file_path")
