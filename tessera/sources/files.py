"""A workspace of files as rows: scan, fingerprints, incremental reads, caps, and the small text formats beside it."""

from __future__ import annotations

import os
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.paths import extension, ignored, language, test_like
from tessera.functions.text import token_count

MOST_BYTES = 2 * 1024 * 1024
SOFT_CAP, HARD_CAP = 6_000, 50_000
MARKERS = (".git", "Cargo.toml", "package.json", "pyproject.toml", "composer.json", "go.mod", "pom.xml")


def safe_root(path: str) -> str:
    """The workspace's real path; refuses the root, the home folder, and what isn't a folder."""
    real = os.path.realpath(path)
    if not os.path.isdir(real) or real in ("/", os.path.realpath(os.path.expanduser("~"))):
        raise ValueError(f"not a workspace: {path}")
    return real


def discover(start: str) -> str:
    """The nearest folder upward that holds a project's marker, else the start."""
    at = Path(start).resolve()
    for folder in (at, *at.parents):
        if any((folder / m).exists() for m in MARKERS):
            return safe_root(str(folder))
    return safe_root(str(at))


def inside(root: str, relative: str) -> str:
    """A file's path within the workspace; refuses absolute paths and what leads out, links followed."""
    full = os.path.realpath(os.path.join(root, relative))
    if os.path.isabs(relative) or os.path.commonpath([full, os.path.realpath(root)]) != os.path.realpath(root):
        raise ValueError(f"outside the workspace: {relative}")
    return full


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Metadata only, so that filters run before any content is read: path, length, modified, language, skipped."""
    real = safe_root(root)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(real)
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^{real}/", "")
    rows = found.select(rel.alias("path"), "length", F.col("modificationTime").alias("modified"))
    why = F.when(ignored("path"), "ignored").when(F.col("length") > MOST_BYTES, "too_large").when(language("path").isNull(), "unknown_extension")
    return rows.withColumn("language", language("path")).withColumn("skipped", why)


def skipped_summary(files: DataFrame, k: int = 6) -> DataFrame:
    """The extensions that were skipped most."""
    return files.filter("skipped = 'unknown_extension'").groupBy(extension("path").alias("ext")).count().orderBy(F.desc("count"), "ext").limit(k)


def capped(files: DataFrame, most: int | None = None) -> DataFrame:
    """Production files before tests, then by path, up to the cap (by default all production files, 6,000 at least and 50,000 at most)."""
    kept = files.filter("skipped IS NULL").withColumn("is_test", test_like("path"))
    if most is None:
        most = min(max(kept.filter("NOT is_test").count(), SOFT_CAP), HARD_CAP)
    return kept.orderBy("is_test", "path").limit(max(1, min(most, HARD_CAP)))


def scan(spark: SparkSession, root: str, known: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Files with content, hash and token count; those whose size and time are as known (path, length, modified) aren't read."""
    wanted = capped(listing(spark, root), most)
    if known is not None:
        wanted = wanted.join(known.select("path", "length", "modified"), ["path", "length", "modified"], "left_anti")
    names = [f"file://{inside(safe_root(root), r.path)}" for r in wanted.select("path").toLocalIterator()]
    if not names:
        return spark.createDataFrame([], "path string, length long, modified timestamp, language string, content string, hash string, tokens long")
    body = spark.read.format("binaryFile").load(names).select(F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^{safe_root(root)}/", "").alias("path"), F.col("content").cast("string").alias("content"))
    read = wanted.select("path", "length", "modified", "language").join(body, "path")
    return read.withColumn("hash", F.sha2("content", 256)).withColumn("tokens", token_count("content"))


def gold_tasks(spark: SparkSession, path: str) -> DataFrame:
    """[[task]] blocks of a TOML file: id, prompt, gold_files, forbidden_files, expect_seeds_missed."""
    with open(path, "rb") as f:
        tasks = tomllib.load(f).get("task", [])
    rows = [(t.get("id"), t.get("prompt"), t.get("gold_files", []), t.get("forbidden_files", []), bool(t.get("expect_seeds_missed", False))) for t in tasks]
    return spark.createDataFrame(rows, "id string, prompt string, gold_files array<string>, forbidden_files array<string>, expect_seeds_missed boolean")


def telemetry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)
