"""Files of note collections and code repositories as DataFrames, and path predicates."""

from __future__ import annotations

import re
from fnmatch import translate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import lexicons

#: Suffixes of languages that are chunked by lines.
CODE_SUFFIXES = ".py .js .jsx .mjs .ts .tsx .java .go .rs .c .h .cpp .cc .cxx .hpp .cs .rb".split()
NOTE_DIRS = (".obsidian", ".trash", ".git")


def parts(path: Column) -> Column:
    return F.split(path, "/")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def has_part(path: Column, names: tuple[str, ...] | list[str]) -> Column:
    return F.arrays_overlap(parts(path), F.array(*map(F.lit, names)))


def matches_glob(path: Column, patterns: list[str]) -> Column:
    """Whether a component of the path matches one of the shell patterns."""
    rules = [re.sub(r"\\[zZ]$", "", translate(p)).replace("(?s:", "(?:") for p in patterns]
    joined = "^(?:" + "|".join(rules) + ")$"
    return F.exists(parts(path), lambda p: p.rlike(joined))


def skipped(path: Column) -> Column:
    """Whether a repository's file is not indexed: by a directory, its name or a binary suffix."""
    dirs = F.slice(parts(path), 1, F.size(parts(path)) - 1)
    name = F.element_at(parts(path), -1)
    low = F.lower
    bad = F.exists(dirs, lambda d: d.isin(lexicons.SKIPPED_DIRS) | d.endswith(".egg-info") | low(d).startswith(".venv") | low(d).startswith("venv") | (low(d) == "env"))
    return bad | name.isin(lexicons.SKIPPED_FILES) | suffix(path).isin(lexicons.BINARY_SUFFIXES)


def indexed(path: Column) -> Column:
    return ~skipped(path) & suffix(path).isin(*CODE_SUFFIXES, *lexicons.DOC_SUFFIXES)


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path`` (relative), ``mtime``, ``size``, ``sha256`` (of the first 64 KiB, 16 digits) and ``text`` of all files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    base = F.regexp_replace("path", "^file:/*", "/")
    root = folder.removeprefix("file://").rstrip("/") + "/"
    relative = F.when(base.startswith(root), F.substring(base, len(root) + 1, 1 << 20)).otherwise(base)
    return files.select(
        relative.alias("path"), F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size"),
        F.substring(F.sha2(F.substring("content", 1, 65536), 256), 1, 16).alias("sha256"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
    )


def scan_notes(spark: SparkSession, folder: str, excluded: tuple[str, ...] = NOTE_DIRS) -> DataFrame:
    """Markdown notes, but for those with an excluded name in their path."""
    files = read_files(spark, folder, "*.md")
    return files.filter(~has_part(F.col("path"), excluded)).withColumn("stem", F.regexp_extract("path", r"([^/]+)\.md$", 1))


def scan_repo(spark: SparkSession, folder: str, repo_name: str) -> DataFrame:
    files = read_files(spark, folder)
    return files.filter(indexed(F.col("path"))).withColumn("repo_name", F.lit(repo_name))
