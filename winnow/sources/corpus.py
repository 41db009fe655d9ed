"""Source-code corpus: one row per file, (project, path, content)."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from winnow import fixed_values as fixed
from winnow.functions import text as t

CORPUS = "project string, path string, content string"


def read_code_corpus(spark: SparkSession, root: str) -> DataFrame:
    """READMEs at the top of each project and code files at any depth.

    File names are filtered while listing, vendor folders before the content
    is used. Spark's file sources pass over names that start with '_'
    (__init__.py); on a mounted folder these are listed and read by tasks.
    """
    names = f"*.{{{','.join(fixed.CODE_EXTENSIONS)},md}}"
    files = (
        spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=names)
        .select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("content"))
    )
    mounted = root.startswith(("/", "file:")) or ":" not in root
    base = os.path.abspath("/" + unquote(root[5:]).lstrip("/") if root.startswith("file:") else root) if mounted else root
    base = base.rstrip("/") + "/"
    place = F.url_decode(F.replace(F.col("uri"), F.lit("+"), F.lit("%2B")))
    files = files.withColumn("place", place).select(
        F.substr("place", F.instr("place", F.lit(base)) + len(base)).alias("relative"),
        F.replace(F.make_valid_utf8("content"), F.lit("�"), F.lit("")).alias("content"),
    )
    if mounted:
        files = files.unionByName(_underscore_files(spark, base))
    corpus = files.select(
        F.substring_index("relative", "/", 1).alias("project"),
        F.expr("substr(relative, instr(relative, '/') + 1)").alias("path"),
        "content",
    ).filter(F.contains("relative", F.lit("/")))
    return filter_vendor_paths(keep_searchable(corpus))


def keep_searchable(files: DataFrame) -> DataFrame:
    """Top-level READMEs and files with a known extension."""
    code = F.rlike(F.col("path"), F.lit(f"\\.(?:{'|'.join(fixed.CODE_EXTENSIONS)})$"))
    hidden = F.rlike(F.col("path"), F.lit("(?:^|/)\\."))
    return files.filter((F.col("path") == fixed.README_NAME) | (code & ~hidden))


def filter_vendor_paths(files: DataFrame) -> DataFrame:
    """Drop paths that hold a vendor name anywhere; READMEs are always at the top and stay."""
    vendor = F.rlike(F.col("path"), F.lit(t.any_of(fixed.VENDOR_PATH_PARTS)))
    return files.filter(~vendor)


def limit_projects(files: DataFrame, projects: int = fixed.MAX_PROJECTS) -> DataFrame:
    """Files of the first projects by name. Only project names are sorted, and at most
    `projects` of them are met with the files."""
    kept = files.select("project").distinct().orderBy("project").limit(projects)
    return files.join(kept, "project", "left_semi")


def _underscore_files(spark: SparkSession, base: str) -> DataFrame:
    """Files Spark's listing hides. Folders are listed by task, then files are read by task,
    so one large project is not read by one task."""
    projects = sorted(entry.name for entry in os.scandir(base) if entry.is_dir())
    endings = tuple("." + ending for ending in fixed.CODE_EXTENSIONS)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for project in batch["project"]:
                for folder, _, names in os.walk(os.path.join(base, project)):
                    inside = os.path.relpath(folder, base)
                    under = any(part.startswith("_") for part in inside.split("/"))
                    found = [
                        os.path.join(inside, name)
                        for name in names
                        if (name.endswith(endings) or name == fixed.README_NAME) and (under or name.startswith("_"))
                    ]
                    if found:
                        yield pd.DataFrame({"relative": found})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["relative"]:
                with open(os.path.join(base, name), encoding="utf-8", errors="ignore", newline="") as f:
                    yield pd.DataFrame({"relative": [name], "content": [f.read()]})

    if not projects:
        return spark.createDataFrame([], "relative string, content string")
    listing = spark.createDataFrame([(p,) for p in projects], "project string").repartition("project")
    paths = listing.mapInPandas(listed, "relative string").repartition("relative")
    return paths.mapInPandas(read, "relative string, content string")
