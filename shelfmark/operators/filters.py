"""Which entries of a listing take part, and why the others don't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.dims import CATEGORIES, GENERATED, INCOMPLETE
from shelfmark.functions.naming import base_name, is_hidden, is_private, parent, suffix


def scan_reason(path: Column, private: list[str], include_existing: bool, is_link: Column | None = None) -> Column:
    """Why a file of a listing is passed over at the scan: the first rule that holds, or null.

    "-" stands for rules that leave no trace: generated files, hidden entries below the root, category folders.
    """
    name, folder = base_name(path), parent(path)
    top = F.substring_index(path, "/", 1)
    out = F.when(name.isin(*GENERATED), "-").when(is_hidden(path), F.when(folder == "", "hidden").otherwise("-"))
    if not include_existing:
        out = out.when(folder != "", F.when(top.isin(*CATEGORIES), "-").otherwise("existing folder"))
    if is_link is not None:
        out = out.when(is_link, "link")
    return out.when(is_private(folder, private) & (folder != ""), "private folder")


def age_reason(name: Column, mtime_ns: Column, now_ns: int, min_age_seconds: int) -> Column:
    """Why a file isn't ripe: an unfinished download, or a change too short a time ago."""
    age = (F.lit(now_ns) - mtime_ns) / 1e9
    return F.when(F.lower(suffix(name)).isin(*INCOMPLETE), "incomplete").when(age < max(min_age_seconds, 0), "recent")


def eligible(files: DataFrame, private: list[str], include_existing: bool, now_ns: int, min_age_seconds: int) -> tuple[DataFrame, DataFrame]:
    """(files that take part, with `private`; skipped (source, reason)) from files (path, name, mtime_ns, ...)."""
    path = F.col("path")
    reasoned = files.withColumn("__skip", F.coalesce(scan_reason(path, private, include_existing), age_reason(F.col("name"), F.col("mtime_ns"), now_ns, min_age_seconds)))
    kept = reasoned.filter(F.isnull("__skip")).drop("__skip").withColumn("private", is_private(path, private))
    return kept, reasoned.filter(F.col("__skip") != "-").select(F.col("path").alias("source"), F.col("__skip").alias("reason"))
