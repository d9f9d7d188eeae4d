"""Two trees compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tree_changes(left: DataFrame, right: DataFrame, keep: tuple[str, ...] = ("README.md",), excluded: tuple[str, ...] = (".git", "__pycache__", ".cache")) -> DataFrame:
    """(path, action) that would make right equal to left: update what is missing or differs, remove what is only right.

    Both are (path, digest). Nothing is carried out; `keep` is never removed.
    """

    def parts(t: DataFrame, name: str) -> DataFrame:
        return t.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, excluded)))).select("path", F.col("digest").alias(name))

    both = parts(left, "l").join(parts(right, "r"), "path", "full_outer")
    action = F.when(F.isnotnull("l") & ~F.col("l").eqNullSafe(F.col("r")), "update").when(F.isnull("l") & ~F.col("path").isin(*keep), "remove")
    return both.select("path", action.alias("action")).filter("action is not null")


def new_only(source: DataFrame, target: DataFrame) -> DataFrame:
    """What a copy that never replaces anything would copy."""
    return source.join(target.select("path"), "path", "left_anti")
