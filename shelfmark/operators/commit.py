"""From a plan to changes: decisions as a table, side effects on the driver, dry-run by default."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.naming import mapping_error, normalized_path


def decisions(moves: DataFrame, current: DataFrame, allow_rename: bool, include_existing: bool) -> DataFrame:
    """moves (source, destination, category, intent_group, status, size, mtime_ns) with a decision each.

    current: (path, size, mtime_ns) as files are now. In order: broken rules fail; a status other than planned, a
    missing source, a taken destination, a change since the plan, and a destination that an earlier move takes are
    skipped. Several moves to one destination are told apart by the order of their sources.
    """
    error = mapping_error(F.col("source"), F.col("destination"), F.col("category"), F.col("intent_group"), allow_rename, include_existing)
    now = current.select(F.col("path").alias("source"), F.col("size").alias("now_size"), F.col("mtime_ns").alias("now_mtime_ns"))
    taken = current.select(F.col("path").alias("destination")).distinct().withColumn("taken", F.lit(True))
    d = moves.withColumn("error", error).join(now, "source", "left").join(taken, "destination", "left")
    same = F.col("now_size").eqNullSafe(F.col("size")) & F.col("now_mtime_ns").eqNullSafe(F.col("mtime_ns"))
    first = (
        F.when(F.isnotnull("error"), F.concat(F.lit("failed: "), "error"))
        .when(F.col("status") != "planned", "skipped: not planned")
        .when(F.isnull("now_size"), "skipped: no source")
        .when(F.coalesce("taken", F.lit(False)), "skipped: destination exists")
        .when(~same, "skipped: changed")
    )
    d = d.withColumn("decision", first)
    earlier = Window.partitionBy("destination").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.isnull("decision").cast("int")).over(earlier), F.lit(0))
    d = d.withColumn("decision", F.when(F.isnotnull("decision"), F.col("decision")).when(before > 0, "skipped: destination exists").otherwise("move"))
    return d.select("source", "destination", "decision")


def until_failure(decided: DataFrame) -> DataFrame:
    """The decisions that are carried out: those up to the first failure in order of source, itself included."""
    failed = decided.filter(F.startswith("decision", F.lit("failed"))).agg(F.min("source").alias("stop"))
    return decided.crossJoin(F.broadcast(failed)).filter("stop is null or source <= stop").drop("stop")


def state_rows(moved: DataFrame) -> DataFrame:
    """Records for the state table, under the new and under the source fingerprint."""
    return moved.select(F.explode(F.array_distinct(F.array("new_fingerprint", "fingerprint"))).alias("fingerprint"), F.col("destination").alias("path"), "original_name", "category", "size", "mtime_ns")


def upsert(old: DataFrame, new: DataFrame, key: str = "fingerprint") -> DataFrame:
    """old with the rows of new in the place of those that have their keys."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def check_plan(plan: dict, root: str, digest: str, open_analyses: int) -> None:
    """The conditions without which nothing is carried out."""
    if os.path.realpath(plan.get("root", "")) != os.path.realpath(root):
        raise ValueError("the plan is for another root")
    if plan.get("config_digest") != digest:
        raise ValueError("the configuration has changed since the plan")
    if open_analyses:
        raise ValueError("analyses are still open")


def carry_out(decided: DataFrame, root: str, dry_run: bool = True) -> list[tuple[str, str, str]]:
    """Moves files one after another on the driver and stops after the first failure: (source, destination, result).

    Tasks are never given side effects, since Spark may run them twice. Rows come in order, a partition at a time.
    Existing files are never replaced, and nothing leaves the root's device.
    """
    out: list[tuple[str, str, str]] = []
    device = os.stat(root).st_dev
    for row in decided.orderBy("source").toLocalIterator():
        result = row["decision"]
        if result == "move":
            source, destination = os.path.join(root, row["source"]), os.path.join(root, row["destination"])
            if os.path.islink(source) or not os.path.isfile(source):
                result = "skipped: no source"
            elif os.path.lexists(destination):
                result = "skipped: destination exists"
            elif os.stat(source).st_dev != device:
                result = "failed: other device"
            elif dry_run:
                result = "would move"
            else:
                try:
                    os.makedirs(os.path.dirname(destination), exist_ok=True)
                    os.rename(source, destination)
                    result = "moved"
                except OSError as e:
                    result = f"failed: {e.strerror}"
        out.append((row["source"], row["destination"], result))
        if result.startswith("failed"):
            break
    return out


def safe_paths(paths: DataFrame, column: str) -> DataFrame:
    """Adds `normal`: the path inside the root, or null."""
    return paths.withColumn("normal", normalized_path(F.col(column)))
