"""The plan: which file goes where under which name, what has to be analysed first, and what is passed over."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.dims import CATEGORIES
from shelfmark.functions.naming import clipped, dated_name, is_meaningful, joined_path, stem
from shelfmark.functions.unicode import nfkc
from shelfmark.operators.classify import classify
from shelfmark.operators.filters import eligible


@dataclass(frozen=True)
class Config:
    """What the user allows. trust: meaningful names need no analysis."""

    allow_rename: bool = True
    include_existing: bool = True
    trust: bool = True
    private: tuple[str, ...] = ()
    min_age_seconds: int = 600


@dataclass
class Plan:
    moves: DataFrame
    analysis: DataFrame
    skipped: DataFrame
    notes: dict = field(default_factory=dict)


def latest_state_by_path(state: DataFrame) -> DataFrame:
    """The last record (by ord) of each path of state (fingerprint, path, size, mtime_ns, ord)."""
    last = F.max_by(F.struct(F.col("fingerprint").alias("old_fingerprint"), F.col("size").alias("old_size"), F.col("mtime_ns").alias("old_mtime_ns")), "ord")
    return state.groupBy("path").agg(last.alias("r")).select("path", "r.*")


def with_caches(files: DataFrame, intent: DataFrame, state: DataFrame) -> DataFrame:
    """files (path, fingerprint, size, mtime_ns, ...) with what is known: intent, state hit, and a changed version.

    Caches are keyed tables; all joins are left outer and on unique keys.
    """
    known = intent.select("fingerprint", F.struct("intent", "suggested_name", "intent_group", F.col("category").alias("told_category"), "confidence").alias("cached")).dropDuplicates(["fingerprint"])
    hits = state.select("fingerprint").distinct().withColumn("state_hit", F.lit(True))
    out = files.join(known, "fingerprint", "left").join(hits, "fingerprint", "left").join(latest_state_by_path(state), "path", "left")
    hit = F.coalesce("state_hit", F.lit(False))
    other = F.isnotnull("old_fingerprint") & (F.col("old_fingerprint") != F.col("fingerprint"))
    differs = ~(F.col("old_size").eqNullSafe(F.col("size")) & F.col("old_mtime_ns").eqNullSafe(F.col("mtime_ns")))
    changed = F.isnotnull("old_fingerprint") & ~hit & differs
    return out.withColumns({"state_hit": hit, "changed": changed, "previous_fingerprint": F.when(other, F.col("old_fingerprint")).otherwise("")}).drop("old_fingerprint", "old_size", "old_mtime_ns")


def make_plan(files: DataFrame, intent: DataFrame, state: DataFrame, extensions: DataFrame, config: Config, now_ns: int, existing: DataFrame | None = None) -> Plan:
    """Plans files (path, name, size, mtime_ns, fingerprint, and binary content or null where it may not be read).

    existing: (path) of the listing that destinations may clash with; the files themselves by default. Private files
    keep their names, and suggestions count only where renaming is allowed. The k-th file that wants one destination
    has place k; all but the first would clash when the plan is applied.
    """
    kept, skipped = eligible(files, list(config.private), config.include_existing, now_ns, config.min_age_seconds)
    f = with_caches(kept, intent, state)
    top = F.substring_index("path", "/", 1)
    in_category = F.contains(F.col("path"), F.lit("/")) & top.isin(*CATEGORIES)
    f = f.withColumn("already_organized", F.col("state_hit") | (in_category & ~F.col("changed")))
    f = classify(f, extensions, "content", F.lit(config.allow_rename) & ~F.col("private") & ~F.col("already_organized")).drop("content")
    f = f.withColumn("meaningful", is_meaningful(nfkc(stem(F.col("name")))))
    trust = config.trust and config.allow_rename
    doubt = F.col("changed") | F.col("private") | F.lit(not trust) | ~F.col("meaningful")
    needed = F.lit(config.allow_rename) & ~F.col("already_organized") & ~F.col("category").isin("安装包", "压缩包") & doubt & F.isnull("cached")
    sure = F.coalesce(F.col("cached.confidence").isin("high", "medium"), F.lit(False))
    usable = sure & F.lit(config.allow_rename) & ~F.col("private")
    recategorised = usable & F.coalesce(F.col("cached.told_category").isin(*CATEGORIES), F.lit(False))
    f = f.withColumns(
        {
            "needed": needed,
            "suggested": F.when(usable, nfkc(F.coalesce("cached.suggested_name", F.lit("")))).otherwise(""),
            "intent_group": F.when(sure, clipped(nfkc(F.coalesce("cached.intent_group", F.lit(""))), 8)).otherwise(""),
            "reason": F.when(recategorised, F.concat(F.lit("intent: "), F.coalesce("cached.intent", F.lit("")))).otherwise(F.col("reason")),
            "category": F.when(recategorised, F.col("cached.told_category")).otherwise(F.col("category")),
        }
    )
    modified = F.timestamp_micros(F.floor(F.col("mtime_ns") / 1000))
    f = f.withColumn("new_name", F.when(F.col("suggested") == "", F.col("name")).otherwise(dated_name(F.col("name"), F.col("suggested"), modified)))
    f = f.withColumn("destination", joined_path(F.col("category"), F.col("intent_group"), F.col("new_name")))
    settled = f.filter("path = destination").select(F.col("path").alias("source"), F.lit("settled").alias("reason"))
    taken = (existing if existing is not None else files).select(F.col("path").alias("destination")).distinct().withColumn("taken", F.lit(True))
    status = F.when(F.col("needed"), "analysis-required").when(F.coalesce("taken", F.lit(False)), "conflict").otherwise("planned")
    # Counting only the files that move, and filtering after the window: the filter would otherwise be pushed down and
    # work out the whole destination once more.
    place = F.expr("cast(count_if(path <> destination) over (partition by destination order by lower(path), path) as int)")
    moves = f.join(taken, "destination", "left").withColumns({"status": status, "place": place}).filter("path <> destination")
    moves = moves.select(
        F.col("path").alias("source"), "destination", F.col("name").alias("original_name"), "new_name", (F.col("name") != F.col("new_name")).alias("renamed"), "intent_group", "category", "reason", "status", "private", "already_organized", "fingerprint", "size", "mtime_ns", "place"
    )
    analysis = f.filter("needed").select(
        F.col("path").alias("source"), "fingerprint", "previous_fingerprint", F.when(F.col("changed"), "modified").otherwise("new").alias("cache_status"), F.col("category").alias("media_category"),
        F.when(F.col("private"), "filename-only").otherwise("content").alias("method_required"),
        F.when(F.col("private") | F.col("meaningful"), stem(F.col("name"))).otherwise("").alias("name_hint"),
        depth(F.col("private"), F.col("changed"), F.col("meaningful"), trust).alias("analysis_depth"),
    )
    return Plan(moves, analysis, skipped.unionByName(settled))


def depth(private: Column, changed: Column, meaningful: Column, trust: bool) -> Column:
    """How a file is to be analysed."""
    return F.when(private, "filename-only").when(changed, "diff").when(F.lit(not trust) & meaningful, "targeted").otherwise("full")


def plan_folders(folders: DataFrame, intent: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """(renames, analysis) of top-level folders (path, fingerprint), if renaming and existing folders are allowed."""
    if not (config.allow_rename and config.include_existing):
        folders = folders.limit(0)
    f = folders.join(intent.select("fingerprint", "suggested_name", "intent", "confidence").dropDuplicates(["fingerprint"]), "fingerprint", "left")
    meaningful = is_meaningful(nfkc(stem(F.col("path"))))
    needed = F.isnull("confidence") & (F.lit(not config.trust) | ~meaningful)
    name = F.when(F.col("confidence").isin("high", "medium"), clipped(nfkc("suggested_name"), 8)).otherwise("")
    f = f.withColumns({"needed": needed, "new_name": F.when(F.coalesce(name, F.lit("")) == "", F.col("path")).otherwise(name), "meaningful": meaningful})
    taken = folders.select(F.col("path").alias("new_name"), F.lit(True).alias("taken"))
    renames = f.filter("new_name <> path").join(taken, "new_name", "left")
    renames = renames.select(F.col("path").alias("source"), F.col("new_name").alias("destination"), F.when(F.coalesce("taken", F.lit(False)), "conflict").otherwise("planned").alias("status"), "fingerprint")
    analysis = f.filter("needed").select(F.col("path").alias("source"), "fingerprint", F.when(F.col("meaningful"), F.col("path")).otherwise("").alias("name_hint"), F.when(F.lit(not config.trust) & F.col("meaningful"), "targeted").otherwise("full").alias("analysis_depth"))
    return renames, analysis
