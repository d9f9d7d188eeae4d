"""The queue of analysis jobs as an append-only table of events, and the tables derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A job in one of these is done.
TERMINAL = ("completed", "failed", "unavailable", "stale", "skipped")
RETRIES, BATCH, MOST_CLAIMED, LEASE_MINUTES = 2, 12, 20, 30


def created(analysis: DataFrame, files: DataFrame) -> DataFrame:
    """First events of a run: one pending job per analysis row, with the file's size and time (null if it is gone)."""
    now = files.select(F.col("path").alias("source"), "size", "mtime_ns")
    return analysis.join(now, "source", "left").withColumns({"seq": F.lit(0).cast("long"), "status": F.lit("pending"), "attempts": F.lit(0)})


def latest(events: DataFrame) -> DataFrame:
    """The last event of each job of events (job, seq, status, ts, ...), and the number of its claims."""
    last = events.groupBy("job").agg(F.max_by(F.struct("seq", "status", "ts"), "seq").alias("e"), F.count_if(F.col("status") == "running").alias("attempts"))
    return last.select("job", "e.seq", "e.status", "e.ts", "attempts")


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("jobs"))


def summary(jobs: DataFrame) -> DataFrame:
    """total, done, remaining and status; a run without jobs is completed."""
    s = jobs.agg(F.count("*").alias("total"), F.count_if(F.col("status").isin(*TERMINAL)).alias("done"))
    return s.select("total", "done", (F.col("total") - F.col("done")).alias("remaining"), F.when(F.col("total") == F.col("done"), "completed").otherwise("running").alias("status"))


def expired(jobs: DataFrame, now, minutes: int = LEASE_MINUTES) -> DataFrame:
    """Running jobs whose lease is over, or whose start isn't known: they are pending again."""
    cutoff = now - F.expr(f"interval {int(minutes)} minutes")
    return jobs.filter((F.col("status") == "running") & (F.isnull("ts") | (F.col("ts") < cutoff)))


def claimed(jobs: DataFrame, limit: int = BATCH) -> DataFrame:
    """The first pending jobs in order of their keys: a worker's batch, of 1 to 20 jobs."""
    return jobs.filter("status = 'pending'").orderBy("job").limit(max(1, min(limit, MOST_CLAIMED))).select("job", (F.col("attempts") + 1).alias("attempts"))


def completed(results: DataFrame, retries: int = RETRIES) -> DataFrame:
    """Transitions of results (job, status, attempts, size, mtime_ns, now_size, now_mtime_ns).

    A result for a file that has changed or gone is stale; a failure is tried again while attempts are left.
    """
    same = F.col("now_size").eqNullSafe(F.col("size")) & F.col("now_mtime_ns").eqNullSafe(F.col("mtime_ns")) & F.isnotnull("now_size")
    told = F.when((F.col("status") == "completed") & ~same, "stale").otherwise(F.col("status"))
    r = results.withColumn("told", told).withColumn("will_retry", (F.col("told") == "failed") & (F.col("attempts") < retries))
    return r.select("job", F.col("told").alias("result"), F.when(F.col("will_retry"), "pending").otherwise(F.col("told")).alias("next_status"), "will_retry")


def last_attempts(attempts: DataFrame) -> DataFrame:
    """The result of the highest attempt of each job of attempts (job, attempt, ...)."""
    rest = [c for c in attempts.columns if c != "job"]
    return attempts.groupBy("job").agg(F.max_by(F.struct(*rest), "attempt").alias("r")).select("job", "r.*")


def merged(jobs: DataFrame, results: DataFrame, intent: DataFrame) -> DataFrame:
    """The intent table after a finished run: jobs (job, status, source, previous), results (job, attempt, intent,
    suggested_name, intent_group, method, confidence, error).

    Unavailable jobs leave an entry of low confidence; completed ones need all five fields; an entry takes the place
    of one with its key, and what it supersedes goes.
    """
    r = jobs.join(last_attempts(results), "job", "left")
    off = F.col("status") == "unavailable"
    whole = (F.col("status") == "completed") & F.isnotnull("intent") & F.isnotnull("suggested_name") & F.isnotnull("intent_group") & F.isnotnull("method") & F.isnotnull("confidence")
    new = r.filter(off | whole).select(
        F.col("job").alias("fingerprint"), "source",
        *(F.when(off, "").otherwise(F.col(c)).alias(c) for c in ("intent", "suggested_name", "intent_group")),
        F.when(off, "unavailable").otherwise(F.col("method")).alias("method"), F.when(off, "low").otherwise(F.col("confidence")).alias("confidence"),
        F.when(off, F.coalesce("error", F.lit("unavailable"))).alias("error"),
        F.when(~off & (F.coalesce("previous", F.lit("")) != "") & (F.col("previous") != F.col("job")), F.col("previous")).alias("supersedes"),
    )
    old = intent.select(new.columns).join(new.select("fingerprint"), "fingerprint", "left_anti")
    return retired(old.unionByName(new))


def retired(intent: DataFrame) -> DataFrame:
    """Without the entries that another one supersedes."""
    gone = intent.filter("supersedes is not null and supersedes <> ''").select(F.col("supersedes").alias("fingerprint")).distinct()
    return intent.join(gone, "fingerprint", "left_anti").select(intent.columns)
