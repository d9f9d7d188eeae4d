"""URL filters by a temporal list join. DataFrame functions only.

A list is a log of dated entries: on a day, a rule for a host, a domain or a path gets a verdict or is taken off. The
entries of a rule become validity intervals, and an as-of join finds for every capture the entries that were active
when it was fetched; the most specific rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Entries with this verdict take a rule off the list.
REMOVED = "removed"


def host(url: Column) -> Column:
    """The host in lower case, without user, port and final dot; empty if there is none."""
    return F.rtrim(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)), F.lit("."))


def path(url: Column) -> Column:
    """The path from its first slash on, without query and fragment; empty if there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(rule, verdict, since, until) from entries (rule, verdict, day): until is the day of the rule's next entry.

    A rule is a host with all hosts below it ("example.com"), or a host and the start of a path ("example.com/a/b").
    Entries without rule, verdict or day are passed over. Of a rule's entries of one day, that whose verdict sorts last
    holds.
    """
    rules = entries.select(F.rtrim(F.lower(F.col("rule")), F.lit("/")).alias("rule"), "verdict", "day").filter("rule is not null and verdict is not null and day is not null").distinct()
    w = Window.partitionBy("rule").orderBy("day", "verdict")
    spans = rules.select("rule", "verdict", F.col("day").alias("since"), F.lead("day").over(w).alias("until"))
    return spans.filter((F.col("verdict") != REMOVED) & (F.col("until").isNull() | (F.col("until") > F.col("since"))))


def _keys(h: Column, p: Column, depth: int) -> Column:
    """The rules that can hold for a URL, as (rank, rule): the more specific, the higher the rank."""
    labels = F.split(h, r"\.")
    n = F.size(labels)
    hosts = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(k.alias("rank"), F.array_join(F.slice(labels, n - k + 1, k), ".").alias("rule")))
    if not depth:
        return F.when(h != "", hosts)
    # Only whole segments count; a rule for /a holds for /a and /a/b, not for /ab.
    parts = F.filter(F.split(F.lower(p), "/"), lambda s: s != "")
    most = F.least(F.size(parts), F.lit(depth))
    paths = F.when(most > 0, F.transform(F.sequence(F.lit(1), most), lambda k: F.struct((n + k).alias("rank"), F.concat_ws("/", h, F.array_join(F.slice(parts, F.lit(1), k), "/")).alias("rule")))).otherwise(F.array().cast("array<struct<rank:int,rule:string>>"))
    return F.when(h != "", F.concat(hosts, paths))


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per row of captures (page_id, url, fetched): these, and verdict, rule, since of the deciding entry.

    The most specific rule that is active at `fetched` (since <= fetched < until) decides; nulls where there is none,
    which holds for null and malformed URLs and for a null time. Rows are independent: repeated rows, ties and null
    identifiers keep rows of their own. Empty captures give an empty result, an empty list gives no verdicts; other
    columns of either table are not read. Captures of one host may be most of the table: the join is on the rule, and
    its large partitions can be split, since a rule has few intervals.
    """
    spans = intervals(entries)
    depth = spans.agg(F.max(F.size(F.split("rule", "/")) - 1)).head()[0] or 0
    rows = captures.select("page_id", "url", "fetched").withColumn("row", F.monotonically_increasing_id())
    keys = rows.select("row", "fetched", F.explode(_keys(host(F.col("url")), path(F.col("url")), depth)).alias("k")).select("row", "fetched", "k.rank", "k.rule")
    active = keys.join(spans, "rule").filter((F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    best = active.groupBy("row").agg(F.max(F.struct("rank", "since", "verdict", "rule")).alias("b")).select("row", F.col("b.verdict").alias("verdict"), F.col("b.rule").alias("rule"), F.col("b.since").alias("since"))
    return rows.join(best, "row", "left").select("page_id", "url", "fetched", "verdict", "rule", "since")
