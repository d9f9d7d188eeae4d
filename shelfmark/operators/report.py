"""Reports: facts per file, the intent index, counts, and an HTML page."""

from __future__ import annotations

import html
import string

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.naming import base_name, clipped, human_size, markdown_cell
from shelfmark.functions.unicode import nfkc


def metadata(state: DataFrame, results: DataFrame) -> DataFrame:
    """(path, original) of files that were organised: what this run moved comes before the state table.

    state: (path, original_name, ord); results: (source, destination, moved).
    """
    new = results.filter("moved").select(F.col("destination").alias("path"), base_name(F.col("source")).alias("original"), F.lit(1).alias("rank"), F.lit(0).cast("long").alias("ord"))
    old = state.select("path", F.coalesce(F.nullif("original_name", F.lit("")), base_name(F.col("path"))).alias("original"), F.lit(0).alias("rank"), F.col("ord").cast("long").alias("ord"))
    return old.unionByName(new).groupBy("path").agg(F.max_by("original", F.struct("rank", "ord")).alias("original"))


def file_facts(files: DataFrame, known: DataFrame) -> DataFrame:
    """Original and current name, time and size of each file of files (path, size, mtime_ns)."""
    f = files.join(known, "path", "left")
    name = base_name(F.col("path"))
    return f.select("path", F.coalesce("original", name).alias("original"), name.alias("current"), F.timestamp_micros(F.floor(F.col("mtime_ns") / 1000)).alias("modified"), human_size(F.col("size")).alias("human_size"), "size")


def intent_index(intent: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows of the index as Markdown, one per fingerprint: intent (fingerprint, path, source, intent, ...), paths (fingerprint, path)."""
    p = paths.select("fingerprint", F.col("path").alias("moved_to"))
    where = F.coalesce(F.nullif("moved_to", F.lit("")), F.nullif("path", F.lit("")), "source", F.lit(""))
    cells = [F.left("fingerprint", F.lit(16)), where, F.coalesce("intent", F.lit("")), clipped(nfkc(F.coalesce("intent_group", F.lit(""))), 8), F.coalesce("method", F.lit("")), F.coalesce("confidence", F.lit(""))]
    return intent.join(p, "fingerprint", "left").select("fingerprint", F.concat(F.lit("| "), F.concat_ws(" | ", *map(markdown_cell, cells)), F.lit(" |")).alias("line"))


def chronology(items: DataFrame) -> DataFrame:
    """Runs newest first: place 1 is the one that a page shows open."""
    runs = items.groupBy("log", "run").agg(F.max("run_at").alias("run_at"), F.count("*").alias("items"))
    return runs.withColumn("place", F.row_number().over(Window.partitionBy("log").orderBy(F.desc("run"))))


_PAGE = string.Template(
    "<!doctype html><html lang='zh-CN'><head><meta charset='utf-8'><title>$title</title></head><body><h1>$title</h1>"
    "<p>$runs runs, $changes changes, $files files</p><h2>Files</h2>$tree<h2>History</h2>$history</body></html>"
)


def html_page(title: str, facts: DataFrame, items: DataFrame) -> str:
    """A page over all files and all items of the history; rows are streamed to the driver, and the page is built there."""
    esc = lambda v: html.escape("" if v is None else str(v), quote=True)
    by: dict[str, list[str]] = {}
    for r in facts.orderBy("path").toLocalIterator():
        by.setdefault(r["path"].split("/", 1)[0], []).append(f"<li title='{esc(r['original'])} {esc(r['human_size'])}'>{esc(r['path'])}</li>")
    tree = "".join(f"<details><summary>{esc(c)} <b>{len(x)}</b></summary><ul>{''.join(x)}</ul></details>" for c, x in by.items()) or "<p>none</p>"
    runs: dict[tuple, list[str]] = {}
    for r in items.orderBy(F.desc("run"), "ord").toLocalIterator():
        runs.setdefault((r["run"], r["run_at"]), []).append("<tr>" + "".join(f"<td>{esc(r[c])}</td>" for c in ("status", "source", "destination", "rename", "reason")) + "</tr>")
    history = "".join(f"<details{' open' if k == 0 else ''}><summary>{esc(at)} <b>{len(x)}</b></summary><table>{''.join(x)}</table></details>" for k, ((_, at), x) in enumerate(runs.items())) or "<p>none</p>"
    return _PAGE.substitute(title=esc(title), runs=len(runs), changes=sum(map(len, runs.values())), files=sum(map(len, by.values())), tree=tree, history=history)
