"""The append-only change log: written as Markdown sections, read back as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.naming import markdown_cell, markdown_cells

FIELDS = ("status", "source", "destination", "rename", "reason")


def log_lines(items: DataFrame) -> DataFrame:
    """(log, line_no, line): the log of items (log, run_at, run, ord, five fields); each run is a section with a table."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(markdown_cell(F.coalesce(c, F.lit(""))) for c in FIELDS)), F.lit(" |"))
    rows = items.select("log", "run", (F.col("ord") + 4).cast("long").alias("n"), cells.alias("line"))
    head = items.select("log", "run", "run_at").distinct()
    first = head.select("log", "run", F.posexplode(F.array(F.concat(F.lit("## "), "run_at"), F.lit(""), F.lit("| 状态 | 原位置 | 目标位置 | 名称变化 | 分类依据 |"), F.lit("|---|---|---|---|---|"))).alias("n", "line"))
    every = first.select("log", "run", F.col("n").cast("long").alias("n"), "line").unionByName(rows)
    return every.select("log", F.row_number().over(Window.partitionBy("log").orderBy("run", "n")).alias("line_no"), "line")


def parse(lines: DataFrame) -> DataFrame:
    """(log, run, run_at, ord, five fields) from lines (log, line_no, line), which may be of many logs.

    "## " starts a run; a table is on from its header to the first line that is neither empty nor a row; rows of five
    cells and more are items. Logs are independent: the state runs along the lines of one log only.
    """
    w = Window.partitionBy("log").orderBy("line_no")
    line = F.col("line")
    header, row = F.startswith(line, F.lit("| 状态 |")), F.startswith(line, F.lit("|"))
    begins = F.startswith(line, F.lit("## "))
    # What a line does to the table state: on at a header, off at a section or other text; rows and empty lines keep it.
    switch = F.when(begins, False).when(header, True).when(~row & (F.trim(line) != "") & ~F.startswith(line, F.lit("配置：")), False)
    state = lines.select("*", F.sum(begins.cast("int")).over(w).alias("run"), F.last(F.when(begins, F.trim(F.substring(line, 4, 1 << 20))), ignorenulls=True).over(w).alias("run_at"), F.last(switch, ignorenulls=True).over(w).alias("on"))
    items = state.filter((F.col("run") > 0) & F.col("on") & row & ~header & ~F.startswith(line, F.lit("|---"))).withColumn("cells", markdown_cells(line)).filter(F.size("cells") >= 5)
    ordered = items.withColumn("ord", F.row_number().over(Window.partitionBy("log", "run").orderBy("line_no")))
    return ordered.select("log", "run", "run_at", "ord", *(F.get("cells", F.lit(k)).alias(c) for k, c in enumerate(FIELDS)))


def kpis(items: DataFrame) -> DataFrame:
    """Per log: runs that changed something, and changes."""
    return items.groupBy("log").agg(F.count_distinct("run").alias("runs"), F.count("*").alias("changes"))


def items_per_run(items: DataFrame) -> DataFrame:
    return items.groupBy("log", "run").agg(F.max("run_at").alias("run_at"), F.count("*").alias("items"))
