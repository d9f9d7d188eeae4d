"""Names and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.dims import CATEGORIES, DEVICE_NAMES, GENERATED, MEANINGLESS

_EDGE = " ._-()[]"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """The path without its last segment; empty at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def suffix(name: Column) -> Column:
    """From the last dot on; a leading or a trailing dot starts none."""
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def stem(name: Column) -> Column:
    return F.left(name, F.length(name) - F.length(suffix(name)))


def is_meaningful(normalized_stem: Column) -> Column:
    """Whether a stem (in NFKC) tells something: four word characters, mostly letters, and no camera or hash pattern."""
    s = F.trim(normalized_stem, F.lit(_EDGE))
    compact = F.regexp_replace(s, r"[^\p{L}\p{N}]", "")
    letters = F.length(F.regexp_replace(compact, r"[^\p{L}]", ""))
    digits = F.length(F.regexp_replace(compact, r"[^\p{Nd}]", ""))
    return (F.length(compact) >= 4) & ~s.rlike(MEANINGLESS) & (letters >= 2) & (letters * 2 >= digits)


def clipped(normalized: Column, limit: int) -> Column:
    """A portable name of at most `limit` characters from a text in NFKC; device names get an addition."""
    tail = r"[ .\-_]+$"

    def cut(x: Column) -> Column:
        return F.regexp_replace(F.left(x, F.lit(limit)), tail, "")

    safe = cut(F.trim(F.regexp_replace(normalized, r'[\x00-\x1f<>:"/\\|?*]', "-"), F.lit(" .-_")))
    # A device name is matched and extended in one step, so that the expression isn't repeated.
    return cut(F.regexp_replace(safe, f"(?i)^({'|'.join(DEVICE_NAMES)})$", "$1-文件"))


def dated_name(original: Column, suggested: Column, modified: Column) -> Column:
    """yymmdd-summary with the original suffix; the original name if nothing is left of the suggestion."""
    summary = F.nullif(clipped(stem(suggested), 15), F.lit(""))
    return F.coalesce(F.concat(F.date_format(modified, "yyMMdd"), F.lit("-"), summary, suffix(original)), original)


def joined_path(*parts: Column) -> Column:
    """The parts that aren't empty, joined by slashes."""
    return F.concat_ws("/", *(F.nullif(p, F.lit("")) for p in parts))


def is_private(path: Column, needles: list[str]) -> Column:
    """Whether a segment of the path (in NFKC) contains one of the needles, in any case."""
    segments = F.split(F.lower(path), "/")
    found = [F.exists(segments, _contains(n.casefold())) for n in needles]
    out = F.lit(False)
    for f in found:
        out = out | f
    return out


def _contains(needle: str):
    return lambda s: F.contains(s, F.lit(needle))


def is_hidden(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda s: F.startswith(s, F.lit(".")))


def human_size(size: Column) -> Column:
    """Bytes as B, and from 1,024 on with two decimals in KB to TB; ties go to the even digit."""

    def shown(k: int, unit: str) -> Column:
        return F.format_string(f"%.2f {unit}", F.bround(size / 1024.0**k, 2))

    out = shown(4, "TB")
    for k, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(size < 1024.0 ** (k + 1), shown(k, unit)).otherwise(out)
    return F.when(size < 1024, F.format_string("%d B", size.cast("long"))).otherwise(out)


def parsed_bool(value: Column) -> Column:
    """True, false, or an error for anything but the words for yes and no."""
    v = F.lower(F.trim(value))
    yes, no = ("yes", "y", "true", "1", "是", "允许"), ("no", "n", "false", "0", "否", "不允许")
    return F.when(v.isin(*yes), True).when(v.isin(*no), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(value, F.lit("null")))).cast("boolean"))


def private_names(value: Column) -> Column:
    """Distinct sorted names from a list with commas; none for empty and for words that say so."""
    parts = F.filter(F.transform(F.split(value, "[、,，]"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.lower(F.trim(value)).isin("", "无", "none", "no", "没有"), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(parts)))


def markdown_cell(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def markdown_cells(line: Column) -> Column:
    """Cells of a table row; a bar after a backslash belongs to its cell, and backslashes go."""
    inner = F.regexp_replace(F.trim(line), r"^\|+|(?<!\\)\|+$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.trim(F.regexp_replace(c, r"\\(.)", "$1")))


def html_text(value: Column) -> Column:
    out = value
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def normalized_path(path: Column) -> Column:
    """The path with "." and ".." worked out; null where it leaves the root or is the root itself."""

    def step(acc: Column, s: Column) -> Column:
        up = F.when(F.size(acc["p"]) > 0, F.struct(acc["ok"].alias("ok"), F.slice(acc["p"], F.lit(1), F.greatest(F.size(acc["p"]) - 1, F.lit(0))).alias("p"))).otherwise(F.struct(F.lit(False).alias("ok"), acc["p"].alias("p")))
        return F.when(s.isin("", "."), acc).when(s == "..", up).otherwise(F.struct(acc["ok"].alias("ok"), F.concat(acc["p"], F.array(s)).alias("p")))

    start = F.struct(F.lit(True).alias("ok"), F.array().cast("array<string>").alias("p"))
    joined = F.aggregate(F.split(path, "/"), start, step, lambda acc: F.when(acc["ok"], F.array_join(acc["p"], "/")))
    return F.when(~F.startswith(path, F.lit("/")), F.nullif(joined, F.lit("")))


def mapping_error(source: Column, destination: Column, category: Column, group: Column, allow_rename: bool, include_existing: bool) -> Column:
    """The first rule that a move breaks, or null: category, folder, generated, existing, rename, outside."""
    folder, home = parent(destination), F.concat_ws("/", category, F.nullif(group, F.lit("")))
    names = [base_name(source), base_name(destination)]
    out = F.when(~F.coalesce(category, F.lit("")).isin(*CATEGORIES), "category").when((folder != category) & (folder != home), "folder").when(names[0].isin(*GENERATED) | names[1].isin(*GENERATED), "generated")
    if not include_existing:
        out = out.when(parent(source) != "", "existing")
    if not allow_rename:
        out = out.when(names[0] != names[1], "rename")
    return out.when(normalized_path(source).isNull() | normalized_path(destination).isNull(), "outside")
