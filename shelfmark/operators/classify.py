"""The decision list that puts a file into a category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.dims import CODE_MARKERS, CONFIG_AMBIGUOUS, DEVELOPMENT_DOCS, DOC_AMBIGUOUS, OBJECTIVE_C, SPECIAL_CODE_NAMES
from shelfmark.functions.naming import suffix


def _contains_any(text: Column, markers: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(text, F.lit(m))
    return out


def looks_like_code(head: Column) -> Column:
    """Whether the text of the first 64 KiB has a marker; binary content (with a NUL) has no text."""
    return _contains_any(F.lower(head), CODE_MARKERS)


def classify(files: DataFrame, extensions: DataFrame, content: str | None = None, allow: Column | None = None) -> DataFrame:
    """Adds category and reason to files (name, and a binary column `content` where it may be looked at).

    The list is worked through in order; extensions is (suffix, category), small enough to broadcast by Spark's own
    measure, else joined by hash. allow: where content may be looked at; everywhere by default.
    """
    name, ext = F.lower("name"), F.lower(suffix(F.col("name")))
    files = files.withColumn("__suffix", ext).join(extensions.select(F.col("suffix").alias("__suffix"), F.col("category").alias("__mapped")), "__suffix", "left")
    named = name.isin(*SPECIAL_CODE_NAMES) | F.startswith(name, F.lit("dockerfile.")) | F.startswith(name, F.lit("makefile."))
    development = F.lit(False)
    for word in DEVELOPMENT_DOCS:
        development = development | F.startswith(name, F.lit(word))
    mapped = F.struct(F.col("__mapped").alias("category"), F.concat(F.lit("extension "), "__suffix").alias("reason"))

    def told(category: str, reason: str) -> Column:
        return F.struct(F.lit(category).alias("category"), F.lit(reason).alias("reason"))

    s = F.col("__suffix")
    if content is None:
        seen = F.lit(False)
        may, code, objective, stream = seen, seen, seen, seen
        first = lambda *_: seen
    else:
        raw = F.col(content)
        may = F.lit(True) if allow is None else allow
        head = F.substring(raw, 1, 65536)
        text = F.when(F.contains(head, F.lit(b"\x00")), "").otherwise(F.coalesce(F.try_validate_utf8(head.cast("string")), F.make_valid_utf8(head.cast("string"))))
        # Columns of their own, so that the branches below share them.
        files = files.withColumn("__text", F.when(may, text))
        files = files.withColumns({"__code": F.coalesce(looks_like_code(F.col("__text")), F.lit(False)), "__objective": F.coalesce(_contains_any(F.col("__text"), OBJECTIVE_C), F.lit(False))})
        code, objective = F.col("__code"), F.col("__objective")
        stream = may & (F.length(raw) > 188) & (F.hex(F.substring(raw, 1, 1)) == "47") & (F.hex(F.substring(raw, 189, 1)) == "47")

        def first(*marks: bytes) -> Column:
            out = F.lit(False)
            for m in marks:
                out = out | F.startswith(raw, F.lit(m))
            return may & out

    out = (
        F.when(named, told("代码", "development file name"))
        .when((s == ".ts") & stream, told("视频", "transport stream"))
        .when((s == ".ts") & code, told("代码", "code in content"))
        .when(s == ".ts", told("其它", "ambiguous extension"))
        .when((s == ".m") & objective, told("代码", "code in content"))
        .when(s == ".m", told("其它", "ambiguous extension"))
        .when(s.isin(*DOC_AMBIGUOUS) & development, told("代码", "development document"))
        .when(s.isin(*DOC_AMBIGUOUS) & code, told("代码", "code in content"))
        .when(s.isin(*DOC_AMBIGUOUS), told("文档资料", "markup document"))
        .when(s.isin(*CONFIG_AMBIGUOUS) & code, told("代码", "code in content"))
        .when(s.isin(*CONFIG_AMBIGUOUS), told("其它", "configuration or data"))
        .when(F.isnotnull("__mapped"), mapped)
        .when(first(b"%PDF"), told("文档资料", "PDF content"))
        .when(first(b"\xff\xd8\xff", b"\x89PNG\r\n\x1a\n", b"GIF87a", b"GIF89a"), told("图片", "image content"))
        .when(first(b"#!"), told("代码", "script content"))
        .otherwise(told("其它", "unknown"))
    )
    return files.withColumn("__told", out).select(*[c for c in files.columns if not c.startswith("__")], F.col("__told.category").alias("category"), F.col("__told.reason").alias("reason"))


def category_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("category").agg(F.count("*").alias("files"))
