"""Bounded evidence of contents, and what changed between two versions of it."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters of a diff that are kept.
DIFF_CHARS = 4000


def latest_evidence(evidence: DataFrame) -> DataFrame:
    """The evidence of the latest run of each fingerprint of evidence (fingerprint, run, ...)."""
    rest = [c for c in evidence.columns if c != "fingerprint"]
    return evidence.groupBy("fingerprint").agg(F.max_by(F.struct(*rest), "run").alias("e")).select("fingerprint", "e.*")


def _lines(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, "\n$", ""), "\n"))


def diff_status(before: Column, after: Column) -> Column:
    """previous-evidence-unavailable, sample-unchanged or changed, by lines."""
    return F.when(F.isnull(before), "previous-evidence-unavailable").when(_lines(before) == _lines(after), "sample-unchanged").otherwise("changed")


def line_delta(before: Column, after: Column) -> tuple[Column, Column]:
    """The distinct lines that were added and removed."""
    a, b = _lines(F.coalesce(before, F.lit(""))), _lines(F.coalesce(after, F.lit("")))
    return F.array_except(b, a), F.array_except(a, b)


@F.pandas_udf(StringType())
def unified_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    """A unified diff with two lines of context, cut to DIFF_CHARS."""

    def one(a: str | None, b: str | None) -> str | None:
        if a is None:
            return None
        return "\n".join(difflib.unified_diff(a.splitlines(), (b or "").splitlines(), fromfile="previous", tofile="current", n=2))[:DIFF_CHARS]

    return pd.Series([one(a, b) for a, b in zip(before, after, strict=True)], dtype=object)


def index(evidence: DataFrame) -> DataFrame:
    """One light row per record of evidence (fingerprint, source, method, text, error, frames)."""
    return evidence.select("fingerprint", "source", "method", F.length(F.coalesce("text", F.lit(""))).alias("characters"), F.coalesce(F.size("frames"), F.lit(0)).alias("frames"), "error")


def still_to_do(jobs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Pending jobs without evidence."""
    return jobs.filter("status = 'pending'").join(evidence.select("fingerprint").distinct(), "fingerprint", "left_anti")


def cacheable(results: DataFrame) -> DataFrame:
    """Results worth keeping; failures are tried again next time."""
    return results.filter(~F.col("method").isin("unavailable", "installation-required", "unsupported") & F.isnull("error"))


def media_result(kind: Column, ocr: Column, speech: Column, frames: Column) -> Column:
    """The branch that counts, of structs (method, text, error): images by OCR, audio by speech, video by speech or frames."""
    spoken = (speech["method"] == "transcription") & (F.trim(F.coalesce(speech["text"], F.lit(""))) != "") & F.isnull(speech["error"])
    return F.when(kind == "image", ocr).when(kind == "audio", speech).when(kind == "video", F.when(spoken, speech).otherwise(frames))
