"""Texts made fit for evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(text: Column, limit: int) -> Column:
    """Control characters and runs of blanks as one blank, at most one empty line, trimmed and cut."""
    out = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]+", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.left(F.trim(out, F.lit(" \t\n\r\x0b\x0c")), F.lit(limit))
