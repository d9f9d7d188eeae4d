"""Deterministic samples: of positions, of times, and of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cleaning import clean_text


def even_indexes(total: Column, count: Column) -> Column:
    """Up to `count` positions of 0..total-1, evenly spread from the first to the last, rounded half to even."""
    last = F.sequence(F.lit(0), F.greatest(count - 1, F.lit(1)))
    spread = F.transform(last, lambda i: F.bround(i * (total - 1) / F.greatest(count - 1, F.lit(1))).cast("int"))
    return (
        F.when((total <= 0) | (count <= 0), F.array().cast("array<int>"))
        .when(total <= count, F.sequence(F.lit(0), F.greatest(total - 1, F.lit(0))))
        .when(count == 1, F.array(F.lit(0)))
        .otherwise(F.array_sort(F.array_distinct(spread)))
    )


def even_times(duration: Column, count: Column) -> Column:
    """Up to nine times of a recording, from 5 % to 95 % of its duration; one time is its middle."""
    n = F.least(F.greatest(count, F.lit(1)), F.lit(9))
    steps = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(1)))
    return F.when(n == 1, F.array(F.round(duration * 0.5, 6))).otherwise(F.transform(steps, lambda i: F.round(duration * (0.05 + 0.9 * i / F.greatest(n - 1, F.lit(1))), 6)))


def _excerpt(text: Column, budget: Column) -> Column:
    """The whole text if it fits, else its start, middle and end."""
    third = F.greatest(F.lit(1), F.floor((budget - 6) / 3)).cast("int")
    middle = F.greatest(F.lit(0), F.floor(F.length(text) / 2) - F.floor(third / 2)).cast("int")
    sampled = F.concat(F.left(text, third), F.lit("\n…\n"), F.substring(text, middle + 1, third), F.lit("\n…\n"), F.right(text, third))
    return F.when(F.length(text) <= budget, text).otherwise(sampled)


def balanced_parts(parts: Column, limit: int) -> Column:
    """Labelled parts (label, text) that share the limit equally; empty ones are left out."""
    bare = F.transform(parts, lambda p: F.struct(p["label"].alias("label"), F.trim(F.coalesce(p["text"], F.lit("")), F.lit(" \t\n\r\x0b\x0c")).alias("text")))
    kept = F.filter(bare, lambda p: p["text"] != "")
    spent = F.aggregate(kept, F.lit(0), lambda t, p: t + F.length(p["label"]) + 4) + 2 * (F.size(kept) - 1)
    budget = F.greatest(F.lit(1), F.floor((F.lit(limit) - spent) / F.greatest(F.size(kept), F.lit(1)))).cast("int")
    # Zipped with the budget, so that it is worked out once.
    dealt = F.zip_with(kept, F.array_repeat(budget, F.size(kept)), lambda p, b: F.concat(F.lit("["), p["label"], F.lit("]\n"), _excerpt(p["text"], b)))
    return F.when(F.size(kept) > 0, clean_text(F.array_join(dealt, "\n\n"), limit)).otherwise("")


def balanced_excerpt(label: Column, text: Column, limit: int) -> Column:
    """One labelled part: whole if it fits the limit, else its start, middle and end."""
    body = F.trim(text, F.lit(" \t\n\r\x0b\x0c"))
    excerpt = _excerpt(body, F.greatest(F.lit(1), F.lit(limit) - F.length(label) - 4))
    return F.when(F.coalesce(body, F.lit("")) == "", "").otherwise(clean_text(F.concat(F.lit("["), label, F.lit("]\n"), excerpt), limit))
