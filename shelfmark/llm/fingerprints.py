"""Document fingerprints by consistent weighted sampling. DataFrame functions only.

A text is a bag of words, each word weighted by its count w. For sample i a word has r and c from Gamma(2, 1) and b
from U(0, 1), all functions of its hash; t = floor(ln w / r + b), and the word with the least
ln a = ln c - r (t - b + 1) is the sample, together with t. Two texts have the same sample with a chance that equals
the generalised Jaccard similarity of their bags: the sum of lesser weights over the sum of greater ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Samples of a fingerprint.
SAMPLES = 48
#: Hex digits of a sample; two different samples agree by chance once in 65,536 times.
_HEX = 4
_LOWEST = -(1 << 63)


def _uniform(bits: Column, shift: int) -> Column:
    """21 of the bits as a number within (0, 2**21); logarithms and products take the factor out later."""
    return F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << 21) - 1)).cast("double") + 0.5


def _samples(word: Column, i: int, logs: list[Column]) -> list[Column]:
    """ln a of sample i of a word under each of the log weights; null where that is null.

    Nothing here is conditional, so the hashes and logarithms that the weights share are computed once.
    """
    x = F.xxhash64(word, F.lit(i))
    y = F.xxhash64(x)
    scale = 42 * math.log(2)
    minus_r = F.log(_uniform(x, 0) * _uniform(x, 21)) - scale
    log_c = F.log(scale - F.log(_uniform(x, 42) * _uniform(y, 0)))
    b = _uniform(y, 21) * 2.0**-21
    per_r, rest = F.lit(-1.0) / minus_r, F.lit(1.0) - b
    return [log_c + minus_r * (F.floor(w * per_r + b).cast("double") + rest) for w in logs]


def agreement(a: Column, b: Column, samples: int) -> Column:
    """The share of samples in which two fingerprints agree."""
    same = [(F.substring(a, 1 + _HEX * i, _HEX) == F.substring(b, 1 + _HEX * i, _HEX)).cast("int") for i in range(samples)]
    return F.aggregate(F.array(*same), F.lit(0), lambda t, x: t + x) / float(samples)


def _print(values: list[Column]) -> Column:
    """The samples as hex digits; a bag without words has zeros."""

    def digits(v: Column) -> Column:
        return F.lower(F.lpad(F.hex(F.xxhash64(v).bitwiseAND(F.lit((1 << 4 * _HEX) - 1))), _HEX, "0"))

    return F.concat(*(F.when(v.isNull(), F.lit("0" * _HEX)).otherwise(digits(v)) for v in values))


def _neighbours(docs: DataFrame) -> DataFrame:
    """(bucket, row, next_row, doc_id, text, following): each row with the row after it in descending order of doc_id.

    Buckets are ranges of doc_id, found from approximate quantiles; the first row of each bucket is also dealt to the
    bucket before it, so that no bucket needs another one. Rows with one doc_id are in the order of a hash of their
    texts; where they take up several quantiles, they are parted by that hash.
    """
    spark = docs.sparkSession
    bits = max(3, (8 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    n = (1 << bits) - 1
    order = F.coalesce(F.col("doc_id"), F.lit(_LOWEST))
    cuts = docs.agg(F.percentile_approx(order, [k / (n + 1) for k in range(n, 0, -1)], 4 * (n + 1)).alias("q")).head()["q"] or [_LOWEST] * n
    times = [cuts.count(c) if k == 0 or cuts[k - 1] != c else 0 for k, c in enumerate(cuts)]
    rows = docs.withColumns({"order": order, "tie": F.xxhash64("text"), "bucket": F.lit(0)})
    for k in reversed(range(bits)):
        # A step of a binary search for the number of cuts above the row.
        ahead = F.get(F.lit(cuts), F.col("bucket") + ((1 << k) - 1)) > F.col("order")
        rows = rows.withColumn("bucket", F.col("bucket") + F.when(ahead, 1 << k).otherwise(0))
    # A doc_id at which several cuts lie has as many buckets, by ranges of the hash.
    part = F.floor((F.col("tie") / 2.0**64 + 0.5) * F.get(F.lit(times), F.col("bucket"))).cast("int")
    split = (F.get(F.lit(cuts), F.col("bucket")) == F.col("order")) & (F.get(F.lit(times), F.col("bucket")) > 1)
    rows = rows.withColumn("bucket", F.col("bucket") + F.when(split, F.least(part, F.get(F.lit(times), F.col("bucket")) - 1)).otherwise(0))
    firsts = rows.groupBy("bucket").agg(F.max(F.struct("order", F.bitwise_not("tie").alias("not_tie"))).alias("top")).select("bucket", "top.*")
    tops = {r["bucket"]: (r["order"], ~r["not_tie"]) for r in firsts.collect()}
    used = sorted(tops)
    before = {b: used[k - 1] for k, b in enumerate(used)}
    top, first_tie = (F.get(F.lit([tops.get(b, (0, 0))[k] for b in range(n + 1)]), F.col("bucket")) for k in (0, 1))
    target = F.get(F.lit([before.get(b, 0) for b in range(n + 1)]), F.col("bucket"))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("ghost"))
    copies = F.when((F.col("order") == top) & (F.col("tie") == first_tie), F.array(own, F.struct(target.alias("bucket"), F.lit(1).alias("ghost")))).otherwise(F.array(own))
    dealt = rows.select("doc_id", "text", "order", "tie", F.col("bucket").alias("home"), F.explode(copies).alias("to")).select("doc_id", "text", "order", "tie", "home", "to.bucket", "to.ghost")
    dealt = dealt.repartition(n + 1, "bucket")
    window = "over (partition by bucket order by ghost, order desc, tie, text)"
    numbered = dealt.selectExpr("*", f"row_number() {window} as place", f"lead(text) {window} as following", f"lead(ghost) {window} as ghost_next", f"lead(home) {window} as home_next")
    row = F.shiftleft(F.col("bucket").cast("long"), 32)
    after = F.when(F.col("ghost_next") == 1, F.shiftleft(F.col("home_next").cast("long"), 32) + 1).otherwise(row + F.col("place") + 1)
    return numbered.filter("ghost = 0").select("bucket", (row + F.col("place")).alias("row"), after.alias("next_row"), "doc_id", "text", "following")


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The edited text is the text with its last third replaced by as much of the start of the next document's text, in
    descending order of doc_id (after the last comes the first; a null doc_id comes last; rows that share a doc_id are
    in the order of a hash of their texts, so those that share the text as well are in one task). A null text counts as empty. Texts without words have a fingerprint of zeros, and
    agree with one another. An empty table gives an empty result; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = _neighbours(docs).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("kept", F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 3) as int))")).withColumn("new", F.substring("following", F.lit(1), third))
    rows = rows.withColumn("edited", F.unhex(F.sha2(F.concat("kept", "new"), 256)))
    # Both texts begin with the words before the last space of what is kept, so these are counted once for both.
    rows = rows.withColumn("cut", F.length("kept") - F.length(F.substring_index("kept", " ", -1)))
    rest = F.expr("substring(text, cut + 1)")
    new_rest = F.concat(F.expr("substring(kept, cut + 1)"), F.col("new"))
    shared = F.expr("substring(text, 1, cut)")
    pieces = F.array(*(F.struct(p.alias("piece"), F.lit(a).alias("in_text"), F.lit(b).alias("in_edited")) for p, a, b in ((shared, 1, 1), (rest, 1, 0), (new_rest, 0, 1))))
    # In one column, so that the samples' aggregation has no more than 100 and Spark generates its code as a whole.
    rows = rows.withColumn("about", F.concat_ws(":", "next_row", "n_chars", F.lower(F.hex("edited")), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    key = ["bucket", "row", "about"]
    parts = rows.select(*key, F.inline(pieces))
    words = parts.select(*key, "in_text", "in_edited", F.explode(F.split(F.lower("piece"), "[ \\t-\\r]+")).alias("word"))
    words = words.select(*key, F.when(F.col("word") != "", F.xxhash64("word")).alias("word"), "in_text", "in_edited")
    # All rows of a bucket are in one partition, and bucket is a key: neither grouping moves a row.
    bags = words.groupBy(*key, "word").agg(F.sum("in_text").alias("wt"), F.sum("in_edited").alias("we"))
    # The logarithm of 0 is null, and so is that of what isn't a word; nulls are no candidates.
    bags = bags.select(*key, "word", *(F.log(F.when(F.isnotnull("word"), F.col(w))).alias(w) for w in ("wt", "we")))
    both = [_samples(F.col("word"), i, [F.col("wt"), F.col("we")]) for i in range(samples)]
    least = bags.groupBy(*key).agg(*(F.min(t).alias(f"t{i}") for i, (t, _) in enumerate(both)), *(F.min(e).alias(f"e{i}") for i, (_, e) in enumerate(both)))
    next_row, n_chars, edited, doc_id = (F.split_part("about", F.lit(":"), F.lit(k)) for k in range(1, 5))
    told = least.select("row", next_row.cast("long").alias("next_row"), F.nullif(doc_id, F.lit("")).cast("long").alias("doc_id"), n_chars.cast("long").alias("n_chars"), edited.alias("edited_sha256"), _print([F.col(f"t{i}") for i in range(samples)]).alias("fingerprint"), _print([F.col(f"e{i}") for i in range(samples)]).alias("edited_fingerprint"))
    told = written(told, "fingerprints")
    nexts = told.select(F.col("row").alias("next_row"), F.col("fingerprint").alias("next_fingerprint"))
    out = told.join(nexts, "next_row")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", agreement(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"), agreement(F.col("fingerprint"), F.col("next_fingerprint"), samples).alias("near_next"))
