"""Mixing sources to target weights by Pfair scheduling.

Each source is a tape of its documents' characters, cut into blocks of equal length. Block j (from 0) of a source with
weight w is released at slot floor(j / w) and due by slot ceil((j + 1) / w); at each slot the released block with the
earliest deadline goes out. Weights are exact ratios of integers, so at every slot each source is less than one block
away from its target, however long the mixture is. The driver walks through the schedule once, block by block, and
keeps a few numbers for each block of BLOCK_CHARS characters; rows find their block's slot by a join.

When a source runs out, the others go on with their weights scaled up: the schedule is a sequence of phases, of which
the first holds the targets exactly, and every document goes out once.
"""

from __future__ import annotations

import heapq
import math
from array import array
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Characters of a block.
BLOCK_CHARS = 1 << 16
#: Slots of a period, for weights that are rounded to multiples of 1 / PERIOD.
PERIOD = 1000
#: Sources that a mixture may have: their weights and phases are handled on the driver.
MOST_SOURCES = 1000
#: The exponent by which the default targets flatten the sources' sizes.
FLATTEN = 0.7


def parts(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Slots of each source in a period: at least one, nearest to the weights, `period` in all."""
    if not weights:
        return {}
    period = max(period, len(weights))
    total = sum(weights.values())
    exact = {k: w / total * period for k, w in weights.items()}
    out = {k: max(1, math.floor(x)) for k, x in exact.items()}
    order = sorted(weights, key=lambda k: (out[k] - exact[k], k))
    while (left := period - sum(out.values())) != 0:
        for k in order if left > 0 else reversed(order):
            if left == 0:
                break
            if left > 0 or out[k] > 1:
                out[k] += 1 if left > 0 else -1
                left += -1 if left > 0 else 1
    return out


def schedule(slots: dict[str, int]) -> list[tuple[int, str, int]]:
    """One period by earliest deadline first: (slot, source, block of the source within the period).

    Released blocks wait in a heap by deadline; ties go to the source whose name is first.
    """
    period = sum(slots.values())
    waiting: list[tuple[int, str, int]] = []
    releases = sorted((j * period // a, -(-(j + 1) * period // a), s, j) for s, a in slots.items() for j in range(a))
    out, k = [], 0
    for slot in range(period):
        while k < len(releases) and releases[k][0] <= slot:
            heapq.heappush(waiting, releases[k][1:])
            k += 1
        due, source, j = heapq.heappop(waiting)
        if due <= slot:
            raise AssertionError("a block missed its deadline")
        out.append((slot, source, j))
    return out


def exact(weights: dict[str, float]) -> dict[str, int]:
    """Integers in the ratio of the weights, each taken as the decimal number or fraction that it is written as."""
    read = {s: Fraction(str(w)) for s, w in weights.items()}
    unit = math.lcm(*(f.denominator for f in read.values()))
    whole = {s: f.numerator * (unit // f.denominator) for s, f in read.items()}
    common = math.gcd(*whole.values()) or 1
    return {s: n // common for s, n in whole.items()}


def phases(blocks: dict[str, int], weights: dict[str, float], period: int | None = None) -> list[dict]:
    """The phases of a mixture: each ends when one of its sources has no more blocks.

    Of each: its first slot, its length in slots, its sources' weights as integers, their blocks sent before, and its
    plan: the source of each slot (its place in `names`) and the release and deadline of the block, counted from the
    first slot. Weights are exact, or multiples of 1 / period where one is given.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    sent = dict.fromkeys(left, 0)
    whole = exact({s: weights[s] for s in left}) if left and period is None else {}
    out, begin = [], 0
    while left:
        slots = parts({s: weights[s] for s in left}, period) if period is not None else {s: whole[s] for s in left}
        total, names = sum(slots.values()), sorted(left)
        of, release, due = array("i"), array("q"), array("q")
        phase = {"begin": begin, "slots": slots, "sent": dict(sent), "names": names, "plan": (of, release, due)}
        # Of each source its next block only: as long as it isn't released, by its release, then by its deadline.
        gone = [0] * len(names)
        coming = [(0, k) for k in range(len(names))]
        waiting: list[tuple[int, int, int]] = []
        slot, ended = 0, False
        while not ended:
            while coming and coming[0][0] <= slot:
                released, k = heapq.heappop(coming)
                heapq.heappush(waiting, (-(-(gone[k] + 1) * total // slots[names[k]]), k, released))
            deadline, k, released = heapq.heappop(waiting)
            if deadline <= slot:
                raise AssertionError("a block missed its deadline")
            of.append(k)
            release.append(released)
            due.append(deadline)
            gone[k] += 1
            slot += 1
            heapq.heappush(coming, (gone[k] * total // slots[names[k]], k))
            ended = gone[k] == left[names[k]]
        for s, n in zip(names, gone, strict=True):
            sent[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        out.append(phase | {"size": slot})
        begin += slot
    return out


def flattened(chars: dict[str, int], exponent: float = FLATTEN) -> dict[str, float]:
    """Targets between the sources' own shares (exponent 1) and equal ones (exponent 0)."""
    return {s: max(n, 1) ** exponent for s, n in chars.items()}


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_chars: int = BLOCK_CHARS, period: int | None = None) -> DataFrame:
    """One row per row of docs (doc_id, source, text): doc_id, source, n_chars, block, slot, release, deadline, phase, seq.

    weights: target of each source; by default the sources' sizes to the power FLATTEN. Sources without a target get
    the smallest one. Targets hold exactly, or rounded to multiples of 1 / period where one is given. A null source is a source named "". Rows are laid on their source's tape in the order of a hash
    of doc_id and, for equal ones, of doc_id and length; a row belongs to the block in which it starts, and a null or
    empty text counts as one character. slot: when that block goes out; release and deadline: its window; phase: 0
    while no source has run out; seq: the row's place within its block. (slot, seq) orders the mixture; rows that are
    equal in doc_id and length have places next to each other. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.greatest(F.length(F.coalesce("text", F.lit(""))), F.lit(1)).cast("long").alias("n_chars"),
    )
    # Buckets by hash are the same share of every source, so none of them grows with one source alone.
    n_buckets = max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = written(rows.withColumn("key", key).withColumn("bucket", F.floor((F.col("key") / 2.0**64 + 0.5) * n_buckets).cast("int")), "mix-rows")
    sums = written(rows.groupBy("source", "bucket").agg(F.sum("n_chars").alias("chars")), "mix-sums")
    totals = {r["source"]: r["chars"] for r in sums.groupBy("source").agg(F.sum("chars").alias("chars")).limit(MOST_SOURCES + 1).collect()}
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; group them first")
    if weights is None:
        weights = flattened(totals)
    if any(not w > 0 for w in weights.values()):
        raise ValueError("target weights must be positive")
    least = min(weights.values(), default=1.0)
    weights = {s: weights.get(s, least) for s in totals}
    plan = phases({s: -(-n // block_chars) for s, n in totals.items()}, weights, period)

    # Characters before each bucket of a source: a prefix sum over bucket totals, of which a source has n_buckets.
    before = "coalesce(sum(chars) over (partition by source order by bucket rows between unbounded preceding and 1 preceding), 0)"
    ahead = sums.select("source", "bucket", F.expr(before).alias("ahead"))
    within = "sum(n_chars) over (partition by source, bucket order by key, doc_id, n_chars rows between unbounded preceding and 1 preceding)"
    placed = rows.withColumn("inside", F.coalesce(F.expr(within), F.lit(0)))
    placed = placed.join(ahead, ["source", "bucket"])
    placed = placed.withColumn("start", F.col("ahead") + F.col("inside")).withColumn("block", F.floor(F.col("start") / block_chars))

    names = sorted(totals)
    place = {s: k for k, s in enumerate(names)}
    schema = pa.schema([("of", pa.int32()), ("block", pa.int64()), ("slot", pa.int64()), ("release", pa.int64()), ("deadline", pa.int64()), ("phase", pa.int32())])
    tables = []
    for k, p in enumerate(plan):
        of, release, due = (np.frombuffer(x, x.typecode) for x in p["plan"])
        # The block of a slot: the source's blocks before the phase and, in the phase, before the slot.
        order = np.argsort(of, kind="stable")
        counts = np.bincount(of, minlength=len(p["names"]))
        block = np.empty(len(of), np.int64)
        block[order] = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        block += np.array([p["sent"][s] for s in p["names"]], np.int64)[of]
        source = np.array([place[s] for s in p["names"]], np.int32)[of]
        slot = p["begin"] + np.arange(len(of))
        tables.append(pa.table([source, block, slot, p["begin"] + release, p["begin"] + due, np.full(len(of), k, np.int32)], schema=schema))
    slots = written(spark.createDataFrame(pa.concat_tables(tables) if tables else schema.empty_table()), "mix-slots")
    numbers = spark.createDataFrame(list(enumerate(names)), "of int, source string")
    out = placed.join(F.broadcast(numbers), "source").join(slots, ["of", "block"])
    return out.select("doc_id", "source", "n_chars", "block", "slot", "release", "deadline", "phase", (F.col("start") - F.col("block") * block_chars).alias("seq"))


def share_error(slots: list[str], weights: dict[str, Fraction]) -> Fraction:
    """The largest distance in blocks between a source's blocks sent and its share, over all slots."""
    sent, worst = dict.fromkeys(weights, 0), Fraction(0)
    for t, s in enumerate(slots, 1):
        sent[s] += 1
        worst = max(worst, *(abs(sent[x] - weights[x] * t) for x in weights))
    return worst
