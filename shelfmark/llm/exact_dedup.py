"""Exact deduplication with a log-structured merge index.

Each task fills memtables that hold every text once with the identifiers of its copies; a full memtable is flushed as
one run, sorted by digest. Compaction merges all runs by digest and keeps one identifier for each. Digests found in
more than one run are hits: a fixed-size Bloom filter over them picks the texts that a second scan brings together,
and their bytes are compared. Texts whose bytes differ under one digest are regrouped by the texts themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_bit, filter_hits, key_filter, written

#: Bytes of texts and identifiers that a memtable holds before it is flushed.
MEMTABLE_BYTES = 16 << 20

#: What an identifier in a memtable counts besides its text.
ENTRY_BYTES = 64

_RUNS = "entry long, digest binary, sha binary, best long, n long, ids array<long>"


def _flush(table: dict[bytes, list], run: int, keep_largest: bool) -> pa.RecordBatch:
    rows = sorted(((sha, ids) for sha, ids in table.values()), key=lambda r: r[0])
    pick = max if keep_largest else min
    best = [pick((i for i in ids if i is not None), default=None) for _, (_, ids) in rows]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([(run << 24) + k for k in range(len(rows))], pa.int64()),
            pa.array([d for d, _ in rows], pa.binary()),
            pa.array([sha for _, (sha, _) in rows], pa.binary()),
            pa.array(best, pa.int64()),
            pa.array([len(ids) for _, (_, ids) in rows], pa.int64()),
            pa.array([ids for _, (_, ids) in rows], pa.list_(pa.int64())),
        ],
        ["entry", "digest", "sha", "best", "n", "ids"],
    )


def _memtables(digest_bytes: int, keep_largest: bool, memtable_bytes: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId() << 16
        table: dict[bytes, list] = {}
        held = 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = text.as_buffer().to_pybytes() if text.is_valid else b""
                if (entry := table.get(body)) is None:
                    sha = hashlib.sha256(body).digest()
                    table[body] = [sha[:digest_bytes], (sha, [key])]
                    held += len(body)
                else:
                    entry[1][1].append(key)
                held += ENTRY_BYTES
                if held >= memtable_bytes:
                    yield _flush(table, run, keep_largest)
                    table, held, run = {}, 0, run + 1
        if table:
            yield _flush(table, run, keep_largest)

    return task


def _suspects(docs: DataFrame, hits: DataFrame, digest_bytes: int) -> DataFrame:
    """(digest, body) of the texts that the filter over the hits lets through; a task gives each text once."""
    shared = docs.sparkSession.sparkContext.broadcast(key_filter(hits, "digest"))
    keyed = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    keyed = keyed.select("body", F.substring(F.unhex(F.sha2("body", 256)), 1, digest_bytes).alias("digest"))
    keyed = keyed.withColumn("bit", filter_bit(F.col("digest")))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = set(), 0
        for batch in batches:
            at = np.flatnonzero(filter_hits(shared.value, batch.column(2).to_numpy()))
            some = batch.take(pa.array(at)).select(["digest", "body"])
            new = []
            for k, body in enumerate(some.column(1).to_pylist()):
                if body not in seen:
                    seen.add(body)
                    new.append(k)
                    held += len(body)
            if new:
                yield some.take(pa.array(new))
            if held > MEMTABLE_BYTES:
                seen, held = set(), 0

    return keyed.mapInArrow(task, "digest binary, body binary")


def exact_dedup(docs: DataFrame, keep: str = "smallest", memtable_bytes: int = MEMTABLE_BYTES, digest_bytes: int = 32) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their UTF-8 bytes are; null counts as empty. keep: "smallest" or "largest" identifier stays.
    A null doc_id stays only where its group has no other; of rows repeated with one doc_id and text, one is kept.
    An empty table gives an empty result; other columns, whatever their names, are not read. digest_bytes shortens the
    digest (for tests of colliding digests); results don't depend on it.
    """
    largest = {"smallest": False, "largest": True}[keep]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    runs = written(docs.mapInArrow(_memtables(digest_bytes, largest, memtable_bytes), _RUNS), "dedup-runs")
    order = F.struct((F.isnotnull("best") if largest else F.isnull("best")).alias("known"), "best", (F.col("entry") * (-1 if largest else 1)).alias("entry"))
    merged = runs.groupBy("digest").agg((F.max if largest else F.min)(order).alias("top"), F.sum("n").alias("group_size"), F.count("*").alias("in_runs"))
    hits = merged.filter("in_runs > 1").select("digest", F.col("top.best").alias("keep_id"), F.abs("top.entry").alias("winner"), "group_size")
    hits = written(hits, "dedup-hits")

    same = _suspects(docs, hits, digest_bytes).groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high"))
    # Whatever isn't found equal byte for byte is regrouped.
    differing = written(hits.join(same.filter("low = high").select("digest"), "digest", "left_anti").select("digest"), "dedup-differing")
    clashes = not differing.isEmpty()
    sound = hits.join(differing, "digest", "left_anti") if clashes else hits
    told = runs.select("entry", "digest").join(sound, "digest").select("entry", "keep_id", "winner", "group_size")
    full = runs.join(told, "entry", "left")
    if clashes:
        full = full.join(differing, "digest", "left_anti")
    full = full.select("entry", "sha", F.col("ids"), F.coalesce("winner", "entry").alias("winner"), F.when(F.isnull("winner"), F.col("best")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", "n").alias("group_size"))
    first = F.when(F.isnull("keep_id"), F.expr("array_position(transform(ids, i -> i is null), true)")).otherwise(F.array_position("ids", F.col("keep_id"))) - 1
    rows = full.withColumn("first", first).select("*", F.posexplode("ids").alias("at", "doc_id"))
    rows = rows.select("doc_id", "keep_id", "group_size", ((F.col("entry") == F.col("winner")) & (F.col("at") == F.col("first"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))

    if not clashes:
        return rows
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("sha", F.sha2("text", 256))
    texts = texts.withColumn("digest", F.substring(F.unhex("sha"), 1, digest_bytes)).join(differing, "digest", "left_semi")
    chosen = texts.groupBy("text").agg((F.max if largest else F.min)("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    again = texts.join(chosen, "text").groupBy("doc_id", "keep_id", "group_size", "sha").agg(F.count("*").alias("copies"))
    again = again.select("doc_id", "keep_id", "group_size", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"), "sha")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return rows.unionByName(again.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256")))
