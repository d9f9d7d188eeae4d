"""What the operators share: written tables in the shared folder, and byte-level text kernels for Arrow batches."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text a Python worker lays out in NumPy at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20


#: Removes the shuffle files of a query when it has ended; what it wrote doesn't need them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What a table may take to be broadcast through the driver: by an estimate, and as measured by a stage that has ended.
_ESTIMATED = "spark.sql.autoBroadcastJoinThreshold"
_MEASURED = "spark.sql.adaptive.autoBroadcastJoinThreshold"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; on a local master, one under the warehouse where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_llm_shared"
    return folder.rstrip("/")


def written(df: DataFrame, name: str, *sort: str) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut, and any executor can be lost afterwards.

    The table stays until dropped() or the end of the application; the query's shuffle files go when it has ended.
    Tables are broadcast only by their measured size: estimates go by compressed files and don't see what explode adds.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"
    if sort:
        df = df.sortWithinPartitions(*sort)
    before = {key: spark.conf.get(key, None) for key in (_CLEANUP, _ESTIMATED, _MEASURED)}
    held = {_CLEANUP: "true", _ESTIMATED: "-1", _MEASURED: before[_MEASURED] or spark.conf.get(_ESTIMATED)}
    try:
        for key, value in held.items():
            spark.conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    if not _tables:
        atexit.register(_forget)
    _tables.append((spark, path))
    return out


_tables: list[tuple[SparkSession, str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def dropped(*tables: DataFrame) -> None:
    """Removes written() tables that no later plan reads."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            for k, (spark, path) in enumerate(_tables):
                if path.rsplit("/", 1)[-1] == file.rsplit("/", 2)[-2]:
                    del _tables[k]
                    _remove(spark, path)
                    break


def _forget() -> None:
    """At the end of the application: what it has written and not dropped, as far as its session is still there."""
    for spark, path in _tables:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001 - the session has ended before
            return


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (two xor-shift-multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit words, the same on every machine."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(0x9E3779B97F4A7C15))


_BYTE_VALUE = constants(256, 11)
_BASE = int(constants(1, 12)[0]) | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), np.uint64(base))
        steps[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(steps, dtype=np.uint64)
        if n <= CHUNK_BYTES + 1:
            _powers[base] = have
    return have[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(at) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts take about `most` bytes."""
    if not batch.num_rows:
        return
    _, at = utf8(batch.column(batch.schema.get_field_index(text)))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def lowered(data: np.ndarray) -> np.ndarray:
    """A copy with A-Z as a-z; bytes of other characters stay."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word [^\\x20\\x09-\\x0D]+; words end where their text ends."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    body = np.zeros(len(data) + 2, np.int8)
    body[1:-1] = ~SPACE[data]
    step = np.diff(body)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = np.unique(at[1:-1])
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = cuts[(body[cuts] == 1) & (body[cuts + 1] == 1)]
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever the span stands (a polynomial over random byte values, scrambled)."""
    n = len(data)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[data] * _power(_BASE, n), out=total[1:])
        raw = (total[ends] - total[starts]) * _power(_BASE_INVERSE, n + 1)[starts]
        return mix64(raw + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


#: Bits of a key filter, whatever the number of keys: 4 MB. A fuller filter lets more rows through; it never loses one.
FILTER_BITS = 1 << 25
_FILTER_WORD = 32768


def filter_bit(key: Column) -> Column:
    """The bit of a Bloom filter with one hash function."""
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def key_filter(keys: DataFrame, key: str) -> np.ndarray:
    """The filter's bytes: built in the executors as 4 KB bitmaps, of which there are FILTER_BITS / 32,768 + 1 at most."""
    bit = keys.select(filter_bit(F.col(key)).alias("b"))
    parts = bit.groupBy(F.expr("bitmap_bucket_number(b)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(b))").alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 8 + _FILTER_WORD, np.uint8)
    for r in parts:
        first = r["bucket"] * (_FILTER_WORD // 8)
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        bits[first : first + len(part)] |= part
    return bits


def filter_hits(bits: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Which of the filter_bit() values are in the filter."""
    # bitmap_bucket_number counts from 1 for bits 1..32768, and bit 0 stands in bucket 0 at position 0.
    bucket, position = np.where(bit > 0, 1 + (bit - 1) // _FILTER_WORD, 0), np.where(bit > 0, (bit - 1) % _FILTER_WORD, 0)
    return ((bits[bucket * (_FILTER_WORD // 8) + (position >> 3)] >> (position & 7).astype(np.uint8)) & 1).astype(bool)


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the component's smallest node; roots themselves are left out.

    Large-star and small-star steps alternate until nothing changes; each round is a written table.
    """
    e = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), name)
    before = None
    while True:
        sym = e.unionByName(e.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        # Written, so that both sides of the join come straight from an exchange and a hub's edges can be split.
        low = written(sym.groupBy("hi").agg(F.min("lo").alias("low")).select("hi", F.least("hi", "low").alias("low")), name)
        large = sym.filter("lo > hi").join(low, "hi").select(F.col("lo").alias("hi"), F.col("low").alias("lo"))
        large = written(large.filter("hi <> lo").distinct(), name)
        low = written(large.groupBy("hi").agg(F.min("lo").alias("low")), name)
        rest = large.join(low, "hi").filter("lo <> low").select(F.col("lo").alias("hi"), F.col("low").alias("lo"))
        e = written(low.select("hi", F.col("low").alias("lo")).unionByName(rest).distinct(), name)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).head()
        if now == before:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = now
