"""Near-duplicate detection: an inverted join over the coordinates of MinHash signatures, confirmed on full shingle sets.

Documents with equal shingle sets form a class with one representative. A representative is posted under the
coordinate-value pairs of its signature. Pairs that at least two representatives have are ordered by rarity, and only
a prefix of them makes postings: two signatures that agree in T of K coordinates share a pair within the first K-T+1
of each. Within a posting list collisions are counted, skipping whatever can't reach T, and what is left are candidate
links; a long list makes one candidate group. Small groups are compared in one tile on their full shingle sets. In
large ones, collisions with a pivot are counted first and what reaches T is confirmed: copies of one text leave as
spokes of its star, which takes work in proportion to their number. Only what no star has joined is dealt into tiles
of bounded size, against the rest of its group. The confirmed links give the components.

Shingles are compared by 64-bit hashes: a link is judged wrongly only where two of the shingles of a pair collide.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, constants, filter_bit, filter_hits, key_filter, lowered, mix64, slices, span_hashes, utf8, words, written

#: Coordinates of a signature.
COORDINATES = 32
#: The chance that a link at the threshold itself has fewer agreeing coordinates than the match threshold.
MISS = 1e-6
#: Longer posting lists become one candidate group, in which collisions are counted with pivots.
LONG_LIST = 64
#: Representatives of one block; a tile holds one or two blocks, or a block and a pivot.
BLOCK = 64
#: Pivots of a large group, one after the other.
STARS = 3

_WINDOW = constants(5, 21)
_FEWER = constants(8, 22)
_SPREAD = constants(COORDINATES, 23) | np.uint64(1)


def match_threshold(k: int, share: float, miss: float = MISS) -> int:
    """The largest T such that a binomial(k, share) is below T with a chance of `miss` at most."""
    below = 0.0
    for t in range(k + 1):
        below += math.comb(k, t) * share**t * (1 - share) ** (k - t)
        if below > miss:
            return max(t, 1)
    return k


def shingles(data: np.ndarray, at: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each text, repeated ones included, and their number by text."""
    data = lowered(data)
    starts, ends, text = words(data, at)
    hashes, total = span_hashes(data, starts, ends), np.bincount(text, minlength=len(at) - 1)
    number = np.where(total >= size, total - size + 1, np.minimum(total, 1))
    first_word, first = np.cumsum(total) - total, np.cumsum(number) - number
    out = np.zeros(number.sum(), np.uint64)
    with np.errstate(over="ignore"):
        full = np.flatnonzero(total >= size)
        if len(full):
            at_out = np.repeat(first[full], number[full])
            offset = np.arange(number[full].sum()) - np.repeat(np.cumsum(number[full]) - number[full], number[full])
            at_in = np.repeat(first_word[full], number[full]) + offset
            value = np.zeros(len(at_in), np.uint64)
            for j in range(size):
                value += hashes[at_in + j] * (_WINDOW[j % 5] + np.uint64(2 * (j // 5)) | np.uint64(1))
            out[at_out + offset] = mix64(value)
        for n in range(1, size):
            few = np.flatnonzero(total == n)
            if len(few):
                value = np.full(len(few), _FEWER[n % 8], np.uint64)
                for j in range(n):
                    value += hashes[first_word[few] + j] * (_WINDOW[j % 5] + np.uint64(2 * (j // 5)) | np.uint64(1))
                out[first[few]] = mix64(value)
    return out, number


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            values, number = shingles(*utf8(part.column("text")))
            ends = np.cumsum(number)
            size, digest = np.zeros(len(number), np.int64), []
            sha = [hashlib.sha256(t.as_buffer() if t.is_valid else b"").digest() for t in part.column("text")]
            for k, (e, n) in enumerate(zip(ends, number, strict=True)):
                own = np.unique(values[e - n : e])
                size[k] = len(own)
                digest.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
            some = np.flatnonzero(number)
            tokens = np.zeros((len(number), COORDINATES), np.int64)
            if len(some):
                first = (ends - number)[some]
                with np.errstate(over="ignore"):
                    for j in range(COORDINATES):
                        least = np.minimum.reduceat(values * _SPREAD[j], first)
                        tokens[some, j] = (least >> np.uint64(32)).astype(np.int64) | (j << 32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, tokens.size + 1, COORDINATES, dtype=np.int32)), pa.array(tokens.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), pa.array(sha, pa.binary()), pa.array(digest, pa.binary()), lists], ["doc_id", "n_shingles", "sha", "digest", "tokens"])


def _candidates(least_percent: int, need: int):
    """Candidate links of the posting lists, which come as runs of equal tokens; of each list only what spans its groups."""

    def links(rows: list[tuple[int, int, set]]) -> Iterator[tuple[int, int]]:
        rows.sort(key=lambda r: (r[1], r[0]))
        group = list(range(len(rows)))

        def root(i: int) -> int:
            while group[i] != i:
                group[i] = group[group[i]]
                i = group[i]
            return i

        for i, (a, n, tokens) in enumerate(rows):
            for j in range(i + 1, len(rows)):
                b, m, others = rows[j]
                if 100 * n < least_percent * m:  # the sizes only grow from here on
                    break
                if root(i) != root(j) and len(tokens & others) >= need:
                    group[root(j)] = root(i)
                    yield a, b

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, rows, out = None, [], []
        for batch in batches:
            for t, rep, n, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if t != token:
                    out += links(rows)
                    token, rows = t, []
                rows.append((rep, n, set(tokens)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])
                out = []
        out += links(rows)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return task


def linked(sets: list[np.ndarray], least_percent: int) -> np.ndarray:
    """For each of the sorted sets the number of the first set that it is connected with by exact links."""
    sizes = np.array([len(s) for s in sets], np.int64)
    n = len(sets)
    values = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    _, code, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.cumsum(shared) - 1
    row = np.repeat(np.arange(n), sizes)
    keep = shared[code]
    row, code = row[keep], column[code[keep]]
    common = np.zeros((n, n), np.float32)
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    width = max(1, (1 << 21) // max(n, 1))
    for first in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(code, [first, first + width])
        part = np.zeros((n, width), np.float32)
        part[row[lo:hi], code[lo:hi] - first] = 1
        common += part @ part.T
    both = np.rint(common).astype(np.int64)
    link = 100 * both >= least_percent * (sizes[:, None] + sizes[None, :] - both)
    link &= (sizes[:, None] > 0) & (sizes[None, :] > 0)
    np.fill_diagonal(link, True)
    group = np.arange(n)
    while True:
        # Each set takes the smallest group among its links, then groups are followed to their roots.
        least = np.where(link, group[None, :], n).min(axis=1)
        least = least[least]
        if np.array_equal(least, group):
            return group
        group = least


def _confirm(least_percent: int):
    def stars(keys: list[int], texts: list[bytes]) -> Iterator[tuple[int, int]]:
        if len(keys) < 2:
            return
        sets = []
        for text in texts:
            data = np.frombuffer(text, np.uint8)
            sets.append(np.unique(shingles(data, np.array([0, len(data)]))[0]))
        for i, g in enumerate(linked(sets, least_percent)):
            if g != i:
                yield keys[g], keys[i]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, keys, texts, out = None, [], [], []
        for batch in batches:
            for t, cls, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if t != tile:
                    out += stars(keys, texts)
                    tile, keys, texts = t, [], []
                keys.append(cls)
                texts.append(text.as_buffer().to_pybytes())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])
                out = []
        out += stars(keys, texts)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return task


def _spokes(least_percent: int, need: int):
    """Confirmed links of the pivot that each run of rows of one tile begins with: (a, b), a the pivot."""

    def own_set(text: pa.BinaryScalar) -> np.ndarray:
        data = np.frombuffer(text.as_buffer(), np.uint8)
        return np.unique(shingles(data, np.array([0, len(data)]))[0])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, pivot, tokens, hub = None, None, frozenset(), np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for t, first, cls, own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                if first:
                    tile, pivot, tokens, hub = t, cls, frozenset(own), own_set(text)
                elif t == tile and cls != pivot and len(tokens.intersection(own)) >= need:
                    other = own_set(text)
                    both = len(np.intersect1d(hub, other, assume_unique=True))
                    if 100 * both >= least_percent * (len(hub) + len(other) - both):
                        a.append(pivot)
                        b.append(cls)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return task


def _stars(large: DataFrame, least_percent: int, need: int) -> DataFrame | None:
    """(a, b): links of up to STARS pivots of each large group with its members; large: (cls, root, total, weight, tokens, text).

    A pivot is the member whose coordinate-value pairs are the most frequent of those that aren't linked with a pivot
    yet; it is compared with the whole group, dealt into chunks that each get a copy of it.
    """
    chunks = F.ceil(F.col("total") / BLOCK)
    chunk = F.pmod(F.xxhash64("cls"), chunks)
    still, links = large.select("cls", "root", "weight"), None
    for k in range(STARS):
        pivots = written(still.groupBy("root").agg(F.max_by("cls", F.struct("weight", "cls")).alias("pivot")), "near-pivots")
        if pivots.isEmpty():
            break
        all_members = large.join(pivots, "root")
        copies = all_members.filter("cls = pivot").select("root", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"), "cls", "tokens", "text")
        rows = all_members.select("root", chunk.alias("chunk"), F.lit(False).alias("first"), "cls", "tokens", "text").unionByName(copies.withColumn("first", F.lit(True)))
        rows = rows.select(F.xxhash64("root", "chunk").alias("tile"), "first", "cls", "tokens", "text").repartition("tile").sortWithinPartitions("tile", F.desc("first"))
        found = written(rows.mapInArrow(_spokes(least_percent, need), "a long, b long"), "near-stars")
        links = found if links is None else links.unionByName(found)
        gone = found.select(F.col("b").alias("cls")).unionByName(pivots.select(F.col("pivot").alias("cls"))).distinct()
        still = written(still.join(gone, "cls", "left_anti"), "near-still")
    return links


def _tiles(members: DataFrame, least_percent: int) -> DataFrame:
    """(cls, tile): each member (cls, root, n_shingles, part) of a large group in every tile where a link that isn't known can stand.

    Sets that differ in size by more than the threshold allows have no link, so a group is parted by size class, a power
    of the threshold: only equal and neighbouring classes meet. Members whose part isn't null are connected with all
    others of that part already. What has one class and part is dealt into blocks by hash.
    """
    grade = F.floor(F.log(F.col("n_shingles")) / math.log(100 / least_percent) + 1e-9).cast("int")
    members = members.select("cls", "root", grade.alias("grade"), F.coalesce("part", F.lit(-1).cast("long")).alias("part"))
    sizes = members.groupBy("root", "grade", "part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    # A group with nothing but one part has no tile.
    lists = sizes.groupBy("root").agg(F.collect_list(F.struct("grade", "part", "blocks")).alias("lists"), F.count_distinct("part").alias("parts"), F.min("part").alias("least"))
    lists = lists.filter("parts > 1 or least = -1").select("root", "lists")
    m = members.join(sizes, ["root", "grade", "part"]).join(lists, "root").withColumn("own", F.expr("cast(pmod(xxhash64(cls, 7), blocks) as int)"))
    others = F.expr("""
        flatten(transform(filter(lists, e -> abs(e.grade - grade) <= 1 and (e.part <> part or part = -1)),
                          e -> transform(sequence(0, e.blocks - 1), j -> array_sort(array(struct(grade, part, own), struct(e.grade as grade, e.part as part, j as own))))))""")
    return m.select("cls", "root", F.explode(F.array_distinct(others)).alias("p")).select("cls", F.xxhash64("root", "p").alias("tile"))


def _compared(texts: DataFrame, tiles: DataFrame, least_percent: int, name: str) -> DataFrame:
    """(a, b): what connects the members of each tile (cls, tile), by exact links."""
    dealt = texts.join(tiles, "cls").select("tile", "cls", "text").repartition("tile").sortWithinPartitions("tile")
    return written(dealt.mapInArrow(_confirm(least_percent), "a long, b long"), name)


def near_duplicates(docs: DataFrame, least_percent: int = 80) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept, text_sha256 (binary).

    Sets of five-word shingles are linked when 100 * intersection >= least_percent * union. component_id is the
    smallest doc_id that links reach, itself included; kept where it is the doc_id. Texts without words (null and
    empty ones too) have an empty set and no link. A row with a null doc_id has no name to be linked by: its component
    is null, and it is kept. Rows repeated with one doc_id are one document if their sets are equal, else each row has
    the component of its own text; doc_id and text_sha256 tell them apart. An empty table gives an empty result; other
    columns are not read.
    """
    need = match_threshold(COORDINATES, least_percent / 100)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(docs.mapInArrow(_signatures, "doc_id long, n_shingles long, sha binary, digest binary, tokens array<long>"), "near-signatures")
    named = signed.filter("doc_id is not null and n_shingles > 0")
    classes = named.groupBy("digest").agg(F.min(F.struct("doc_id", "sha")).alias("top"), F.min("n_shingles").alias("n_shingles"), F.min("tokens").alias("tokens"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("cls"), "digest", "top.doc_id", "top.sha", "n_shingles", "tokens"), "near-classes")

    posted = classes.select("cls", "n_shingles", F.explode("tokens").alias("token"))
    often = posted.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    own = posted.join(often, "token").groupBy("cls", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("common"))
    own = own.filter(F.size("common") >= need)
    # Pairs that no other document has come first in the order of rarity, so they use up places of the prefix.
    places = F.size("common") - (need - 1)
    weight = F.aggregate("common.df", F.lit(0).cast("long"), lambda t, x: t + x)
    own = written(own.select("cls", "n_shingles", weight.alias("weight"), F.col("common.token").alias("tokens"), F.slice("common", F.lit(1), places).alias("prefix")), "near-prefixes")
    lists = own.select("cls", "n_shingles", "tokens", F.explode("prefix").alias("p")).select(F.col("p.token").alias("token"), F.col("p.df").alias("df"), "cls", "n_shingles", "tokens")
    short = lists.filter(F.col("df") <= LONG_LIST).select("token", "cls", "n_shingles", "tokens").repartition("token").sortWithinPartitions("token")
    counted = short.mapInArrow(_candidates(least_percent, need), "a long, b long")
    long = lists.filter(F.col("df") > LONG_LIST).select("token", "cls")
    pivots = long.groupBy("token").agg(F.min("cls").alias("a"))
    grouped = long.join(pivots, "token").select("a", F.col("cls").alias("b")).distinct()
    groups = components(counted.unionByName(grouped), "near-candidates")

    nodes = groups.select(F.col("node").alias("cls"), "root").unionByName(groups.select(F.col("root").alias("cls"), "root").distinct())
    members = nodes.join(own.select("cls", "n_shingles", "weight", "tokens"), "cls").join(classes.select("cls", "doc_id", "sha"), "cls")
    totals = nodes.groupBy("root").agg(F.count("*").alias("total"))
    members = written(members.join(totals, "root"), "near-members")
    bits = docs.sparkSession.sparkContext.broadcast(key_filter(members, "doc_id"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.flatnonzero(filter_hits(bits.value, batch.column(2).to_numpy()))
            if len(at):
                yield batch.select([0, 1]).take(pa.array(at))

    texts = docs.filter("doc_id is not null").select("doc_id", F.col("text").cast("binary").alias("text"), filter_bit(F.col("doc_id")).alias("bit"))
    texts = texts.mapInArrow(listed, "doc_id long, text binary").filter("text is not null").withColumn("sha", F.unhex(F.sha2("text", 256)))
    texts = texts.join(members.select("cls", "doc_id", "sha"), ["doc_id", "sha"]).select("cls", "text").dropDuplicates(["cls"])
    texts = written(texts, "near-texts")

    links = _compared(texts, members.filter(F.col("total") <= BLOCK).select("cls", F.xxhash64("root").alias("tile")), least_percent, "near-links")
    big = members.filter(F.col("total") > BLOCK)
    if not big.isEmpty():
        large = written(big.select("cls", "root", "total", "weight", "tokens").join(texts, "cls"), "near-large")
        stars = _stars(large, least_percent, need)
        joined = written(components(stars, "near-joined").select(F.col("node").alias("cls"), F.col("root").alias("part")), "near-parts")
        parts = joined.unionByName(joined.select(F.col("part").alias("cls"), "part").distinct())
        wide = parts.groupBy("part").agg(F.count("*").alias("n")).filter(F.col("n") >= BLOCK // 2).select("part")
        rest = big.select("cls", "root", "n_shingles").join(parts.join(wide, "part"), "cls", "left")
        links = links.unionByName(stars).unionByName(_compared(texts, _tiles(rest, least_percent), least_percent, "near-links-large"))
    found = components(links, "near-components").select(F.col("node").alias("cls"), "root")
    # The last query isn't written here, so it is told that the members of components aren't broadcast.
    found = found.unionByName(found.select(F.col("root").alias("cls"), "root").distinct()).hint("merge")
    least = found.join(classes.select("cls", "doc_id"), "cls").groupBy("root").agg(F.min("doc_id").alias("component"))
    roots = classes.select("cls", "digest", "doc_id").join(found.join(least, "root").select("cls", "component"), "cls", "left")
    roots = roots.select("digest", F.coalesce("component", "doc_id").alias("component_id"))
    rows = named.join(roots, "digest").select("doc_id", "n_shingles", "component_id", "sha")
    rows = rows.unionByName(signed.filter("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "sha"))
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), F.col("sha").alias("text_sha256"))
