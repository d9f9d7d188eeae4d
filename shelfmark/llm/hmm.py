"""A hidden Markov language model: Baum-Welch counts aggregated over partitions, and exact likelihoods by scaled
forward recursion.

A text is a sequence of words and one end. A first pass lays documents out as blocks: word numbers of each document, and
the block's dictionary, dealt into shards by the words' hash. The vocabulary is never in one place: a shard numbers its
own words and holds their counts. In every round a block gets one packed row from each shard for its own words, computes
the expected counts of its training documents and sends one packed row back to each; shards add them up, word by word,
to the emissions of the next round. A model of a bounded sample, fitted in one task, only breaks the symmetry of the
states before the first round.

Within a block, texts are cut into segments that are worked on side by side. A long text's segments get their exact
starts and ends from transfer matrices, so a long text costs no more steps than a short one.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, dropped, lowered, slices, span_hashes, utf8, words, written

#: Latent states; at most 6, since a word's shares of all but the last are packed into one long.
STATES = 6
#: The sample: training documents with the smallest hashes of doc_id, of at most so many characters each.
SAMPLE = 600
SAMPLE_CHARS = 50_000
#: Rounds over the first tenth of the sample and over all of it, and random beginnings tried.
SAMPLE_ROUNDS = (20, 10)
BEGINNINGS = 3
#: The most rounds over all training documents.
ROUNDS = 3
#: Further rounds stop when one adds less than this to the mean log10 likelihood of a training token.
ENOUGH = 1e-4
#: Words of a segment, and of the segments that are worked on together.
SEGMENT = 1024
TOGETHER = 1 << 18
#: Steps of the recursion after which its numbers are scaled; a step takes off a word's probability.
SCALED = 8
#: A block is closed when it has so many bytes of text; one of more distinct words is halved.
BLOCK_BYTES = 14 << 20
BLOCK_WORDS = 300_000
#: Bytes of text for each of which the vocabulary gets a shard.
SHARD_BYTES = 16 << 20
#: The share of each state's emissions that follows the unigram model while the sample is fitted.
BACKOFF = 0.1
#: Expected counts are multiples of 1 / UNIT, a word's shares of the states multiples of 1 / SHARES.
UNIT = 256
SHARES = (1 << 12) - 1
#: Groups in which the blocks' expected transitions are added up.
SIDE_GROUPS = 16
#: Expected transitions, starts and logarithms are multiples of 1 / SIDE_UNIT.
SIDE_UNIT = 1 << 20
#: The end of a text in the dictionary; no word is a line feed.
END = b"\n"


class Model:
    """Transitions, and the distribution of the state before the first word."""

    def __init__(self, trans: np.ndarray, before: np.ndarray) -> None:
        self.trans, self.before = trans, before


class Steps:
    """Segments of a run of words, longest first, and their words step by step: at each step one word of each segment that is so long."""

    def __init__(self, start: np.ndarray, size: np.ndarray) -> None:
        steps = int(size[0]) if len(size) else 0
        self.active = np.searchsorted(-size, -np.arange(steps), "left")
        self.to = np.cumsum(self.active)
        self.begin = self.to - self.active
        step = np.repeat(np.arange(steps), self.active)
        self.at = start[np.arange(len(step)) - np.repeat(self.begin, self.active)] + step


class Chains:
    """Likelihoods and expected counts of texts, given the emissions of the dictionary's words by state."""

    def __init__(self, model: Model, emit: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> None:
        """emit: by state and word number; codes: the texts' word numbers; lengths: at least one word each."""
        self.model, self.emit, self.codes, self.lengths = model, emit, codes, lengths
        first = np.cumsum(lengths) - lengths
        self.number = -(-lengths // SEGMENT)
        self.first = np.cumsum(self.number) - self.number
        self.text = np.repeat(np.arange(len(lengths)), self.number)
        nth = np.arange(len(self.text)) - self.first[self.text]
        self.start = first[self.text] + nth * SEGMENT
        self.size = np.minimum(SEGMENT, (first + lengths)[self.text] - self.start)
        states = len(model.before)
        #: The state before each segment given all words before it, and the backward vector at its end (up to a factor).
        self.before = np.repeat(model.before[:, None], len(self.text), axis=1)
        self.after = np.ones((states, len(self.text)))
        if len(self.text) > len(lengths):
            self._chain()
        #: Natural logarithm of each text's probability; worked out by walk().
        self.log_likelihood = np.zeros(len(lengths))

    def _groups(self, which: np.ndarray) -> Iterator[np.ndarray]:
        """The segments, longest first, in groups of about TOGETHER words."""
        order = which[np.argsort(-self.size[which], kind="stable")]
        total = np.cumsum(self.size[order])
        first = 0
        while first < len(order):
            last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + TOGETHER, "right")))
            yield order[first:last]
            first = last

    def _chain(self) -> None:
        """Starts and ends of the segments of texts that have several."""
        states, trans = len(self.model.before), self.model.trans
        last = self.first + self.number - 1
        long = np.flatnonzero(self.number > 1)
        inner = np.flatnonzero((self.number > 1)[self.text] & (np.arange(len(self.text)) != last[self.text]))
        matrix = np.empty((states, states, len(inner)))  # [state at the end, state before, segment]
        place = np.zeros(len(self.text), np.int64)
        place[inner] = np.arange(len(inner))
        for group in self._groups(inner):
            q = len(group)
            m = np.repeat(np.eye(states)[:, :, None], q, axis=2)
            for t in range(SEGMENT):
                m = (trans.T @ m.reshape(states, -1)).reshape(states, states, q)
                m *= self.emit[:, self.codes[self.start[group] + t]][:, None, :]
                if t % SCALED == SCALED - 1:
                    m /= m.sum(axis=(0, 1))
            matrix[:, :, place[group]] = m / m.sum(axis=(0, 1))
        ends = last[long]
        back = np.ones((states, len(self.text)))
        for group in self._groups(ends):
            steps = Steps(self.start[group], self.size[group])
            b = np.ones((states, len(group)))
            for t in range(len(steps.active) - 1, -1, -1):
                n = steps.active[t]
                x = trans @ (self.emit[:, self.codes[steps.at[steps.begin[t] : steps.to[t]]]] * b[:, :n])
                b[:, :n] = x / x.sum(axis=0)
            back[:, group] = b
        for j in range(int(self.number.max()) - 1):
            seg = self.first[long[self.number[long] > j + 1]] + j
            v = np.einsum("jiq,iq->jq", matrix[:, :, place[seg]], self.before[:, seg])
            self.before[:, seg + 1] = v / v.sum(axis=0)
        for j in range(int(self.number.max()) - 2, -1, -1):
            seg = self.first[long[self.number[long] > j + 1]] + j
            u = back[:, seg + 1]
            self.after[:, seg] = u
            v = np.einsum("jiq,jq->iq", matrix[:, :, place[seg]], u)
            back[:, seg] = v / v.sum(axis=0)

    def walk(self, expect: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fills log_likelihood; with expect, expected counts by state and word, of transitions, and of the states before the first words."""
        trans, states = self.model.trans, len(self.model.before)
        forth = np.ascontiguousarray(trans.T)
        words = self.emit.shape[1]
        counts, pairs, begun = np.zeros((states, words)), np.zeros((states, states)), np.zeros(states)
        for group in self._groups(np.arange(len(self.text))):
            steps = Steps(self.start[group], self.size[group])
            codes = self.codes[steps.at]
            emit = self.emit[:, codes]
            alpha, logs = np.empty_like(emit), np.zeros(len(group))
            f = f0 = np.ascontiguousarray(self.before[:, group])
            begin, to = steps.begin.tolist(), steps.to.tolist()
            for t, (a, b) in enumerate(zip(begin, to, strict=True)):
                x = alpha[:, a:b]
                np.matmul(forth, f[:, : b - a], out=x)
                x *= emit[:, a:b]
                if t % SCALED == SCALED - 1:
                    # The backward pass takes the same scale off the same words.
                    by = 1.0 / x.sum(axis=0)
                    x *= by
                    emit[:, a:b] *= by
                    logs[: b - a] -= np.log(by)
                f = x
            end = steps.begin[self.size[group] - 1] + np.arange(len(group))
            logs += np.log(alpha[:, end].sum(axis=0))
            of = self.text[group]
            self.log_likelihood += np.bincount(of, weights=logs, minlength=len(self.lengths))
            if not expect:
                continue
            # At every word, the product of both passes is then the same number, which is made 1 at the segment's end.
            back = self.after[:, group]
            back = back / (alpha[:, end] * back).sum(axis=0)
            for t in range(len(begin) - 1, -1, -1):
                a, b = begin[t], to[t]
                here = back[:, : b - a]
                x = emit[:, a:b]
                x *= here
                prior = alpha[:, begin[t - 1] : begin[t - 1] + b - a] if t else f0
                pairs += prior @ x.T
                alpha[:, a:b] *= here
                here[...] = trans @ x
            for k in range(states):
                counts[k] += np.bincount(codes, weights=alpha[k], minlength=words)
            head = np.flatnonzero(self.first[of] == group)
            begun += (f0 * back)[:, head].sum(axis=1)
        return counts, pairs * trans, begun


def _updated(pairs: np.ndarray, start: np.ndarray) -> Model:
    pairs, start = pairs + 1.0, start + 1.0
    return Model(pairs / pairs.sum(axis=1)[:, None], start / start.sum())


def split_words(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of these texts, lower-cased, and how many each text has."""
    data = lowered(data)
    starts, ends, text = words(data, at)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    parts = [None, pa.py_buffer(offsets), pa.py_buffer(data[~SPACE[data]])]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), parts), np.bincount(text, minlength=len(at) - 1)


def numbered(runs: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct words of some runs of texts, and each run's word numbers, each text followed by the end, which is 0."""
    found = pa.concat_arrays([pa.array([END], pa.large_binary()), *(w for w, _ in runs)]).dictionary_encode()
    indices = found.indices.to_numpy()[1:]
    codes, begin = [], 0
    for run, counts in runs:
        own = np.zeros(len(run) + len(counts), np.int32)
        keep = np.ones(len(own), bool)
        keep[np.cumsum(counts + 1) - 1] = False
        own[keep] = indices[begin : begin + len(run)]
        begin += len(run)
        codes.append(own)
    return found.dictionary, codes


def fit_sample(texts: list[bytes], states: int) -> tuple[Model, dict[bytes | None, np.ndarray]]:
    """A model of the sample, and the share that each state has of each of its words, and of all others (None).

    A few texts part the states well, since each begins with a mixture of its own; from there all texts are taken in.
    Of several random beginnings, that with the greatest likelihood is kept.
    """
    runs = [split_words(np.frombuffer(text, np.uint8), np.array([0, len(text)])) for text in texts]
    dictionary, every = numbered(runs)
    n = len(dictionary)
    stay = 0.95
    model = Model(np.full((states, states), (1 - stay) / max(states - 1, 1)), np.full(states, 1 / states))
    np.fill_diagonal(model.trans, stay if states > 1 else 1.0)
    if not runs:
        return model, {None: np.full(states, 1 / states)}
    codes, lengths = np.concatenate(every), np.concatenate([counts + 1 for _, counts in runs])
    rate = np.bincount(codes, minlength=n) / len(codes)
    few = max(1, len(lengths) // 10)
    best = None
    for seed in range(BEGINNINGS):
        gamma = np.repeat(np.random.default_rng(seed).dirichlet(np.full(states, 0.3), few), lengths[:few], axis=0)
        counts = np.stack([np.bincount(codes[: len(gamma)], weights=gamma[:, s], minlength=n) for s in range(states)])
        own = model
        for number, rounds in ((few, SAMPLE_ROUNDS[0]), (len(lengths), SAMPLE_ROUNDS[1])):
            some = codes[: lengths[:number].sum()]
            for _ in range(rounds):
                emit = (1 - BACKOFF) * counts / (counts.sum(axis=1)[:, None] + 1e-9) + BACKOFF * rate
                chains = Chains(own, emit, some, lengths[:number])
                counts, pairs, start = chains.walk(expect=True)
                own = _updated(pairs, start)
        reached = chains.log_likelihood.sum()
        if best is None or reached > best[0]:
            best = reached, own, counts
    _, model, counts = best
    mass = counts.sum(axis=1)[:, None]
    share = ((1 - BACKOFF) * counts + BACKOFF * rate * mass) / len(codes) / rate
    return model, {w: share[:, i] for i, w in enumerate(dictionary.to_pylist())} | {None: mass[:, 0] / len(codes)}


def _sharded(dictionary: pa.Array, shards: int) -> np.ndarray:
    """The shard of each word."""
    data, at = utf8(dictionary)
    return (span_hashes(data, at[:-1], at[1:]) % np.uint64(shards)).astype(np.int32)


def _sample_task(states: int, shards: int):
    """One row for each word of the sample, and side rows: the model's, and the shares of words that aren't in the sample."""

    def group(table: pa.Table) -> pa.Table:
        model, share = fit_sample([b.as_py() for b in table.sort_by([("hash", "ascending"), ("text", "ascending")])["text"]], states)
        others = share.pop(None)
        names, values = list(share), [np.rint(SIDE_UNIT * v).astype(np.int64) for v in share.values()]
        side = np.rint(np.vstack([model.trans, model.before, others]) * SIDE_UNIT).astype(np.int64)
        columns = np.array([*values, *side], np.int64).reshape(-1, states)
        words = pa.array([*names, *[b""] * (states + 2)], pa.binary())
        rank = pa.array([None] * len(names) + list(range(states + 2)), pa.int32())
        return pa.table([words, pa.array(_sharded(words, shards)), rank, *(pa.array(columns[:, k]) for k in range(states))], names=["word", "shard", "side", *_names(states)])

    return group


def _names(states: int) -> list[str]:
    return [f"e{k}" for k in range(states)]


def _packed(codes: np.ndarray) -> bytes:
    """The numbers' bytes by significance, compressed."""
    planes = np.ascontiguousarray(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _rounded(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """By state and word, multiples of 1 / UNIT that add up to each word's whole count."""
    share = np.cumsum(counts, axis=0)
    share = share / np.maximum(share[-1], 1e-300) * (UNIT * total)
    return np.diff(np.rint(share).astype(np.int64), axis=0, prepend=0)


def held_out(ids: list) -> np.ndarray:
    """crc32 of doc_id as text, modulo 5, is 1; a null doc_id counts as an empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i in ids], bool)


_BLOCKS = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("held", pa.list_(pa.bool_())), ("codes", pa.binary()), ("shard", pa.int32()), ("words", pa.binary()), ("sizes", pa.binary()), ("n", pa.binary())])
_BLOCK_COLUMNS = "block long, ids array<long>, lengths array<int>, held array<boolean>, codes binary, shard int, words binary, sizes binary, n binary"


def _blocks(shards: int):
    """A row for each run of documents, and one for each shard of a block's dictionary, which is numbered shard by shard.

    The latter has the words one after the other, their sizes, and their counts in training documents.
    """
    of = lambda k, values: pa.array(values, _BLOCKS.field(k).type)

    def closed(runs: list[tuple], keys: list[list], flags: list[np.ndarray]) -> Iterator[list[pa.RecordBatch]]:
        dictionary, codes = numbered(runs)
        if len(dictionary) > BLOCK_WORDS and len(runs) > 1:
            half = len(runs) // 2
            del dictionary, codes
            yield from closed(runs[:half], keys[:half], flags[:half])
            yield from closed(runs[half:], keys[half:], flags[half:])
            return
        shard = _sharded(dictionary, shards)
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        counts, out = np.zeros(len(dictionary), np.int64), []
        for own, (_, sizes), ids, held in zip(codes, runs, keys, flags, strict=True):
            own = place[own]
            counts += np.bincount(own[~np.repeat(held, sizes + 1)], minlength=len(counts))
            out.append({"ids": [ids], "lengths": [(sizes + 1).astype(np.int32)], "held": [held], "codes": [_packed(own)]})
        data, at = utf8(dictionary.take(pa.array(order)))
        shard = shard[order]
        first = np.flatnonzero(np.diff(shard, prepend=-1))
        spans = list(zip(first.tolist(), [*first[1:].tolist(), len(shard)], strict=True))
        sizes = np.diff(at).astype("<i4")
        out.append({"shard": shard[first], "words": [data[at[a] : at[b]].tobytes() for a, b in spans], "sizes": [sizes[a:b].tobytes() for a, b in spans], "n": [counts[a:b].astype("<i8").tobytes() for a, b in spans]})
        yield out

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20

        def batched(*runs: list) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for block in closed(*runs):
                for some in block:
                    rows = len(next(iter(some.values())))
                    columns = {"block": np.full(rows, number)} | some
                    yield pa.RecordBatch.from_arrays([of(k, columns[k]) if k in columns else pa.nulls(rows, _BLOCKS.field(k).type) for k in _BLOCKS.names], schema=_BLOCKS)
                number += 1

        runs, keys, flags, size = [], [], [], 0
        for batch in batches:
            for part in slices(batch):
                data, at = utf8(part.column("text"))
                runs.append(split_words(data, at))
                keys.append(part.column(0).to_pylist())
                flags.append(held_out(keys[-1]))
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield from batched(runs, keys, flags)
                    runs, keys, flags, size = [], [], [], 0
        if runs:
            yield from batched(runs, keys, flags)

    return task


def _emissions(counts: np.ndarray, shares: np.ndarray, totals: dict, states: int) -> tuple[np.ndarray, np.ndarray]:
    """By state, P(word | state) of words with these counts and packed shares; and P(word) of the unigram model."""
    unigram = (counts + 0.5) / (totals["n"] + 0.5 * (totals["v"] + 1))
    emit, rest = np.empty((states, len(counts))), np.full(len(counts), SHARES, np.int64)
    for k, (mass, types) in enumerate(zip(totals["mass"], totals["types"], strict=True)):
        part = (shares >> (12 * k)) & SHARES if k < states - 1 else rest
        rest = rest - part
        own = part * counts / (SHARES * mass) if mass > 0 else unigram
        # As many of a state's words are new as it has had new words so far (Witten and Bell).
        new = (types + 1) / (types + mass + 1)
        emit[k] = (1 - new) * own + new * unigram
    return emit, unigram


def _texts(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and lengths of a block's texts."""
    lengths = [x.values.to_numpy() for x in block["lengths"]]
    codes = [_unpacked(c.as_py(), int(x.sum())) for c, x in zip(block["codes"], lengths, strict=True)]
    return np.concatenate([np.zeros(0, np.int32), *codes]), np.concatenate([np.zeros(0, np.int64), *lengths]).astype(np.int64)


def _flags(block: pa.Table) -> np.ndarray:
    return np.concatenate([np.zeros(0, bool), *(x.values.to_numpy(zero_copy_only=False) for x in block["held"])])


def _longs(column: pa.ChunkedArray, kind: str = "<i8") -> np.ndarray:
    """The numbers of all rows of a column of packed ones."""
    return utf8(column)[0].view(kind)


def _dictionary(told: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """Counts and packed shares of a block's words, of which the texts have n at least; and the shards' rows in their order."""
    told = told.sort_by("shard")
    counts, shares = _longs(told["c"]), _longs(told["shares"])
    if len(counts) < n:
        raise ValueError("a block lacks a shard of its dictionary")
    return counts, shares, told


def _expect(model: Model, totals: dict, states: int):
    """Expected counts of a block's training documents: a row for each shard of its dictionary, and a side row."""

    def group(block: pa.Table, told: pa.Table) -> pa.Table:
        codes, lengths = _texts(block)
        held = _flags(block)
        codes, lengths = codes[~np.repeat(held, lengths)], lengths[~held]
        counts, shares, told = _dictionary(told, int(codes.max(initial=-1)) + 1)
        emit, _ = _emissions(counts, shares, totals, states)
        chains = Chains(model, emit, codes, lengths)
        expected, pairs, start = chains.walk(expect=True)
        e = _rounded(expected, np.bincount(codes, minlength=len(counts)))
        logs = np.zeros(states)
        logs[0] = chains.log_likelihood.sum() / np.log(10)
        side = np.rint(np.vstack([pairs, start, logs]) * SIDE_UNIT).astype("<i8")
        to = np.cumsum([len(c.as_py()) // 8 for c in told["c"]]).tolist()
        parts = [e[:, a:b] for a, b in zip([0, *to], to, strict=False)]
        # Shards take numbers of four bytes for what fits them.
        packed = [x.astype("<i4" if x.max(initial=0) < 1 << 31 else "<i8").tobytes() for x in parts]
        number = told["block"][0].as_py() if len(parts) else 0
        shard = np.append(told["shard"].to_numpy(), -1 - number % SIDE_GROUPS).astype(np.int32)
        return pa.table([pa.array(np.full(len(shard), number)), pa.array(shard), pa.array([*packed, side.tobytes()], pa.binary())], names=["from_block", "to_shard", "e"])

    return group


def _score(model: Model, totals: dict, states: int):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def group(block: pa.Table, told: pa.Table) -> pa.Table:
        codes, lengths = _texts(block)
        counts, shares, _ = _dictionary(told, int(codes.max(initial=-1)) + 1)
        emit, unigram = _emissions(counts, shares, totals, states)
        chains = Chains(model, emit, codes, lengths)
        chains.walk()
        begin = np.cumsum(lengths) - lengths
        known = np.add.reduceat((counts > 0)[codes].astype(np.int64), begin) if len(begin) else begin
        base = np.add.reduceat(np.log10(unigram)[codes], begin) if len(begin) else np.zeros(0)
        ids = pa.concat_arrays([x.values for x in block["ids"]]) if block.num_rows else pa.array([], pa.int64())
        columns = [ids, pa.array(_flags(block)), pa.array(lengths), pa.array(known), pa.array(np.full(len(lengths), totals["n"], np.int64)), pa.array(base), pa.array(chains.log_likelihood / np.log(10))]
        return pa.table(columns, names=names)

    return group


_TOLD = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("c", pa.binary()), ("shares", pa.binary()), ("keys", pa.binary()), ("sums", pa.list_(pa.int64()))])
_TOLD_COLUMNS = "block long, shard int, c binary, shares binary, keys binary, sums array<long>"


def _told(shard: int, blocks: np.ndarray, sizes: np.ndarray, keys: np.ndarray, e: np.ndarray, counts: np.ndarray, with_keys: bool) -> pa.Table:
    """What a shard tells: a row for each block, with the counts and packed shares of its words, and one with the shard's sums.

    e and counts are by the shard's words, of which keys are those of the blocks one after the other. Shares are those of
    the states but the last, rounded along their sum.
    """
    states = len(e)
    total = np.maximum(e.sum(axis=0), 1)
    upto = np.floor(float(SHARES) * np.cumsum(e, axis=0)[:-1] / total + 0.5).astype(np.int64)
    part = np.diff(upto, axis=0, prepend=0, append=SHARES) if states > 1 else np.full((1, len(counts)), SHARES, np.int64)
    known = counts > 0
    shares = np.zeros(len(counts), np.int64)
    for k in range(states - 1):
        shares += np.where(known, part[k] << (12 * k), 0)
    part = part[:, known]
    sums = [int(known.sum()), int(counts.sum()), *(part * counts[known]).sum(axis=1).tolist(), *part.sum(axis=1).tolist()]
    to = np.cumsum(sizes).tolist()
    spans = list(zip([0, *to], to, strict=False))
    packed = lambda values, kind: [values[a:b].astype(kind).tobytes() for a, b in spans] + [None]
    columns = [[*blocks.tolist(), None], [shard] * (len(spans) + 1), packed(counts[keys], "<i8"), packed(shares[keys], "<i8"), packed(keys, "<i4") if with_keys else [None] * (len(spans) + 1), [None] * len(spans) + [sums]]
    return pa.table([pa.array(v, f.type) for v, f in zip(columns, _TOLD, strict=True)], schema=_TOLD)


def _nothing() -> pa.Table:
    return _TOLD.empty_table()


def _number(states: int, others: list[int]):
    """Numbers a shard's words; tells their counts, and shares as in the sample or those of other words."""

    def group(rows: pa.Table, sample: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _nothing()
        rows = rows.sort_by("block")
        size = _longs(rows["sizes"], "<i4").astype(np.int64)
        at = np.concatenate([[0], np.cumsum(size)])
        found = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(utf8(rows["words"])[0])]).dictionary_encode()
        keys, names = found.indices.to_numpy(), found.dictionary
        counts = np.zeros(len(names), np.int64)
        np.add.at(counts, keys, _longs(rows["n"]))
        e = np.repeat(np.array(others, np.int64)[:, None], len(names), axis=1)
        if sample.num_rows:
            where = pc.index_in(names, value_set=sample["word"].combine_chunks().cast(pa.large_binary())).fill_null(-1).to_numpy()
            for k, x in enumerate(_names(states)):
                e[k, where >= 0] = sample[x].to_numpy()[where[where >= 0]]
        sizes = np.array([len(x.as_py()) // 4 for x in rows["sizes"]])
        return _told(rows["shard"][0].as_py(), rows["block"].to_numpy(), sizes, keys, e, counts, True)

    return group


def _add(states: int):
    """Adds up the expected counts of a shard's words, or those of the side rows of a group of blocks."""

    def group(rows: pa.Table, counted: pa.Table) -> pa.Table:
        if not rows.num_rows:
            sums = sum(np.frombuffer(x.as_py(), "<i8") for x in counted["e"])
            return pa.table([pa.array(v, f.type) for v, f in zip([[None], [counted["to_shard"][0].as_py()], [None], [None], [None], [sums]], _TOLD, strict=True)], schema=_TOLD)
        rows, counted = rows.sort_by("block"), counted.sort_by("from_block")
        if rows["block"].to_pylist() != counted["from_block"].to_pylist():
            raise ValueError("a shard lacks the counts of a block")
        sizes = np.array([len(x.as_py()) // 4 for x in rows["keys"]])
        keys = _longs(rows["keys"], "<i4")
        parts = [np.frombuffer(x.as_py(), "<i4" if len(x.as_py()) == 4 * states * n else "<i8").reshape(states, n) for x, n in zip(counted["e"], sizes.tolist(), strict=True)]
        # Whole numbers below 2 ** 53, so that their sums don't depend on the order.
        e = np.stack([np.bincount(keys, weights=np.concatenate([x[k] for x in parts])) for k in range(states)]).astype(np.int64)
        return _told(rows["shard"][0].as_py(), rows["block"].to_numpy(), sizes, keys, e, e.sum(axis=0) // UNIT, False)

    return group


def _totals(told: DataFrame, states: int) -> dict:
    """Tokens and distinct words, and each state's tokens and distinct words."""
    sums = told.filter("block is null and shard >= 0").agg(*(F.coalesce(F.sum(F.col("sums")[k].cast("decimal(20,0)")), F.lit(0)).alias(f"s{k}") for k in range(2 + 2 * states))).head()
    sums = [int(x) for x in sums]
    return {"v": sums[0], "n": sums[1], "mass": [x / SHARES for x in sums[2 : 2 + states]], "types": [x / SHARES for x in sums[2 + states :]]}


def _sides(rows: DataFrame, states: int) -> np.ndarray:
    """The side rows of the sample, of which there are states + 2 at most."""
    out = np.zeros((states + 2, states))
    for r in rows.filter("side is not null").collect():
        out[r["side"]] = [r[x] / SIDE_UNIT for x in _names(states)]
    return out


def _added(told: DataFrame, states: int) -> np.ndarray:
    """Expected transitions, starts, and the likelihood, of which there are SIDE_GROUPS sums at most."""
    out = [0] * (states * (states + 2))
    for r in told.filter("shard < 0").collect():
        out = [x + y for x, y in zip(out, r["sums"], strict=True)]
    return np.array([x / SIDE_UNIT for x in out]).reshape(states + 2, states)


def _sample(docs: DataFrame, sample: int, states: int, shards: int) -> DataFrame:
    """(word, shard, side, e0, ...) of the model of the sample, fitted in one task."""
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5))
    short = docs.filter((fold != 1) & F.col("doc_id").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    picked = short.select(F.xxhash64("doc_id").alias("hash"), F.col("text").cast("binary").alias("text")).orderBy("hash", "text").limit(sample)
    schema = "word binary, shard int, side int, " + ", ".join(f"{x} long" for x in _names(states))
    return picked.groupBy(F.lit(0).alias("one")).applyInArrow(_sample_task(states, shards), schema)


def lm_scores(docs: DataFrame, states: int = STATES, sample: int = SAMPLE, rounds: int = ROUNDS, report: list | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    rounds: the most Baum-Welch rounds over all training documents, at least one; they stop early when a round adds
    less than ENOUGH to a training token's mean log10 likelihood. The sample only starts them. Expected counts are
    rounded to 1 / UNIT, and a word's shares of the states to 1 / SHARES; likelihoods are exact for the model so stored.
    report, if given, gets the mean log10 likelihood of a training token before each round.

    score: log10 of the text's probability under the model; base_score: under the unigram model with 0.5 added to each
    count. Both learn from the documents that aren't held out. Words that those don't have count as one more word. A
    null text counts as empty, which is one end; a null doc_id is not held out; repeated rows count each time and keep
    their rows. A very long text is worked on in segments, with memory for its word numbers alone. Without training
    documents all words are unknown. An empty table gives an empty result; other columns are not read.
    """
    if not 1 <= states <= 6:
        raise ValueError("1 to 6 states")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0]
    shards = max(1, -(-(size or 0) // SHARD_BYTES))
    start = written(_sample(docs, sample, states, shards), "hmm-sample")
    blocks = written(docs.mapInArrow(_blocks(shards), _BLOCK_COLUMNS), "hmm-blocks")
    side = _sides(start, states)
    if not side.any():
        model, share = fit_sample([], states)
        side = np.vstack([model.trans, model.before, share[None]])
    others = [int(round(x * SIDE_UNIT)) for x in side[states + 1]]

    dealt = blocks.filter("shard is not null").select("shard", "block", "words", "sizes", "n").groupBy("shard")
    known = start.filter("side is null").select("shard", "word", *_names(states)).groupBy("shard")
    first = told = written(dealt.cogroup(known).applyInArrow(_number(states, others), _TOLD_COLUMNS), "hmm-shards")
    keys = first.filter("block is not null").select("shard", "block", "keys")
    model, totals = Model(side[:states], side[states]), _totals(told, states)
    coded = blocks.filter("codes is not null").select("block", "ids", "lengths", "held", "codes")

    def by_block():
        return coded.groupBy("block").cogroup(told.filter("block is not null").select("block", "shard", "c", "shares").groupBy("block"))

    reached = None
    for k in range(rounds):
        counted = by_block().applyInArrow(_expect(model, totals, states), "from_block long, to_shard int, e binary")
        before, told = told, written(keys.groupBy("shard").cogroup(counted.groupBy("to_shard")).applyInArrow(_add(states), _TOLD_COLUMNS), f"hmm-round-{k}")
        if k:
            dropped(before)
        side = _added(told, states)
        model, totals = _updated(side[:states], side[states]), _totals(told, states)
        mean = side[states + 1][0] / max(totals["n"], 1)
        if report is not None:
            report.append(mean)
        if reached is not None and mean - reached < ENOUGH:
            break
        reached = mean
        gc.collect()
    return by_block().applyInArrow(_score(model, totals, states), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
