"""A quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is a position of the chain with two labels, good and bad. Its features describe the line and its two
neighbours (shares of capitals, symbols, digits, separators and repeated words, word lengths, repeated lines).
The field is fitted with L-BFGS on a bounded, documented number of labelled documents, whose lines carry the label of
their document. Forward-backward gives each line's marginal; marginals weighted by line length make the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lowered, slices, span_hashes, utf8, words

#: Labelled documents that the field is fitted on: those with the smallest hashes of their doc_id.
FIT_DOCUMENTS = 4000
#: Bytes of a text that count as capitals, symbols, and so on.
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "symbol": b"#$%&*@^~<>{}[]\\/=+_`",
    "bang": b"!?",
    "bar": b"|",
    "digit": b"0123456789",
    "stop": b".,;:'\"()-",
    "wide": bytes(range(0xC2, 0xF5)),
}
_CUTS = (0.01, 0.04, 0.1, 0.25, 0.5)
_RATES = (*_CLASSES, "again", "repeat")
_BASE = len(_RATES) + 6
#: Of one line: the bias, each rate and whether it is above each cut, and the measures; neighbours give rates and measures.
_OWN = 1 + _BASE + len(_RATES) * len(_CUTS)
N_FEATURES = _OWN + 2 * (_BASE + 1)


def lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each line, and the number of lines of each text: at least one, also of an empty text."""
    newlines = np.flatnonzero(data == 10)
    newlines = newlines[~np.isin(newlines + 1, at[1:])]
    counts = 1 + np.diff(np.searchsorted(newlines, at))
    return np.sort(np.concatenate([at[:-1], newlines + 1])), np.sort(np.concatenate([at[1:], newlines])), counts


def _per_line(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=total[1:])
    return total[ends] - total[starts]


def line_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rates and measures of each line, its length in bytes, and the number of lines of each text."""
    starts, ends, counts = lines(data, at)
    size, n = np.maximum(ends - starts, 1), len(starts)
    out = np.zeros((n, _BASE), np.float32)
    for k, name in enumerate(_CLASSES):
        table = np.zeros(256, bool)
        table[list(_CLASSES[name])] = True
        out[:, k] = _per_line(table[data], starts, ends) / size
    first, last, _ = words(data, at)
    hashes, own = span_hashes(lowered(data), first, last), np.searchsorted(starts, first, "right") - 1
    total = np.bincount(own, minlength=n)
    some = np.maximum(total, 1)
    k = len(_CLASSES)
    same = (hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1]) if len(own) else np.zeros(0, bool)
    out[:, k] = np.bincount(own[1:][same], minlength=n) / some
    keys = np.sort((own.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    out[:, k + 1] = 1 - np.bincount((keys[new] >> np.uint64(40)).astype(np.int64), minlength=n) / some
    out[:, k + 1][total == 0] = 0
    text = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    whole = span_hashes(data, starts, ends)
    mark = (text << np.uint64(40)) | (whole >> np.uint64(24))
    order = np.argsort(mark, kind="stable")
    twin = np.zeros(n, bool)
    equal = mark[order][1:] == mark[order][:-1]
    twin[order[1:][equal]] = True
    twin[order[:-1][equal]] = True
    length = np.bincount(own, weights=last - first, minlength=n) / some
    k += 2
    out[:, k] = np.log1p(ends - starts) / 8
    out[:, k + 1] = np.log1p(total) / 6
    out[:, k + 2] = np.minimum(length, 40) / 20
    out[:, k + 3] = twin
    out[:, k + 4] = np.repeat(np.log1p(counts), counts) / 8
    out[:, k + 5] = total <= 1
    return out, (ends - starts + 1).astype(np.float32), counts


def expand(base: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Features of each line with those of the lines before and after it in the same text."""
    n, ends = len(base), np.cumsum(counts)
    out = np.zeros((n, N_FEATURES), np.float32)
    out[:, 0] = 1
    out[:, 1 : 1 + _BASE] = base
    for k, cut in enumerate(_CUTS):
        first = 1 + _BASE + k * len(_RATES)
        out[:, first : first + len(_RATES)] = base[:, : len(_RATES)] > cut
    has = np.ones(n, bool)
    has[ends - counts] = False
    before = np.flatnonzero(has)
    out[before, _OWN : _OWN + _BASE] = base[before - 1]
    out[before, _OWN + _BASE] = 1
    out[before - 1, _OWN + _BASE + 1 : -1] = base[before]
    out[before - 1, -1] = 1
    return out


def forward_backward(score: np.ndarray, trans: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Marginals (n, 2), the sum of log partition functions, and expected transitions (2, 2).

    score: of labels at each position; trans: of label pairs. All chains go through a step together, the longest first.
    """
    n, steps = len(score), int(counts.max()) if len(counts) else 0
    peak = score.max(axis=1, keepdims=True) if n else score
    emit, move = np.exp(score - peak), np.exp(trans - trans.max())
    first = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    active = np.searchsorted(-counts[order], -np.arange(steps), "left")
    alpha, scale, beta = np.zeros((n, 2)), np.ones(n), np.ones((n, 2))
    begin = first[order]
    for t in range(steps):
        at = begin[: active[t]] + t
        a = emit[at] if t == 0 else (alpha[at - 1] @ move) * emit[at]
        s = a.sum(axis=1)
        alpha[at], scale[at] = a / s[:, None], s
    for t in range(steps - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        beta[at] = ((emit[at + 1] * beta[at + 1]) @ move.T) / scale[at + 1][:, None]
    log_z = float(np.log(scale).sum() + peak.sum() + trans.max() * (n - len(counts)))
    has = np.ones(n, bool)
    has[first[counts > 0]] = False
    to = np.flatnonzero(has)
    pairs = alpha[to - 1][:, :, None] * move[None] * (emit[to] * beta[to] / scale[to][:, None])[:, None, :]
    return alpha * beta, log_z, pairs.sum(axis=0)


def _minimise(fun, x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with a backtracking line search."""
    value, grad = fun(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        d, saved = -grad, []
        for s, y, r in reversed(steps):
            a = r * (s @ d)
            saved.append(a)
            d = d - a * y
        if steps:
            s, y, _ = steps[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y, r), a in zip(steps, reversed(saved), strict=True):
            d = d + s * (a - r * (y @ d))
        slope = grad @ d
        step = 1.0 if steps else min(1.0, 1 / max(np.abs(grad).sum(), 1e-12))
        for _ in range(20):
            new_value, new_grad = fun(x + step * d)
            if new_value <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = step * d, new_grad - grad
        if s @ y > 1e-12:
            steps = [*steps, (s, y, 1 / (s @ y))][-memory:]
        done = abs(value - new_value) < 1e-7 * max(1, abs(value))
        x, value, grad = x + s, new_value, new_grad
        if done:
            break
    return x


def fit(base: np.ndarray, size: np.ndarray, counts: np.ndarray, labels: np.ndarray, l2: float = 1.0, rounds: int = 80) -> dict:
    """Weights of the field, and the two numbers that turn the mean marginal into a calibrated score."""
    features = expand(base, counts)
    y = np.repeat(labels.astype(np.int64), counts)
    edges = np.maximum(counts - 1, 0)
    seen = np.diag([float(edges[labels == 0].sum()), float(edges[labels == 1].sum())])
    # The classes weigh alike whatever their numbers, so that a rare class isn't drowned; calibration brings the rates back.
    n_docs = len(labels)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, trans = x[:N_FEATURES], x[N_FEATURES:].reshape(2, 2)
        s = np.zeros((len(features), 2))
        s[:, 1] = features @ w.astype(np.float32)
        p, log_z, pairs = forward_backward(s, trans, counts)
        value = log_z - s[np.arange(len(s)), y].sum() - (trans * seen).sum()
        grad = np.concatenate([(p[:, 1] - y).astype(np.float32) @ features, (pairs - seen).ravel()])
        return (value + l2 * (x @ x) / 2) / n_docs, (grad + l2 * x) / n_docs

    x = _minimise(loss, np.zeros(N_FEATURES + 4), rounds)
    model = {"w": x[:N_FEATURES], "trans": x[N_FEATURES:].reshape(2, 2), "a": 1.0, "b": 0.0}
    raw = document_scores(model, base, size, counts)[1]

    def platt(v: np.ndarray) -> tuple[float, np.ndarray]:
        z = v[0] * raw + v[1]
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        value = -np.mean(np.log(np.where(labels == 1, p, 1 - p) + 1e-12)) + 1e-4 * (v[0] - 1) ** 2
        return value, np.array([np.mean((p - labels) * raw) + 2e-4 * (v[0] - 1), np.mean(p - labels)])

    model["a"], model["b"] = _minimise(platt, np.array([1.0, 0.0]), 50)
    model["a"] = max(model["a"], 1e-3)
    return model


def document_scores(model: dict, base: np.ndarray, size: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, log-odds of the length-weighted mean marginal, and number of bad lines of each text."""
    s = np.zeros((len(base), 2))
    s[:, 1] = expand(base, counts) @ model["w"].astype(np.float32)
    p = forward_backward(s, model["trans"], counts)[0]
    p = np.clip(p[:, 1] / p.sum(axis=1), 0, 1)
    first = np.cumsum(counts) - counts
    mean = np.add.reduceat(p * size, first) / np.add.reduceat(size.astype(np.float64), first)
    mean = np.clip(mean, 1e-9, 1 - 1e-9)
    raw = np.log(mean / (1 - mean))
    return 1 / (1 + np.exp(-np.clip(model["a"] * raw + model["b"], -40, 40))), raw, np.add.reduceat((p < 0.5).astype(np.int64), first)


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 3, is 1; a null doc_id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            base, size, counts = line_features(*utf8(part.column("text")))
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("label"),
                    pa.array([base[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)], pa.binary()),
                    pa.array([size[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)], pa.binary()),
                ],
                ["label", "base", "size"],
            )


def train(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCUMENTS) -> dict | None:
    """Fits the field on at most `most` labelled rows outside the held-out third; None if there are none."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.filter(~held_out(F.col("doc_id")))
    # orderBy + limit is a top-k over ids and labels only; no text moves for it.
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    rows = rows.select("label", "text").mapInArrow(_features, "label int, base binary, size binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (bytes(r["base"]), r["label"]))
    size = [np.frombuffer(r["size"], np.float32) for r in rows]
    base = np.concatenate([np.frombuffer(r["base"], np.float32).reshape(-1, _BASE) for r in rows])
    return fit(base, np.concatenate(size), np.array([len(s) for s in size]), np.array([r["label"] for r in rows]))


def _scored(field: dict | None, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base, size, counts = line_features(*utf8(part.column("text")))
    if field is None:
        return np.full(len(counts), 0.5), counts, np.zeros(len(counts), np.int64)
    score, _, bad = document_scores(field, base, size, counts)
    return score, counts, bad


def good_documents(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCUMENTS) -> DataFrame:
    """The rows of docs, with all their columns, whose score is 0.5 or more; nulls and empty texts as in quality()."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(_scored(shared.value, part)[0] >= 0.5))

    return docs.mapInArrow(task, docs.schema)


def quality(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCUMENTS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, score, predicted, n_lines, n_bad_lines.

    labels (doc_id, quality) is read outside the held-out third only; rows with a null doc_id or quality are passed
    over, repeated ones count each time. A null text counts as empty, and an empty text is one empty line. Without
    labels every score is 0.5, which predicts 1. Only doc_id and text of docs are read, whatever its other columns.
    """
    model = train(docs, labels, most)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                score, counts, bad = _scored(shared.value, part)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array(counts.astype(np.int64)), pa.array(bad)], ["doc_id", "score", "n_lines", "n_bad_lines"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(task, "doc_id long, score double, n_lines long, n_bad_lines long")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_lines", "n_bad_lines")
