"""BPE encoding and decoding with an index of pair occurrences.

The distinct words of a run of rows that aren't known yet are laid out together as one array of symbols with links to
their neighbours. An index maps each adjacent pair that has a rank to all its positions. The active ranks are taken in
ascending order; a rank is applied at all its positions at once, and the lists of the pairs next to them are updated.
Documents are then put together from the ids of their words, and texts from the strings of the ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, span_hashes, utf8, words

#: Words whose ids a worker remembers; with more it starts afresh.
REMEMBERED = 300_000
_NONE = np.int64(1 << 40)
_WHITE = r"\t-\r \x85\xa0  -     　"


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself where it is printable in Latin-1, else the next one from U+0100 on."""
    own = {b: chr(b) for b in (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))}
    spare = iter(range(0x100, 0x200))
    return [own[b] if b in own else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A tokenizer file of kind BPE with word ends, NFC, lower case, and a pattern that drops white space."""

    def __init__(self, content: bytes) -> None:
        spec = json.loads(content)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") is None or spec.get("decoder") is not None or spec.get("post_processor") is not None:
            raise ValueError("a BPE file with word ends and without decoder or post-processor is needed")
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in split] != ["Split", "ByteLevel"] or split[0]["behavior"] != "Removed" or not split[0]["invert"]:
            raise ValueError("this chain of normalizers and pre-tokenizers isn't supported")
        # \s is Unicode's white space there, without the separators U+001C to U+001F; a line feed marks a word's end here.
        self.pieces = regex.compile(split[0]["pattern"]["Regex"].replace(r"[^\s", f"[^{_WHITE}") + r"|\n")
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"]
        self.strings = dict((i, s) for s, i in vocab.items())
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letters = byte_letters()
        missing = -1
        self.inner = np.array([vocab.get(c, missing) for c in letters], np.int64)
        self.last = np.array([vocab.get(c + self.suffix, missing) for c in letters], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.width = 1 + max(self.strings)
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        key = left * self.width + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.left, self.right, self.made = left, right, made

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NONE where it has none; b < 0 stands for a missing neighbour."""
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (b >= 0) & (a >= 0), self.ranks[at], _NONE)

    def split(self, text: str) -> list[tuple[str, bool]]:
        """The text in parts: special tokens, marked True, and what is between them."""
        if self.special_split is None:
            return [(text, False)]
        return [(x, x in self.special) for x in self.special_split.split(text) if x]

    def normalized(self, text: str) -> str:
        import unicodedata

        if text.isascii():
            return text.lower()
        # str.lower() looks at the letters around a capital sigma; here each character is lowered by itself.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def merge(vocab: Vocabulary, body: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words that stand in body one after another, and the number of ids of each word."""
    n = len(body)
    sym = vocab.inner[np.frombuffer(body, np.uint8)].copy()
    sym[ends - 1] = vocab.last[np.frombuffer(body, np.uint8)[ends - 1]]
    nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
    nxt[ends - 1] = -1
    prv[np.concatenate([[0], ends[:-1]])] = -1
    alive = np.ones(n, bool)
    rank = vocab.rank(sym, np.where(nxt >= 0, sym[nxt % n], -1))

    # The index: the positions of each pair by rank; new positions are added to the lists in pieces.
    where = np.argsort(rank, kind="stable")
    found = rank[where]
    where = where[: np.searchsorted(found, _NONE)]
    starts = np.flatnonzero(np.diff(found[: len(where)], prepend=-1))
    index: dict[int, list[np.ndarray]] = {int(found[a]): [where[a:b]] for a, b in zip(starts, [*starts[1:], len(where)], strict=True)}
    active = list(index)
    heapq.heapify(active)
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r, None)
        if lists is None:
            continue
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        at = at[rank[at] == r]
        if not len(at):
            continue
        if vocab.left[r] == vocab.right[r] and len(at) > 1:
            # Positions in a row share symbols: the first of each two goes.
            keep, taken = [], -1
            for p in at.tolist():
                if p != taken:
                    keep.append(p)
                    taken = nxt[p]
                else:
                    taken = -1
            at = np.array(keep)
        gone = nxt[at]
        after = nxt[gone]
        sym[at] = vocab.made[r]
        alive[gone] = False
        rank[gone] = _NONE
        nxt[at] = after
        has = after >= 0
        prv[after[has]] = at[has]
        before = prv[at]
        left = before[before >= 0]
        changed = np.concatenate([at, left])
        follower = nxt[changed]
        fresh = vocab.rank(sym[changed], np.where(follower >= 0, sym[follower], -1))
        rank[changed] = fresh
        some = fresh < _NONE
        changed, fresh = changed[some], fresh[some]
        if len(fresh) > 1:
            order = np.argsort(fresh, kind="stable")
            changed, fresh = changed[order], fresh[order]
        cuts = np.flatnonzero(fresh[1:] != fresh[:-1]) + 1 if len(fresh) > 1 else []
        for a, b in zip([0, *cuts], [*cuts, len(fresh)], strict=True):
            if b > a:
                x = int(fresh[a])
                if x in index:
                    index[x].append(changed[a:b])
                else:
                    index[x] = [changed[a:b]]
                    heapq.heappush(active, x)
    # Bytes without a symbol of their own give no id.
    alive &= sym >= 0
    total = np.concatenate([[0], np.cumsum(alive)])
    return sym[alive], np.diff(total[np.concatenate([[0], ends])])


class Encoder:
    """Ids of words, with a memory of those already met."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.number: dict[bytes, int] = {}
        self.ids: list[bytes] = []
        self.texts: list[bytes] = []
        self.counts: list[int] = []
        n = vocab.width
        self.id_text = [b" %d" % i for i in range(n)]
        self.string = [(" " + vocab.strings.get(i, "")).encode() for i in range(n)]

    def learn(self, new: list[bytes]) -> None:
        """Adds words (without ASCII white space) that aren't known yet."""
        vocab, letters, plan = self.vocab, [], [[]]
        piece_of: dict[str, int] = {}
        for part, special in vocab.split("\n".join(map(bytes.decode, new))):
            if special:
                plan[-1].append(-1 - vocab.special[part])
                continue
            own = plan[-1]
            for piece in vocab.pieces.findall(vocab.normalized(part)):
                if piece == "\n":
                    plan.append(own := [])
                    continue
                k = piece_of.get(piece)
                if k is None:
                    k = piece_of[piece] = len(letters)
                    letters.append(piece.encode())
                own.append(k)
        if letters:
            ends = np.cumsum([len(x) for x in letters])
            ids, counts = merge(vocab, b"".join(letters), ends)
            at = np.concatenate([[0], np.cumsum(counts)]).tolist()
            ids = ids.tolist()
        for word, own in zip(new, plan, strict=True):
            got: list[int] = []
            for k in own:
                if k < 0:
                    got.append(-1 - k)
                else:
                    got += ids[at[k] : at[k + 1]]
            self.number[word] = len(self.ids)
            self.ids.append(b"".join([self.id_text[i] for i in got]))
            self.texts.append(b"".join([self.string[i] for i in got]))
            self.counts.append(len(got))

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[bytes], list[bytes]]:
        """Of each text: the number of ids, the ids in decimal and the decoded text, both joined by one space."""
        starts, ends, text = words(data, at)
        hashes = span_hashes(data, starts, ends)
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        raw = data.tobytes()
        distinct = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        if len(self.number) > REMEMBERED:
            self.number, self.ids, self.texts, self.counts = {}, [], [], []
        new = [w for w in distinct if w not in self.number]
        if new:
            self.learn(new)
        of = np.array([self.number[w] for w in distinct], np.int64)
        own = of[inverse] if len(of) else of
        bounds = np.searchsorted(text, np.arange(len(at)))
        counts = np.array(self.counts, np.int64)[own] if len(own) else own
        total = np.concatenate([[0], np.cumsum(counts)])
        own, ids, texts = own.tolist(), self.ids, self.texts
        id_rows, text_rows = [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            id_rows.append(b"".join([ids[k] for k in own[a:b]])[1:])
            text_rows.append(b"".join([texts[k] for k in own[a:b]])[1:])
        return np.diff(total[bounds]), id_rows, text_rows


def _vocabulary(docs: DataFrame, tokenizer: str) -> bytes:
    """The tokenizer file's content; it has a fixed size and is shipped to the tasks."""
    with open(tokenizer, "rb") as f:
        return f.read()


def bpe(docs: DataFrame, tokenizer: str, texts: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256; with texts=True ids and decoded too.

    tokenizer: path of a tokenizer file on the driver. A text is encoded without special tokens around it; strings of
    special tokens within a text become those tokens. Decoding joins the strings of all ids with spaces, as a file
    without decoder asks for. A null text counts as empty and has no tokens; rows are independent, so ties, repeated
    rows and null identifiers keep their own rows; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_vocabulary(docs, tokenizer))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(shared.value))
        for batch in batches:
            for part in slices(batch):
                n, ids, decoded = encoder.encode(*utf8(part.column("text")))
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if texts:
                    columns += [pa.array(ids, pa.binary()).cast(pa.string()), pa.array(decoded, pa.binary()).cast(pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids string, decoded string" if texts else ""))
