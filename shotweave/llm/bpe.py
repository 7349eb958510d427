"""Byte-level BPE encoding and decoding with a pair occurrence index (operator 6)."""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Text bytes whose new words are merged together, and words whose ids a task remembers at most before it starts afresh.
PART_BYTES = 2 << 20
REMEMBERED = 200_000

#: How the vocabulary's own file splits text, for text of ASCII letters in lower case and for any.
_ASCII = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_ANY = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Tables of a tokenizer file: first symbols per byte (inside and at the end of a word), merges by rank, special tokens, names."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        letters = _byte_letters()
        self.inner = np.array([ids[x] for x in letters], np.int32)
        self.last = np.array([ids[x + end] for x in letters], np.int32)
        merges = [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], np.int32)
        self.right = np.array([ids[b] for _, b in merges], np.int32)
        self.made = np.array([ids[a + b] for a, b in merges], np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: x for x, i in (ids | self.special).items()}
        self.size = max(self.names) + 1
        keys = self.left.astype(np.int64) * self.size + self.right
        self._order = np.argsort(keys)
        self._keys = keys[self._order]
        self._split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it never merges."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._order[at], -1)

    def pieces(self, word: bytes) -> list[bytes | int]:
        """The parts of a text without ASCII white space within which pairs merge; an integer is a special token's id."""
        if word.isascii() and b"<|" not in word:
            return _ASCII.findall(word.lower())
        out: list[bytes | int] = []
        for part in self._split.split(word.decode("utf-8")) if self._split else [word.decode("utf-8")]:
            if part in self.special:
                out.append(self.special[part])
                continue
            part = unicodedata.normalize("NFC", part)
            part = "".join(map(str.lower, part)) if "Σ" in part else part.lower()
            out.extend(p.encode() for p in _ANY.findall(part))
        return out


@functools.lru_cache(1)
def load(path: str) -> Vocabulary:
    """A vocabulary file, read once per worker process."""
    return Vocabulary(path)


def merge_pieces(vocab: Vocabulary, pieces: list[bytes | int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces in a row, and how many each has.

    The index maps every pair that merges to all its places; the heap holds the active ranks. The least rank is applied to all its
    places at once (left to right where they overlap), then the pairs on both sides of each merge are entered in their lists.
    A place whose pair has changed since it was listed is skipped. A merge only makes pairs of higher ranks.
    """
    raw = b"".join(b"\0" if isinstance(p, int) else p for p in pieces)
    size = np.fromiter((1 if isinstance(p, int) else len(p) for p in pieces), np.int64, len(pieces))
    codes = np.frombuffer(raw, np.uint8)
    n = len(codes)
    if not n:
        return np.zeros(0, np.int32), size
    ends = np.cumsum(size) - 1
    sym = vocab.inner[codes]
    sym[ends] = vocab.last[codes[ends]]
    for k, p in enumerate(pieces):
        if isinstance(p, int):
            sym[ends[k]] = p
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    after[ends] = -1
    before[ends[:-1] + 1] = -1
    places: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(at: np.ndarray) -> None:
        rank = vocab.ranks(sym[at], sym[after[at]])
        at, rank = at[rank >= 0], rank[rank >= 0]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cut = np.nonzero(np.diff(rank))[0] + 1
        for r, a, b in zip(rank[np.r_[0, cut]].tolist(), [0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True):
            if r not in places:
                places[r] = []
                heapq.heappush(heap, r)
            places[r].append(at[a:b])

    enter(np.nonzero(after >= 0)[0].astype(np.int32))
    while heap:
        r = heapq.heappop(heap)
        lists = places.pop(r)
        at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
        a, b = vocab.left[r], vocab.right[r]
        at = at[(sym[at] == a) & (after[at] >= 0)]
        at = at[sym[after[at]] == b]
        if not len(at):
            continue
        if a == b:  # of overlapping places, every other one from the left
            run = np.r_[True, after[at[:-1]] != at[1:]]
            step = np.arange(len(at))
            at = at[(step - np.maximum.accumulate(np.where(run, step, 0))) % 2 == 0]
        gone = after[at]
        beyond = after[gone]
        sym[at], sym[gone], after[at] = vocab.made[r], -1, beyond
        has = beyond >= 0
        before[beyond[has]] = at[has]
        prior = before[at]
        enter(np.concatenate([prior[prior >= 0], at[has]]))
    alive = sym >= 0
    return sym[alive], np.add.reduceat(alive.astype(np.int64), ends - size + 1)


class Encoder:
    """Encodes texts as the vocabulary's library does; remembers the ids of words, so each is merged once."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: Iterable[bytes]) -> None:
        fresh = [w for w in words if w not in self.index]
        if not fresh:
            return
        pieces: dict[bytes | int, int] = {}  # equal pieces of different words are merged once
        parts = [[pieces.setdefault(p, len(pieces)) for p in self.vocab.pieces(w)] for w in fresh]
        ids, sizes = merge_pieces(self.vocab, list(pieces))
        starts = np.cumsum(sizes) - sizes
        flat = np.fromiter((p for x in parts for p in x), np.int64)
        got = _gather(ids, starts[flat], sizes[flat])
        per = np.zeros(len(fresh) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)), out=per[1:])
        total = np.r_[0, np.cumsum(sizes[flat])]
        length = total[per[1:]] - total[per[:-1]]
        self.starts = np.concatenate([self.starts, len(self.ids) + total[per[:-1]]])
        self.sizes = np.concatenate([self.sizes, length])
        self.ids = np.concatenate([self.ids, got])
        self.index.update(zip(fresh, range(len(self.index), len(self.index) + len(fresh)), strict=True))

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has. White space separates words in this vocabulary and has no id."""
        words = [(t or b"").split() for t in texts]
        if len(self.index) > REMEMBERED:
            self._clear()
        self._learn(set().union(*words))
        at = np.fromiter((self.index[w] for x in words for w in x), np.int64)
        sizes = self.sizes[at]
        total = np.r_[0, np.cumsum(sizes)]
        per = np.r_[0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]
        return _gather(self.ids, self.starts[at], sizes), total[per[1:]] - total[per[:-1]]


def _gather(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.repeat(starts - ends + sizes, sizes) + np.arange(total)]


class Decoder:
    """Texts of id lists: the tokens' names, joined by spaces, as the library does for a file without a decoder. Unknown ids are left out."""

    def __init__(self, vocab: Vocabulary):
        self.names = [vocab.names.get(i) for i in range(vocab.size)]

    def decode(self, ids: Iterable[int]) -> str:
        names, size = self.names, len(self.names)
        try:
            return " ".join([names[i] for i in ids])
        except (TypeError, IndexError):
            return " ".join(names[i] for i in ids if 0 <= i < size and names[i] is not None)


def encode_documents(docs: DataFrame, keep: list[str], path: str | None = None, decode: bool = False) -> DataFrame:
    """``keep`` columns and ``ids`` (array of int) of each text; with ``decode`` also ``decoded``, the text that those ids give.

    Needs ``text``. Null and empty texts have no ids and decode to the empty text; repeated rows get equal results; an empty table gives
    an empty result. One narrow stage without a shuffle: each task merges the distinct words of a bounded part of its texts.
    """
    path = path or default_vocabulary()

    def factory():
        vocab = load(path)
        encoder, decoder = Encoder(vocab), Decoder(vocab)

        def work(texts):
            ids, sizes = encoder.encode(texts)
            ends = np.cumsum(sizes)
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            out = {"ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))}
            if decode:
                out["decoded"] = [decoder.decode(ids[a:b].tolist()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            return out

        return work

    return map_texts(docs, factory, keep, "ids array<int>" + ", decoded string" * decode, PART_BYTES)


def decode_documents(encoded: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """``keep`` columns and ``text`` of a table of ``ids``; null ids give a null text."""
    path = path or default_vocabulary()
    kept = [f"`{k}` {encoded.schema[k].dataType.simpleString()}" for k in keep]

    def run(batches):
        decoder = Decoder(load(path))
        for batch in batches:
            texts = [None if x is None else decoder.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(texts, pa.string())], [*keep, "text"])

    return encoded.select(*keep, "ids").mapInArrow(run, ", ".join([*kept, "text string"]))


def round_trip(docs: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """``keep`` columns, ``n_tokens``, and digests of the decimal ids joined by spaces and of the decoded text."""
    both = encode_documents(docs, keep, path, decode=True)
    return both.select(*keep, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
