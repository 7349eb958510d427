"""Token-id files: documents compressed one by one with a shared zstandard dictionary (operator 3)."""

from __future__ import annotations

import array
import functools
import hashlib
import json
import os
import re
import string

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import default_vocabulary
from .common import slices, small_batches

#: Fixed value: the id that ends each document.
END_ID = 2
#: Bounds of the dictionary, of the documents that it is trained on (a sample by hash) and of the ids taken from each.
DICT_BYTES, DICT_DOCS, DICT_IDS = 64 << 10, 1000, 4096
#: Compressed bytes after which a block of documents is closed, and parts of words whose ids a process remembers.
BLOCK_BYTES, REMEMBERED = 2 << 20, 1_000_000
LEVEL = 3

BLOCKS = ("part int, block int, dict_hash string, first_id long, last_id long, n_ids long, "
          "index array<struct<doc_id: long, start: long, n_tokens: long, at: int, size: int>>, body binary")


#: By byte: white space as ``bytes.split`` sees it, ASCII letters and digits, ASCII punctuation, capitals.
_SPACE, _ALNUM, _MARK, _UPPER = (np.array([bytes([b]) in (bytes([x]) for x in kept) for b in range(256)]) for kept in (
    string.whitespace.encode(), (string.ascii_letters + string.digits).encode(), string.punctuation.encode(), string.ascii_uppercase.encode()))


class TextEncoder:
    """Texts to little-endian 32-bit ids by the tokenizers library.

    Where the file's own splitter drops white space between words, a word's ids do not depend on its neighbours, and no token spans the step
    from an ASCII letter or digit to ASCII punctuation. Then the library sees each such part of a word once, in lower case if the file lowers it
    anyway, and ids are remembered. Other files get whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        # a pattern of letters, numbers and non-white-space keeps every match inside a word
        pattern = steps[0].get("pattern", {}).get("Regex", "") if steps else ""
        self.by_word = r"[^\s\p{L}\p{N}]+" in pattern and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
        self.lowers = any(x.get("type") == "Lowercase" for x in (spec.get("normalizer") or {}).get("normalizers", []))
        # special tokens hold punctuation, more than one character of it
        self.special = re.compile(b"|".join(re.escape(t["content"].encode()) for t in spec["added_tokens"]) or b"(?!)")
        self.known: dict[bytes, bytes] = {}

    def _ids(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8") for t in texts], add_special_tokens=False)
        return [array.array("I", e.ids).tobytes() for e in found]

    def _parts(self, texts: list[bytes]) -> list[list[bytes]]:
        """The parts of each text's words. All texts are cut in one pass over their bytes.

        A word with other than ASCII characters keeps its case, as composing comes before lowering in the library; one with a special token stays whole.
        """
        ends = np.cumsum([len(t) + 1 for t in texts])
        joined = b"\n".join([*texts, b""])
        b = np.frombuffer(joined, np.uint8)
        word = np.cumsum(_SPACE[b], dtype=np.int32)
        whole = np.zeros(int(word[-1]) + 1, bool)
        whole[word[[m.start() for m in self.special.finditer(joined)]]] = True
        step = _ALNUM[b[:-1]] & _MARK[b[1:]] & ~whole[word[1:]]
        if self.lowers:
            whole[word[b >= 128]] = True
            b = b + ((_UPPER[b] & ~whole[word]) << 5).astype(np.uint8)
        at = np.flatnonzero(step) + 1
        cut = np.insert(b, at, 32).tobytes()
        ends += np.searchsorted(at, ends)
        return [cut[i:j].split() for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        texts = [t or b"" for t in texts]
        if not self.by_word or not texts:
            return self._ids(texts)
        parts = self._parts(texts)
        used = set().union(*parts)
        known = self.known
        if len(known) > REMEMBERED:  # what this slice uses stays
            known = self.known = {p: known[p] for p in used if p in known}
        new = [p for p in used if p not in known]
        for k in range(0, len(new), 20_000):
            known.update(zip(new[k:k + 20_000], self._ids(new[k:k + 20_000]), strict=True))
        return [b"".join([known[p] for p in x]) for x in parts]


@functools.lru_cache(1)
def encoder_of(path: str) -> TextEncoder:
    """The encoder of a vocabulary file, kept by the worker process from task to task."""
    return TextEncoder(path)


def train_dictionary(docs: DataFrame, path: str) -> bytes:
    """A dictionary trained on the first ids of at most ``DICT_DOCS`` documents; empty if there are too few ids to train on."""
    n = docs.count()
    key = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // DICT_DOCS)))
    sample = docs.select("doc_id", "text").where(key == 0).limit(DICT_DOCS)

    def run(batches):
        encoder = encoder_of(path)
        for _, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([x[:4 * DICT_IDS] for x in encoder.encode(texts)], pa.binary())], ["ids"])

    # a sample of a few thousand ids a document, at most 16 MB in all
    ids = [bytes(r["ids"]) for r in sample.mapInArrow(run, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICT_BYTES, ids, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdCompressor(level=LEVEL)


def write_token_files(docs: DataFrame, target: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Writes the ids of all documents, in ascending order of ``doc_id``, to the folder ``target`` on any store that Spark writes to.

    ``target/dictionary`` is one row: the dictionary and its hash. ``target/blocks`` holds blocks of documents: an index (id, start within the
    part, number of ids, place and size of the frame) and a body of one zstandard frame per document. Parts are ranges of ids, so one shuffle
    of the texts orders them; equal ids are ordered by a hash of their texts. Null texts are empty: they have the end id alone.
    Rows without an id come first.
    """
    path = path or default_vocabulary()
    spark = docs.sparkSession
    small_batches(spark)
    raw = train_dictionary(docs, path)
    digest = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(digest, bytearray(raw), path.rsplit("/", 1)[-1], end_id)], "dict_hash string, dictionary binary, vocabulary string, end_id int").coalesce(1).write.parquet(f"{target}/dictionary")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder, zstd = encoder_of(path), _compressor(raw)
        part, block, start = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        counts: list[int] = []
        sizes: list[int] = []
        body = bytearray()

        def close() -> pa.RecordBatch:
            nonlocal start, block, ids, counts, sizes, body
            n, size = np.array(counts, np.int64), np.array(sizes, np.int64)
            known = [i for i in ids if i is not None]
            index = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array((np.cumsum(size) - size).astype(np.int32)), pa.array(size.astype(np.int32))],
                                               names=["doc_id", "start", "n_tokens", "at", "size"])
            values = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([digest]), pa.array([min(known, default=None)], pa.int64()), pa.array([max(known, default=None)], pa.int64()),
                      pa.array([int(n.sum())]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), index), pa.array([bytes(body)], pa.binary())]
            start, block, ids, counts, sizes, body = start + int(n.sum()), block + 1, [], [], [], bytearray()
            return pa.RecordBatch.from_arrays(values, ["part", "block", "dict_hash", "first_id", "last_id", "n_ids", "index", "body"])

        for batch, texts in slices(batches):
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                frame = zstd.compress(found + end)
                ids.append(doc_id)
                counts.append(len(found) // 4 + 1)
                sizes.append(len(frame))
                body += frame
                if len(body) >= BLOCK_BYTES:
                    yield close()
        if ids:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(run, BLOCKS).write.parquet(f"{target}/blocks")


def _dictionary(spark: SparkSession, target: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{target}/dictionary").first()
    raw = bytes(row["dictionary"])
    if hashlib.sha256(raw).hexdigest() != row["dict_hash"]:
        raise ValueError(f"the dictionary in {target} does not have its own hash")
    return row["dict_hash"], raw


def read_token_files(spark: SparkSession, target: str, doc_ids: tuple[int, ...] | None = None) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` (little-endian 32-bit integers) of the files in ``target``.

    With ``doc_ids``, only blocks whose range holds one of them are read and only those frames are decompressed. A block written with another
    dictionary, or a frame of another length than its index says, raises an error.
    """
    small_batches(spark)
    digest, raw = _dictionary(spark, target)
    blocks = spark.read.parquet(f"{target}/blocks")
    # one number per written part, as many as the writing had tasks: small enough to go with the reading function
    sums = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before = dict(zip([p for p, _ in sums], np.cumsum([0, *(n for _, n in sums)]).tolist(), strict=False))
    wanted = set(doc_ids) if doc_ids is not None else None
    if wanted is not None:
        hit = F.lit(False)
        for d in sorted(wanted):
            hit = hit | ((F.col("first_id") <= d) & (F.col("last_id") >= d))
        blocks = blocks.where(hit)

    def run(batches):
        zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
        for batch in batches:
            for row in range(len(batch)):
                part, block, given = (batch.column(c)[row].as_py() for c in ("part", "block", "dict_hash"))
                if given != digest:
                    raise ValueError(f"block {part}/{block} needs dictionary {given}")
                index, body = batch.column("index")[row].values, memoryview(batch.column("body")[row].as_buffer())
                if wanted is not None:
                    index = index.filter(pa.array([i in wanted for i in index.field("doc_id").to_pylist()], pa.bool_()))
                n = index.field("n_tokens").to_numpy()
                places = zip(index.field("at").to_pylist(), index.field("size").to_pylist(), strict=True)
                ids = [zstd.decompress(body[at:at + size]) for at, size in places]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                if (sizes != 4 * n).any():
                    k = int(np.flatnonzero(sizes != 4 * n)[0])
                    raise ValueError(f"document {index.field('doc_id')[k]} has {sizes[k] // 4} ids, its index says {n[k]}")
                yield pa.RecordBatch.from_arrays([index.field("doc_id"), pa.array(before[part] + index.field("start").to_numpy()), index.field("n_tokens"), pa.array(ids, pa.binary())],
                                                 ["doc_id", "start", "n_tokens", "ids"])

    return blocks.select("part", "block", "dict_hash", "index", "body").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
