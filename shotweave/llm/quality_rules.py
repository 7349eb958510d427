"""Quality rules with compression bands (operator 10)."""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Fixed chunk of the second measurement, in bytes; a last chunk of up to ``SHORT`` bytes is too short to tell.
CHUNK, SHORT = 4096, 256
LEVEL = 3
#: Length-specific limits of the ratio of bytes to compressed bytes: (up to so many bytes, least, most). Invented or natural
#: prose in alphabetic scripts lies between 1.34 and 3 at these lengths; random printable characters stay near 1.25, loops go far above.
BANDS = ((256, 0.0, 3.0), (1024, 1.28, 3.5), (4096, 1.35, 4.0), (32768, 1.45, 4.5), (1 << 62, 1.45, 5.5))
#: Limits of a full chunk's ratio (a last one has those of its length), and the share of the chunks' bytes outside them that rejects the text.
CHUNK_BAND = (1.35, 4.0)
CHUNK_SHARE = 0.5

SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, "
          "ratio double, n_chunks long, n_low_chunks long, n_high_chunks long, chunk_bytes long, odd_bytes long")


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more in the text."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    pair = a[:-1] * len(ids) + a[1:]
    if len(ids) > 1 << 20:  # three ids would not fit into 63 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    _, where, counts = np.unique(pair[:-1] * len(ids) + a[2:], return_inverse=True, return_counts=True)
    again = counts[where] > 1
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k:len(words) - 2 + k] |= again
    return int(hit.sum())


def dup_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    n = 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip():
            seen.add(line)
    return n


def measure(text: bytes | None, zstd: zstandard.ZstdCompressor) -> tuple:
    """The columns of ``SCHEMA`` for one text; null counts as empty, an empty text has ratio 0 and no chunks."""
    text = text or b""
    words = text.split()
    bare = text.translate(None, b" \t\n\x0b\x0c\r")
    low = high = measured = odd = 0
    sizes = [(len(c), len(c) / len(zstd.compress(c))) for k in range(0, len(text), CHUNK) if len(c := text[k:k + CHUNK]) > SHORT]
    for n, r in sizes:
        least, most = CHUNK_BAND if n == CHUNK else next((lo, hi) for top, lo, hi in BANDS if n <= top)
        low, high = low + (r < least), high + (r > most)
        measured, odd = measured + n, odd + n * (not least <= r <= most)
    ratio = len(text) / len(zstd.compress(text)) if text else 0.0
    return (len(words), len(bare.decode("utf-8", "replace")), len(text) - len(text.translate(None, b"#*$%&|<>")), dup_lines(text),
            repeat_words(words), len(text), ratio, len(sizes), low, high, measured, odd)


def _factory():
    zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return lambda texts: dict(zip(names, map(list, zip(*(measure(t, zstd) for t in texts), strict=True)), strict=True))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: its counts, compression ratios, the base rules' and the final verdict.

    Needs ``doc_id`` and ``text``; other columns are ignored. A null or empty text has zero counts and fails the base rules; rows
    are judged one by one, so repeated rows give repeated results and an empty table gives an empty one. A text passes the bands
    if its whole ratio lies within the limits of its length and at most half of its chunks' bytes lie outside the chunk limits. One
    narrow stage without a shuffle; memory is bounded by one slice of texts or one text.
    """
    m = map_texts(docs, _factory, ["doc_id"], SCHEMA)
    least = most = None
    for top, lo, hi in reversed(BANDS):
        least = F.lit(lo) if least is None else F.when(F.col("n_bytes") <= top, lo).otherwise(least)
        most = F.lit(hi) if most is None else F.when(F.col("n_bytes") <= top, hi).otherwise(most)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    odd = F.col("odd_bytes") > CHUNK_SHARE * F.col("chunk_bytes")
    return (m.withColumn("base_failed", base)
            .withColumn("band", F.when(F.col("ratio") < least, "incompressible").when(F.col("ratio") > most, "repetitive")
                        .when(odd, F.when(F.col("n_low_chunks") > F.col("n_high_chunks"), "incompressible chunks").otherwise("repetitive chunks")))
            .withColumn("kept", ~F.col("base_failed") & F.col("band").isNull()).drop("chunk_bytes", "odd_bytes"))
