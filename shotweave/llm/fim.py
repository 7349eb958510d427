"""Fill-in-middle transformation by block rotation in place (operator 13)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of a hundred documents, those from this number on stay plain; of the others, those below the second number take the suffix first.
PLAIN_FROM, SPM_BELOW = 90, 20
#: Bytes that a reversal exchanges at once.
BLOCK = 1 << 16


def reverse(buf: bytearray, first: int, past: int) -> None:
    """Reverses ``buf[first:past]`` in place, a block of each end at a time."""
    while past - first > 2 * BLOCK:
        left = bytes(buf[first:first + BLOCK])
        buf[first:first + BLOCK] = buf[past - BLOCK:past][::-1]
        buf[past - BLOCK:past] = left[::-1]
        first, past = first + BLOCK, past - BLOCK
    buf[first:past] = buf[first:past][::-1]


def rotate(buf: bytearray, first: int, middle: int, past: int) -> None:
    """Exchanges ``buf[first:middle]`` and ``buf[middle:past]`` in place by three reversals."""
    reverse(buf, first, middle)
    reverse(buf, middle, past)
    reverse(buf, first, past)


def unit_starts(text: bytes) -> np.ndarray:
    """Byte offsets of the units of a UTF-8 text: runs of ASCII letters, and every other code point by itself."""
    b = np.frombuffer(text, np.uint8)
    lower = b | 32
    letter = (lower >= 97) & (lower <= 122)
    start = (b & 0xC0) != 0x80
    start[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(start)


def characters(text: bytes | bytearray) -> int:
    b = np.frombuffer(text, np.uint8)
    return int(np.count_nonzero((b & 0xC0) != 0x80))


def draws(key: str) -> list[int]:
    """Four numbers that depend on the key only."""
    h = hashlib.sha256(b"1:" + key.encode()).hexdigest()
    return [int(h[8 * k:8 * k + 8], 16) for k in range(4)]


def transform(buf: bytearray, low: int, high: int, form: str) -> None:
    """Brings a text with cuts at the bytes ``low`` and ``high`` into the form, within its own buffer."""
    n, p, m = len(buf), len(PREFIX), len(MIDDLE)
    buf[high:high] = SUFFIX
    buf[low:low] = MIDDLE
    buf[:0] = PREFIX
    low, high, n = low + p, high + p + m, n + p + m + len(SUFFIX)
    rotate(buf, low if form == "psm" else 0, high, n)


def restore(buf: bytearray, form: str) -> None:
    """The inverse of ``transform``: the rotation that undoes it, then the sentinels go. A plain text stays as it is.

    Sentinels are found from the front. A text that holds one is never transformed, and none can arise where a piece meets a sentinel.
    """
    if form == "plain":
        return
    if form == "psm":
        first = buf.index(SUFFIX)
        second = buf.index(MIDDLE, first)
        rotate(buf, first, second, len(buf))
    else:
        second = buf.index(PREFIX)
        rotate(buf, 0, second, len(buf))
    low = buf.index(MIDDLE)
    high = buf.index(SUFFIX, low)
    del buf[high:high + len(SUFFIX)]
    del buf[low:low + len(MIDDLE)]
    del buf[:len(PREFIX)]


def rearrange(key: int | None, text: bytes | None) -> dict:
    """Number of units, form, lengths in code points, output and restored text of one document."""
    text = text or b""
    starts = unit_starts(text)
    n = len(starts)
    h = draws(str(key)) if key is not None else None
    plain = h is None or not text or h[2] % 100 >= PLAIN_FROM or any(s in text for s in (PREFIX, SUFFIX, MIDDLE))
    buf = bytearray(text)
    if plain:
        return {"n": n, "form": "plain", "prefix_chars": None, "middle_chars": None, "output": text, "restored": text}
    form = "spm" if h[3] % 100 < SPM_BELOW else "psm"
    low, high = (int(starts[u]) if u < n else len(text) for u in sorted(x % (n + 1) for x in h[:2]))
    sizes = characters(text[:low]), characters(text[low:high])
    transform(buf, low, high, form)
    output = bytes(buf)
    restore(buf, form)
    return {"n": n, "form": form, "prefix_chars": sizes[0], "middle_chars": sizes[1], "output": output, "restored": bytes(buf)}


def fill_in_middle(docs: DataFrame, keep: list[str] | None = None, texts: bool = True) -> DataFrame:
    """One row per document: its id, ``n`` units, ``form``, ``prefix_chars``, ``middle_chars``, digests and, if ``texts``, the ``output`` text.

    Needs ``doc_id`` and ``text``; ``keep`` names further columns to hand on. The cuts and the form depend on the id and the text alone, so a
    rerun or a lost executor changes nothing, and nothing is shuffled. A null text counts as empty; an empty text, one that holds a sentinel and
    one without an id stay plain, with null lengths. Repeated rows give equal rows. A long text is worked on in one buffer, its
    reversals in blocks. ``restored_sha256`` is the digest of the text rebuilt from output and form. An empty table gives an empty result.
    """
    cols = ["doc_id", *(keep or [])]
    out = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + (", output string" if texts else "")

    def factory():
        def work(batch_texts: list, ids: list) -> dict:
            made = [rearrange(k, t) for k, t in zip(ids, batch_texts, strict=True)]
            got = {c: [m[c] for m in made] for c in ("n", "form")}
            got |= {c: pa.array([m[c] for m in made], pa.int64()) for c in ("prefix_chars", "middle_chars")}
            got |= {f"{c}_sha256": [hashlib.sha256(m[c]).hexdigest() for m in made] for c in ("output", "restored")}
            if texts:
                got["output"] = pa.array([m["output"].decode() for m in made], pa.string())
            return got

        return work

    return map_texts(docs, factory, cols, out, with_keys="doc_id")


def oracle_sql() -> str:
    """The same in DuckDB, with the units as a list."""
    number = "CAST('0x' || substr(h, {}, 8) AS BIGINT)"
    h1, h2, h3, h4 = (number.format(1 + 8 * k) for k in range(4))
    return f"""
    WITH units AS (
      SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
             sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
    drawn AS (
      SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, {h1} % (len(u) + 1) AS x, {h2} % (len(u) + 1) AS y,
             CASE WHEN doc_id IS NULL OR text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {h3} % 100 >= {PLAIN_FROM}
                  THEN 'plain' WHEN {h4} % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM units),
    cut AS (
      SELECT *, array_to_string(u[1:least(x, y)], '') AS prefix, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS middle,
             array_to_string(u[greatest(x, y) + 1:], '') AS suffix FROM drawn)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                            ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
    FROM cut"""
