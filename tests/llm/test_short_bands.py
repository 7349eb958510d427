"""Compression bands of op10 on short noise, and on a last chunk of noise."""

import random
import string

import zstandard
from shotweave.llm import quality_rules


def noise(rnd, size: int) -> str:
    text = " ".join("".join(rnd.choice(string.printable[:94]) for _ in range(5)) for _ in range(size))
    return text[:size]


def test_short_noise_is_rejected(spark):
    rnd = random.Random(12)
    rows = [(k, noise(rnd, size)) for k, size in enumerate([300, 600, 1000] * 10)]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 30 and all(r["band"] == "incompressible" and not r["kept"] for r in got)
    assert not any(r["base_failed"] for r in got if r["n_bytes"] > 300)


def test_last_chunk_is_measured():
    rnd = random.Random(13)
    words = ["".join(rnd.choice(string.ascii_lowercase) for _ in range(rnd.randint(2, 9))) for _ in range(300)]
    prose = " ".join(rnd.choice(words) for _ in range(2000))[:quality_rules.CHUNK]
    zstd = zstandard.ZstdCompressor(level=quality_rules.LEVEL, write_checksum=False)
    names = [c.split()[0] for c in quality_rules.SCHEMA.split(", ")]
    for size in (300, 600, 1000, 2000):
        got = dict(zip(names, quality_rules.measure((prose + noise(rnd, size)).encode(), zstd), strict=True))
        assert (got["n_chunks"], got["n_low_chunks"], got["n_high_chunks"], got["odd_bytes"]) == (2, 1, 0, size)
