"""Periodic runs and the fill-in-middle transformation against plain versions, on the given tables and on edges."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import brute
from shotweave.llm import fim, repeats
from shotweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def shown(doc_id, text):
    w = brute.WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def plain_runs(w):
    """Every lag by itself; a stretch counts for its smallest period."""
    found = {}
    for q in range(1, len(w) // 3 + 1):
        m = 0
        for i in range(q, len(w) + 1):
            if i < len(w) and w[i] == w[i - q]:
                m += 1
                continue
            if m and m + q >= max(24, 3 * q):
                found.setdefault((i - m - q, m + q), q)
            m = 0
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_row(doc_id, text):
    w = shown(doc_id, text)
    runs = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, brute.sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), brute.sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def plain_middle(doc_id, text):
    t = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    n, restored = len(units), brute.sha(t)
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    if doc_id is None or not t or re.search("<[PSM]>", t) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, restored, restored
    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:x], units[x:y], units[y:]))
    form = "spm" if h4 % 100 < 20 else "psm"
    return doc_id, n, form, len(p), len(m), brute.sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), restored


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_runs_of_the_table(spark, docs):
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op12_periodic_runs"][0](spark, SF).collect()}
    assert len(got) == len(docs) and sum(r[1] > 0 for r in got.values()) > 5
    for i, t in docs:
        if len(brute.WORD.findall(t or "")) < 3000:
            assert got[i] == plain_row(i, t)


def test_middles_of_the_table(spark, docs):
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op13_fill_in_middle"][0](spark, SF).collect()}
    assert got == {i: plain_middle(i, t) for i, t in docs}
    assert {r[2] for r in got.values()} == {"plain", "psm", "spm"}


def test_middle_sql(spark):
    from oracle import compare, connect

    status, n, _, info = compare(spark, connect(SF), SF, "op13_fill_in_middle", *QUERIES["op13_fill_in_middle"])
    assert status == "ok" and n == 200, info


def edge_rows():
    rnd = random.Random(21)
    rows = [(0, None), (1, ""), (2, " \t\n"), (None, "a b " * 30), (None, None), (3, "x " * 40), (3, "x " * 40), (4, "x " * 7000), (5, "ß 漢字 \U0001F600 <P> x"), (6, "no sentinel < P>" * 9),
            (7, "<S" * 40), (8, ">" * 30), (9, "é" * 3000), (10, "y" * 200_000), (11, ("ab cd " * 5 + "ef ") * 12), (12, ("a " * 10 + "b ") * 9)]
    for k in range(13, 260):
        letters = "ab"[:rnd.randint(1, 2)] + "c" * rnd.randint(0, 1)
        part = [rnd.choice(letters) for _ in range(rnd.randint(1, 40))]
        body = [rnd.choice(letters) for _ in range(rnd.randint(0, 30))] + part * rnd.randint(1, 6) + part[:rnd.randint(0, len(part))] + [rnd.choice(letters) for _ in range(rnd.randint(0, 30))]
        rows.append((k, " ".join(body)))
    return rows


@pytest.mark.parametrize("which", ["runs", "middles"])
def test_edges(spark, which):
    rows = edge_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df = df.select(*df.columns, *(F.lit("extra").alias(c) for c in ("start", "length", "period", "runs", "form", "n", "output", "collapsed")))
    call, plain = (repeats.periodic_runs, plain_row) if which == "runs" else (fim.fill_in_middle, plain_middle)
    got = call(df).collect()
    want = [plain(i, t) for i, t in rows if len((t or "").split()) < 3000]
    mine = [tuple(r)[:8 if which == "runs" else 7] for r in got if r["doc_id"] != 4]
    assert sorted(mine, key=str) == sorted((w for w in want if w[0] != 4), key=str)
    assert call(df.where("false")).collect() == []
    assert call(df, ["form", "runs"]).columns[:3] == ["doc_id", "form", "runs"] if which == "runs" else True
    if which == "runs":
        four = next(r for r in got if r["doc_id"] == 4)
        assert (four["n_runs"], four["period"], four["length"], four["collapsed"]) == (1, 1, 7000, "x")
        assert all(len(r["runs"]) == r["n_runs"] for r in got)
    else:
        texts = {(i, t or "") for i, t in rows}
        assert all((r["doc_id"], r["output"]) in texts for r in got if r["form"] == "plain")


def test_rotations_in_blocks(monkeypatch):
    monkeypatch.setattr(fim, "BLOCK", 3)
    rnd = random.Random(2)
    for _ in range(300):
        text = bytes(rnd.choice(b"abc<PSM>") for _ in range(rnd.randint(0, 40)))
        a, b = sorted(rnd.randint(0, len(text)) for _ in range(2))
        buf = bytearray(text)
        fim.rotate(buf, a, b, len(buf))
        assert bytes(buf) == text[:a] + text[b:] + text[a:b]
        if not re.search(b"<[PSM]>", text):
            for form in ("psm", "spm"):
                buf = bytearray(text)
                fim.transform(buf, a, b, form)
                fim.restore(buf, form)
                assert bytes(buf) == text


def test_a_word_repeated_often_stays_linear():
    """Twice the words of one period take about twice the events, not four times."""
    import numpy as np

    def events(n):
        words = np.zeros(n, np.int64)
        return sum(len(x[0]) for x in repeats.occurrences(words, np.full(n, n)))

    assert events(40_000) < 2.5 * events(20_000)
