"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names; and each method's own parts."""

import random
import re
import string

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from shotweave.llm import bpe, decontaminate, pii, quality_model, quality_rules, secrets, sharding, simhash, token_files, warc
from shotweave.llm.common import scratch
from shotweave.llm.components import components

PROSE = " ".join(random.Random(3).choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()) + str(k) for k in range(60))
ROWS = [(1, ""), (2, None), (None, PROSE), (3, PROSE + " tail"), (3, PROSE + " tail"), (4, PROSE * 300), (5, "naïve ÉTÉ ß 漢字 \U0001F600 <|endoftext|> x"),
        (6, PROSE + " tail"), (7, " \t\n"), (8, "x" * 70_000), (9, "1" * 5000), (10, "a@" * 3000), (None, None)]
#: Names that the operators use for columns of their own.
EXTRA = ["hash", "node", "first_key", "bad_id", "_text", "text_crc32", "fp", "row", "score", "shard", "hits", "tkey", "base", "spans", "n_words", "key", "ids", "group", "size", "kind"]


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select(*df.columns, *(F.lit("extra").alias(c) for c in EXTRA))


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, PROSE[:200]), (1, PROSE[:200]), (2, "tail"), (3, ""), (4, None), (None, PROSE[150:400])], "item_id long, text string").withColumn("fp", F.lit(1))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, 0) for k in range(12)] + [(None, 1, 0), (3, None, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")


def key(rows):
    return sorted(rows, key=str)


OPERATORS = {
    "shards": lambda d, b, x: sharding.assign_shards(d, 5),
    "secrets": lambda d, b, x: secrets.scan_secrets(d),
    "decontaminate": lambda d, b, x: decontaminate.benchmark_hits(d, b),
    "bpe": lambda d, b, x: bpe.round_trip(d, ["doc_id"]),
    "pii": lambda d, b, x: pii.find_personal_data(d),
    "classifier": lambda d, b, x: quality_model.classify(d, x),
    "simhash": lambda d, b, x: simhash.near_duplicates(d),
    "rules": lambda d, b, x: quality_rules.quality_rules(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_edge_rows(edge, bench, labels, name):
    got = OPERATORS[name](edge, bench, labels).collect()
    assert len(got) == len(ROWS)
    same = [{k: v for k, v in r.asDict().items() if k != "slot"} for r in got if r["doc_id"] == 3]
    assert same[0] == same[1]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(edge, bench, labels, name):
    assert OPERATORS[name](edge.where("false"), bench, labels).collect() == []
    assert len(OPERATORS[name](edge, bench.where("false"), labels.where("false")).collect()) == len(ROWS)


def test_edge_values(edge, bench):
    hits = {(r["doc_id"], r["n_words"]): r for r in decontaminate.benchmark_hits(edge, bench).collect()}
    want = brute.contamination(list(enumerate(t for _, t in ROWS)), [(r["item_id"], r["text"]) for r in bench.collect()])
    for k, (i, _) in enumerate(ROWS):
        n, hit, items = want[k]
        assert (hits[i, n]["n_hit"], hits[i, n]["items"]) == (hit, items)
    fps = {k: brute.fingerprint(t) for k, (_, t) in enumerate(ROWS)}
    got = simhash.near_duplicates(edge).collect()
    assert sorted(r["fingerprint"] for r in got) == sorted(format(x, "016x") for x in fps.values())
    for k, (i, t) in enumerate(ROWS):
        spans = brute.personal(t)
        assert any(r["doc_id"] == i and r["base_sha256"] == brute.sha(brute.joined(spans)) for r in pii.find_personal_data(edge.where(F.col("doc_id").eqNullSafe(i))).collect()), k
        break


def test_pipeline_stages_on_edges(spark, edge, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(k, 1, 0) for k in range(4)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, PROSE[:200])], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = edge.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), *EXTRA)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.where("false"), sf)
        assert empty.collect() == [], name
        out = stage(spark, docs, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
    kept = corpus_pipeline.near_dedup(spark, docs, sf).collect()
    assert len([r for r in kept if r["doc_id"] == 3]) == 1 and not any(r["doc_id"] == 6 for r in kept)
    short = spark.createDataFrame([(1, "tail", "en", "s", 4), (2, PROSE + " tail", "en", "s", 4)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "tail")], "item_id long, text string").write.mode("overwrite").parquet(f"{sf}/benchmark.parquet")
    assert len(corpus_pipeline.decontaminate(spark, short, sf).collect()) == 2
    clean = {r["doc_id"]: r["text"] for r in corpus_pipeline.personal_data(spark, docs.where("doc_id is not null"), sf).collect()}
    assert clean[4] == PROSE * 300 and clean[2] is None


def test_redaction(spark):
    text = "Write to é@x ann.b@mail.example.com, +1 (555) 555-0123 or 10.0.0.7 now; card 4111 1111 1111 1111."
    docs = spark.createDataFrame([(1, text, len(text)), (2, "clean 12 and 2024-01-01", 23)], "doc_id long, text string, n_chars int")
    got = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert got[1]["text"] == "Write to é@x [EMAIL], [PHONE] or [IP] now; card [CARD]." and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == "clean 12 and 2024-01-01"


def test_best_fit_decreasing_against_plain():
    rnd = random.Random(1)
    for _ in range(60):
        sizes = [rnd.randint(0, 40) for _ in range(rnd.randint(1, 60))]
        cap, bins = max(40, max(sizes)), []
        for s in sorted(sizes, reverse=True):
            fit = min((b for b in range(len(bins)) if bins[b] >= s), key=lambda b: (bins[b], b), default=None)
            if fit is None:
                bins.append(cap)
                fit = len(bins) - 1
            bins[fit] -= s
        plan = sharding.best_fit_decreasing([(s, sizes.count(s)) for s in set(sizes)], cap)
        left = {}
        for p in plan:
            left[p.number] = left.get(p.number, cap) - p.size * (p.past - p.first)
        assert [left[b] for b in range(len(bins))] == bins


def test_plan_bins_covers_each_group_once():
    rnd = random.Random(2)
    for bins in (1, 2, 7, 40):
        sizes = [(s, rnd.randint(1, 30)) for s in rnd.sample(range(16, 3000), 50)] + [(200_000, 2)]
        plan = sharding.plan_bins(sizes, bins)
        for s, n in sizes:
            assert sorted(k for p in plan if p.size == s for k in range(p.first, p.past)) == list(range(n))
        assert {p.number for p in plan} <= set(range(bins))


@pytest.mark.parametrize("pairwise", [64, 1])
def test_links_of_dense_groups(spark, monkeypatch, pairwise):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    rnd = random.Random(5)
    fps = {0, 1, (1 << 64) - 1}
    for _ in range(12):
        seed = rnd.getrandbits(64)
        for _ in range(25):
            x = seed
            for b in rnd.sample(range(64), rnd.randint(0, 4)):
                x ^= 1 << b
            fps.add(x)
    signed = {simhash._signed(x): x for x in fps}
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    pairs = edges.collect()
    assert all((signed[r["a"]] ^ signed[r["b"]]).bit_count() <= (2 if pairwise == 64 else 2) for r in pairs)
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    want = brute.components({s: x for s, x in signed.items()})
    assert {s: roots.get(s, s) for s in signed} == want


def test_components_of_paths_and_hubs(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (3, 2)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}


def test_entropy_spans(spark):
    rnd = random.Random(9)
    draw = lambda alphabet, n: "".join(rnd.choice(alphabet) for _ in range(n))
    mixed, hexes = draw(string.ascii_letters + string.digits, 40), "0123456789ABCDEF"
    uuid = "123e4567-e89b-12d3-a456-426614174000"
    rows = [(1, f"key {mixed} end"), (2, "zzzzzzzzzz1zzzzzzzzzzwwwwwwwwwwww"), (3, f"id {uuid}"), (4, "sample" + mixed), (5, "password = hunter22 and secret=token: abcdef123"),
            (6, "K " + draw(hexes, 40)), (7, "K " + draw(hexes + "abcdef", 40)), (8, "K " + draw(string.ascii_uppercase + "234567", 32)), (9, "example" * 8 + "1"), (10, hexes * 2),
            (11, "see_the_long_identifier_of_a_function_name_2"), (12, "sha " + draw("0123456789abcdef", 40)), (13, None), (14, ""), (15, (mixed + " ") * 3000)]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == "entropy_base64:4:44" and got[4] == "entropy_base64:6:46"  # the rest of a candidate next to an allowed word
    assert all(got[k] == "" for k in (2, 3, 9, 10, 11, 13, 14))
    assert got[5] == brute.joined(brute.secrets(rows[4][1])) == "assign:0:19"
    assert got[6] == got[7] == "entropy_hex:2:42" and "entropy_base32:2:34" in got[8].split(",") and got[12] == "hex:4:44"
    assert len(got[15].split(",")) == 3000


def test_packed_counts_against_plain_windows(spark):
    """The span of each candidate, by counting every window anew."""
    from collections import Counter
    from math import log2

    rnd = random.Random(19)
    rows = [(k, "".join(rnd.choice(rnd.choice(["AB12", "0123456789ABCDEF", string.ascii_uppercase + "234567", string.ascii_letters + string.digits])) for _ in range(rnd.randint(20, 60)))) for k in range(150)]
    got = {r["doc_id"]: set(filter(None, r["spans"].split(","))) for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = 0
    for k, text in rows:
        base, want = brute.secrets(text), set()
        for c in secrets.CLASSES:
            for m in re.finditer(c.pattern, text):
                if not re.search("[0-9]", m[0]) or not re.search("[A-Za-z]", m[0]):
                    continue
                shown = m[0].lower() if c.folded else m[0]
                ok = [i for i in range(len(shown) - c.window + 1) if log2(c.window) - sum(n * log2(n) for n in Counter(shown[i:i + c.window]).values()) / c.window >= c.least_bits]
                if ok and not any(a <= m.start() + ok[0] and b >= m.start() + ok[-1] + c.window for _, a, b in base):
                    want.add(f"{c.name}:{m.start() + ok[0]}:{m.start() + ok[-1] + c.window}")
        assert got[k] - {f"{n}:{a}:{b}" for n, a, b in base} == want, text
        found += len(want)
    assert found > 50


def test_added_personal_data(spark):
    """What only the generators propose: spelt addresses, numbers without a plus behind a cue, cards of 15 digits; and what looks like it."""
    yes = {"Write to ann (at) example (dot) com now": "email_spelt:9:35", "my phone: 555-123-4567 thanks": "phone_parts:10:22", "pay with card 378282246310005 ok": "card_run:14:29",
           "number 378282246310005 stands here": "card_run:7:22", "tel 030 555-1234": "phone_parts:4:16", "j.doe[at]mail.example[dot]org": "email_spelt:0:29", "4111 1111 1111 1111": "card:0:19"}
    no = ["on 2024-01-15 10:20:30 order 555-123-4567 came", "version 1.2.3 and 2024-01-15", "it weighs 100 200 300 400 kg", "invoice 371449635398431 paid", "see 555-123-4567 there",
          "isbn 9780306406157", "3 4 5 6", "card 378282246310006", "12-30-2019 555-1234", ""]
    rows = [(k, t) for k, t in enumerate([*yes, *no])] + [(99, None), (100, "ann@example.com +1 (555) 123-4567 x 10.0.0.7 x 4111 1111 1111 1111 x " * 3000)]
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k]["spans"] for k in range(len(yes))] == list(yes.values())
    assert [got[len(yes) + k]["spans"] for k in range(len(no))] == [""] * len(no)
    assert got[99]["spans"] == "" and [got[100][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [3000] * 4


def test_all_labelled_candidates_train(spark, monkeypatch):
    """Every labelled candidate of every different text is in the fit or in the held-out fifth, however many there are; copies count once."""
    seen = []

    class Watched(pii.GBTClassifier):
        def fit(self, rows):
            seen.append(rows)
            return super().fit(rows)

    monkeypatch.setattr(pii, "GBTClassifier", Watched)
    texts = [f"text {k}: " + "order 555-123-4567, " * 250 for k in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:50])), "doc_id long, text string")
    got = pii.find_personal_data(docs).collect()
    assert len(got) == 150 and all(r["spans"] == "" for r in got)
    own = seen[0].where("source = 1")
    n = own.agg(F.sum("n") if "n" in own.columns else F.count("*")).first()[0]
    assert 0.78 * 25_000 < n < 0.82 * 25_000


def test_token_files_round_trip_and_lookup(spark, edge):
    target = scratch(spark, "test")
    token_files.write_token_files(edge, target)
    ids = {i: bpe.Encoder(bpe.Vocabulary(bpe.default_vocabulary())).encode([(t or "").encode()])[0].tolist() + [2] for i, t in ROWS if i is not None}
    got = token_files.read_token_files(spark, target).collect()
    assert len(got) == len(ROWS)
    start = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
        if r["doc_id"] is not None:
            assert np.frombuffer(r["ids"], "<u4").tolist() == ids[r["doc_id"]]
    assert {r["doc_id"] for r in token_files.read_token_files(spark, target, (4, 5)).collect()} == {4, 5}
    empty = scratch(spark, "test")
    token_files.write_token_files(edge.where("false"), empty)
    assert token_files.read_token_files(spark, empty).collect() == []


def test_archives(spark):
    target = scratch(spark, "test")
    rows = [(1, "http://a/1", "same"), (5, "http://a/5\r\nX: y", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (6, "u", "é" * 100_000), (None, "u", "only"), (7, "u", "x\r\n\r\ny"), (7, "u", "x\r\n\r\ny")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("_page", F.lit(0))
    warc.write_archives(pages, target)
    got = warc.read_archives(spark, target).collect()
    assert len(got) == len(rows) and not any(r["error"] for r in got)
    by = {r["page_id"]: r for r in got}
    assert {i: (r["record_type"], r["refers_to"]) for i, r in by.items()} == {
        1: ("revisit", 5), 2: ("revisit", 5), 5: ("response", None), 3: ("revisit", 4), 4: ("response", None), 6: ("response", None), None: ("response", None), 7: ("response", None)}
    assert by[6]["payload"] == ("é" * 100_000).encode() and by[1]["payload_bytes"] == 4 and by[1]["payload"] is None
    assert by[1]["payload_digest"] == brute.sha1_base32(b"same") and by[7]["payload"] == b"x\r\n\r\ny"
    small = scratch(spark, "test")
    warc.write_archives(pages, small, least_bytes=5)
    assert {r["page_id"] for r in warc.read_archives(spark, small).collect() if r["record_type"] == "revisit"} == set()
    none = scratch(spark, "test")
    warc.write_archives(pages.where("false"), none)


def test_archive_validation():
    record = warc.format_record(1, "u", b"hello", brute.sha1_base32(b"hello"), None, False, "d")
    sample = [record.replace(b"hello", bytes([97 + k % 26]) * 40 + str(k).encode() * 9) for k in range(400)]
    raw = zstandard.train_dictionary(2048, sample).as_bytes()
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw)).compress
    lead = b"\x5d\x2a\x4d\x18" + len(raw).to_bytes(4, "little") + raw
    data = lead + frame(record) + warc.EMPTY_FRAME.encode() + frame(record.replace(b"hello", b"hallo")) + frame(record[:-5] + b"\r\n\r\n") + frame(b"WARC/1.0\r\n\r\n")
    got = list(warc.records(data))
    assert got[0]["payload"] == b"hello" and [g.get("error") for g in got[1:]] == ["payload digest differs", "block length differs from Content-Length", "no WARC/1.1 header"]
    assert list(warc.records(data[:-3]))[-1]["error"].startswith("truncated")
    assert list(warc.records(lead + b"junk!"))[-1]["error"] == "no frame start"
    for size in (0, 1, 100, 1 << 20):
        for body in (b"a" * size, random.Random(size).randbytes(size)):
            for checksum in (False, True):
                f = zstandard.ZstdCompressor(write_checksum=checksum).compress(body)
                assert warc.frame_size(memoryview(f + b"rest"), 0) == len(f)


def test_bpe_against_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    vocab = bpe.Vocabulary(bpe.default_vocabulary())
    encoder, decoder, rnd = bpe.Encoder(vocab), bpe.Decoder(vocab), random.Random(4)
    letters = list("aAbBeéÉßςΣİı \t\n\x0b\x1c\x85\xa0 ​̱́!?.,'’<|>$%01२½漢字ㄱ한\U0001F600ا") + ["<|endoftext|>", "'s", "'LL", "aaaa", "!!!!!", "H̱"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    ids, sizes = encoder.encode([t.encode() for t in texts])
    for t, got in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert got.tolist() == want and decoder.decode(want) == lib.decode(want, skip_special_tokens=False)


def test_winnowing_finds_every_shared_window():
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(30)]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))) for i in range(40)]
    for _ in range(20):
        shared = " ".join(rnd.choice(words) for _ in range(10))
        a = decontaminate.word_hashes([f"x {shared} y".encode()])[0]
        b = decontaminate.word_hashes([f"p q {shared}".encode()])[0]
        pick = lambda w: set(decontaminate._grams(w, 5)[decontaminate._winnow(decontaminate._grams(w, 5), np.ones(max(0, len(w) - 9), bool))].tolist())
        assert pick(a) & pick(b)
    h, n = decontaminate.word_hashes([t.encode() for _, t in docs])
    assert n.tolist() == [len(t.split()) for _, t in docs] and len(h) == n.sum()
    assert len(set(h.tolist())) == len({w for _, t in docs for w in t.split()})


def test_compression_bands(spark):
    rnd = random.Random(6)
    noise = " ".join("".join(rnd.choice(string.printable[:94]) for _ in range(7)) for _ in range(800))
    loop = " ".join(f"{a} {b}" for a in range(10) for b in ["the quick brown fox jumps over the lazy dog again and again"] * 40)
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame([(1, PROSE), (2, noise), (3, loop)], "doc_id long, text string")).collect()}
    assert got[1]["kept"] and got[2]["band"].startswith("incompressible") and got[3]["band"] == "repetitive"
    assert not got[2]["base_failed"] and not got[2]["kept"] and not got[3]["kept"]
