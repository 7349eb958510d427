"""Each registered query of the subpackage against a brute-force version on the smallest tables."""

import array
import zlib

import pytest

import brute
from shotweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def rows(spark):
    made = {}

    def get(name):
        if name not in made:
            made[name] = QUERIES[name][0](spark, SF).collect()
        return made[name]

    return get


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_sharding(rows, docs):
    got = rows("op1_sharding")
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    by_text, shards = {}, {}
    for r in got:
        t = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 16, zlib.crc32(t), "bytes", None)
        by_text.setdefault(t, set()).add(r["shard"])
        shards.setdefault(r["shard"], []).append(r)
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in shards.values())
    sizes = [sum(r["size"] for r in x) for x in shards.values()]
    assert len(sizes) == 40 and max(sizes) < 1.25 * sum(sizes) / 40 or max(sizes) == max(r["size"] for r in got)


def test_secrets(rows, docs):
    for r in rows("op2_secret_scan"):
        base = brute.secrets(docs[r["doc_id"]])
        assert r["base_sha256"] == brute.sha(brute.joined(base))
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[0] == k for s in base) for k in ("assign", "access", "hex"))
        assert set(brute.joined(base).split(",")) <= set(r["spans"].split(",")) or not base


def test_token_files(rows, docs, tokenizer):
    start, got = 0, {r["doc_id"]: r for r in rows("op3_token_files")}
    assert len(got) == len(docs)
    for i in sorted(docs):
        ids = tokenizer.encode(docs[i] or "", add_special_tokens=False).ids + [2]
        assert tuple(got[i])[1:] == (start, len(ids), zlib.crc32(array.array("I", ids).tobytes()))
        start += len(ids)


def test_decontamination(rows, docs, spark):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute.contamination(docs.items(), bench)
    assert sum(x[1] > 0 for x in want.values()) >= 3
    for r in rows("op4_winnowing_decontamination"):
        n, hit, items = want[r["doc_id"]]
        assert tuple(r)[1:] == (n, hit, len(items), brute.sha(",".join(items)), hit > 0)


def test_warc(rows, spark):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    top = {}
    for i, b in pages.items():
        top[b] = max(top.get(b, i), i)
    got = rows("op5_warc")
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    for r in got:
        b = pages[r["page_id"]]
        own = top[b] == r["page_id"]
        assert tuple(r)[1:] == (len(b), brute.sha1_base32(b), "response" if own else "revisit", None if own else top[b])


def test_bpe(rows, docs, tokenizer):
    for r in rows("op6_bpe_round_trip"):
        ids = tokenizer.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids
        assert tuple(r)[1:] == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(tokenizer.decode(ids, skip_special_tokens=False)))


def test_personal_data(rows, docs):
    for r in rows("op7_personal_data"):
        base = brute.personal(docs[r["doc_id"]])
        assert r["base_sha256"] == brute.sha(brute.joined(base))
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone"))
        assert set(brute.joined(base).split(",")) <= set(r["spans"].split(",")) or not base


def test_quality_classifier(spark):
    sf = SF.replace("0.001", "0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op8_quality_classifier"][0](spark, sf).collect()
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) / len(held) > 0.95


def test_near_duplicates(rows, docs):
    fps = {i: brute.fingerprint(t) for i, t in docs.items()}
    want = brute.components(fps)
    assert len(set(want.values())) < len(docs)
    for r in rows("op9_simhash_near_dedup"):
        assert tuple(r)[1:] == (format(fps[r["doc_id"]], "016x"), want[r["doc_id"]])


def test_quality_rules(rows, docs):
    for r in rows("op10_quality_rules"):
        n, chars, symbols, dup, repeat = brute.quality(docs[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (n, chars, symbols, dup)
        assert repeat is None or r["n_repeat_words"] == repeat
        assert r["base_failed"] == (n < 50 or 100 * r["n_repeat_words"] > 50 * n)
        assert not (r["base_failed"] and r["kept"])


def test_secret_sql(spark):
    from oracle import compare, connect

    status, n, _, info = compare(spark, connect(SF), SF, "op2_secret_scan", *QUERIES["op2_secret_scan"])
    assert status == "ok" and n == 200, info


def test_pipeline(spark, rows, docs):
    import corpus_pipeline
    from test_near_dedup import groups, shingles

    good = {r["doc_id"] for r in rows("op8_quality_classifier") if r["predicted"]}
    got = corpus_pipeline.run(spark, SF).collect()
    kept = {r["doc_id"] for r in got}
    assert len(kept) == len(got) and kept <= good

    def sets(i):
        words = tuple((docs[i] or "").lower().split())
        return shingles(docs[i] or "") if len(words) > 4 else {words}

    least = groups({i: sets(i) for i in good})
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = brute.contamination([(i, docs[i]) for i in good], [(i, t) for i, t in bench if len(brute.BENCH_WORD.findall(brute.lower(t))) >= 10])
    assert kept == {i for i in good if least[i] == i and not hits[i][1]}
    assert all(r["n_tokens"] > 0 for r in got) and len(kept) > 50
