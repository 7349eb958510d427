"""The pipeline's near-dedup stage on planted near copies, which lie several fingerprint bits apart."""

import random

import brute
import corpus_pipeline
import pytest
from shotweave.llm import similar

WORDS = [f"w{k}" for k in range(2000)]


def shingles(text: str) -> set:
    words = text.lower().split()
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)}


def jaccard(x: set, y: set) -> float:
    return len(x & y) / len(x | y)


def changed(rnd, text: str, n: int) -> str:
    words = text.split()
    for k in rnd.sample(range(len(words)), n):
        words[k] = rnd.choice(WORDS)
    return " ".join(words)


def groups(sets: dict[int, set]) -> dict[int, int]:
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and jaccard(sets[a], sets[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("pairwise", [64, 2])
def test_planted_near_copies(spark, monkeypatch, pairwise):
    monkeypatch.setattr(similar, "PAIRWISE", pairwise)
    rnd = random.Random(11)
    texts = {}
    for _ in range(20):
        base = " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(120, 300)))
        for n in (0, 1, 2, 4, 6, 9, 15, 40):
            texts[len(texts)] = changed(rnd, base, n)
    sets = {i: shingles(t) for i, t in texts.items()}
    want = {i for i, r in groups(sets).items() if i == r}
    pairs = [(a, b) for a in texts for b in texts if a < b and jaccard(sets[a], sets[b]) >= 0.8]
    far = sum((brute.fingerprint(texts[a]) ^ brute.fingerprint(texts[b])).bit_count() > 2 for a, b in pairs)
    assert len(pairs) > 50 and far > len(pairs) / 2 and len(want) < len(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(kept) == sorted(want)


def counted(monkeypatch):
    """Rows of every candidate step, by the step's name."""
    rows = {}
    for name in ("_by_prefix", "_ordered"):
        def step(*a, _fn=getattr(similar, name), _name=name):
            made = _fn(*a)
            rows[_name] = rows.get(_name, 0) + made.count()
            return made
        monkeypatch.setattr(similar, name, step)
    return rows


@pytest.mark.parametrize("size", [600, 1800])
def test_a_shared_passage_stays_linear(spark, monkeypatch, size):
    """Documents that share a long passage and are otherwise unlike: candidates in proportion to the documents, none of them alike."""
    rows = counted(monkeypatch)
    rnd = random.Random(17)
    passage = [rnd.choice(WORDS) for _ in range(90)]
    texts = [(i, " ".join([*(rnd.choice(WORDS) for _ in range(25)), *passage, *(rnd.choice(WORDS) for _ in range(25))])) for i in range(size)]
    texts += [(size + k, changed(rnd, texts[k][1], 3)) for k in range(40)]
    got = similar.similar_groups(spark.createDataFrame(texts, "key long, text string").selectExpr("key", "key as hash", "text")).collect()
    assert {r["key"]: r["first_key"] for r in got} == {i: i - size if i >= size else i for i, _ in texts}
    assert rows["_ordered"] < 40 * size and rows["_by_prefix"] < size, rows


def test_a_loose_group_stays_whole_and_linear(spark, monkeypatch):
    """Near copies of one text with up to so many changes that most pairs lie below the limit: exact groups, few candidates."""
    rows = counted(monkeypatch)
    rnd = random.Random(18)
    base = " ".join(rnd.choice(WORDS) for _ in range(150))
    texts = [(i, changed(rnd, base, rnd.randint(0, 9))) for i in range(500)]
    sets = {i: shingles(t) for i, t in texts}
    got = similar.similar_groups(spark.createDataFrame(texts, "key long, text string").selectExpr("key", "key as hash", "text")).collect()
    assert {r["key"]: r["first_key"] for r in got} == groups(sets)
    pairs = [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8]
    assert len(pairs) > 5000 and sum(rows.values()) < 60 * len(texts), (len(pairs), rows)


def test_bands_find_pairs_at_the_limit():
    """Measured share of pairs a little above the limit that share no band: none of 2000."""
    import numpy as np

    rnd, missed = np.random.default_rng(3), 0
    for _ in range(2000):
        both = rnd.integers(0, 1 << 63, 160, np.uint64)
        a, b = (np.unique(np.concatenate([both, rnd.integers(0, 1 << 63, 20, np.uint64)])) for _ in "ab")
        missed += not set(similar.bands(a)) & set(similar.bands(b))
    assert missed == 0


def test_null_and_empty_texts_with_clashing_columns(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE  two"), (6, "one two three")]
    docs = spark.createDataFrame(rows, "key long, text string").selectExpr("key", "key * 7 as hash", "text", "1 as node", "2 as n", "3 as bands", "4 as part", "5 as first_key")
    got = {r["key"]: r["first_key"] for r in similar.similar_groups(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    assert similar.similar_groups(docs.where("false")).collect() == []


def test_fingerprints_propose_pairs(spark):
    """Linked fingerprints are candidates by themselves, without any band; sizes that cannot be similar are not."""
    rows = [(1, 10, 0b0), (2, 10, 0b0), (3, 11, 0b11), (4, 10, 0b111111), (5, 90, 0b1)]
    nodes = spark.createDataFrame(rows, "node long, n long, fp long")
    assert {tuple(sorted(r)) for r in similar._by_fingerprint(nodes).collect()} == {(1, 2), (1, 3)}
