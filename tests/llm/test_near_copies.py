"""The pipeline's near-duplicate stage against brute-force Jaccard of all pairs."""

import random
from collections import Counter
from itertools import combinations

import numpy as np

import corpus_pipeline
from vaporline.llm import near_copies as N

from .helpers import awkward, empty


def shingle_set(text):
    words = text.lower().split()
    width = min(5, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def brute(docs):
    sets, root = {k: shingle_set(t) for k, t in docs.items()}, {k: k for k in docs}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(sorted(docs), 2):
        x, y = sets[a], sets[b]
        if x == y or (x | y and 5 * len(x & y) >= 4 * len(x | y)):
            low, high = sorted((top(a), top(b)))
            root[high] = low
    return {k for k in docs if top(k) == k}


def made(r):
    """Texts of 6 to 120 words, and copies of some with one to four words changed."""
    words = [f"w{i}" for i in range(400)]
    passage = [r.choice(words) for _ in range(30)]
    texts = [[r.choice(words) for _ in range(r.randint(6, 120))] + passage * (i % 4 == 0) for i in range(80)]
    for i in range(80):
        for _ in range(r.randint(0, 3)):
            copy = list(texts[i])
            for _ in range(r.randint(1, 4)):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(copy)
    r.shuffle(texts)
    return {i: " ".join(t) for i, t in enumerate(texts)}


def test_stage_against_brute_force(spark):
    docs = made(random.Random(3))
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {x.doc_id for x in corpus_pipeline.near_stage(spark, frame, "").collect()}
    want = brute(docs)
    assert got == want and 80 < len(want) < len(docs) - 20


def test_any_order_of_shingles_finds_all(spark, monkeypatch):
    docs = made(random.Random(4))
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    monkeypatch.setattr(N, "MOST_COMMON", 3)
    assert {x.doc_id for x in N.kept_rows(frame).collect()} == brute(docs)


def test_without_centres_and_in_blocks(spark, monkeypatch):
    """The search of the trees alone finds all, in groups dealt into blocks, too."""
    docs = made(random.Random(5))
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    monkeypatch.setattr(N, "NEAREST", 0)
    assert {x.doc_id for x in N.kept_rows(frame).collect()} == brute(docs)
    monkeypatch.setattr(N, "GROUP_LIMIT", 2)
    assert {x.doc_id for x in N.kept_rows(frame).collect()} == brute(docs)


def test_large_groups_give_few_pairs(spark):
    """Variants of one text: what is compared grows with the sets, not with their pairs."""
    r = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    docs = {}
    for i in range(400):
        text = list(base)
        for _ in range(r.randint(1, 4)):
            text[r.randrange(150)] = f"x{r.randrange(1000)}"
        docs[i] = " ".join(text)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    texts = frame.selectExpr("doc_id", "xxhash64(text) AS text_hash", "text")
    rows = N.described(texts, *N.common_shingles(texts, 400, 5), 5)
    found = N.links(rows, texts)
    assert found.count() < 5 * 400
    assert {x.doc_id for x in N.kept_rows(frame).collect()} == brute(docs)


def test_shared_shingles_over_batches(spark):
    r = random.Random(7)
    rows = [(k, [r.choice((0, 1, 2, *range(90))) for _ in range(8)]) for k in range(60)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    got = N.held_by_several(spark.createDataFrame(rows, "fp long, prefix array<long>")).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    held = {(s, k) for k, each in rows for s in each}
    several = {s for s, n in Counter(s for s, _ in held).items() if n > 1}
    assert sorted((x.shingle, x.fp) for x in got) == sorted(x for x in held if x[0] in several)


def test_awkward_documents(spark):
    docs = awkward(spark)
    out = N.kept_rows(docs)
    assert out.columns == docs.columns
    assert {x.doc_id for x in out.collect()} >= {1, 3, 6, 7, 8, 9} and out.where("doc_id IN (2, 4, 5)").count() == 0
    assert N.kept_rows(empty(spark)).count() == 0


def test_parities_are_a_lower_bound():
    """Sets differ in at least as many shingles as parities; in as many if they are few."""
    r = np.random.default_rng(8)
    for size, changed in ((1, 1), (30, 3), (150, 20), (3000, 700)):
        a = np.unique(r.integers(0, 1 << 64, size, np.uint64))
        b = np.unique(np.concatenate([a[changed:], r.integers(0, 1 << 64, changed, np.uint64)]))
        unlike = int(np.bitwise_count((N.parities(a) ^ N.parities(b)).view(np.uint64)).sum())
        differ = len(np.setxor1d(a, b))
        assert unlike <= differ and (differ - unlike) % 2 == 0 and (differ > 3 or unlike == differ)
        assert not (N.parities(a) ^ N.parities(a)).any()
    assert not N.parities(np.empty(0, np.uint64)).any()
