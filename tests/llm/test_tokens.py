import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from vaporline.llm import bpe_codec, queries, token_counts
from vaporline.llm.bpe_vocab import AT_REST, Bounded, default_vocabulary
from vaporline.llm.common import free_memory

from .helpers import AWKWARD, awkward, empty

PIECES = ["'ll", "'re", "'v", " ", "  ", "\n", "\t", "é", "ß", "日本", "a", "the", "ing", "!!", "'", "12", "3", ".", "<|endoftext|>", "<|endof", "\u00a0", "th", "er", "  \n", "😀", "l"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


def encoded(library, text):
    return library.encode(text, add_special_tokens=False).ids


def texts(seed, n, pieces=PIECES, most=14):
    r = random.Random(seed)
    return ["".join(r.choice(pieces) for _ in range(r.randint(0, most))) for _ in range(n)]


def test_every_prefix_is_exact(library):
    count = token_counts.PrefixCounter(default_vocabulary())
    for text in texts(1, 250):
        at = count.prefixes(text).tolist()
        assert at == [len(encoded(library, text[:i])) for i in range(len(text) + 1)]
        for budget in (0, 1, 3, 7):
            assert count.count(text, budget) == (at[-1], max(i for i, n in enumerate(at) if n <= budget))
    text = "plain words only\nand nothing else " * 3 + "end"
    at = count.prefixes(text).tolist()
    for budget in range(0, len(at), 3):
        assert count.count(text, budget) == (at[-1], max(i for i, n in enumerate(at) if n <= budget))


@pytest.mark.parametrize(("leaf", "window"), [(2, 2), (5, 2), (32, 2), (4, 1), (24, 1), (32, 8)])
def test_trees_of_small_leaves_are_exact(library, leaf, window):
    codec = bpe_codec.Codec(default_vocabulary(), leaf, window)
    sets = [PIECES, ["a", "b", "the", "ing", "er", "l", "x"], ["!", "'", "-", "s", "=="], ["1", "22", "345"], [" ", "  ", "a"], ["日", "本", "é"], ["a"], ["!", "😀", "<|endoftext|>", "x", "'ll", "'re", "<|endof"]]
    for n, pieces in enumerate(sets):
        for text in texts(n, 60, pieces, 90):
            ids = encoded(library, text)
            assert np.frombuffer(codec.encode(text), np.int32).tolist() == ids
            assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_queries_digests(spark, library):
    docs = awkward(spark)
    got = queries.bpe_digests(bpe_codec.encode(docs)).collect()
    want = []
    for i, text, *_ in AWKWARD:
        ids = encoded(library, text or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    into = bpe_codec.encode_into(docs)
    assert into.columns == [c for c in docs.columns if c != "ids"] + ["n_tokens", "ids"] and into.count() == len(AWKWARD)
    assert bpe_codec.decode(bpe_codec.encode(empty(spark))).count() == 0


def test_counts_and_stored_prefixes(spark, library):
    docs = awkward(spark)
    got = token_counts.token_counts(docs, budget=5).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit)) for r in got) == sorted(str((i, len((t or "").encode()), n := len(encoded(library, t or "")), n > 5)) for i, t, *_ in AWKWARD)
    short = docs.where("doc_id <> 7")
    table = token_counts.prefix_counts(short)
    stored = {(r.doc_id, r.fit) for r in table.select("doc_id", token_counts.within("counts", 5).alias("fit")).collect()}
    assert stored == {(r.doc_id, r.fit_chars) for r in got if r.doc_id not in (7, None)}
    assert token_counts.token_counts(empty(spark)).count() == 0


def test_bounded_cache_gives_what_is_made():
    made = []
    cache = Bounded(lambda k: made.append(k) or len(k), most=3, longest=4)
    assert [cache[k] for k in ["a", "bb", "ccc", "a", "dddd", "a", "bb", "eeeee", "eeeee"]] == [1, 2, 3, 1, 4, 1, 2, 5, 5]
    assert len(cache) <= 3 and made.count("a") == 1 and made.count("eeeee") == 2


def test_free_memory_goes_back():
    anon = lambda: sum(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Pss_Anon:"))  # noqa: E731, SIM115
    held = [bytearray(5000) for _ in range(20_000)]
    last = bytearray(5000)  # keeps the heap's end in use
    full = anon()
    del held
    free_memory()
    assert last and anon() < full - 80_000


def test_workers_keep_few_words_between_tasks(spark):
    path = default_vocabulary()
    text = " ".join(f"w{i}x" for i in range(AT_REST + 10_000))
    assert bpe_codec.encode_into(spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1)).select("n_tokens").first()[0] > 0

    def kept(batches):
        import time

        time.sleep(0.5)  # so that each worker has a task
        list(batches)
        found = bpe_codec.codec(path)
        yield pa.RecordBatch.from_arrays([pa.array([len(found.bare) + len(found.spaced) + len(found.bare.old) + len(found.spaced.old)])], ["n"])

    sizes = [x.n for x in spark.range(0, 8, 1, 8).mapInArrow(kept, "n long").collect()]
    assert len(sizes) == 8 and max(sizes) < AT_REST
