import random
import re

from vaporline.llm import components as parts
from vaporline.llm import simhash as S
from vaporline.llm.components import components

from .helpers import AWKWARD, awkward, empty


def slow(text):
    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    hashes = [xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprints():
    for _, text, *_ in AWKWARD:
        if len(text or "") < 1000:
            assert S.fingerprint(text or "") == slow(text or "")
    assert S.fingerprint("") == S.fingerprint(" \n") == 0
    assert S.fingerprint("A B") == S.fingerprint("a  b") != S.fingerprint("a b c")


def test_links_connect_what_is_near_however_dense(spark):
    r = random.Random(4)
    bases, found = [r.getrandbits(64) for _ in range(3)], set()
    for _ in range(700):
        x = r.choice(bases)
        for _ in range(r.randint(0, 4)):
            x ^= 1 << r.randrange(64)
        found.add(x)
    frame = spark.createDataFrame([(S.signed(x),) for x in found], "fp long")
    want = groups(sorted(S.signed(x) for x in found), lambda a, b: ((a ^ b) & S.ALL_BITS).bit_count() <= 2)
    for limit in (150, S.GROUP_LIMIT):
        links = S.links(frame, 2, limit)
        roots = {x.node: x.root for x in components(links).collect()}
        assert {n: roots.get(n, n) for n in want} == want
        assert links.count() < 40 * len(found)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95)] + [(-5, 1000 + i) for i in range(30)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {95: 90, 100: 90} | {1000 + i: -5 for i in range(30)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_edges_take_few_tasks(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spark.sparkContext.setJobGroup("few edges", "")
        assert components(edges).count() == 40
    finally:
        spark.sparkContext.setJobGroup("others", "")
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("few edges") for s in tracker.getJobInfo(j).stageIds}
    # The first two reads of the edges have a task a partition, no round has.
    assert sum(tracker.getStageInfo(s).numCompletedTasks for s in stages if tracker.getStageInfo(s)) < 200


def test_components_without_broadcast_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(parts, "BROADCAST_NODES", 0)
    r = random.Random(11)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(500, 501 + i) for i in range(50)] + [(None, 7), (8, None), (None, None)]
    linked = {(a, b) for a, b in edges if a is not None and b is not None}
    nodes = sorted({x for e in linked for x in e})
    want = groups(nodes, lambda a, b: (a, b) in linked or (b, a) in linked)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n: got.get(n, n) for n in nodes} == want and all(n != root for n, root in got.items())


def test_components_of_more_edges_than_a_task_reads(spark, monkeypatch):
    monkeypatch.setattr(parts, "EDGES_A_TASK", 20)
    test_components_of_chains(spark)
    test_components_without_broadcast_and_nulls(spark, monkeypatch)


def test_awkward_documents(spark):
    docs = awkward(spark)
    rows = S.classes(docs).collect()
    assert len(rows) == len(AWKWARD)
    by_id = {x.doc_id: x for x in rows if x.doc_id not in (6, None)}
    assert by_id[1].component_id == by_id[2].component_id == 1
    assert by_id[3].component_id == by_id[4].component_id == by_id[5].component_id == 3
    assert by_id[3].fingerprint == "0" * 16
    kept = S.kept_rows(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({x.root for x in rows})
    assert S.classes(empty(spark)).count() == 0 and S.kept_rows(empty(spark)).count() == 0
