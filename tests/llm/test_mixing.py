from collections import defaultdict

from vaporline.llm import mixing

from .helpers import AWKWARD, awkward, empty


def water_level(sizes, weights):
    """By rounds: what exceeds a cap goes to the others by weight."""
    cap = {s: 3.0 * n for s, n in sizes.items()}
    target, left, open_ = dict.fromkeys(sizes, 0.0), float(sum(sizes.values())), set(sizes)
    while open_:
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / total > cap[s]}
        if not over:
            target |= {s: left * weights[s] / total for s in open_}
            break
        for s in over:
            target[s] = cap[s]
            left -= cap[s]
        open_ -= over
    return target


def test_targets_by_rounds(spark):
    sizes = {"a": 1000, "b": 3, "c": 40, "d": 2, "e": 0, None: 5}
    got = {r.source: r for r in mixing.source_targets(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")).collect()}
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = water_level(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)})
    assert {s: round(r.target, 6) for s, r in got.items()} == {s: round(t, 6) for s, t in want.items()}


def test_awkward_documents(spark):
    docs = awkward(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(AWKWARD)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r["size"]
        assert r.taken == r["size"] * r.copies and 0 <= r.copies <= 3
    assert all(r.source_size == sizes[r.source] for r in rows)
    assert {r["size"] for r in rows if r.doc_id == 6} == {1, 6}
    emitted = mixing.emit(docs)
    assert emitted.columns == docs.columns
    assert emitted.count() == sum(r.copies for r in rows)
    assert sorted(map(str, emitted.collect())) == sorted(map(str, mixing.emit(docs).collect()))


def test_near_targets_and_empty(spark):
    docs = spark.createDataFrame([(i, "w " * 20, "abc"[i % 7 % 3]) for i in range(6000)], "doc_id long, text string, source string")
    by = mixing.mix(docs).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) < 0.1 * r["max(target)"] for r in by)
    assert mixing.mix(empty(spark)).count() == 0


def test_rows_without_ids_draw_on_their_own(spark):
    rows = [(None, f"w{i} " * 10, "abc"[i % 3]) for i in range(600)]
    by = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) < 0.3 * r["max(target)"] for r in by)
