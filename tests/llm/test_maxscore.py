import random

from vaporline.llm import maxscore


def brute(rows, k=5):
    from math import floor, isfinite

    sound = [(i, [floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and isfinite(x) for x in v)]
    out = []
    for n, (q, query) in enumerate(sound):
        if q is not None and q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(query, v)), i is None, i or 0) for m, (i, v) in enumerate(sound) if m != n)[:k]
            out += [(q, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(scores, 1)]
    return sorted(out, key=str)


def test_against_brute_force(spark):
    r = random.Random(3)
    rows = [(i, [r.choice((0.0, r.uniform(-1, 1), 0.5)) for _ in range(9)]) for i in range(400)]
    rows += [(401 + i, rows[3][1]) for i in range(40)]  # ties
    rows += [(500, None), (501, [1.0, None]), (502, [float("nan")]), (503, [float("inf")]), (None, [1.0]), (None, [9.0] * 9), (0, rows[7][1]), (0, rows[0][1]), (50, None), (7, rows[7][1]), (550, [0.25]), (600, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block, queries in ((1 << 16, 4096), (64, 3)):
        got = maxscore.top_k(frame, block=block, query_block=queries).collect()
        assert sorted(((x.query_id, x["rank"], x.vec_id, x.score) for x in got), key=str) == brute(rows)


def test_huge_components_few_rows_and_empty(spark):
    rows = [(0, [1e12, -3.0]), (50, [1e12, 1.0]), (3, [2.0, 2.0])]
    got = maxscore.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    top = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in got}
    assert top[0, 1] == (50, min((1 << 63) - 1, int(256e12) ** 2 - 3 * 256 * 256)) and top[0, 2] == (3, int(256e12) * 512 - 768 * 512) and len(got) == 4
    far = spark.createDataFrame([(0, [1e300, 1e308]), (1, [1e9, 0.0]), (2, [-1e308, 0.5]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(x.vec_id, x.score) for x in sorted(maxscore.top_k(far).collect(), key=lambda x: x["rank"])] == [(1, (1 << 63) - 1), (3, 0), (2, -(1 << 63))]
    assert maxscore.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_clashing_columns_and_single_floats(spark):
    rows = [(i, [0.1 * i, -0.3, 0.7], "x", 1, 2) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, row string, score int, V int")
    got = maxscore.top_k(frame).collect()
    assert len(got) == 10 and {x.query_id for x in got} == {0, 50}
    plain = maxscore.top_k(frame.select("vec_id", "embedding")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, plain))
