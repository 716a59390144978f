import random

from pyspark.sql import functions as F

from vaporline.operators import relational as R


def test_range_join_equals_all_comparisons(spark):
    r = random.Random(0)
    points = [(f"k{r.randint(0, 2)}", r.randint(-50, 300), i) for i in range(150)]
    spans = [(f"k{r.randint(0, 2)}", a := r.randint(-60, 250), a + r.choice((-1, 0, 5, 90)), i) for i in range(60)]
    got = R.range_join(spark.createDataFrame(points, "k string, at long, p int"), spark.createDataFrame(spans, "k string, a long, b long, s int"), ["k"], "at", "a", "b", 20)
    assert sorted((x.p, x.s) for x in got.collect()) == sorted((p, s) for k, t, p in points for q, a, b, s in spans if k == q and a <= t <= b)
    outer = R.range_join(spark.createDataFrame(points, "k string, at long, p int"), spark.createDataFrame(spans, "k string, a long, b long, s int"), ["k"], "at", "a", "b", 20, "left")
    assert {x.p for x in outer.collect()} == {p for _, _, p in points}


def test_as_of_takes_the_last_sample_at_or_before(spark):
    r = random.Random(1)
    anchors = [("a", r.randint(0, 50), i) for i in range(40)] + [("none", 5, 99)]
    samples = [("a", r.randint(5, 50), i, f"v{i}") for i in range(30)]
    got = R.as_of(spark.createDataFrame(anchors, "k string, at long, i int"), spark.createDataFrame(samples, "k string, t long, n long, v string"), ["k"], "at", "t", ["v"], "n")
    want = {i: max(((t, n, v) for q, t, n, v in samples if q == k and t <= at), default=(0, 0, None))[2] for k, at, i in anchors}
    assert {x.i: x.v for x in got.collect()} == want


def test_mutual_and_either_end(spark):
    edges = spark.createDataFrame([("a", "b", 9.0), ("a", "c", 8.0), ("b", "c", 1.0), ("c", "d", 7.0)], "u string, v string, w double")
    order = [F.col("w").desc(), F.col("u"), F.col("v")]
    assert {(x.u, x.v) for x in R.mutual_top_k(edges, "u", "v", order, 1).collect()} == {("a", "b")}
    assert {(x.u, x.v) for x in R.top_k_either_end(edges, "u", "v", order, 1).collect()} == {("a", "b"), ("a", "c"), ("c", "d")}


def test_median_mad_and_jaccard(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 4.0, 8.0)], "k string, x double")
    row = R.median_mad(df, ["k"], ["x"]).first()
    assert (row.x_median, row.x_mad) == (3.0, 1.5)
    assert R.jaccard(df, df.where("x > 2"), ["x"]).first().jaccard == 0.5
    assert R.jaccard(df.limit(0), df.limit(0), ["x"]).first().jaccard == 0.0
