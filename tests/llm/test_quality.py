import math
import random

import numpy as np

from vaporline.llm import quality

from .helpers import AWKWARD, awkward, empty


def corpus(n=1200):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(r.randint(5, 90))]
        bad = r.random() < 0.2
        if bad:
            words = r.choice(([w.upper() + "!!" for w in words], [w + "$$$" for w in words], [words[0]] * len(words) + ["x"] * 12))
        rows.append((i, " ".join(words) + "."))
        if r.random() < 0.6:
            labels.append((i, int(not bad)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.train(docs, known)
    got = {x.doc_id: x for x in quality.score(docs, model).collect()}
    held = [(x.score, y) for i, y in labels if (x := got[i]).held_out]
    good, bad = ([s for s, y in held if y == want] for want in (1, 0))
    assert len(good) > 50 and len(bad) > 10
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([g >= 0.7 for g in good]) > 0.97
    assert all(x.predicted == int(x.score >= 0.7) and 0 <= x.score <= 1 for x in got.values())
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {i for i, x in got.items() if x.predicted}


def test_labels_of_held_out_rows_are_not_used(spark):
    import zlib

    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    a, b = (quality.train(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, flipped))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def plain_risk(w, p, u, prior):
    """The non-negative risk of a linear model, row by row as the method defines it."""
    loss = lambda x, sign: math.log1p(math.exp(-sign * float(np.dot(x, w))))
    mean = lambda xs: sum(xs) / len(xs)
    negative = mean([loss(x, -1) for x in u]) - prior * mean([loss(x, -1) for x in p])
    return prior * mean([loss(x, 1) for x in p]) + max(0.0, negative), negative


def samples(prior, n=400, seed=3):
    r = np.random.default_rng(seed)
    good, bad = (lambda k: r.normal(1.0, 1.0, (k, 3))), (lambda k: r.normal(-1.0, 1.0, (k, 3)))
    return good(n), np.vstack([good(int(prior * n)), bad(n - int(prior * n))])[r.permutation(n)]


def test_fit_minimises_the_plain_risk():
    p, u = samples(0.6)
    model = quality.fit(p, u, 0.6, penalty=0.0, steps=2000)
    wide = lambda x: np.hstack([np.clip((x - model.mean) / model.scale, -8, 8), np.ones((len(x), 1))])
    w = np.append(model.weights, model.bias)
    least, negative = plain_risk(w, wide(p), wide(u), 0.6)
    assert negative > 0 and least < plain_risk(0 * w, wide(p), wide(u), 0.6)[0]
    r = np.random.default_rng(9)
    assert all(plain_risk(w + r.normal(0, s, len(w)), wide(p), wide(u), 0.6)[0] > least - 1e-4 for s in (0.05, 0.5) for _ in range(20))


def test_negative_risk_stays_near_zero():
    # A prior far too large makes the unbiased risk's negative part fall below 0 without end.
    p, u = samples(0.5, n=40)
    model = quality.fit(p, u, 0.95, penalty=0.0, steps=2000)
    wide = lambda x: np.hstack([np.clip((x - model.mean) / model.scale, -8, 8), np.ones((len(x), 1))])
    assert plain_risk(np.append(model.weights, model.bias), wide(p), wide(u), 0.95)[1] > -0.05


def test_prior_is_estimated_without_labels_of_bad_documents(spark):
    for prior in (0.3, 0.6, 0.9):
        assert abs(quality.estimated_prior(*samples(prior, n=4000)) - prior) < 0.08
    assert quality.estimated_prior(np.zeros((0, 3)), np.zeros((5, 3))) == 0.5
    assert 0 < quality.estimated_prior(np.ones((9, 3)), np.ones((9, 3))) < 1
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (quality.train(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, [x for x in labels if x[1]]))
    assert a.prior == b.prior and np.array_equal(a.weights, b.weights)


def test_awkward_documents(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 1), (4, None), (None, 1), (6, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert quality.score(docs, model).count() == len(AWKWARD)
    assert quality.accepted(docs, model, threshold=0.0).columns == docs.columns
    none = quality.train(docs, labels.limit(0))
    assert {x.score for x in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(empty(spark), quality.train(empty(spark), labels)).count() == 0
