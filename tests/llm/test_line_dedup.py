import random

import corpus_pipeline
from vaporline.llm import line_dedup as L

from .helpers import AWKWARD, awkward, empty


def test_patience_alignment():
    assert L.patience(list("abcXde"), list("abYcde")) == [(0, 0), (1, 1), (2, 3), (4, 4), (5, 5)]
    assert L.patience([], list("ab")) == []
    r = random.Random(0)
    for _ in range(300):
        a, b = ([r.choice("abcdefgh") for _ in range(r.randint(0, 12))] for _ in range(2))
        got = L.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))


def brute(docs, block=10):
    """Every document against every earlier one: the diagonals of equal lines."""
    norm = {k: [" ".join(x.split()) for x in t.split("\n")] for k, t in docs.items()}
    out = {}
    for k, later in norm.items():
        gone = set()
        for e, earlier in norm.items():
            for shift in range(-len(earlier), len(later)) if e < k else ():
                run = []
                for i in range(len(later) + 1):
                    if i < len(later) and 0 <= i - shift < len(earlier) and later[i] == earlier[i - shift]:
                        run.append(i)
                    else:
                        if sum(len(later[n].split()) for n in run) >= block:
                            gone.update(run)
                        run = []
        out[k] = sorted(gone)
    return out


def test_against_brute_force(spark):
    r = random.Random(1)
    lines = [" ".join(r.choice("abcdefghij") for _ in range(r.randint(0, 14))) for _ in range(40)]
    docs = {i: "\n".join(r.choice(lines) for _ in range(r.randint(1, 12))) for i in range(120)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {x.doc_id: [int(i) for i in x.removed.split(",") if i] for x in L.line_report(frame).collect()}
    want = brute(docs)
    assert got == want and any(want.values())
    texts = {x.doc_id: x.text for x in L.deduplicated(frame, drop_emptied=False).collect()}
    assert texts == {k: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[k]) for k, t in docs.items()}


def test_common_passage_and_clean_documents(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"own start {i} of it all\n{passage}\nown end {i} of it all") for i in range(50)] + [(100 + i, f"clean text number {i} says nothing that others say\nAs.\nThe end.") for i in range(20)]
    out = {x.doc_id: x.text for x in L.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(passage in t for t in out.values()) == 1 and passage in out[0]
    assert all(out[k] == t for k, t in rows if k >= 100)


def test_awkward_documents(spark):
    docs = awkward(spark)
    assert L.line_report(docs).count() == len(AWKWARD)
    out = L.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == len(AWKWARD)
    assert sum(x.text is None for x in out.collect()) == 2
    assert L.line_report(empty(spark)).count() == 0 and L.deduplicated(empty(spark)).count() == 0


def test_blocks_whose_lines_have_other_first_holders(spark):
    one, two = "alpha beta gamma delta epsilon", "zeta eta theta iota kappa"
    short = "\n".join(f"a{i} b{i} c{i}" for i in range(5))
    docs = {1: f"own one\n{one}\nmore of one", 2: f"own two\n{two}\nmore of two", 3: f"own three\n{one}\n{two}\nmore three", 4: f"own four\n{one}\n{two}\nmore four", 5: f"own five\n{short}\nmore five", 6: f"own six\n{short}\nmore six"}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {x.doc_id: x.removed for x in L.line_report(frame).collect()}
    assert got == {1: "", 2: "", 3: "", 4: "1,2", 5: "", 6: "1,2,3,4,5"}
    assert {x.doc_id: x.text for x in corpus_pipeline.line_stage(spark, frame, "").collect()}[4] == "own four\nmore four"


def test_copies_within_a_document_and_crossing_blocks(spark):
    one, two = ("\n".join(f"{p} line {i} of some words" for i in range(6)) for p in "ab")
    docs = {1: f"start one\n{one}\nmiddle\n{two}\nend one", 2: f"start two\n{two}\nbetween\n{one}\nend", 3: f"{one}\nx\n{one}\ny\n{one}"}
    got = {x.doc_id: x.text.split("\n") for x in L.deduplicated(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got[2] == ["start two", "between", "end"] and got[3] == ["x", "y"]


def test_a_document_that_very_many_share(spark, monkeypatch):
    monkeypatch.setattr(L, "PARTS", 7)
    passage = "\n".join(f"line {i} of the one passage" for i in range(5))
    docs = {i: f"own {i}\n{passage}\nand {i % 3} more of it than others have at all" for i in range(200)}
    got = {x.doc_id: [int(i) for i in x.removed.split(",") if i] for x in L.line_report(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == brute(docs)
