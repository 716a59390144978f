import hashlib
import re

from vaporline.llm import exact_dedup as E
from vaporline.llm.common import text_of

from .helpers import AWKWARD, awkward, empty


def sha(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


def test_classes_of_awkward_documents(spark):
    got = E.classes(awkward(spark), E.scratch_index(spark)).collect()
    groups = {}
    for i, text, *_ in AWKWARD:
        groups.setdefault(sha(text), []).append(i)
    want = []
    for h, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        kept = False
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            want.append((i, keep, len(ids), i == keep and not kept, h))
            kept = kept or i == keep
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_batches_against_a_persistent_index(spark, tmp_path):
    index = E.DigestIndex(spark, "digests_of_batches", 4, f"file://{tmp_path}/index")
    one = spark.createDataFrame([(1, "x  y"), (2, "z")], "doc_id long, text string")
    two = spark.createDataFrame([(0, "x y"), (3, "new"), (4, "new")], "doc_id long, text string")
    assert E.classes(one, index).where("kept").count() == 2
    got = {r.doc_id: (r.keep_id, r.kept) for r in E.classes(two, index).collect()}
    assert got == {0: (1, False), 3: (3, True), 4: (3, False)}
    spark.sql("DROP TABLE digests_of_batches")  # external: its files stay
    again = E.DigestIndex(spark, "digests_once_more", 4, f"file://{tmp_path}/index")
    assert again.table().count() == 3
    plan = again.lacking(E.batch_digests(two))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan


def test_kept_rows(spark):
    docs = awkward(spark)
    index = E.scratch_index(spark)
    kept = E.kept_rows(docs, index)
    assert kept.columns == docs.columns
    assert sorted(sha(r.text) for r in kept.collect()) == sorted({sha(t) for _, t, *_ in AWKWARD})
    assert E.kept_rows(docs, index).count() == 0
    assert E.classes(empty(spark), E.scratch_index(spark)).count() == 0


def test_only_native_plans(spark):
    plan = E.classes(awkward(spark), E.scratch_index(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_clashing_columns_and_dropped_index(spark):
    docs = awkward(spark).selectExpr("*", "'x' AS text_sha256", "1 AS keep_id", "2 AS sha_of_text")
    index = E.scratch_index(spark)
    kept = E.kept_rows(docs, index)
    index.drop()
    assert kept.columns == docs.columns and kept.count() == docs.select(E.digest(text_of("text"))).distinct().count()
    assert not spark.catalog.tableExists(index.name)
