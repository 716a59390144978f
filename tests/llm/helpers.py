"""Small awkward documents: nulls, empties, ties, repeats, clashing columns."""

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, target double, score double, ids string, TAKEN string, kept string"

AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away home", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog and runs far away home", "en", "a"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, " \n\t ", "de", "b"),
    (6, "one", "de", "b"),
    (6, "one", "de", "b"),
    (6, "another text under the same id", "de", "b"),
    (None, "a text without an id", "fr", "c"),
    (None, None, None, None),
    (7, "long " * 30000, "fr", "c"),
    (8, "mail me@example.org or +49 30 1234567 now; 4111 1111 1111 1111; 10.0.0.255 — é😀<|endoftext|>", "fr", None),
    (9, "a  b\u00a0c \u2003 d\r\ne", "fr", ""),
]


def awkward(spark):
    rows = [(*r, None if r[1] is None else len(r[1]), "x", 1.5, 0.5, "y", "z", "k") for r in AWKWARD]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
