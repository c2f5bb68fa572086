"""Small tables for the awkward cases that every operator must take."""

LONG = "Alpha beta gamma delta. " * 4000
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (3, None),
    (4, ""),
    (5, " \t\n\x0b\x0c\r "),
    (6, "!!! ??? 123 456"),
    (7, LONG),
    (None, "row without an id"),
    (None, "row without an id"),
    (8, "é́ ünïcode ‘quotes’ 中文 😀 \x1c \xa0 end"),
    (9, "word"),
]


def awkward(spark):
    """Documents with null, empty, repeated and very long texts, null and repeated ids, and columns with clashing names."""
    rows = [(i, t, "en", "s", None if t is None else len(t), "x", 1, 2.0) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, h int, score double")


def empty(spark):
    return awkward(spark).limit(0)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")
