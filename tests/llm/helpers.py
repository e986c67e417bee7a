"""Small tables with the awkward cases: nulls, empty and long texts, repeated rows, clashing extra columns."""

LONG = "word " * 5000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, id long, component string"


def docs(spark, rows, repeat=()):
    """``rows``: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1, "x", 7, "y") for r in (*rows, *repeat)]
    return spark.createDataFrame(full, DOCS)


def awkward(spark):
    rows = [(1, "Alpha beta gamma."), (2, None), (3, ""), (4, "Alpha beta gamma."), (5, LONG), (None, "Alpha beta gamma."), (6, "  \n\t "), (7, "é ñ 日本 😀")]
    return docs(spark, rows, repeat=[(7, "é ñ 日本 😀"), (2, None)])


def empty(spark):
    return spark.createDataFrame([], DOCS)
