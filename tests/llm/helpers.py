"""Fixture rows with nulls, empties, ties, long texts and clashing column names."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label int, size long"


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    return spark.createDataFrame([(r[0], r[1], None, r[2] if len(r) > 2 else "s", 0, 1, 5) for r in rows], DOCS)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols or df.columns).collect()), key=repr)
