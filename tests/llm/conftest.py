import pytest

ROWS = [
    # doc_id, text, lang, source, n_chars, rule (a name that operators use themselves)
    (1, "one two  three\tfour", "en", "a", 1, "x"),
    (2, "one two three four", "en", None, 1, "x"),
    (3, None, None, "a", None, None),
    (4, "", "en", "b", 0, "x"),
    (5, " \t\n ", "de", "b", 0, "x"),
    (6, "One two three four", "en", "a", 1, "x"),
    (7, "a b c a b c a b c " * 40, "en", "c", 1, "x"),
    (7, "a b c a b c a b c " * 40, "en", "c", 1, "x"),
    (8, "line one here\nline one here\n\nline one here\n***", "fr", "c", 1, "x"),
    (None, "one two three four", "en", "a", 1, "x"),
    (9, "w" + " lorem ipsum dolor" * 4000 + " end", "en", "d", 1, "x"),
    (10, "w" + " lorem ipsum dolor" * 4000 + " end.", "en", "d", 1, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rule string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, blanks, repeated rows, long texts and a clashing extra column."""
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def duck(sql, **tables):
    import duckdb
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return sorted(map(tuple, con.execute(sql).fetchall()), key=repr)


def rows(df, columns=None):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
