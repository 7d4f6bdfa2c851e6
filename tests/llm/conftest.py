import pytest

#: Rows that every operator on documents has to live with: nulls, empty and blank texts, ties, repeats, a clash of names.
ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "a", 10, "x"),
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "a", 10, "x"),
    (2, None, "en", "a", None, "x"),
    (3, "", None, None, 0, None),
    (4, " \n\t ", "de", "b", 4, "x"),
    (None, "der die das und nicht mit von auf für ist", "de", "b", 40, "x"),
    (5, "1234 5678 !!", "fr", None, 12, "x"),
    (6, "one two three", "en", "c", 13, "x"),
    (7, "word " * 30_000, "en", "c", 150_000, "x"),
    (8, "x" * 70_000, "en", "c", 70_000, "x"),
    (9, "\u0000   é \U0001f600 ▁   token = \"aaaaaaaaaaaaaaaaaaaa\"", "en", "c", 30, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, {}"


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents with an extra column of the given name."""

    def make(extra="node string", rows=ODD):
        return spark.createDataFrame(rows, SCHEMA.format(extra))

    return make


def ids_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
