import pytest

#: name -> rows of the awkward documents that every operator is run on
LONG = "Wort " * 30_000 + "Ende"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and white texts, a very long one, ties, repeated rows, odd characters,
    and extra columns with names that operators use themselves."""
    rows = [
        (1, "the cat sat on the mat", "en", "a", 22),
        (2, "the cat  sat on the\tmat", "en", "a", 23),
        (3, None, "en", "b", None),
        (4, "", None, "b", 0),
        (5, " \t\n\r\x0b\x0c", "en", None, 6),
        (6, LONG, "de", "a", len(LONG)),
        (7, "ünïcödé   and spaces \U0001f600", "fr", None, 27),
        (8, "two words", "en", "c", 9),
        (8, "two words", "en", "c", 9),
        (None, "no id here", "en", "c", 10),
        (None, None, None, None, None),
        (9, "twowords", "en", "c", 8),
        (10, LONG, "de", "b", len(LONG)),
    ]
    extra = ["id", "key", "fp", "score", "n", "rank", "size", "taken", "row_key", "own_sha", "keep_doc", "c0", "host", "label"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(extra)])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def small_dir(spark, tmp_path_factory):
    """A few hundred real documents and their labels, as a folder of tables."""
    import os

    source = "/root/testdata/sf0.001"
    if not os.path.isdir(source):
        pytest.skip("no test data")
    return source
