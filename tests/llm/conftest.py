import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Documents with nulls in every column, empty and long texts, repeats and other columns."""
    base = " ".join(WORDS)
    rows = [
        (0, base, "en", "a"), (1, base, "en", "a"), (2, base.upper() + " extra", "en", "b"), (3, None, "en", "b"), (4, "", None, None), (5, " \t\n ", "fr", "a"),
        (6, "ab " * 30_000, "fr", "c"), (7, "x" * 70_000, None, "c"), (8, "one two", "de", "a"), (9, "One  TWO", "de", None), (10, "123 456 !!", "de", "b"),
        (11, "日本語 text é <|endoftext|> more\x1c y", "en", "a"), (12, base, None, "a"), (12, base, None, "a"), (None, base, "en", "a"), (None, None, None, None),
        (13, "Licensed under the Apache License, Version 2.0. All rights reserved. All Rights Reserved", "en", "b"),
    ]
    rows = [(*r, 1, 2.0, "q", True) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, score double, labels string, kept boolean").repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
