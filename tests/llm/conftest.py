import pytest

EDGE = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, n double, row string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, columns whose names clash."""
    long_text = "palabra otra tercera cuarta. " * 6000
    rows = [
        (1, None, "en", "a"), (2, "", "en", None), (3, "   \n\t ", None, "a"), (4, long_text, "es", "b"), (5, "x" * 200_000, "en", "b"),
        (6, "same words here again and again", "en", "a"), (7, "same words here again and again", "en", "a"),
        (7, "same words here again and again", "en", "a"), (None, "no id but text", None, None), (8, "𝒳 emoji 😀 ünïcode", "de", "c"),
        (9, "1" * 50_000 + " " + "a@" * 20_000, "en", "a"), (10, "123456", None, "c"),
    ]
    return spark.createDataFrame([(*r, None, "clash", "clash", 1.5, "clash") for r in rows], EDGE)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], EDGE)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, 0) for i in range(1, 12)] + [(None, 1, 0), (3, None, None), (4, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark):
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota"), (2, "short item"), (3, None), (4, ""), (None, "no id item text here"),
        (1, "alpha beta gamma delta epsilon zeta eta theta iota"), (5, "Kappa, lambda; MU nu xi omicron pi rho sigma tau upsilon"),
    ]
    return spark.createDataFrame(rows, "item_id long, text string")
