import pytest

CLASHING = ("score", "fp", "n", "row", "shard", "x", "bin", "component_id", "known", "h", "l_id", "y", "size", "u", "p", "q", "rank", "node", "kept", "languages", "copies", "__id")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def prose(i: int, n: int = 60, stem: str = "word") -> str:
    return " ".join(f"{stem}{(i * 7919 + k * k * 31 + k) % 997}" for k in range(n)) + "."


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(prose(i, 200) for i in range(60))
    rows = [
        (1, prose(1), "en", "a"), (2, prose(1), "en", "a"), (2, prose(1), "en", "a"), (3, prose(3), None, "b"), (4, None, "en", None), (5, "", "de", "b"), (6, " \n\t ", "de", "b"),
        (None, prose(7), "en", "c"), (None, None, None, None), (8, long, "en", "a"), (9, "x " * 3000, "de", "c"), (10, "123 456 !!", "de", "c"), (11, "été à Noël \U0001f600퟿", "fr", "c"),
        *((20 + i, prose(i), "en" if i % 2 else "de", "ab"[i % 2]) for i in range(12)),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *("clash",) * len(CLASHING)) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(40)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
