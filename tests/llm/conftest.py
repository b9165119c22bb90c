import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string, size string, copies string, target string, kept string, spans string, component_id string, entities string, fp string, ids string, digest string"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in any column, empty and very long texts, ties and repeated rows, extra columns with clashing names."""
    extra = ("x",) * 12
    long = "Alpha beta gamma delta. " * 9000 + "token = " + "ab12" * 10
    prose = " ".join(f"word{i % 97}x{i}" for i in range(120))
    rows = [
        (1, None, "en", "a", 0),
        (2, "", "en", "a", 0),
        (3, " \t\n ", None, None, 4),
        (4, long, "en", "a", len(long)),
        (5, prose, "en", "a", len(prose)),
        (5, prose, "en", "a", len(prose)),
        (6, prose, "de", "b", None),
        (None, prose, "de", "b", len(prose)),
        (None, None, None, None, None),
        (7, "é日本\U0001f600 <|endoftext|> ### $$$ " * 30, "fr", "c", 9),
        (8, "Mail a.b@c.example.org or call +1 (017) 555-7713, card 4111111111111111.", "en", "b", 7),
    ]
    return spark.createDataFrame([r + extra for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
