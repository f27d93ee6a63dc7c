import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with every awkward case: NULLs, empty and long texts, copies, repeated rows, an extra column."""
    prose = " ".join(f"w{i * 7919 % 1009}" for i in range(400))
    rows = [(1, prose, "en", "a"), (2, prose, "en", "a"), (2, prose, "en", "a"), (3, prose + " tail", None, "a"),
            (4, None, "en", None), (5, "", "en", "a"), (6, " \n\t ", "de", "b"), (7, "x " * 30_000, "en", "a"),
            (None, "Mail a.b@c.de or +49 (30) 1234-5678. Card 4111 1111 1111 1111, host 10.0.0.256 10.0.0.25.", "en", "b"),
            (8, "ß Œuvre l'été I'VE 123 <|endoftext|> İ é", "fr", "b")]
    return spark.createDataFrame([(*r, "clash") for r in rows],
                                 "doc_id long, text string, lang string, source string, node string")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (7, 0, 1), (None, 0, 1), (8, None, None), (8, 1, 0)],
                                 "doc_id long, quality int, toxic int")
