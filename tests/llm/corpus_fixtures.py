import pytest

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _all string, _row int, _fp int, _q int, _t int, _kept int"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and
    extra columns whose names operators use themselves."""
    long_text = " ".join(f"word{i % 977}" for i in range(40_000)) + "\n" + "x" * 70_000
    para = "Anna wrote a long letter to her sister about the garden, the weather and the price of bread in town."
    rows = [
        (1, para, "en", "a"), (2, para, "en", "a"), (2, para, "en", "a"), (3, para.upper(), "en", "b"),
        (4, None, "en", "a"), (5, "", None, "b"), (6, " \n\t ", "de", None), (None, "ohne Nummer " * 30, "de", "b"),
        (7, long_text, "en", "hot"), (8, "mail bob@example.com or +1 (724) 555-7058, card 4111 1111 1111 1111, host 10.0.0.1", "en", "hot"),
        (9, "4711 !!! ***", None, None), (10, "Der Garten und die Straße sind schön. " * 20, "de", "b"),
        (11, "password = \"ab12cd34ef56ab78\" é😀 c.d@e.org", "fr", "c"), (12, "a b", "fr", "c"),
    ]
    return spark.createDataFrame([(*r, None, "a", 1, 2, 3, 4, 5) for r in rows], DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(edge):
    return edge.where("doc_id = -1")
