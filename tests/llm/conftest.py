"""Edge tables shared by the tests of the training-data operators."""
import pytest

from showerframe.llm.shipping import ship

SF = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"word{i % 37}x{i * 7 % 101}" for i in range(120))
LONG = " ".join(f"tok{i * i % 9973}" for i in range(30_000))


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


#: Null ids and texts, empty and blank texts, a very long text, repeated rows, equal texts under other ids, near copies.
EDGE = [
    (None, "text without an id " + PASSAGE, None), (1, None, "en"), (2, "", "en"), (3, " \t\n\x0b ", None), (4, "one", "en"),
    (5, "Two words", "de"), (6, LONG, "en"), (7, PASSAGE, "fr"), (7, PASSAGE, "fr"), (8, PASSAGE, "fr"),
    (9, PASSAGE + " and a tail", "fr"), (10, "a head, then " + PASSAGE, "fr"), (11, "ONE", None), (12, "x " * 400, "en"),
    (13, "ünï çödé\u00a0nbsp  two  blanks\nline\nline\n\nline <|endoftext|> a\u3000b", "de"), (14, "12 %% ## $$", None),
]


@pytest.fixture(scope="session")
def edge(spark):
    """The edge rows, with extra columns whose names the operators use themselves."""
    rows = [(i, t, lang, "src", len(t or ""), "n", "k", 1, "r") for i, t, lang in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, name string, key string, "
                                       "node int, row string").repartition(3)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.filter("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
