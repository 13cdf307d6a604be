import pytest

TEXTS = [
    (0, "The cat sat on the mat. It was happy there, in the sun.\nA second line follows here.", "en", "a"),
    (1, "The cat sat on the mat. It was happy there, in the sun.\nA second line follows here.", "en", "a"),
    (2, "the CAT sat on the mat. It was happy there, in the sun.\nA second line follows here.", "en", "b"),
    (3, "Der Hund schläft unter dem großen Baum und träumt von Würsten.", "de", "a"),
    (4, None, "en", "a"),
    (5, "", None, None),
    (6, "1234 !!! \t\n  ", "fr", "b"),
    (7, "Le chat dort près de l'été ; ça va  bien   ici.", "fr", "c"),
    (8, "mail bob.smith@mail.example.com or +1 (456) 555-2186, host 10.2.3.4, card 4111 1111 1111 1111", "en", "c"),
    (9, "word " * 3000 + "end", "en", "a"),
    (None, "no id here, only text.", "en", "a"),
    (11, "repeated row", "en", "a"),
    (11, "repeated row", "en", "a"),
    (12, "日本語 text, emoji 😀 and ſ İstanbul ΣΑΣ '<|endoftext|>' don't", "en", "z"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Documents of all sorts, with columns whose names clash with results'."""
    rows = [(*r, len(r[1]) if r[1] is not None else None, 7, "x") for r in TEXTS]
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id long, ids string"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
