import pytest

from recordlens.session import steady_unions


@pytest.fixture(autouse=True)
def _steady(spark):
    steady_unions(spark)


EDGE_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, ids string, n_tokens string, score string, key string, "
               "size string, spans string, taken string, kept string, n_words string, n_lines string, _row string, _id string, _hash string, "
               "_text string, word string, sig string, leaf string, target string, held_out string, _group string, sigs string")


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and blank texts, a long text, ties, repeated rows, columns with the operators' own names."""
    long_text = "\n".join(f"line {k} of the very long text about word{k % 700} and thing{k % 311}." for k in range(6000))
    texts = [
        (1, "the cat sat on the mat and the dog ran to the big house", "en", "s1"),
        (1, "the cat sat on the mat and the dog ran to the big house", "en", "s1"),
        (1, "another text with the same id, which is a tie to settle", "en", "s1"),
        (None, "a text whose id is missing but which has the words it needs", None, None),
        (None, None, None, None),
        (2, None, "en", "s2"), (3, "", "de", "s2"), (4, " \t\n\x0b\r ", "de", "s1"), (5, "x", "fr", "s3"),
        (6, long_text, "en", "s1"), (7, "é ñ 日本 😀 ▁ <|endoftext|> don't", None, "s3"),
        (8, "a" * 5000, "en", "s4"), (9, "same same same same same same same same same same same same", "en", "s4"),
    ]
    rows = [(i, t, lang, source, None if t is None else len(t), *["clash"] * 21) for i, t, lang, source in texts]
    return spark.createDataFrame(rows, EDGE_SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.where("doc_id < -5")
