import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, keep_id string, score string, n string, mark string, node string, id string, uid string"

STORY = ("the quick brown fox jumps over the lazy dog while seven wise owls watch from the old oak tree near the quiet river and "
         "nobody in the village ever hears the sound of their wings at night because the mill wheel turns until the morning comes")


def edited(text, at, word):
    parts = text.split(" ")
    parts[at] = word
    return " ".join(parts)


@pytest.fixture(scope="session")
def rows():
    """Texts with nulls, empties, ties, repeated rows, a very long one and copies."""
    out = [
        (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (None, "No id here", "en"), (None, "NO ID HERE", None),
        (4, "One Two", "en"), (5, "one two", "de"), (6, "ÀB ONE", "fr"), (7, "àb one", "fr"), (8, "12 34 --", "en"),
        (9, STORY, "en"), (10, edited(STORY, 0, "a"), "en"), (11, edited(STORY, 40, "whenever"), "en"), (12, STORY.upper(), "en"),
        (13, STORY, "en"), (13, STORY, "en"), (14, "word " * 40_000, "en"), (15, STORY + " " + "x y z " * 200, "es"), (16, "a b c", "de"), (17, "a  b\nc", "de"),
    ]
    return [(i, t, lang, "src", None if t is None else len(t), "k", "k", "s", "n", "m", "n", "i", "u") for i, t, lang in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
