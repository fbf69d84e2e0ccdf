import pytest


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with every oddity the operators must stand: nulls, blanks, repeats, a long text, a clashing column."""
    base = "the quick brown fox jumps over the lazy dog while seven wise owls watch from the old oak tree near the river"
    edit = base.replace("seven", "eight")
    rows = [(0, base, "en", "a"), (1, base, "en", "a"), (2, edit, None, None), (3, "", "en", "b"), (4, None, "en", "b"),
            (5, "un petit texte en français avec des élèves très heureux à l'école", "fr", "b"),
            (6, " \n\t ", "fr", "b"), (7, "one two", "en", "a"), (8, "One  two", "en", "a"),
            (9, ("word%d " * 5 % (1, 2, 3, 4, 5)) * 4000, "en", "b"), (None, base, "en", "a"), (11, "password=Abc123def456XYZ", "en", "a"),
            (5, "un petit texte en français avec des élèves très heureux à l'école", "fr", "b"),
            (12, base + "\n" + edit + "\n\nshort", "en", "a")]
    return spark.createDataFrame([(*r, len(r[1] or ""), "clash") for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, n string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
