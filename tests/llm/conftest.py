import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row int, size string, language string, copies int, h double"


def documents(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    full = [(i, t, lang, src, None if t is None else len(t), 7, "x", "klingon", 5, 0.5) for i, t, lang, src in rows]
    return spark.createDataFrame(full, COLUMNS)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, odd characters."""
    long = " ".join(f"word{i % 977} und{i % 31}" for i in range(60_000))
    return [
        (1, "the cat sat on the mat and the dog", "en", "a"), (2, "the cat  sat on\tthe mat and the dog", "en", "a"),
        (2, "the cat  sat on\tthe mat and the dog", "en", "a"), (None, "the cat sat on the mat and the dog", None, None),
        (3, None, "en", None), (4, "", None, "b"), (5, " \n\t ", "de", "b"), (6, long, "de", "a"), (7, long + " end", "de", "a"),
        (8, "x", "fr", "c"), (9, "É\x00\x85 \U0001f600 é…", "xx", "c"), (10, "a" * 100_000, "en", "c"), (11, "der Hund\x0bund die Katze", "de", "\U0001f600"),
    ]
