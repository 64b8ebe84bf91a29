import pytest

TEXTS = [
    None, "", " ", "\n", "a", "one line of words here\nanother line of words\none line of words here", "ONE LINE OF words here  \nshort\nanother line of words",
    "word " * 3000, "a b c a b c a b c", "ñandú é – “x” 中文 \U0001f600 line of words é", "tab\tand\x0bform\x0cfeed\r\nend of the line", "x" * 5000,
    "\n".join(f"line number {i} of the text" for i in range(400)), "\n".join(f"line number {i} of the text" for i in range(0, 800, 2)),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, repeated rows, ties, a null id, and extra columns whose names clash with inner ones."""
    rows = [(i, t, "en", "h1" if i % 2 else None, "x", 7, "z") for i, t in enumerate(TEXTS)]
    rows += [(5, TEXTS[5], "en", "h2", "x", 7, "z"), (None, TEXTS[5], None, None, None, None, None), (100, TEXTS[12], "fr", "h1", "x", 7, "z")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, _text string, n_words int, key string")


@pytest.fixture(scope="session")
def duck(sf):
    from check import connect

    return connect(sf)
