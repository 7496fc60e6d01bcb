import random

import pytest

WORDS = "the of and to in harbour quiet lantern meadow copper signal border winter paper river garden engine novel silver thunder".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, digest binary, n_words string, print int"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return "".join(r.choice(WORDS) + r.choice([" "] * 12 + [". ", ",\n"]) for _ in range(n))


def odd_texts() -> list:
    """Nulls, empties, white space, very long and unsplit texts, ties and repeated rows."""
    long = prose(1, 6000)
    return [None, "", "   \n\t ", "word", "a b c", prose(2, 60), prose(2, 60), prose(3, 400), long, "x" * 20_000, "é́ " * 300, "one line\n" * 40, "7" * 3000, None, "😀中文 text <|endoftext|>", "\r\n\x0b\x0c end"]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(k, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", 0, "k", b"d", "w", 1) for k, t in enumerate(odd_texts())]
    return spark.createDataFrame([*rows, rows[5], (None, "no id here at all", "fr", "s1", 3, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
