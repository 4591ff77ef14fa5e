"""Small documents with what inputs can hold: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, size long, anchor string, _id long, word string, score double, bucket string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(n))


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), "x", 1, "y", 2, "z", 0.5, "b")


@pytest.fixture(scope="session")
def odd_rows():
    shared = prose(1, 150)
    rows = [row(i, prose(100 + i, 20 + 7 * i), "en" if i % 2 else "de", ("a", "b", None)[i % 3]) for i in range(12)]
    return [
        *rows,
        row(20, None),
        row(21, ""),
        row(22, " \n\t"),
        row(23, "12345 !!!", None),
        row(24, "one two"),
        row(25, shared + " tail one"),
        row(26, "head " + shared),
        row(26, "head " + shared),
        row(27, prose(107, 20 + 49)),
        row(28, "é" * 300 + shared[:450] + "ü" * 250),
        row(29, "ab" * 900),
        row(30, "MIT Licence " + prose(7, 5000)),
        row(31, "the <|endoftext|> don't 'S  ΑΣ 日本 " + prose(8, 10)),
        row(None, prose(9, 40), "en", None),
        row(None, prose(9, 40), "en", None),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
