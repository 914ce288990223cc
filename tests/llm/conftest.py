import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: Rows that every operator has to stand: nulls, empty and blank texts, repeats, no letters, one word, a long run, other scripts.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "12 34 !!"), (5, "one"), (5, "one"), (6, "one"), (None, "one two three four five six"), (7, "one two three four five six"), (8, "A" * 60_000),
    (9, "漢字 仮名 кириллица"), (10, "don't stop 'sam''s it’s İstanbul \x1c"), (None, None), (11, "x y " * 30_000), (12, "tail \U0001f600 smile"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with further columns whose names clash with those that operators use."""
    rows = [(i, t, "en" if k % 2 else None, "s", k, "z", 1, b"q") for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _id int, _text string, size int, `set` binary").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("doc_id = -1")
