"""The near-duplicates stage on rows without an id and on ids that come again."""

import random

import pytest

from factloom.llm import simhash
from factloom.llm.common import Scratch


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    text = lambda: [rng.choice("abcdefghij") + str(rng.randrange(300)) for _ in range(80)]
    edited = lambda words: " ".join([*words[:40], "other", *words[41:]])
    a, b, c, d = text(), text(), text(), text()
    return [
        (3, " ".join(a), "x"), (None, edited(a), "x"), (None, " ".join(a), "y"),  # copies without an id go
        (None, " ".join(b), "x"), (None, edited(b), "x"), (None, " ".join(b), "w"),  # of rows without an id one stays
        (7, " ".join(c), "x"), (7, edited(c), "x"), (8, " ".join(c), "a"),  # two texts of one id in one group
        (3, edited(d), "x"), (2, " ".join(d), "x"),  # an id that another group keeps
        (None, None, "x"), (9, "", "x"),
    ]


def test_each_group_keeps_one_row(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id int, text string, tag string")
    got = simhash.keep_one(docs.repartition(3), Scratch(spark, "t"))
    assert got.dtypes == docs.dtypes
    b, c = min(rows[3][1], rows[4][1]), min(rows[6][1], rows[7][1])
    want = {rows[0], (None, b, "w" if b == rows[5][1] else "x"), (7, c, "x"), rows[10], rows[12]}
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
