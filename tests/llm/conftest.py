import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or return; a table may have them too.
CLASHES = ["lang_pred", "score", "__score", "__lang", "class_id", "shard", "__shard", "__part", "topic", "n_tokens", "probability", "ids", "k", "id", "rep", "weight", "slot", "held_out"]


def prose(seed: int, n: int, words=("the", "of", "and", "stone", "river", "walks", "under", "light", "green", "seven")) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


def edge_rows():
    german = ("der", "und", "nicht", "straße", "ein", "mit", "von", "grün", "haus", "wasser")
    rows = [(0, None, None, None, None), (1, "", "en", "a", 0), (2, "   ", "en", None, 3), (3, prose(3, 60_000), "en", "a", None), (None, "a text without a key of its own", "en", "a", 1)]
    rows += [(4, "1234 !!! 5678", None, "b", 1), (5, "word", "en", "b", 4), (6, "tabs\tand\nlines\r\n and ▁ marks é 😀", "en", "b", 9)]
    for i in range(10, 60):
        rows.append((i, prose(i, 40 + i) if i % 2 else prose(i, 40 + i, german), "en" if i % 2 else "de", "a" if i % 3 else "b", 1))
    copy = prose(1000, 120)
    rows += [(70 + i, copy, "en", "a", 1) for i in range(6)]
    near = copy.split()
    near[50] = "changed"
    rows += [(80, " ".join(near), "en", "b", 1), (81, copy, "en", "a", 1), (81, copy, "en", "a", 1)]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(spark, edge):
    from pyspark.sql import functions as F

    return edge.select("*", *(F.lit("x").alias(c) for c in CLASHES)).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, 1 if i % 2 else 0, 0) for i in range(10, 60)] + [(3, 1, 0), (1, None, 0), (None, 1, 0), (11, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
