import random

import pytest

BASE = "doc_id long, text string"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeéghiß") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty, blank and very long texts, ties, repeated rows, copies, near copies, shared passages, runs."""
    shared, long = words(40, 1), words(6000, 2)
    near = words(200, 3).split()
    out = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "two words"), (6, long), (7, words(30, 4) + " " + shared + " " + words(30, 5)),
        (8, words(25, 6) + "\n" + shared + "\n" + words(25, 7)), (9, shared), (10, shared), (11, " ".join(near)), (12, " ".join([*near[:100], "changed", *near[101:]])),
        (13, "ha " * 90), (14, "x" * 300), (15, "x" * 120), (16, words(80, 8)), (17, long + " end"), (18, "ab" * 100 + " " + words(60, 9)),
        (19, words(20, 10) + " " + words(20, 10)), (20, "\x00" * 60 + "ÿé" * 30), (20, "\x00" * 60 + "ÿé" * 30), (None, shared), (-5, words(50, 11)), (21, words(50, 11)),
    ]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with further columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, BASE).repartition(3)
    for name in ("bucket", "shard", "key", "n", "ids", "band", "label", "window", "quire_text", "sh", "w", "lang_pred"):
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], BASE)
