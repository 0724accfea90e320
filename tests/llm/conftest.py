import pytest
from texts import edited, prose

CLASHING = "bucket, node, f0, h, i, key, label, line, shard, size, slot, score, count, w, at, row, words, items, y, part, step, name, th, run, th_drop"


@pytest.fixture(scope="session")
def hard_rows():
    """(doc_id, text): nulls, empty and white texts, a very long one, copies, near copies, repeated rows, rows without an id."""
    base = prose(1, 300)
    shared = prose(2, 80, 20)
    rows = [
        (1, base), (2, None), (3, ""), (4, " \n\t "), (5, prose(3, 30_000)), (6, base), (6, base), (7, edited(base, 150)), (8, edited(base, 140, 1)),
        (None, "lonely text without an id"), (None, base), (9, "one"), (10, "One"), (11, "tie tie tie tie tie tie"), (12, "ünïcode ÇA va 東京 \U0001f600 x"),
        (13, prose(4, 60) + "\n" + shared + "\n" + prose(5, 60)), (14, prose(6, 90) + "\n" + shared + "\n" + prose(7, 30)),
        (15, 'key token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and number 9807915762804490 end'),
    ]
    return rows + [(100 + k, prose(100 + k, 120)) for k in range(20)]


@pytest.fixture(scope="session")
def clashing(spark):
    """Adds columns whose names the operators use inside."""
    def add(df):
        from pyspark.sql import functions as F

        have = {c.lower() for c in df.columns}
        return df.withColumns({c: F.lit("caller's") for c in CLASHING.split(", ") if c not in have})

    return add


@pytest.fixture(scope="session")
def hard_docs(spark, hard_rows, clashing):
    return clashing(spark.createDataFrame(hard_rows, "doc_id long, text string"))


@pytest.fixture(scope="session")
def no_docs(spark, clashing):
    return clashing(spark.createDataFrame([], "doc_id long, text string"))
