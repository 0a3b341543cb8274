import pytest

from pyspark.sql import types as T

#: columns whose names the operators use themselves
CLASH = ["node", "component_id", "a", "b", "region", "block", "position", "slot", "phase", "key", "range", "copy", "score", "part", "chunk"]


@pytest.fixture(scope="session")
def documents(spark):
    """Awkward documents: nulls in each column, empty, blank and very long texts, repeats, clashing names."""
    long = " ".join(f"w{i % 9173}x{i % 31}" for i in range(60_000))
    text = "One two three four five six seven eight nine ten eleven twelve.\nThirteen fourteen fifteen sixteen " * 3
    rows = [(1, text), (2, None), (3, ""), (4, " \t\n "), (5, long), (6, long + " end"), (7, text), (8, text + " more"),
            (None, text), (None, None), (9, "word"), (10, "word"), (11, "two words"), (12, text), (12, text), (13, "a b   é"),
            (14, "mail a.b1@mail.example.com or 10.0.0.1, card 4539 1488 0343 6467, +1 (212) 555-0100"), (-5, "minus five")]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                           T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASH]])
    full = [(d, t, None, None if k % 5 == 0 else f"s{k % 3}", None if t is None else len(t), *["x"] * len(CLASH)) for k, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, schema)


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.where("1 = 0")
