import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use themselves
    T.StructField("_text", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("node", T.LongType()),
    T.StructField("shard", T.IntegerType()), T.StructField("sequence_id", T.LongType()), T.StructField("toxic_score", T.StringType()),
])
WORDS = "river stone light paper winter garden letter window silver morning market teacher bridge island music summer forest doctor engine velvet".split()


def prose(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ed"]) for _ in range(n)) + "."


def edge_rows():
    long = " ".join(prose(1000 + i, 200) for i in range(150))
    texts = [prose(1), prose(1), None, "", "   \n\t ", "one two", "One  TWO", long, "ñé漢字🙂 " * 20, "!!!???", prose(2), prose(3), "x" * 50_000, prose(2) + " end"]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 4 else None, None, "clash", 0.5, 1, 2, 3, "c") for i, t in enumerate(texts)]
    rows.append(rows[0])  # a repeated row
    rows.append((None, prose(4), None, None, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), DOCS).coalesce(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
