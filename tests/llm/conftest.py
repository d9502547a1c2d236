import random

import pytest

#: Columns that operators use inside, to clash with.
CLASHES = "size score fp keys rep key n rank shard cell p u line a b d t h at item m start row row_ copies component_id x id word count doc source_size target node root gone bucket points parity"


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    sentence = lambda n: " ".join(word() for _ in range(n)) + "."
    base = "\n".join(sentence(40) for _ in range(4))
    near = base.replace(base.split()[70], "changed", 1)
    texts = [base, base, near, None, "", " \t\n", "one", "Zwei Wörter", sentence(30), sentence(30) * 3, "é😀ß " * 40, "x" * 200_000, " ".join(word() for _ in range(60_000)), base.upper(), "a\r\nb\n\nc", "\n".join(["the same line of several words, again and again."] * 9)]
    rows = [(i, t, rng.choice(["en", None, "de"]), rng.choice(["s1", "s2", None, "ß"]), len(t) if t else None) for i, t in enumerate(texts)]
    rows += [(None, base, None, None, None), (None, None, None, "s1", None), rows[0], rows[3], (100, base, "en", "s2", None)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(edge_rows, SCHEMA)
    return docs.select("*", *[F.lit(7).alias(c) for c in CLASHES.split()]).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
