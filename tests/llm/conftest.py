import random

import pytest

from caseloom.llm import queries

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

WORDS = "the of and rain letter house seven green over under river stone paper light never always common quiet table cloud".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and
    columns whose names the operators use themselves."""
    rng = random.Random(4)
    long = prose(rng, 30_000)
    base = prose(rng, 120)
    near = base.split(" ")
    near[60] = "changed"
    rows = [
        (1, base, "en", "a", None), (2, base, "en", "a", 5), (2, base, "en", "a", 5), (3, " ".join(near), None, "b", 1), (4, None, "en", "b", None),
        (5, "", "en", None, 0), (6, " \n\t ", "en", "c", 4), (7, long, "de", "c", 1), (None, prose(rng, 40), "en", "a", 2), (None, None, None, None, None),
        (8, "x", "en", "b", 1), (9, prose(rng, 20) + "\n" + base, "en", "b", 9), (7, prose(rng, 50), "en", "c", 1), (10, "é漢 ▁ \x00  🙂 AKIA" + "A" * 20, "en", "a", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    for name in ("target", "v", "score", "bucket", "host", "spans", "mix_size", "of", "group"):
        df = df.withColumn(name, F.lit("mine"))
    return df.repartition(3)


def rows_of(spark, name):
    return queries.QUERIES[name](spark, SF01).collect()
