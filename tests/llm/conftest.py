import random

import pytest

WORDS = "the of and to in is that it was for on are with as his they at be this from have or by one had not but what all were when we there can an your which their said".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "ing", "ed", "s", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source): nulls in each column, empty and very long texts, ties, repeated rows."""
    rng = random.Random(5)
    base = sentence(rng, 300)
    rows = [(i, sentence(rng, rng.randint(3, 120)), "en", f"s{i % 3}") for i in range(20)]
    rows += [(20, None, "en", "s0"), (21, "", None, "s1"), (22, " \n\t ", "en", None), (23, "!!! 123", "en", "s0"), (24, base, "en", "s0"), (25, base, "en", "s1"), (25, base, "en", "s1")]
    rows += [(26, base + " tail", "en", "s2"), (27, sentence(rng, 30_000), "en", "s0"), (28, "x" * 50_000, None, "s0"), (29, "é日本😀 ñandú ß\x00end", "fr", "s0"), (None, "no id here", "en", "s1")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """As a table, with a further column whose name clashes with results."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string")
    return df.repartition(3).withColumn("score", F.lit("clash")).withColumn("labels", F.lit(1)).withColumn("fp", F.lit(2))


@pytest.fixture
def folder(tmp_path):
    """Writes tables to a folder for queries that read one."""

    def put(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put
