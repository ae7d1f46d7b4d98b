import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents of the smallest table, and rows that are null, empty, equal, blank or very long."""
    real = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(1)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "it's", "x9"]) + str(rng.randint(0, 400)) for _ in range(12_000))
    first = real.orderBy("doc_id").first()
    odd = [
        (900001, None, "en", "src0", None),
        (900002, "", "en", "src0", 0),
        (900003, " \n\t ", None, None, 4),
        (900004, long, "en", "src0", len(long)),
        (900005, long, "en", "src0", len(long)),
        (900006, first.text, "de", "src1", len(first.text)),
        (900007, first.text + " und noch ein Satz am Ende.", "de", "src1", None),
        (900008, "one two three", "en", "src2", 13),
        (900009, "ONE two three", "en", "src2", 13),
        (900010, "12 34 !!", None, "src2", 8),
        (900010, "12 34 !!", None, "src2", 8),
    ]
    return real.unionByName(spark.createDataFrame(odd, real.schema)).repartition(4).cache()


@pytest.fixture(scope="session")
def rows(docs):
    return sorted(docs.collect(), key=lambda r: (r.doc_id, r.text or ""))


@pytest.fixture(scope="session")
def empty(docs, spark):
    return spark.createDataFrame([], docs.schema)
