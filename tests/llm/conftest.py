import pytest


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Small tables need few shuffle partitions."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    yield
    spark.conf.set(key, before)


@pytest.fixture()
def docs(spark):
    """Make (doc_id, text) tables from lists of texts or (id, text) pairs."""
    def make(rows, schema="doc_id long, text string"):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame(rows, schema)
    return make
