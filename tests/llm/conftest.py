import pytest


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Many small jobs: two partitions each are enough."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")
