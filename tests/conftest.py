import pytest

from formline.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("formline-tests")


@pytest.fixture
def split(spark):
    """Force every entity above a few rows onto the split path."""
    spark.conf.set("spark.formline.smallInputBytes", "0")
    spark.conf.set("spark.formline.splitRows", "12")
    yield spark
    spark.conf.unset("spark.formline.smallInputBytes")
    spark.conf.unset("spark.formline.splitRows")
