import pytest
from samples import SCHEMA, sample


@pytest.fixture(scope="session")
def odd_rows():
    return sample()


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(5, "n_chars")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
