import pytest


@pytest.fixture()
def rows(spark):
    """Make a DataFrame from tuples and a schema, over several partitions."""

    def make(data, schema, parts=3):
        return spark.createDataFrame(data, schema).repartition(parts)

    return make
