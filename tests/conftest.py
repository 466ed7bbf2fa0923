import pytest

from tabscope.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """Build a DataFrame from a schema string and rows given as tuples."""
    return lambda schema, rows: spark.createDataFrame(rows, schema)


def as_dicts(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def by(df, key):
    return {r[key]: r.asDict(recursive=True) for r in df.collect()}
