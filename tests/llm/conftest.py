import pytest


@pytest.fixture(scope="session")
def clash():
    """Adds columns whose names the operators use inside."""

    def add(df):
        from pyspark.sql import functions as F

        for name in ("a", "b", "node", "label", "root", "n", "id", "side", "head", "core", "key", "path", "found", "size", "shard", "gram", "first", "entity", "component"):
            if name not in df.columns:
                df = df.withColumn(name, F.lit("x"))
        return df

    return add
