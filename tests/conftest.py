import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from cohortgrid.session import local_session

    session = local_session(memory="8g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """Build a frame from tuples; columns typed ``ts`` take text timestamps."""

    def build(schema: str, *data):
        from pyspark.sql import functions as F

        names = [part.split()[0] for part in schema.split(",")]
        kinds = dict(zip(names, [part.split()[1] for part in schema.split(",")]))
        text = ", ".join(f"{n} {'string' if k == 'ts' else k}" for n, k in kinds.items())
        df = spark.createDataFrame(list(data), text)
        return df.select(*[F.col(n).cast("timestamp_ntz" if k == "ts" else k).alias(n) for n, k in kinds.items()])

    return build


@pytest.fixture(scope="session")
def bound(spark):
    from cohortgrid.sources.bindings import Bound

    return Bound(spark, "/root/testdata/sf0.001")
