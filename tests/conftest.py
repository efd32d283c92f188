import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for folder in (ROOT, os.path.dirname(os.path.abspath(__file__))):
    sys.path.insert(0, folder)

from tidemark.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from tidemark.catalog.queries import Tables

    return Tables(spark, SMALL)


@pytest.fixture(scope="session")
def hot_events(spark):
    """Events where one entity and one feature hold a third of all rows each, with nulls in code and value."""
    import datetime as dt
    import random

    rng = random.Random(7)
    rows = []
    for i in range(6000):
        entity = 1 if i % 3 == 0 else rng.randint(2, 120)
        feature = "F_hot" if i % 3 == 1 else rng.choice([None] + [f"F_{k:02d}" for k in range(40)])
        value = None if rng.random() < 0.1 else float(rng.randint(1, 50))
        rows.append((entity, dt.date(2000, 1, 1) + dt.timedelta(days=rng.randint(0, 1500)), feature, value))
    return spark.createDataFrame(rows, "entity_id long, date date, feature string, value double").repartition(6), rows
