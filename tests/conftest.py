import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from recspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=8, shuffle_partitions=4, memory="8g", app_name="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def skewed(spark):
    """Random ratings: 40 users, 30 items; three users rated most of the catalogue."""
    import random

    rng = random.Random(7)
    rows = []
    for u in range(40):
        n = 24 if u < 3 else rng.randint(1, 6)
        for i in rng.sample(range(30), n):
            rows.append((u, i, float(rng.randint(1, 5)), f"{u:03d}-{i:03d}-{rng.random():.6f}"))
    rows += [(5, rows[-1][1], 4.0, "dup-1"), (5, rows[-1][1], 2.0, "dup-2")]
    df = spark.createDataFrame(rows, "user_id long, item_id long, rating double, row_key string")
    return df.persist()
