import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quillframe.session import local_table  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quillframe.session import build_session

    session = build_session(
        "tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": 4,
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def passengers(spark):
    """Twelve passengers, one age missing; half survived."""
    ages = [22.0, 38.0, None, 35.0, 28.0, 18.0, 32.0, 40.0, 26.0, 30.0, 50.0, 21.0]
    survived = [0, 1, 1, 1, 0, 0, 0, 1, 1, 0, 1, 0]
    rows = [
        (survived[i], i % 3 + 1, "male" if i % 2 == 0 else "female", ages[i], i % 2, i % 3, 7.25 + 5 * i)
        for i in range(12)
    ]
    return local_table(
        spark, rows, "survived int, pclass int, sex string, age double, sibsp int, parch int, fare double"
    )


@pytest.fixture(scope="session")
def shop(spark):
    """Two years of monthly sales for two groups; the margin falls from 25 % to 16 %."""
    rows = []
    for year, growth, margin in ((2024, 1.0, 0.25), (2025, 1.15, 0.16)):
        for month in range(1, 13):
            for k, (group, region, weight) in enumerate((("Core", "West", 1.0), ("Growth", "East", 0.7))):
                revenue = (1000 + 20 * month) * weight * growth
                rows.append((f"{year}-{month:02d}-15", f"{year}{month:02d}{k}", group, group, region, revenue,
                             revenue * margin, 0.1 if group == "Growth" else 0.0, 10))
    return local_table(
        spark,
        rows,
        "order_date string, order_id string, customer_id string, category string, region string, revenue double, "
        "profit double, discount double, quantity int",
    )
