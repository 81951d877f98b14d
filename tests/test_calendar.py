"""Calendar periods against pandas, over moments of four centuries."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest

from quillframe.functions.calendar import Period
from quillframe.operators.groups import trend_analysis
from quillframe.session import local_table

CODES = [
    "Y", "A", "Y-JAN", "A-JUN", "Y-NOV", "Q", "Q-JAN", "Q-MAR", "2Q-OCT", "M", "2M", "W", "2W", "W-SUN", "W-MON", "W-WED", "W-SAT", "B", "D", "3D",
    "h", "6h", "min", "15min", "s", "ms", "us", "1D12h", "1.5h", "24h",
]


@pytest.fixture(scope="module")
def moments():
    rng = random.Random(3)
    start, micros = dt.datetime(1801, 1, 1), 400 * 365 * 86_400 * 10**6
    out = [start + dt.timedelta(microseconds=rng.randrange(micros)) for _ in range(300)]
    out += [dt.datetime(1970, 1, 1), dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(2024, 2, 29, 12), dt.datetime(2000, 12, 31, 23, 59, 59)]
    out += [dt.datetime(2023, 12, 25) + dt.timedelta(days=k, hours=5) for k in range(20)]
    return out


@pytest.fixture(scope="module")
def table(spark, moments):
    return local_table(spark, [(m,) for m in moments] + [(None,)], "t timestamp_ntz")


@pytest.mark.filterwarnings("ignore::FutureWarning")
@pytest.mark.parametrize("code", CODES)
def test_periods_are_those_of_pandas(table, moments, code):
    want = pd.Series(moments).astype("datetime64[us]").dt.to_period(code).astype(str).value_counts()
    got = {r["period"]: r["value"] for r in trend_analysis(table, "t", frequency=code).collect()}
    assert got == {k: float(v) for k, v in want.items()}


def test_nanoseconds_have_nine_digits(spark):
    table = local_table(spark, [(dt.datetime(2024, 1, 2, 3, 4, 5, 6),), (dt.datetime(1900, 1, 2, 3, 4, 5, 6),)], "t timestamp_ntz")
    got = sorted(r["period"] for r in trend_analysis(table, "t", frequency="ns").collect())
    assert got == ["1900-01-02 03:04:05.000006000", "2024-01-02 03:04:05.000006000"]


@pytest.mark.parametrize("code, length", [("15min", 900), ("6h", 21_600), ("90s", 90), ("3D", 3 * 86_400), ("1D12h", 129_600), ("2W", 14 * 86_400)])
def test_spans_of_the_clock(table, moments, code, length):
    """Whole multiples from 1970-01-01; weeks from the Monday before it."""
    origin = dt.datetime(1969, 12, 29) if "W" in code else dt.datetime(1970, 1, 1)
    want: dict = {}
    for m in moments:
        first = origin + ((m - origin) // dt.timedelta(seconds=length)) * dt.timedelta(seconds=length)
        want[first] = want.get(first, 0) + 1
    got = {r["period"]: r["value"] for r in trend_analysis(table, "t", frequency=code, spans=True).collect()}
    assert {dt.datetime.fromisoformat(k.split("/")[0]): v for k, v in got.items()} == want


def test_spans_of_months_and_fiscal_years(spark):
    days = [dt.datetime(2024, m, 15) for m in range(1, 13)]
    table = local_table(spark, [(d,) for d in days], "t timestamp_ntz")
    found = lambda code: {r["period"]: r["value"] for r in trend_analysis(table, "t", frequency=code, spans=True).collect()}
    assert found("3M") == {"2024-01": 3, "2024-04": 3, "2024-07": 3, "2024-10": 3}
    assert found("2Y-JUN") == {"2024": 12}
    assert found("2Q-MAR") == {"2024Q3": 3, "2025Q1": 6, "2025Q3": 3}


@pytest.mark.parametrize("code", ["", "X", "MS", "0D", "-1M", "Q-ABC", "W-", "1.5M", "1M1D", "M-JAN", "W-JAN", "15 parsecs"])
def test_other_codes_are_errors(code):
    with pytest.raises(ValueError):
        Period.of(code)
