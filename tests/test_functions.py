"""Column functions against hand-checked values (FIXTURES §3)."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import business_days, is_friday, round_half_even, strict_date, to_real


def test_lenient_cast(spark):
    vals = ["1,234.5", "abc", "", None, " 12.5x", "1e3", ".5", "nan", "-"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(to_real("s")).collect()]
    assert got == [1.0, 0.0, 0.0, None, 12.5, 1000.0, 0.5, 0.0, 0.0]


def test_strict_cast(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(to_real("s", "strict")).collect()] == [1.5, None, None]


def test_business_days(spark):
    days = ["2026-01-30", "2026-01-31", "2026-02-01", "2026-02-02"]
    df = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in days], "d date")
    got = [[x.isoformat() for x in r[0]] for r in df.select(business_days("d", 5)).collect()]
    week = ["2026-02-02", "2026-02-03", "2026-02-04", "2026-02-05", "2026-02-06"]
    assert got[0] == got[1] == got[2] == week
    assert got[3] == ["2026-02-03", "2026-02-04", "2026-02-05", "2026-02-06", "2026-02-09"]


def test_business_days_all_weekdays_and_horizons(spark):
    import pandas as pd
    start = dt.date(2026, 3, 2)
    rows = [(start + dt.timedelta(days=i), h) for i in range(7) for h in range(1, 13)]
    df = spark.createDataFrame(rows, "d date, h int")
    for d, h in rows[:: 5]:
        got = df.where((F.col("d") == d) & (F.col("h") == h)).select(business_days("d", h)).first()[0]
        want = pd.date_range(pd.Timestamp(d) + pd.offsets.BDay(1), periods=h, freq="B")
        assert [x.isoformat() for x in got] == [x.date().isoformat() for x in want]


def test_rounding_half_even(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (-0.125,), (2.5,)], "v double")
    two = [r[0] for r in df.select(round_half_even("v", 2)).collect()]
    assert two[:3] == [0.12, 0.38, -0.12]
    assert df.select(round_half_even("v", 0)).collect()[3][0] == 2.0


def test_strict_date_and_friday(spark):
    vals = ["2026-01-30", "2026-02-30", "2026/01/30", "2026-1-30", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = df.select(strict_date("s").alias("d")).select("d", is_friday("d")).collect()
    assert got[0][0] == dt.date(2026, 1, 30) and got[0][1] is True
    assert all(r[0] is None for r in got[1:])
