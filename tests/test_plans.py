"""Plan shape of the flagship query and exactly-once streaming ingest."""

import uuid

from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_plan_shape(spark):
    import __spark_entry__ as E
    plan = _plan(E.entry(spark))
    assert "SinglePartition" not in plan
    # scan prunes to the three needed columns; one shuffle for the daily mean,
    # one for the per-series window, none for the final aggregate
    assert "ReadSchema: struct<l_suppkey:bigint,l_extendedprice:double,l_shipdate:timestamp_ntz>" in \
        E.entry(spark)._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert plan.count("Exchange hashpartitioning") == 2


def test_stream_ingest_exactly_once(spark):
    from tidemark.session import scratch_path
    from tidemark.streaming import ingest_stream
    schema = spark.read.parquet(f"{SF_SMALL}/orders.parquet").schema
    run = uuid.uuid4().hex
    out, ck = scratch_path(spark, f"s-out-{run}"), scratch_path(spark, f"s-ck-{run}")
    pattern = f"{SF_SMALL}/orders*.parquet"
    ingest_stream(spark, pattern, schema, out, ck)
    n1 = spark.read.parquet(out).count()
    ingest_stream(spark, pattern, schema, out, ck)
    assert spark.read.parquet(out).count() == n1 == spark.read.parquet(f"{SF_SMALL}/orders.parquet").count()


def test_stream_ingest_replays_a_batch_without_duplicates(spark):
    """The commit mark of the last batch is gone, as after a crash between
    writing and committing: the restarted query runs that batch again."""
    import glob
    import os

    from tidemark.session import scratch_path
    from tidemark.streaming import ingest_stream
    schema = spark.read.parquet(f"{SF_SMALL}/orders.parquet").schema
    run = uuid.uuid4().hex
    out, ck = scratch_path(spark, f"r-out-{run}"), scratch_path(spark, f"r-ck-{run}")
    pattern = f"{SF_SMALL}/orders*.parquet"
    ingest_stream(spark, pattern, schema, out, ck)
    marks = [f for f in glob.glob(f"{ck.removeprefix('file:')}/commits/*") if os.path.basename(f).isdigit()]
    assert marks
    for f in marks:
        os.remove(f)
        crc = os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")
        if os.path.exists(crc):
            os.remove(crc)
    ingest_stream(spark, pattern, schema, out, ck)
    assert spark.read.parquet(out).count() == spark.read.parquet(f"{SF_SMALL}/orders.parquet").count()


def test_fill_time_grows_linearly(spark):
    import time

    from pyspark.sql import functions as F

    from tidemark.operators.align import fill

    def seconds(n):
        df = spark.range(n).select(F.expr("date_add(date'1900-01-01', cast(id as int))").alias("ssd"),
                                   *[F.when(F.col("id") % 7 == k, F.col("id").cast("double")).alias(f"c{k}") for k in range(4)])
        t = time.time()
        assert fill(df, ["c0", "c1", "c2", "c3"]).where("c0 is null or c3 is null").count() == 0
        return time.time() - t

    seconds(1_000)
    assert seconds(40_000) < 15


def test_bucketed_tables_join_without_a_shuffle(spark):
    from tidemark.plans.registry import bucketed_scores
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = _plan(bucketed_scores(spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Exchange" not in plan and plan.count("Bucketed: true") == 2


def test_asof_plan_builds_no_windows(spark):
    from tidemark.plans.registry import QUERIES
    for name in ("asof_windows", "recent_history", "history_many"):
        assert "collect_list" not in _plan(QUERIES[name](spark, SF_SMALL))


def test_scored_report_days_stay_in_the_jvm(spark):
    from tidemark.plans.registry import QUERIES
    plan = _plan(QUERIES["attribution_long"](spark, SF_SMALL))
    assert "Python" not in plan and "Pandas" not in plan and "collect_list(array" not in plan


def test_lag_windows_many_returns_every_step(spark):
    from tidemark.plans import roles as R
    from tidemark.plans.registry import QUERIES
    rows, sums = QUERIES["lag_windows_many"](spark, SF_SMALL), QUERIES["lag_window_sums_many"](spark, SF_SMALL)
    assert {"step", "lag_date", *R.FEATURES} <= set(rows.columns)
    assert rows.count() == R.LAG * sums.count() > 0


def test_rows_of_a_series_are_dealt_once(spark):
    """Nothing that a row is widened or exploded to is sent or broadcast."""
    import re

    from tidemark.plans.registry import QUERIES
    for name in ("ridge_eval_many", "attribution_many", "driver_role_many"):
        plan = _plan(QUERIES[name](spark, SF_SMALL)).splitlines()
        dealt = [x for x in plan if "Exchange hashpartitioning(series_id" in x]
        assert dealt and all("REPARTITION_BY_NUM" in x for x in dealt)
        assert not [x for x in plan if re.search(r"BroadcastHashJoin \[series_id", x)]


def test_buckets_grow_with_the_rows(spark, monkeypatch):
    import re

    from tidemark import session
    from tidemark.plans.registry import bucketed_scores
    monkeypatch.setattr(session, "ROWS_PER_PART", 100)
    scores = bucketed_scores(spark, SF_SMALL)
    counts = {int(n) for n in re.findall(r"SelectedBucketsCount: \d+ out of (\d+)", _plan(scores))}
    assert len(counts) == 1 and min(counts) > 16 and scores.count() > 0


def test_window_rows_of_roles_are_made_once(spark):
    """Scores and predictions share the report's window rows (the other ones are the
    background's), and no score is exploded by driver before it is summed."""
    import re

    from tidemark.plans.registry import QUERIES
    plan = _plan(QUERIES["driver_role_many"](spark, SF_SMALL))
    assert plan.count("Generate posexplode(sequence") == 2
    assert not re.search(r"Generate explode\(array\(struct\(driver, \w+, score", plan)
    # series' parameters, means and models are hashed; only dates are sorted, narrow
    assert not re.search(r"SortMergeJoin \[(series_id#\d+L)(, (step|rn)#\d+L?)?\],", plan)


def test_scaler_rows_are_not_exploded(spark):
    """Each series is one group of the scaler fit, with a buffer per driver."""
    from tidemark.operators.scale import fit_robust
    frame = spark.createDataFrame([], "k long, ssd date, a double, b double")
    plan = _plan(fit_robust(frame, ["a", "b"], 2, frame.select("k", "ssd"), ["k"]))
    assert plan.index("Generate explode") < plan.index("ObjectHashAggregate")
