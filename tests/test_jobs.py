"""The experiment run and a report request end to end (smallest tables)."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidemark.operators.attribution import attribution_summary, driver_role
from tidemark.operators.context import INSIGHT_FIELDS, driver_context, parse_insights, render_driver_context, report_context
from tidemark.operators.path import current_spot
from tidemark.operators.requests import request_outcomes, validate_requests
from tidemark.plans import jobs
from tidemark.plans import roles as R
from tidemark.session import scratch_path
from tidemark.sources.dictionary import driver_dictionary
from tidemark.sources.scan import read_table


def test_experiment_and_report(spark):
    out = scratch_path(spark, f"job-{uuid.uuid4().hex}")
    spot = R.spot_one(spark, SF_SMALL)
    jobs.labels_job(spot, out, R.HORIZON)
    jobs.features_job([spot], [R.index_wide(spark, SF_SMALL), R.inventory(spark, SF_SMALL),
                               R.freight(spark, SF_SMALL)], out)
    jobs.training_job(spark, spot, out, R.LAG, R.HORIZON, R.TRAIN_CUTOFF)
    jobs.fit_job(spark, out, R.LAG)
    paths = jobs.backtest_job(spark, out, R.LAG, R.EVAL_BOUNDARY)
    summary = read_table(spark, paths["eval_summary"])
    assert summary.count() == 2 * R.HORIZON
    fridays = spot.where(F.weekday("ssd") == 4).select(F.date_format("ssd", "yyyy-MM-dd").alias("friday_date"))
    asked = fridays.union(fridays.limit(1)).union(spark.createDataFrame([("1999-13-01",), ("1995-01-06",)], "friday_date string"))
    rep = jobs.report_job(spark, asked, spot, out, R.LAG, R.HORIZON, start="1995-01-01", end="2001-12-31")
    ctx = read_table(spark, rep["report_context"])
    assert ctx.count() > 0 and ctx.where("is_valid").count() > 0
    assert read_table(spark, rep["driver_prompts"]).where(F.col("prompt").contains("[path]")).count() > 0
    assert ctx.count() == ctx.select("ssd").distinct().count()
    outcomes = read_table(spark, rep["outcomes"])
    assert outcomes.count() == asked.count()
    assert {r.status for r in outcomes.collect()} >= {"done", "rejected"}
    assert outcomes.where("status = 'failed' and outcome_reason is null").count() == 0


def test_driver_record_has_every_lag_step(spark):
    day, lags, ahead = dt.date(2001, 3, 2), 3, 2
    a, b = R.FEATURES[:2]
    scores = [(day, h, d, k, day - dt.timedelta(2 - k), (h + k / 8 + 0.00006) * (1 if d == a else -1))
              for h in (1, 2) for d in (a, b) for k in range(lags)]
    scores = spark.createDataFrame(scores[::-1], "ssd date, days_ahead int, driver string, lag_step int, lag_date date, score double")
    path = spark.createDataFrame([(day, h, day + dt.timedelta(2 + h), 100.0 + h, 100.0) for h in (1, 2)],
                                 "ssd date, days_ahead int, future_date date, forecast_price double, current_spot double")
    history = spark.createDataFrame([(day, d, 0, day, 1.0) for d in (a, b)], "ssd date, driver string, step int, hist_date date, value double")
    summary = attribution_summary(scores)
    ctx = driver_context(driver_dictionary(spark), history, path, summary, driver_role(summary, path), scores=scores)
    said = {r.driver: r.step_scores for r in ctx.collect()}
    assert set(said) == {a, b}
    assert said[a].split("\n") == [
        f"[{ahead}]{{horizon,scores}}:",
        "  SHAPScoreFor 2001-03-05,2001-02-28:1.0001 2001-03-01:1.1251 2001-03-02:1.2501",
        "  SHAPScoreFor 2001-03-06,2001-02-28:2.0001 2001-03-01:2.1251 2001-03-02:2.2501"]
    assert "2001-03-01:-1.1251" in said[b]
    for r in render_driver_context(ctx).collect():
        assert said[r.driver] in r.prompt


def test_report_for_many_series(spark):
    out = scratch_path(spark, f"jobs-{uuid.uuid4().hex}")
    keys = ["series_id"]
    spot = R.spot_many(spark, SF_SMALL)
    jobs.labels_job(spot, out, R.HORIZON, keys)
    jobs.features_job([spot], [R.index_wide(spark, SF_SMALL), R.inventory(spark, SF_SMALL), R.freight(spark, SF_SMALL)], out, keys)
    jobs.training_job(spark, spot, out, R.LAG, R.HORIZON, R.TRAIN_CUTOFF, keys)
    jobs.fit_job(spark, out, R.LAG, keys)
    fridays = (spot.where(F.weekday("ssd") == 4).groupBy("ssd").count().orderBy(F.desc("count"), "ssd").limit(3)
               .select(F.date_format("ssd", "yyyy-MM-dd").alias("friday_date")))
    told = spot.where(F.weekday("ssd") == 4).select(*keys, "ssd", F.lit("price").alias("driver"), F.to_json(F.struct(
        *[F.lit("x").alias(c) for c in INSIGHT_FIELDS])).alias("response"))
    rep = jobs.report_job(spark, fridays, spot, out, R.LAG, R.HORIZON, keys, start="1995-01-01", end="2001-12-31", responses=told)
    ctx = read_table(spark, rep["report_context"])
    assert ctx.where("is_valid").count() > 0
    assert ctx.where("is_valid and n_insights <> 1").count() == 0
    assert ctx.count() == ctx.select("series_id", "ssd").distinct().count()
    done = {str(r.ssd): r["count"] for r in ctx.groupBy("ssd").count().collect()}
    assert {str(r.report_date): r.n_reports for r in read_table(spark, rep["outcomes"]).collect()} == done


def test_report_reasons_and_outcomes(spark):
    days = [f"2024-01-{d:02d}" for d in (5, 12, 19, 26)]  # complete, no spot, short path, no driver
    asked = spark.createDataFrame([(d,) for d in [*days, days[0], "2024-01-06", "2024-02-02"]], "friday_date string")
    checked = validate_requests(asked)
    ssd = checked.where("is_valid and report_date < '2024-02-01'").select(F.col("report_date").alias("ssd"))
    spot = spark.createDataFrame([(d, 10.0) for d in days if d != days[1]], "ssd string, price double").withColumn("ssd", F.to_date("ssd"))
    path = spark.createDataFrame([(d, h, 11, 10.0) for d, n in zip(days, (2, 2, 1, 2)) for h in range(1, n + 1)],
                                 "ssd string, days_ahead int, forecast_price long, current_spot double").withColumn("ssd", F.to_date("ssd"))
    path = path.withColumn("future_date", F.date_add("ssd", "days_ahead"))
    ctx = spark.createDataFrame([(d, x) for d in days[:3] for x in ("b", "a")], "ssd string, driver string").withColumn("ssd", F.to_date("ssd"))
    for c in ("business_name", "attribution_direction", "forecast_direction", "role", "strength"):
        ctx = ctx.withColumn(c, F.lit("x"))
    whole = '{"feature_name":"a","feature_behavior":"u","shap_interpretation":"v","forecast_alignment":"w","influence_strength":"y","analyst_explanation":"z"}'
    told = parse_insights(ctx.where(F.col("ssd") == days[0]).select(
        "ssd", "driver", F.when(F.col("driver") == "a", whole).otherwise("{").alias("response")))
    rep = report_context(ssd, current_spot(spot, ssd.distinct(), []), path, ctx, told, horizon=2)
    rows = {str(r.ssd): r for r in rep.collect()}
    assert [rows[d].reason for d in days] == [None, "missing current price", "missing forecast path", "missing driver context"]
    first = rows[days[0]]
    assert (first.n_steps, first.n_drivers, first.n_insights) == (2, 2, 1) and rows[days[3]].drivers is None
    assert [(x.driver, x.insight and x.insight.analyst_explanation) for x in first.drivers] == [("a", "z"), ("b", None)]
    got = sorted((r.request, r.status, r.outcome_reason) for r in request_outcomes(checked, rep).collect())
    assert got == [(days[0], "done", None), (days[0], "done", None), ("2024-01-06", "rejected", None), (days[1], "failed", "missing current price"),
                   (days[2], "failed", "missing forecast path"), (days[3], "failed", "missing driver context"),
                   ("2024-02-02", "failed", "no spot for the date")]
