"""Operators on micro tables and properties."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.align import align_sources, fill, outer_merge, pivot_drivers
from tidemark.operators.attribution import attribute_linear, attribution_summary, sample_background, score_rows
from tidemark.operators.context import parse_insights, render_report, report_context
from tidemark.operators.evaluate import eval_rows, metric_pivot
from tidemark.operators.forecast.linear import fit_linear, score_linear, score_sliding
from tidemark.operators.labels import future_returns
from tidemark.operators.order import halo_leads, row_numbers
from tidemark.operators.profile import StageCounts
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.requests import validate_requests
from tidemark.operators.scale import fit_robust
from tidemark.operators.windows import asof_last_n, asof_rows, fit_split, gather_rows, lag_windows, label_vectors, training_set
from tidemark.sources import snapshot
from tidemark.sources.scan import scan_prices

D = [dt.date(2024, 1, i) for i in range(1, 32)]


def test_pivot_drops_all_null_dates(spark):
    rows = [(D[0], "x", 1.0), (D[0], "y", None), (D[1], "x", None), (D[2], "x", 3.0), (D[2], "x", 5.0)]
    df = spark.createDataFrame(rows, "ssd date, driver string, value double")
    got = {r.ssd: r.x for r in pivot_drivers(df, ["x"]).collect()}
    assert got == {D[0]: 1.0, D[2]: 4.0}


def test_outer_merge_fans_out_duplicates(spark):
    a = spark.createDataFrame([(D[0], 2.0), (D[2], 1.0)], "ssd date, a double")
    b = spark.createDataFrame([(D[0], 6.0), (D[0], 7.0), (D[1], 5.0)], "ssd date, b double")
    got = sorted(tuple(r) for r in outer_merge([a, b]).collect())
    assert got == [(D[0], 2.0, 6.0), (D[0], 2.0, 7.0), (D[1], None, 5.0), (D[2], 1.0, None)]


def test_labels_hand_example(spark):
    spot = spark.createDataFrame([(D[0], 10.0), (D[1], 11.0), (D[2], 9.9)], "ssd date, price double")
    got = sorted((r.ssd, r.days_ahead, r.predicted_for, None if r.y is None else round(r.y, 10))
                 for r in future_returns(spot, 2).collect())
    assert got == [(D[0], 1, D[1], 0.1), (D[0], 2, D[2], -0.01), (D[1], 1, D[2], -0.1),
                   (D[1], 2, None, None), (D[2], 1, None, None), (D[2], 2, None, None)]


def test_label_null_count_property(spark):
    n, h = 23, 5
    spot = spark.createDataFrame([(D[i], 100.0 + i) for i in range(n)], "ssd date, price double")
    lab = future_returns(spot, h)
    assert lab.count() == n * h
    assert lab.where(F.col("y").isNull()).count() == sum(min(k, n) for k in range(1, h + 1))


def test_evaluation_hand_example(spark):
    labels = spark.createDataFrame([(D[0], 100.0, D[1], 1, 0.02), (D[1], 100.0, D[2], 1, 0.0)],
                                   "ssd date, current_spot_price double, predicted_for date, days_ahead int, y double")
    preds = spark.createDataFrame([(D[0], 1, -0.01), (D[1], 1, 0.0)], "ssd date, days_ahead int, prediction double")
    rows = {r.ssd: r for r in eval_rows(labels, preds, "2024-01-02").collect()}
    assert rows[D[0]].actual_price == pytest.approx(102) and rows[D[0]].predicted_price == pytest.approx(99)
    assert rows[D[0]].ape == pytest.approx(3 / 102) and rows[D[0]].da == 0
    assert rows[D[1]].da == 1 and rows[D[1]].period == "validation"


def test_metric_pivot_missing_period(spark):
    rows = spark.createDataFrame([(1, "train", 1.0), (1, "validation", 2.0), (2, "train", 3.0)],
                                 "days_ahead int, period string, ape double")
    got = {r.days_ahead: r for r in metric_pivot(rows, "ape").collect()}
    assert (got[1].train_mean, got[1].validation_mean, got[1].train_count) == (1.0, 2.0, 1)
    assert got[2].validation_mean is None and not got[2].validation_count


def _random_frame(rng, n, cols):
    data = rng.normal(size=(n, len(cols)))
    data[rng.random(size=data.shape) < 0.4] = np.nan
    return pd.DataFrame(data, columns=cols)


def test_fill_equals_pandas(spark):
    rng = np.random.default_rng(7)
    cols = ["a", "b", "c"]
    for _ in range(20):
        pdf = _random_frame(rng, 15, cols)
        pdf.insert(0, "ssd", D[:15])
        sdf = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "ssd date, a double, b double, c double")
        got = fill(sdf, cols).orderBy("ssd").toPandas()[cols]
        want = pdf[cols].ffill().bfill()
        assert np.allclose(got.to_numpy(dtype=float), want.to_numpy(dtype=float), equal_nan=True)


def test_window_count_and_null_slots(spark):
    n, lag = 20, 4
    frame = spark.createDataFrame([(D[i], float(i)) for i in range(n)], "ssd date, a double")
    w = lag_windows(frame, ["a"], lag)
    assert w.count() == n - lag + 1
    assert w.where(F.col("ssd") == D[lag - 1]).first().x == [[0.0], [1.0], [2.0], [3.0]]
    labels = future_returns(frame.withColumnRenamed("a", "price").where(F.col("price") > 0), 3)
    vec = {r.ssd: r.y for r in label_vectors(labels).collect()}
    assert len(vec[D[n - 1]]) == 3 and all(v is None for v in vec[D[n - 1]])


def test_asof_matches_brute_force(spark):
    frame_days = [D[i] for i in (0, 1, 3, 4, 7, 8, 9, 12)]
    frame = spark.createDataFrame([(d, float(i)) for i, d in enumerate(frame_days)], "ssd date, a double")
    probes = [D[i] for i in (0, 2, 5, 10, 20)]
    got = {r.ssd: [v[0] for v in r.x] for r in
           asof_last_n(frame, spark.createDataFrame([(p,) for p in probes], "ssd date"), ["a"], 3).collect()}
    for p in probes:
        hist = [float(i) for i, d in enumerate(frame_days) if d <= p][-3:]
        assert got[p] == hist


def test_weighted_percentile_equals_stacked_windows(spark):
    rng = np.random.default_rng(3)
    n, lag = 30, 4
    vals = rng.normal(size=n)
    frame = spark.createDataFrame([(D[i], float(vals[i])) for i in range(n)], "ssd date, a double")
    ends_idx = [i for i in range(lag - 1, n) if i % 3 != 0]
    ends = spark.createDataFrame([(D[i],) for i in ends_idx], "ssd date")
    p = fit_robust(frame, ["a"], lag, ends).first()
    stacked = np.concatenate([vals[i - lag + 1:i + 1] for i in ends_idx])
    q25, q50, q75 = np.percentile(stacked, [25, 50, 75])
    assert p.center == pytest.approx(q50) and p.scale == pytest.approx(q75 - q25)


def test_partition_count_invariance(spark):
    from tidemark.plans.registry import QUERIES
    from tests.conftest import SF_SMALL
    a = sorted(map(tuple, QUERIES["baseline_eval_many"](spark, SF_SMALL).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        b = sorted(map(tuple, QUERIES["baseline_eval_many"](spark, SF_SMALL).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a == b


def _toy_samples(spark, n=60, lag=3, nf=2, seed=1):
    rng = np.random.default_rng(seed)
    w_true = rng.normal(size=lag * nf)
    rows = []
    for i in range(n):
        x = rng.normal(size=(lag, nf))
        y = [float(x.ravel() @ w_true + 0.5), float(2 * (x.ravel() @ w_true))]
        rows.append(("s1", D[0] + dt.timedelta(days=i), x.tolist(), y, True))
    schema = "series_id string, ssd date, x array<array<double>>, y array<double>, is_train boolean"
    return spark.createDataFrame(rows, schema), w_true


def test_linear_fit_recovers_weights(spark):
    samples, w_true = _toy_samples(spark)
    models = {r.days_ahead: r for r in fit_linear(samples, keys=["series_id"], reg=0.0).collect()}
    assert np.allclose(models[1].weights, w_true, atol=1e-8) and models[1].intercept == pytest.approx(0.5)
    assert np.allclose(models[2].weights, 2 * w_true, atol=1e-8)
    preds = score_linear(samples, fit_linear(samples, keys=["series_id"], reg=0.0), ["series_id"])
    assert preds.count() == 120


def test_attribution_additivity(spark):
    samples, _ = _toy_samples(spark)
    samples = samples.withColumn("lag_dates", F.array_repeat(F.col("ssd"), 3))
    models = fit_linear(samples, keys=["series_id"], reg=0.1)
    bg = sample_background(samples, 10, 42, ["series_id"])
    scores = attribute_linear(samples, models, bg, ["a", "b"], ["series_id"])
    tot = attribution_summary(scores, ["series_id"]).groupBy("ssd", "days_ahead").agg(F.sum("total").alias("t"))
    preds = score_linear(samples, models, ["series_id"])
    bg_mean = score_linear(bg, models, ["series_id"]).groupBy("days_ahead").agg(F.avg("prediction").alias("fb"))
    chk = tot.join(preds, ["ssd", "days_ahead"]).join(bg_mean, "days_ahead") \
        .select((F.col("t") - (F.col("prediction") - F.col("fb"))).alias("gap")).collect()
    assert max(abs(r.gap) for r in chk) < 1e-9


def test_request_rules(spark):
    vals = ["2026-01-30", "2026-01-31", "2026-02-30", "2026/01/30", "2015-01-09", "2026-02-06", None]
    df = spark.createDataFrame([(v,) for v in vals], "friday_date string")
    got = {r.request: (r.is_valid, r.reason) for r in validate_requests(df).collect()}
    assert got["2026-01-30"] == (True, None)
    assert got["2026-01-31"][1] == "Provided date is not a Friday"
    assert got["2026-02-30"][1] == got["2026/01/30"][1] == got[None][1] == "Date must be in YYYY-MM-DD format"
    assert got["2015-01-09"][1].startswith("Date must be between")
    assert got["2026-02-06"][1].startswith("Date must be between")


def test_training_set_embargo(spark):
    frame = spark.createDataFrame([(D[i], float(i + 1)) for i in range(12)], "ssd date, price double")
    labels = future_returns(frame, 2)
    w = lag_windows(frame, ["price"], 3)
    plain = training_set(w, labels, "2024-01-08").where("is_train").count()
    emb = training_set(w, labels, "2024-01-08", embargo=True).where("is_train").count()
    assert plain == 5 and emb == 3


def test_two_pass_fill_equals_window_fill(spark):
    from tidemark.operators.order import two_pass_fill
    rng = np.random.default_rng(11)
    rows = []
    for s in ("a", "b"):
        for i in range(40):
            v = [None if rng.random() < 0.5 else float(rng.normal()) for _ in range(2)]
            rows.append((s, D[0] + dt.timedelta(days=int(i * 2 + (s == "b"))), *v))
    df = spark.createDataFrame(rows, "k string, ssd date, u double, v double")
    for how in ("ffill", "ffill_bfill"):
        a = sorted(map(tuple, fill(df, ["u", "v"], ["k"], how).collect()))
        b = sorted(map(tuple, two_pass_fill(df, ["u", "v"], ["k"], how, block_days=5).collect()))
        assert a == b


def test_halo_windows_equal_global_windows(spark):
    from tidemark.operators.order import halo_lag_windows
    rows = [(s, D[0] + dt.timedelta(days=i * 3), float(i), float(-i)) for s in ("a", "b") for i in range(37)]
    df = spark.createDataFrame(rows, "k string, ssd date, u double, v double")
    a = sorted((r.k, r.ssd, str(r.x), str(r.lag_dates)) for r in
               lag_windows(df, ["u", "v"], 4, ["k"], with_dates=True).collect())
    b = sorted((r.k, r.ssd, str(r.x), str(r.lag_dates)) for r in
               halo_lag_windows(df, ["u", "v"], 4, ["k"], block_rows=5, with_dates=True).collect())
    assert a == b and len(a) == 2 * (37 - 3)


def _many_dates(spark):
    """Two series with gaps, repeated NULLs and dates outside the date-only source."""
    rows = [("a", D[2], 1.0), ("a", D[5], None), ("a", D[9], 3.0), ("b", D[0], None), ("b", D[4], 7.0), ("b", D[30], 8.0), ("c", D[12], None)]
    spot = spark.createDataFrame(rows, "k string, ssd date, price double")
    glob = spark.createDataFrame([(D[3], 1.0), (D[4], None), (D[8], 2.5), (D[20], None)], "ssd date, g double")
    return spot, glob


def test_union_calendar_equals_the_single_series(spark):
    spot, glob = _many_dates(spark)
    many = fill(align_sources([spot], [glob], keys=["k"], calendar="union"), ["price", "g"], ["k"])
    got = {}
    for r in many.collect():
        got.setdefault(r.k, {})[r.ssd] = (r.price, r.g)
    assert many.count() == sum(map(len, got.values()))
    for k in "abc":
        one = fill(align_sources([spot.where(F.col("k") == k).drop("k")], [glob]), ["price", "g"])
        assert got[k] == {r.ssd: (r.price, r.g) for r in one.collect()}


def test_asof_in_blocks_equals_per_series(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(3 * i) for i in range(500)]
    frame = spark.createDataFrame([(d, float(i)) for i, d in enumerate(days)], "ssd date, a double")
    probes = spark.createDataFrame([(dt.date(2019, 12, 31),), *[(dt.date(2020, 1, 1) + dt.timedelta(7 * i),) for i in range(250)]], "ssd date")
    one = asof_rows(frame, probes, ["a"], 4)
    many = asof_rows(frame.withColumn("k", F.lit(1)), probes.withColumn("k", F.lit(1)), ["a"], 4, ["k"]).drop("k")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    by_day = {}
    for r in one.collect():
        by_day.setdefault(r.ssd, []).append((r.step, r.a))
    for p, got in by_day.items():
        last = max(i for i, d in enumerate(days) if d <= p)
        assert sorted(got) == list(enumerate(float(i) for i in range(max(0, last - 3), last + 1)))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_block_labels_and_split_equal_windows(spark):
    rng = np.random.default_rng(0)
    days = [dt.date(2010, 1, 1) + dt.timedelta(int(x)) for x in np.cumsum(rng.integers(1, 40, 300))]
    spot = spark.createDataFrame([(k, d, float(i)) for k in "ab" for i, d in enumerate(days[:300 if k == "a" else 7])], "k string, ssd date, price double")
    for keys, df in ((["k"], spot), ([], spot.where("k = 'a'"))):
        rows = [sorted(map(tuple, future_returns(df, 5, keys, path=p).collect()), key=str) for p in ("window", "halo")]
        assert rows[0] == rows[1]
        split = [sorted(map(tuple, fit_split(df, .3, keys, path=p).select(*keys, "ssd", "is_val").collect())) for p in ("window", "blocks")]
        assert split[0] == split[1]
    blocks = halo_leads(spot.where("k = 'a'"), ["price"], 5, block_rows=8).collect()
    for r in blocks:
        i = int(r.price)
        assert [x.price for x in r._ahead] == [float(j) if j < 300 else None for j in range(i + 1, i + 6)]


def test_sliding_scores_equal_window_scores(spark):
    rng = np.random.default_rng(3)
    frame = spark.createDataFrame([(k, D[i], *rng.standard_normal(2).tolist()) for k, n in (("a", 31), ("b", 3), ("c", 2)) for i in range(n)],
                                  "k string, ssd date, p double, q double")
    models = spark.createDataFrame([(k, h, rng.standard_normal(6).tolist(), float(h)) for k in "ab" for h in (1, 2)],
                                   "k string, days_ahead int, weights array<double>, intercept double")
    want = score_linear(lag_windows(frame, ["p", "q"], 3, ["k"]), models, ["k"])
    ends = row_numbers(frame, ["k"])
    rows = gather_rows(ends, ends.where("rn >= 3").select("k", "ssd", "rn"), ["p", "q"], 3, ["k"])
    for got in (score_sliding(frame, models, ["p", "q"], 3, ["k"]), score_rows(rows, models, ["p", "q"], ["k"])):
        a, b = ({(r.k, r.ssd, r.days_ahead): r.prediction for r in x.collect()} for x in (want, got))
        assert a.keys() == b.keys() and all(a[x] == pytest.approx(b[x]) for x in a) and len(a) == 60


def test_fit_from_many_partial_sums(spark):
    """1,000 tasks, labels missing in turns: the merged sums give the plain solution."""
    rng = np.random.default_rng(8)
    x, y = rng.standard_normal((3000, 3)), rng.standard_normal((3000, 2))
    known = rng.random((3000, 2)) > .2
    rows = [(x[i].reshape(3, 1).tolist(), [float(v) if k else None for v, k in zip(y[i], known[i])], True) for i in range(3000)]
    samples = spark.createDataFrame(rows, "x array<array<double>>, y array<double>, is_train boolean").repartition(1000)
    got = {r.days_ahead: r for r in fit_linear(samples, reg=.01).collect()}
    for h in (0, 1):
        k = known[:, h]
        a = np.hstack([x[k], np.ones((k.sum(), 1))])
        w = np.linalg.solve(a.T @ a + np.diag([.01 * k.sum()] * 3 + [0]), a.T @ y[k, h])
        assert got[h + 1].n == k.sum() and np.allclose([*got[h + 1].weights, got[h + 1].intercept], w)
    assert fit_linear(samples)._jdf.queryExecution().executedPlan().toString().count("Generate") == 0


def test_insight_in_other_text(spark):
    full = '{"feature_name":"a}{\\"b","feature_behavior":"x","shap_interpretation":"x","forecast_alignment":"x","influence_strength":"x","analyst_explanation":"y"}'
    texts = {"plain": full, "fence": f"```json\n{full}\n```", "told": f"Sure: {full} and {{more}}", "quote": f'He said "hi" {full}',
             "open": full[:-1], "none": "no object", "empty": "", "null": None, "wrong": "a {b} c", "some": 'x {"feature_name":"z"} y'}
    df = spark.createDataFrame(list(texts.items()), "k string, response string")
    got = {r.k: (r.parse_status, r.feature_name) for r in parse_insights(df).collect()}
    name = 'a}{"b'
    assert got == {"plain": ("ok", name), "fence": ("ok", name), "told": ("ok", name), "quote": ("ok", name), "open": ("malformed", None),
                   "none": ("malformed", None), "empty": ("malformed", None), "null": ("malformed", None), "wrong": ("malformed", None),
                   "some": ("incomplete", "z")}


def test_observed_counts(spark):
    src = spark.createDataFrame([("2024-01-01", "1.5"), ("2024-01-01", "x1"), ("1/2/2024", "2"), (None, None), ("2024-01-03", None)], "d string, v string")
    counts = StageCounts()
    scan_prices(src, "d", "v", cast="strict", counts=counts, stage="s").write.format("noop").mode("overwrite").save()
    assert {r.metric: r.n for r in counts.table(spark).collect()} == {"rows": 5, "null_dates": 1, "bad_dates": 1, "bad_values": 1}


def test_failed_refresh_keeps_the_old_version(spark, monkeypatch, tmp_path):
    land, out = str(tmp_path / "land"), str(tmp_path / "snap")
    spark.range(3).write.parquet(f"{land}/t.parquet")
    snapshot.ingest_snapshot(spark, land, out, ["t"])
    spark.range(5).write.mode("overwrite").parquet(f"{land}/t.parquet")

    def fails(*_):
        raise OSError("stopped before the commit")
    with monkeypatch.context() as m:
        m.setattr(snapshot, "_commit", fails)
        with pytest.raises(OSError):
            snapshot.ingest_snapshot(spark, land, out, ["t"])
    assert snapshot.read_snapshot(spark, out, "t").count() == 3
    held = snapshot.read_snapshot(spark, out, "t")
    snapshot.ingest_snapshot(spark, land, out, ["t"])
    assert snapshot.read_snapshot(spark, out, "t").count() == 5 and held.count() == 3
    with pytest.raises(FileNotFoundError):
        snapshot.read_snapshot(spark, out, "other")


def test_quantiles_of_one_driver_in_many_tasks(spark):
    rng = np.random.default_rng(4)
    values = {"wide": rng.standard_normal(3000) * 10.0 ** rng.integers(-3, 3, 3000), "same": np.full(50, 2.5),
              "few": np.array([1.0, 2.0, 4.0]), "ties": rng.integers(0, 5, 2000).astype(float), "one": np.array([7.0]),
              "huge": np.array([-1.7e308, 0.0, 1.7e308])}
    rows = [(k, float(v), int(m)) for k, vs in values.items() for v, m in zip(vs, rng.integers(0, 4, len(vs)))]
    rows += [("few", None, 3), ("few", 9.0, 0)]
    df = spark.createDataFrame(rows, "driver string, v double, m long").repartition(12)
    qs = (.25, .5, .75, .999)
    got = {r.driver: r.qs for r in exact_quantiles(df, qs, ["driver"], buckets=256).collect()}
    want = df.where("m > 0").groupBy("driver").agg(F.percentile("v", F.array(*map(F.lit, qs)), F.col("m")).alias("qs"))
    want = {r.driver: r.qs for r in want.collect()}
    assert got.keys() == want.keys()
    for k in got:
        assert got[k] == pytest.approx(want[k], rel=1e-12)


def test_report_text(spark):
    full = '{"feature_name":"a","feature_behavior":"x","shap_interpretation":"x","forecast_alignment":"x","influence_strength":"x","analyst_explanation":"why"}'
    day = dt.date(2024, 1, 5)
    ctx = spark.createDataFrame([(day, "b", None, "U", "U", "SUPPORTING", "LOW"), (day, "a", "Name", "U", "D", "OPPOSING", "STRONG")],
                                "ssd date, driver string, business_name string, attribution_direction string, forecast_direction string, role string, strength string")
    path = spark.createDataFrame([(day, 1, dt.date(2024, 1, 8), 101, 100.0)], "ssd date, days_ahead int, future_date date, forecast_price long, current_spot double")
    days = spark.createDataFrame([(day,), (dt.date(2024, 1, 12),)], "ssd date")
    now = spark.createDataFrame([(day, 100.0)], "ssd date, current_spot double")
    told = parse_insights(spark.createDataFrame([(day, "a", full)], "ssd date, driver string, response string"))
    got = {r.ssd: r.report.split("\n") for r in render_report(report_context(days, now, path, ctx, told, horizon=1)).collect()}
    assert got[day] == ["[report] on=2024-01-05 spot=100.00 state=complete", "[path] price per business day", "[1]{day,price}:",
                        "  2024-01-08,101", "[drivers] 2, explained 1", "- Name (OPPOSING, STRONG): why", "- b (SUPPORTING, LOW)"]
    assert got[dt.date(2024, 1, 12)] == ["[report] on=2024-01-12 spot=- state=missing current price", "[path] price per business day", "-",
                                         "[drivers] 0, explained 0"]


def _roles_of(rows, models, means, cols, spot_now, keys, shared):
    """Roles from scores exploded by driver and predictions of their own, or from wide
    scores that carry the parts of the predictions."""
    from tidemark.operators.attribution import attribute_rows, driver_role
    from tidemark.operators.path import forecast_path
    if shared:
        scored = score_rows(rows, models, cols, keys, alongside=True)
        summary = attribution_summary(attribute_rows(scored, None, means, cols, keys, wide=True), keys, cols, wide=True)
        return driver_role(forecast_path(summary, spot_now, 2, keys, carry=cols), None, keys, cols=cols)
    summary = attribution_summary(attribute_rows(rows, models, means, cols, keys), keys)
    return driver_role(summary, forecast_path(score_rows(rows, models, cols, keys), spot_now, 2, keys), keys)


def test_wide_scores_give_the_same_summary_and_roles(spark):
    from tidemark.operators.attribution import attribute_rows, step_means
    rng, cols, keys, lag = np.random.default_rng(11), ["a", "b", "c"], ["k"], 3
    rows = [(k, i + 1, D[i], *[None if rng.random() < 0.15 else float(v) for v in rng.normal(size=2)],
             None if k == 2 else float(k)) for k in (1, 2, 3) for i in range(12)]
    frame = spark.createDataFrame(rows, "k long, rn long, ssd date, a double, b double, c double")
    ends = frame.select("k", "ssd", "rn")
    report, background = ends.where("rn >= 3 and rn % 2 = 0"), ends.where("rn >= 5")
    gathered = [sorted(map(tuple, gather_rows(frame, report, cols, lag, keys, dealt=x).collect()), key=str) for x in (False, True)]
    assert gathered[0] == gathered[1] and len(gathered[0]) == 3 * 5 * lag
    win = gather_rows(frame, report, cols, lag, keys, dealt=True)
    means = step_means(gather_rows(frame, background, cols, lag, keys, dealt=True), cols, keys)
    models = spark.createDataFrame([(k, h, [float(v) for v in rng.normal(size=lag * len(cols))], float(h))
                                    for k in (1, 2, 3) for h in (1, 2)], "k long, days_ahead int, weights array<double>, intercept double")
    # one date has no price: it has a summary and no role
    spot_now = frame.select("k", "ssd", F.lit(100.0).alias("current_spot"),
                            F.when((F.col("k") == 1) & (F.col("rn") == 4), "missing").otherwise("ok").alias("status"))

    def held(df):
        return {tuple(r[c] for c in ("k", "ssd", "days_ahead", "driver") if c in df.columns): r.asDict() for r in df.collect()}

    long = held(attribution_summary(attribute_rows(win, models, means, cols, keys), keys))
    wide = held(attribution_summary(attribute_rows(win, models, means, cols, keys, wide=True), keys, cols))
    assert len(long) == 3 * 5 * 2 * 3
    roles = [held(_roles_of(win, models, means, cols, spot_now, keys, x)) for x in (False, True)]
    assert len(roles[0]) == (3 * 5 - 1) * 3
    assert any(r["role"] != "NEUTRAL" for r in roles[0].values()) and any(r["total"] is None for r in long.values())
    for old, new in ((long, wide), roles):
        assert old.keys() == new.keys()
        for key in old:
            assert {c: pytest.approx(v) if isinstance(v, float) else v for c, v in old[key].items()} == new[key]


def test_scaler_of_many_series_equals_one_by_one(spark):
    rng, lag = np.random.default_rng(5), 3
    rows = [(k, D[i], None if rng.random() < 0.2 else float(rng.normal()), None if k == 2 else i, float(k or 0))
            for k in (1, 2, None) for i in range(15)]
    frame = spark.createDataFrame(rows, "k long, ssd date, a double, b int, c double")
    ends = frame.where(F.dayofmonth("ssd") % 3 != 0).select("k", "ssd")
    many = fit_robust(frame, ["a", "b", "c"], lag, ends, ["k"]).collect()
    assert len(many) == 6 and {r.k for r in many} == {1, 2}  # a series without a key has no window ends
    for k in (1, 2):
        one = fit_robust(frame.where(F.col("k") == k).drop("k"), ["a", "b", "c"], lag, ends.where(F.col("k") == k).drop("k")).collect()
        assert {(r.driver, r.center, r.scale) for r in many if r.k == k} == {(r.driver, r.center, r.scale) for r in one}
