"""Per-driver analyst context: compact tables, rendered text, insight
parsing and the per-date report context. All string work is built-in
expressions; each text is assembled from one small group (≤ lag or H rows)."""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import round_half_even
from tidemark.functions.text import fmt_fixed, render_table
from tidemark.sources.dictionary import with_driver_info

# Fixed value: the label that stands before a score's target day.
SCORE_LABEL = "SHAPScoreFor "

# The fields of an insight.
INSIGHT_FIELDS = ["feature_name", "feature_behavior", "shap_interpretation",
                  "forecast_alignment", "influence_strength", "analyst_explanation"]
INSIGHT_SCHEMA = "struct<" + ", ".join(f"{f}: string" for f in INSIGHT_FIELDS) + ">"


def encode_table(df: DataFrame, group: Sequence[str], order: str, cells: Sequence[Column],
                 names: Sequence[str], out: str = "text") -> DataFrame:
    """``(group…, <out>)``: the rows of each group as compact text, a header
    ``[n]{names}:`` then one line per row (cells joined by commas) in
    ``order``."""
    line = F.concat_ws(",", *cells)
    g = df.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"),
                                                                      line.alias("_l")))).alias("_rows"))
    rows = F.transform("_rows", lambda r: r["_l"])
    return g.select(*group, render_table(rows, F.size("_rows"), list(names)).alias(out))


def history_text(history: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """From ``recent_history`` rows: ``(keys…, ssd, driver, history)``."""
    keys = list(keys)
    return encode_table(history, keys + ["ssd", "driver"], "step",
                        [F.date_format("hist_date", "yyyy-MM-dd"), fmt_fixed("value", 2)],
                        ["ssd", "value"], out="history")


def path_text(path: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """From ``forecast_path`` rows: ``(keys…, ssd, current_spot, forecast)``."""
    keys = list(keys)
    t = encode_table(path, keys + ["ssd"], "days_ahead",
                     [F.date_format("future_date", "yyyy-MM-dd"), fmt_fixed("forecast_price", 0)],
                     ["day", "price"], out="forecast")
    spot = path.groupBy(*keys, "ssd").agg(F.first("current_spot").alias("current_spot"))
    return t.join(spot, keys + ["ssd"])


def _places(score: Column) -> Column:
    """A score at 4 places. It is brought to 9 places first: whether a sum that ends
    on a decimal tie goes up or down must not depend on the order of summation."""
    return round_half_even(round_half_even(score, 9), 4)


def attribution_text(summary: DataFrame, path: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """From ``attribution_summary`` rows: ``(keys…, ssd, driver, attribution)``:
    one line per horizon, labelled with its target business day, total score
    rounded to 4 places."""
    keys = list(keys)
    p = path.select(*keys, "ssd", "days_ahead", "future_date")
    s = summary.join(p, keys + ["ssd", "days_ahead"])
    label = F.concat(F.lit(SCORE_LABEL), F.date_format("future_date", "yyyy-MM-dd"))
    return encode_table(s, keys + ["ssd", "driver"], "days_ahead",
                        [label, fmt_fixed(_places(F.col("total")), 4)],
                        ["horizon", "score"], out="attribution")


def step_scores_text(scores: DataFrame, path: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """From ``attribute_rows`` rows: ``(keys…, ssd, driver, step_scores)``: one
    line per horizon, labelled with its target business day, then the score of
    every lag step as ``date:score``, oldest first, rounded to 4 places."""
    keys = list(keys)
    on = keys + ["ssd", "days_ahead"]
    step = F.concat(F.date_format("lag_date", "yyyy-MM-dd"), F.lit(":"), fmt_fixed(_places(F.col("score")), 4))
    vectors = scores.groupBy(*on, "driver").agg(
        F.array_sort(F.collect_list(F.struct("lag_step", step.alias("t")))).alias("steps"))
    s = vectors.join(path.select(*on, "future_date"), on)
    label = F.concat(F.lit(SCORE_LABEL), F.date_format("future_date", "yyyy-MM-dd"))
    return encode_table(s, keys + ["ssd", "driver"], "days_ahead", [label, F.array_join("steps.t", " ")],
                        ["horizon", "scores"], out="step_scores")


def driver_context(info: DataFrame, history: DataFrame, path: DataFrame, summary: DataFrame,
                   roles: DataFrame, keys: Iterable[str] = (), scores: DataFrame | None = None) -> DataFrame:
    """One row per (keys, ssd, driver): dictionary fields, current spot,
    history / forecast / attribution tables and the role labels. With ``scores``
    (``attribute_rows`` rows) also ``step_scores``, every lag step's score."""
    keys = list(keys)
    on = keys + ["ssd", "driver"]
    h = history_text(history, keys)
    a = attribution_text(summary, path, keys)
    f = path_text(path, keys)
    r = roles.select(*on, "attribution_direction", "forecast_direction", "role", "strength")
    base = h.join(a, on).join(r, on).join(f, keys + ["ssd"])
    if scores is not None:
        base = base.join(step_scores_text(scores, path, keys), on)
    return with_driver_info(base, info)


def render_driver_context(ctx: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """``(keys…, ssd, driver, prompt)``: one keyed record per driver. A head of
    ``name=value`` fields says what the driver is and where it stands; three
    tables follow, each under a line that names it and its columns' meaning, and
    ``step_scores`` after the scores if ``ctx`` has them."""
    keys = list(keys)

    def field(name, value):
        return F.concat(F.lit(f"{name}="), F.coalesce(value, F.lit("-")))

    steps = [F.lit("[steps] score per horizon and lag date, oldest first"), F.col("step_scores")] if "step_scores" in ctx.columns else []
    text = F.concat_ws(
        "\n",
        F.concat_ws(" ", F.lit("[driver]"), field("id", F.col("driver")), field("on", F.date_format("ssd", "yyyy-MM-dd")),
                    field("spot", fmt_fixed(round_half_even("current_spot", 1), 1))),
        F.concat_ws("; ", field("stance", F.col("role")), field("weight", F.col("strength")),
                    field("pushes", F.col("attribution_direction")), field("path", F.col("forecast_direction"))),
        F.concat_ws("; ", field("title", F.col("business_name")), field("class", F.col("asset_class")),
                    field("theme", F.col("macro_role")), field("link", F.col("relationship_to_target"))),
        F.lit("[scores] total per horizon"), F.col("attribution"), *steps,
        F.lit("[path] price per business day"), F.col("forecast"),
        F.lit("[series] latest values, oldest first"), F.col("history"))
    return ctx.select(*keys, "ssd", "driver", text.alias("prompt"))


def first_object(text: Column) -> Column:
    """The first balanced ``{…}`` of a text, NULL without one: one pass over the
    characters that keeps the depth and whether it is inside a quoted string (where
    braces do not count and a backslash hides the next character)."""
    zero = F.lit(0)
    start = F.struct(zero.alias("i"), zero.alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("hidden"),
                     zero.alias("first"), zero.alias("last"))

    def step(s, ch):
        inside, open_quote = s["depth"] > 0, s["quoted"]
        mark = inside & (ch == '"') & ~s["hidden"]
        opens = ~open_quote & (ch == "{")
        closes = inside & ~open_quote & (ch == "}")
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        return F.when(s["last"] > 0, s).otherwise(F.struct(
            (s["i"] + 1).alias("i"), depth.alias("depth"), F.when(mark, ~open_quote).otherwise(open_quote).alias("quoted"),
            (open_quote & ~s["hidden"] & (ch == "\\")).alias("hidden"),
            F.when(opens & (s["first"] == 0), s["i"] + 1).otherwise(s["first"]).alias("first"),
            F.when(closes & (depth == 0), s["i"] + 1).otherwise(0).alias("last")))

    found = F.aggregate(F.split(text, ""), start, step, lambda s: F.struct(s["first"], s["last"]))
    return F.when(found["last"] > 0, F.substr(text, found["first"], found["last"] - found["first"] + 1))


def _insight(text: Column) -> Column:
    """The parsed struct of a JSON text, NULL if it is malformed (partial results of
    the reader are discarded)."""
    parsed = F.from_json(text, INSIGHT_SCHEMA[:-1] + ", _corrupt_record: string>",
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return F.when(parsed["_corrupt_record"].isNull(), parsed)


def parse_insights(df: DataFrame, col: str = "response") -> DataFrame:
    """Parse insight JSON into its six fields. A text that is not JSON as a whole is
    searched for its first balanced object (code fences, text before and after).
    ``parse_status``: 'ok' when all six are present, 'incomplete' when some are
    missing, 'malformed' when neither parses (then every field is NULL). Never fails
    the job."""
    out = df.withColumn("_p", _insight(F.col(col)))
    out = out.withColumn("_p", F.coalesce("_p", _insight(F.when(F.col("_p").isNull(), first_object(F.col(col))))))
    complete = F.lit(True)
    for f in INSIGHT_FIELDS:
        complete = complete & F.col(f"_p.{f}").isNotNull()
    status = F.when(F.col("_p").isNull(), F.lit("malformed")).when(complete, F.lit("ok")).otherwise(F.lit("incomplete"))
    return out.select(*df.columns, *[F.col(f"_p.{f}").alias(f) for f in INSIGHT_FIELDS], status.alias("parse_status"))


def report_context(days: DataFrame, spot_now: DataFrame, path: DataFrame, ctx: DataFrame,
                   insights: DataFrame | None = None, keys: Iterable[str] = (), horizon: int = 5) -> DataFrame:
    """One row per requested ``(keys, ssd)`` of ``days``, whatever is known of it:
    spot (``current_spot`` rows), forecast table and its number of steps, the
    driver contexts as an array sorted by driver, each with the fields of its
    parsed insight (``parse_insights`` rows of status 'ok', one per keys, ssd and
    driver), and ``is_valid`` / ``reason``: a report needs a spot, all ``horizon``
    steps and at least one driver."""
    keys = list(keys)
    on = keys + ["ssd"]
    shown = ["driver", "business_name", "attribution_direction", "forecast_direction", "role", "strength"]
    known = ctx.select(*on, *shown)
    if insights is None:
        told = known.withColumn("insight", F.lit(None).cast(INSIGHT_SCHEMA))
    else:
        ok = insights.where("parse_status = 'ok'").select(*on, "driver", F.struct(*INSIGHT_FIELDS).alias("insight"))
        told = known.join(ok, on + ["driver"], "left")
    drivers = told.groupBy(*on).agg(F.count(F.lit(1)).alias("n_drivers"), F.count("insight").alias("n_insights"),
                                    F.array_sort(F.collect_list(F.struct(*shown, "insight"))).alias("drivers"))
    steps = path.groupBy(*on).agg(F.count("forecast_price").alias("n_steps"))
    g = (days.select(*on).distinct()
         .join(spot_now.select(*on, "current_spot"), on, "left")
         .join(path_text(path, keys).select(*on, "forecast"), on, "left")
         .join(steps, on, "left").join(drivers, on, "left")
         .fillna(0, ["n_steps", "n_drivers", "n_insights"]))
    reason = (F.when(F.col("current_spot").isNull(), F.lit("missing current price"))
              .when(F.col("n_steps") < horizon, F.lit("missing forecast path"))
              .when(F.col("n_drivers") == 0, F.lit("missing driver context")))
    return g.select(*on, "current_spot", "forecast", "n_steps", "n_drivers", "n_insights", "drivers",
                    reason.isNull().alias("is_valid"), reason.alias("reason"))


def render_report(reports: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """``(keys…, ssd, report)``: one text per row of ``report_context``. The head says
    whether the report is complete, the path follows, then each driver on a line of
    its own with its stance, its weight and, where there is one, its explanation."""
    keys = list(keys)

    def line(x):
        said = F.when(x["insight"]["analyst_explanation"].isNotNull(), F.concat(F.lit(": "), x["insight"]["analyst_explanation"]))
        return F.concat(F.lit("- "), F.coalesce(x["business_name"], x["driver"]), F.lit(" ("), F.coalesce(x["role"], F.lit("-")),
                        F.lit(", "), F.coalesce(x["strength"], F.lit("-")), F.lit(")"), F.coalesce(said, F.lit("")))

    text = F.concat_ws(
        "\n",
        F.concat(F.lit("[report] on="), F.date_format("ssd", "yyyy-MM-dd"), F.lit(" spot="),
                 F.when(F.col("current_spot").isNull(), "-").otherwise(fmt_fixed("current_spot", 2)), F.lit(" state="), F.coalesce("reason", F.lit("complete"))),
        F.lit("[path] price per business day"), F.coalesce("forecast", F.lit("-")),
        F.concat(F.lit("[drivers] "), F.col("n_drivers"), F.lit(", explained "), F.col("n_insights")),
        F.when(F.size("drivers") > 0, F.array_join(F.transform("drivers", line), "\n")))
    return reports.select(*keys, "ssd", text.alias("report"))
