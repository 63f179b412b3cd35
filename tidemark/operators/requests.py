"""Report requests: validation rules as one expression chain, and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import is_friday, strict_date

# Fixed values that must equal the reference service: the allowed report
# range and the three rejection messages, checked in this order.
REPORT_START = "2015-01-14"
REPORT_END = "2026-02-05"
MSG_FORMAT = "Date must be in YYYY-MM-DD format"
MSG_FRIDAY = "Provided date is not a Friday"
MSG_RANGE = "Date must be between {start} and {end}"


def validate_requests(requests: DataFrame, col: str = "friday_date",
                      start: str = REPORT_START, end: str = REPORT_END) -> DataFrame:
    """``(request, report_date, is_valid, status_code, reason)``: the first
    failing rule wins (format, then Friday, then inclusive range); a valid
    request has status 200 and no reason."""
    d = strict_date(F.col(col))
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    reason = (F.when(d.isNull(), F.lit(MSG_FORMAT))
              .when(~is_friday(d), F.lit(MSG_FRIDAY))
              .when(~d.between(lo, hi), F.lit(MSG_RANGE.format(start=start, end=end))))
    return (requests.select(F.col(col).alias("request"), d.alias("report_date"), reason.alias("reason"))
            .select("request", "report_date", F.col("reason").isNull().alias("is_valid"),
                    F.when(F.col("reason").isNull(), F.lit(200)).otherwise(F.lit(400)).alias("status_code"),
                    "reason"))


def request_outcomes(checked: DataFrame, reports: DataFrame) -> DataFrame:
    """One row per request with ``n_reports`` and ``n_complete`` of its date and
    ``status``: 'rejected' by validation, 'failed' when no report of the date is
    complete, 'partial' when some are, else 'done'; ``outcome_reason`` is the
    first reason (by name) that a report of the date is not complete."""
    per_day = reports.groupBy(F.col("ssd").alias("report_date")).agg(
        F.count(F.lit(1)).alias("n_reports"), F.count_if("is_valid").alias("n_complete"), F.min("reason").alias("_why"))
    j = checked.join(per_day, "report_date", "left").fillna(0, ["n_reports", "n_complete"])
    status = (F.when(~F.col("is_valid"), "rejected").when(F.col("n_complete") == 0, "failed")
              .when(F.col("n_complete") < F.col("n_reports"), "partial").otherwise("done"))
    why = F.when(status.isin("failed", "partial"), F.coalesce("_why", F.lit("no spot for the date")))
    return j.withColumn("status", status).withColumn("outcome_reason", why).drop("_why")
