"""Exact weighted quantiles without a buffer per group: the value at a rank is found
by histograms that narrow down to the bucket holding it."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

BUCKETS = 1024


def exact_quantiles(values: DataFrame, qs: Sequence[float], group: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """``(group…, qs ARRAY<DOUBLE>)`` of ``values(group…, v, m)``: the quantiles of
    the values, each counted ``m`` times, with linear interpolation between ranks
    (what ``percentile`` gives). NULL values and weights below one are left out.

    Equal values are added up first, and a row is one value of one group, so a group
    spreads over all tasks. A round cuts the range that holds a wanted rank into
    ``buckets`` of equal width, sums their weights (partial sums per task) and keeps
    the bucket with the rank, trimmed to its smallest and largest value; it ends when
    a range is one value. Each round at least halves the distinct values of a range
    at its ends; evenly spread values take two or three rounds.
    """
    group = list(group)
    v = materialize(values.where(F.col("v").isNotNull() & (F.col("m") > 0)).groupBy(*group, "v").agg(F.sum("m").alias("m")), "values")
    totals = materialize(v.groupBy(*group).agg(F.sum("m").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi")), "totals")
    ranks = F.array(*[f(F.lit(float(q)) * (F.col("w") - 1)).cast("long") for q in qs for f in (F.floor, F.ceil)])
    state = totals.select(*group, "lo", "hi", F.lit(0).cast("long").alias("below"), F.explode(F.array_distinct(ranks)).alias("rank"))
    on = [*group, "lo", "hi"]
    while True:
        state = materialize(state, "ranks")
        if state.where("lo < hi").isEmpty():
            break
        ranges = state.where("lo < hi").select(*on).distinct()
        inside = v.join(ranges, group).where("v BETWEEN lo AND hi")
        # halves: the width of a range may be beyond the largest double
        at = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * buckets), F.lit(buckets - 1))
        hist = inside.groupBy(*on, at.alias("b")).agg(F.sum("m").alias("n"), F.min("v").alias("_lo"), F.max("v").alias("_hi"))
        past = F.coalesce(F.sum("n").over(Window.partitionBy(*on).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cut = state.where("lo < hi").join(hist.withColumn("past", past), on).where("rank >= below + past AND rank < below + past + n")
        state = state.where("lo = hi").unionByName(cut.select(
            *group, F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), (F.col("below") + F.col("past")).alias("below"), "rank"))
    found = state.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("rank", "lo"))).alias("at"))  # two ranks a quantile

    def pick(q):
        pos = F.lit(float(q)) * (F.col("w") - 1)
        low, high = F.floor(pos).cast("long"), F.ceil(pos).cast("long")
        value = F.element_at("at", low)
        return F.when(low == high, value).otherwise((high - pos) * value + (pos - low) * F.element_at("at", high))

    return totals.select(*group, "w").join(found, group).select(*group, F.array(*[pick(q) for q in qs]).alias("qs"))
