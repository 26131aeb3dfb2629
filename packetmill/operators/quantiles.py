"""Exact quantiles of many features at once, without gathering a feature anywhere.

1. values are folded to (feature, value, count), so a value that fills a third of the
   table is one row;
2. a mergeable sketch yields splitters that cut each feature into about equal intervals;
3. exact interval counts tell in which interval each wanted rank lies;
4. only those intervals are sorted and walked.

The sketch decides how evenly the work is cut, never the result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetmill.session import materialise

# One interval is sorted by one task; it should hold about this many distinct values.
_PER_INTERVAL = 1_000_000
_MAX_INTERVALS = 4000


def value_counts(values: DataFrame) -> DataFrame:
    """(feature, value) to (feature, value, cnt); nulls and NaN are left out."""
    return values.where("value is not null and not isnan(value)").groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("cnt"))


def _interval(step: int):
    """Number of splitters at or below the value, by a coarse and a fine search."""
    k = F.size(F.filter("coarse", lambda s: s <= F.col("value")))
    fine = F.slice("splits", (F.greatest(k, F.lit(1)) - 1) * step + 1, F.lit(step))
    inner = F.size(F.filter(fine, lambda s: s <= F.col("value")))
    return F.when(k == 0, 0).otherwise((k - 1) * step + inner)


def values_at_ranks(counts: DataFrame, ranks: DataFrame, intervals: int | None = None) -> DataFrame:
    """(feature, r, value): the r-th smallest value, from zero, for each wanted rank.

    ``ranks`` holds few rows per feature; ``counts`` should be a written table, as it is
    read three times and counted to choose the number of intervals.
    """
    if intervals is None:
        intervals = min(_MAX_INTERVALS, max(16, counts.count() // _PER_INTERVAL))
    step = math.isqrt(intervals - 1) + 1
    grid = F.expr("array(" + ",".join(f"{i / intervals}D" for i in range(1, intervals)) + ")")
    splits = counts.groupBy("feature").agg(
        F.array_sort(F.array_distinct(F.percentile_approx("value", grid, F.lit(10 * intervals)))).alias("splits"))
    coarse = F.transform(F.sequence(F.lit(0), F.size("splits") - 1, F.lit(step)), lambda i: F.col("splits")[i])
    splits = splits.withColumn("coarse", coarse)
    placed = counts.join(F.broadcast(splits), "feature").select("feature", "value", "cnt", _interval(step).alias("slot"))

    before = Window.partitionBy("feature").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = placed.groupBy("feature", "slot").agg(F.sum("cnt").alias("slot_n")).withColumn(
        "carry", F.coalesce(F.sum("slot_n").over(before), F.lit(0)))
    # The wanted ranks and at most ``intervals`` slots per feature meet here.
    needed = (
        slots.join(ranks.select("feature", "r").distinct(), "feature")
        .where((F.col("r") >= F.col("carry")) & (F.col("r") < F.col("carry") + F.col("slot_n")))
        .groupBy("feature", "slot", "carry").agg(F.collect_set("r").alias("rs"))
    )
    upto = Window.partitionBy("feature", "slot").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    walked = placed.join(F.broadcast(needed), ["feature", "slot"]).withColumn(
        "end", F.col("carry") + F.sum("cnt").over(upto))
    hit = F.filter("rs", lambda r: (r >= F.col("end") - F.col("cnt")) & (r < F.col("end")))
    return walked.select("feature", "value", F.explode(hit).alias("r"))


def quantiles(counts: DataFrame, probs: list[float], intervals: int | None = None) -> DataFrame:
    """(feature, q, value) for folded counts, linear between neighbouring ranks."""
    totals = counts.groupBy("feature").agg(F.sum("cnt").alias("n"))
    q = F.explode(F.array(*map(F.lit, probs))).alias("q")
    low = F.floor("rank").cast("long")
    wanted = totals.select("feature", "n", q).withColumn("rank", F.col("q") * (F.col("n") - 1)).select(
        "feature", "q", "rank", low.alias("lo"), F.least(low + 1, F.col("n") - 1).alias("hi"))
    ranks = wanted.select("feature", F.explode(F.array("lo", "hi")).alias("r"))
    found = values_at_ranks(counts, ranks, intervals)

    ends = wanted.select("feature", "q", "rank", F.posexplode(F.array("lo", "hi")).alias("side", "r"))
    pairs = ends.join(found, ["feature", "r"]).groupBy("feature", "q", "rank").agg(
        F.max(F.when(F.col("side") == 0, F.col("value"))).alias("a"),
        F.max(F.when(F.col("side") == 1, F.col("value"))).alias("b"))
    t, gap = F.col("rank") - F.floor("rank"), F.col("b") - F.col("a")
    value = F.when(t >= 0.5, F.col("b") - gap * (1 - t)).otherwise(F.col("a") + gap * t)
    return pairs.select("feature", "q", value.alias("value"))


def running_sum(rows: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` up to and including the row, per ``group`` in ``order``, without a task that sees a whole group.

    Rows are dealt by ranges of group and order and stored; the sums of earlier ranges are carried over a table of one row a
    range and group. ``order`` must be total.
    """
    stored = materialise(rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = stored.groupBy(*group, "_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*group, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carried"))
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return stored.join(carried, [*group, "_part"]).withColumn(out, F.col("_carried") + F.sum(value).over(inside)).drop("_part", "_carried")
