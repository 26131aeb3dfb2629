"""Questions about the one global packet order, answered without a global window.

The capture is first reduced to its distinct times (map-side combined), then cut into
buckets of ``BUCKET_US``. A bucket holds at most ``BUCKET_US`` distinct microseconds
however hot it is, and the answer that crosses buckets comes from a table with one row
per bucket (about three million per year of capture).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetmill.functions.numbers import slot

BUCKET_US = 10_000_000
_BUCKETS_PER_BLOCK = 8640  # one day of buckets


def _bucket(us):
    return slot(us, BUCKET_US)


def timeline(packets: DataFrame) -> DataFrame:
    """Distinct packet times with the lowest arrival number at each."""
    return packets.groupBy("ts_us").agg(F.min("seq").alias("first_seq"))


def _carry(buckets: DataFrame, value: str, forward: bool) -> DataFrame:
    """Per bucket, ``value`` of the nearest other bucket after (or before) it.

    Two levels: inside a day by window, across days from one row per day.
    """
    order = F.col("bucket").desc() if forward else F.col("bucket")
    block = slot(F.col("bucket"), _BUCKETS_PER_BLOCK)
    rows = buckets.withColumn("block", block)
    inside = rows.withColumn("near", F.lag(value).over(Window.partitionBy("block").orderBy(order)))
    pick = F.min(value) if forward else F.max(value)
    day_order = F.col("block").desc() if forward else F.col("block")
    days = rows.groupBy("block").agg(pick.alias("edge"))
    days = days.withColumn("far", F.lag("edge").over(
        Window.partitionBy(F.lit(0)).orderBy(day_order))).drop("edge")
    return inside.join(days, "block").select(
        "bucket", F.coalesce("near", "far").alias("carried"))


def previous_packet_time(points: DataFrame, packets: DataFrame) -> DataFrame:
    """Add ``prev_global_us`` to points (packets, or some of them): the time of the packet
    that precedes each in the whole capture."""
    line = timeline(packets).withColumn("bucket", _bucket(F.col("ts_us")))
    carried = _carry(line.groupBy("bucket").agg(F.max("ts_us").alias("last_us")), "last_us", False)
    within = F.lag("ts_us").over(Window.partitionBy("bucket").orderBy("ts_us"))
    before = (
        line.withColumn("near", within)
        .join(carried, "bucket")
        .select("ts_us", "first_seq", F.coalesce("near", "carried").alias("before_us"))
    )
    prev = F.when(F.col("seq") > F.col("first_seq"), F.col("ts_us")).otherwise(F.col("before_us"))
    return points.join(before, "ts_us").withColumn("prev_global_us", prev).drop("first_seq", "before_us")


def next_packet(questions: DataFrame, at: str, packets: DataFrame) -> DataFrame:
    """Add ``next_us`` and ``next_seq``: first packet of the capture at or after column ``at``.

    A forward as-of join: questions and packet times are laid out together per bucket and
    a running value walks from late to early, so the cost is one sort per bucket.
    """
    line = timeline(packets).select(
        F.col("ts_us").alias("at_us"), F.lit(0).alias("kind"),
        F.struct(F.col("ts_us").alias("us"), F.col("first_seq").alias("seq")).alias("hit"),
    ).withColumn("bucket", _bucket(F.col("at_us")))
    asked = questions.select(
        F.col(at).alias("at_us"), F.lit(1).alias("kind"), F.struct(*questions.columns).alias("row"),
    ).withColumn("bucket", _bucket(F.col("at_us")))
    both = line.unionByName(asked, allowMissingColumns=True)
    # Late to early; packets before questions at the same time, so "at or after" holds.
    walk = Window.partitionBy("bucket").orderBy(F.col("at_us").desc(), "kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("near", F.last("hit", ignorenulls=True).over(walk)).where("kind = 1")

    heads = line.groupBy("bucket").agg(F.min("hit").alias("head"))
    # Buckets with questions but no packets still need a carried value.
    grid = heads.unionByName(
        asked.select("bucket").distinct(), allowMissingColumns=True
    ).groupBy("bucket").agg(F.min("head").alias("head"))
    carried = _carry_nonempty(grid)
    return found.join(carried, "bucket").select(
        "row.*",
        F.coalesce(F.col("near.us"), F.col("carried.us")).alias("next_us"),
        F.coalesce(F.col("near.seq"), F.col("carried.seq")).alias("next_seq"),
    )


def _carry_nonempty(grid: DataFrame) -> DataFrame:
    """Like ``_carry`` forward, skipping buckets whose head is null."""
    rows = grid.withColumn("block", slot(F.col("bucket"), _BUCKETS_PER_BLOCK))
    later = Window.partitionBy("block").orderBy(F.col("bucket").desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    inside = rows.withColumn("near", F.last("head", ignorenulls=True).over(later))
    days = rows.groupBy("block").agg(F.min("head").alias("edge"))
    later_days = Window.partitionBy(F.lit(0)).orderBy(F.col("block").desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    days = days.select("block", F.last("edge", ignorenulls=True).over(later_days).alias("far"))
    return inside.join(days, "block").select("bucket", F.coalesce("near", "far").alias("carried"))
