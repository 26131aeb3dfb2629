"""Running totals over a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetmill.session import materialise


def running_total(df: DataFrame, order: list[Column], value: str, out: str, group: str | None = None,
                  name: str = "ordered") -> DataFrame:
    """Add ``out``: the total of ``value`` up to and including the row, in ``order`` (per ``group`` if given).

    The rows are dealt by ranges of (group, order) and stored with their range number; each range is
    summed, the sums of earlier ranges are carried over a table of one row per range (and group), and only
    inside a range is there a window. ``order`` must be total, so that a rerun gives the same totals.
    """
    lead = [F.col(group).asc()] if group else []
    stored = materialise(df.repartitionByRange(*lead, *order).withColumn("__part", F.spark_partition_id()), name)
    by = [group] if group else []
    sums = stored.groupBy(*by, "__part").agg(F.sum(value).alias("__sum"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    if group:
        before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*by, "__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (stored.join(starts, [*by, "__part"])
            .withColumn(out, F.col("__before") + F.sum(value).over(inside)).drop("__part", "__before"))
