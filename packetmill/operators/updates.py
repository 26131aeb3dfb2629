"""State changes on append-only tables, expressed as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mark_processed(flows: DataFrame, batch: DataFrame, at: Column) -> DataFrame:
    """Set the processed flag of flows whose id occurs in the batch."""
    done = batch.select("flow_id").where("flow_id is not null").distinct().withColumn("_done", F.lit(True))
    hit = F.col("_done").isNotNull()
    return flows.join(done, "flow_id", "left").withColumns({
        "processed_flag": F.col("processed_flag") | hit,
        "processed_at": F.when(hit, at).otherwise(F.col("processed_at")),
    }).drop("_done")


def inherit_synthetic(alerts: DataFrame, flows: DataFrame) -> DataFrame:
    """Alerts of a synthetic flow become synthetic themselves."""
    smoke = flows.where("is_synthetic").select("flow_id").distinct().withColumn("_smoke", F.lit(True))
    return alerts.join(smoke, "flow_id", "left").withColumn(
        "is_synthetic", F.col("is_synthetic") | F.col("_smoke").isNotNull()).drop("_smoke")


def unprocessed(flows: DataFrame) -> DataFrame:
    """All flows still to score. How many a run takes at once is for the stream source to say."""
    return flows.where(~F.col("processed_flag"))


def drift_window(flows: DataFrame, as_of: Column, hours: int = 1) -> DataFrame:
    """All processed live flows loaded in the trailing window."""
    since = as_of - F.expr(f"interval {int(hours)} hours")
    return flows.where((F.col("created_at") >= since) & F.col("processed_flag") & ~F.col("is_synthetic"))
