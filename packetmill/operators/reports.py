"""Reporting queries over the alert, flow and drift tables.

Every report takes an explicit ``as_of`` instead of the wall clock, so a rerun returns
the same rows. Grouped reports combine on the map side; top-N reports are per-task heaps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def live(table: DataFrame) -> DataFrame:
    """Rows that did not come from smoke tests."""
    return table.where(~F.col("is_synthetic"))


def run_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("scored"),
        F.count_if("is_alert").alias("alerts_raised"),
        F.count_if(F.col("is_alert") & (F.col("severity") == "CRITICAL")).alias("critical"),
    )


def summary_text(summary: DataFrame) -> DataFrame:
    return summary.select(F.concat(
        F.lit("scored="), F.col("scored").cast("string"),
        F.lit(" rows, alerts_raised="), F.col("alerts_raised").cast("string"),
        F.lit(", critical="), F.col("critical").cast("string")).alias("summary"))


def kpis(alerts: DataFrame) -> DataFrame:
    real = ~F.col("is_synthetic")
    blocked = F.when(real & (F.col("mitigation_status") == "ACTIONED"), F.col("src_ip"))
    return alerts.agg(
        F.count_if(real).alias("total_alerts"),
        F.count_if(real & (F.col("severity") == "CRITICAL")).alias("critical"),
        F.count_if(real & (F.col("severity") == "HIGH")).alias("high"),
        F.countDistinct(blocked).alias("active_blocks"),
        F.count_if("is_synthetic").alias("synthetic_alerts"),
    )


def by_class(alerts: DataFrame) -> DataFrame:
    return (
        live(alerts).groupBy(F.col("attack_type").alias("classification"))
        .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "classification")
    )


def timeline(alerts: DataFrame, as_of: str, hours: int = 72) -> DataFrame:
    since = moment(as_of) - F.expr(f"interval {int(hours)} hours")
    return (
        live(alerts).where(F.col("alert_ts") >= since)
        .groupBy(F.date_trunc("hour", "alert_ts").cast("timestamp_ntz").alias("hour_bucket"),
                 F.col("attack_type").alias("classification"))
        .agg(F.count(F.lit(1)).alias("count")).orderBy("hour_bucket", "classification")
    )


def active_blocks(alerts: DataFrame, as_of: str, ttl_hours: int = 24) -> DataFrame:
    blocks = live(alerts).where("mitigation_status = 'ACTIONED'").groupBy("src_ip").agg(
        F.min("alert_ts").alias("first_alert_ts"),
        F.max("mitigated_at").alias("mitigated_at"),
        F.count(F.lit(1)).alias("alert_count"),
    )
    expires = F.col("mitigated_at") + F.expr(f"interval {int(ttl_hours)} hours")
    left = F.unix_seconds(F.col("expires_at").cast("timestamp")) - F.unix_seconds(
        moment(as_of).cast("timestamp"))
    text = F.when(
        F.col("ttl_seconds") > 0,
        F.concat(F.floor(F.col("ttl_seconds") / 3600).cast("string"), F.lit("h "),
                 F.floor(F.col("ttl_seconds") % 3600 / 60).cast("string"), F.lit("m")),
    ).otherwise("EXPIRED")
    return blocks.withColumn("expires_at", expires).withColumn("ttl_seconds", left).withColumn("ttl_text", text)


def counts_by(table: DataFrame, *columns: str) -> DataFrame:
    return table.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


STREAM_COLUMNS = ["alert_id", "alert_ts", "src_ip", "dst_ip", "src_port", "dst_port", "attack_type",
                  "confidence", "anomaly_score", "severity", "mitigation_status"]


def threat_stream(alerts: DataFrame, limit: int = 100) -> DataFrame:
    return live(alerts).select(*STREAM_COLUMNS).orderBy(F.desc("alert_ts"), "alert_id").limit(limit)


def latest(table: DataFrame, ts: str, limit: int = 1, tie: str | None = None) -> DataFrame:
    return table.orderBy(F.desc(ts), *([tie] if tie else [])).limit(limit)


def latest_per_key(table: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row of each key by ``order``; combines on the map side, unlike a ranked window."""
    rest = [c for c in table.columns if c not in keys]
    return (
        table.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
        .select(*keys, "row.*")
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
             for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)
