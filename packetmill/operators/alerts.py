"""From scored flows to rows of the alert table and of the simple alert log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetmill.functions import alerts as fx
from packetmill.schemas import ANOMALY_THRESHOLD, CONFIDENCE_THRESHOLD, CRITICAL_THRESHOLD, TARGETS

SCORE_COLUMNS = ["predicted_category", "confidence", "anomaly_score", "severity",
                 "is_zero_day_suspect", "is_alert"]


def classify(scored: DataFrame, conf: float = CONFIDENCE_THRESHOLD,
             critical: float = CRITICAL_THRESHOLD, anomaly: float = ANOMALY_THRESHOLD) -> DataFrame:
    """Add severity, zero-day suspicion and the alert decision to model output."""
    category, confidence, score = (F.col(c) for c in SCORE_COLUMNS[:3])
    return scored.withColumns({
        "severity": fx.severity(category, confidence, score, conf=conf, critical=critical, anomaly=anomaly),
        "is_zero_day_suspect": fx.zero_day_suspect(category, score, anomaly),
    }).withColumn("is_alert", fx.is_alert(F.col("severity")))


def alert_rows(classified: DataFrame, model_version: str, at: Column | None = None) -> DataFrame:
    """Rows for the alert table; ids depend on flow and model only, so a retry repeats them."""
    have = set(classified.columns)
    raw = F.to_json(F.struct(*[
        F.col(c).cast("string").alias(c) if t in ("timestamp", "timestamp_ntz", "date") else F.col(c)
        for c, t in classified.dtypes if c not in SCORE_COLUMNS
    ]), {"ignoreNullFields": "false"})

    def get(name, kind, default=None):
        value = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        return value if default is None else F.coalesce(value, F.lit(default).cast(kind))

    return classified.where("is_alert").select(
        F.md5(F.concat(get("flow_id", "string", ""), F.lit("|"), F.lit(model_version))).alias("alert_id"),
        (get("alert_ts", "timestamp_ntz") if at is None else at).alias("alert_ts"),
        get("flow_id", "string", "").alias("flow_id"),
        get("src_ip", "string", "").alias("src_ip"),
        get("dst_ip", "string", "").alias("dst_ip"),
        get("src_port", "int", 0).alias("src_port"),
        get("dst_port", "int", 0).alias("dst_port"),
        F.col("predicted_category").alias("attack_type"),
        F.round("confidence", 6).alias("confidence"),
        F.round("anomaly_score", 6).alias("anomaly_score"),
        "severity", "is_zero_day_suspect",
        get("is_synthetic", "boolean", False).alias("is_synthetic"),
        F.lit("PENDING").alias("mitigation_status"),
        F.lit(None).cast("timestamp_ntz").alias("mitigated_at"),
        F.lit(None).cast("struct<status:string,reason:string,rule_number:int,ttl_epoch:bigint>")
        .alias("mitigation_details"),
        raw.alias("raw_features"),
    )


def log_rows(classified: DataFrame, at: Column, summary: Column | None = None) -> DataFrame:
    """Rows for the simple alert log, whose severity follows the class alone."""
    have = set(classified.columns)

    def get(name, kind, default):
        value = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        return F.coalesce(value, F.lit(default).cast(kind))

    if summary is None:
        summary = fx.log_summary(F.col("anomaly_score"), F.col("is_zero_day_suspect"), F.col("severity"))
    return classified.where("is_alert").select(
        at.alias("timestamp"),
        get("protocol_type", "string", "tcp").alias("protocol"),
        get("service", "string", "other").alias("service"),
        get("src_bytes", "long", 0).alias("src_bytes"),
        get("dst_bytes", "long", 0).alias("dst_bytes"),
        "predicted_category", "confidence",
        fx.class_severity(F.col("predicted_category")).alias("severity"),
        summary.alias("features_summary"),
    )


def explain(classified: DataFrame) -> DataFrame:
    """Add class, confidence in percent, reasons, summary text and key metrics."""
    have = set(classified.columns)
    reasons = fx.explanation_reasons(F.col("predicted_category"), have)
    return classified.withColumns({
        "confidence_pct": F.bround(F.col("confidence") * 100.0, 1),
        "primary_reasons": reasons,
        "key_metrics": fx.key_metrics(have),
    }).withColumn("summary", F.array_join("primary_reasons", "; "))


def without_targets(flows: DataFrame) -> DataFrame:
    """Lower-case the column names and drop label columns if there are any."""
    return flows.toDF(*[c.lower() for c in flows.columns]).drop(*TARGETS)
