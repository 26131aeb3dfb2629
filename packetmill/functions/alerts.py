"""Column expressions on scored flows: severity, suspicion, text and coercions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetmill.schemas import (
    ALERT_SEVERITIES, ANOMALY_THRESHOLD, CONFIDENCE_THRESHOLD, CRITICAL_THRESHOLD,
)


def zero_day_suspect(category: Column, score: Column, threshold: float = ANOMALY_THRESHOLD) -> Column:
    known = score.isNotNull() & ~F.isnan(score)
    return F.coalesce((category == "Normal") & known & (score < F.lit(threshold)), F.lit(False))


def severity(category: Column, confidence: Column, score: Column | None = None, *,
             conf: float = CONFIDENCE_THRESHOLD, critical: float = CRITICAL_THRESHOLD,
             anomaly: float = ANOMALY_THRESHOLD) -> Column:
    suspect = F.lit(False) if score is None else zero_day_suspect(category, score, anomaly)
    grave = category.isin("DoS", "U2R")
    return (
        F.when(category == "Normal", F.when(suspect, "HIGH").otherwise("INFO"))
        .when((confidence >= conf) & grave, "CRITICAL")
        .when(confidence >= critical, "CRITICAL")
        .when(confidence >= conf, "HIGH")
        .otherwise("MEDIUM")
    )


def is_alert(sev: Column) -> Column:
    return sev.isin(ALERT_SEVERITIES)


def class_severity(category: Column) -> Column:
    """Severity of the simple alert log, which looks at the class alone."""
    return (
        F.when(category == "Normal", "INFO")
        .when(category.isin("U2R", "R2L"), "CRITICAL")
        .when(category == "DoS", "HIGH")
        .otherwise("MEDIUM")
    )


def truthy(value: Column, kind: str = "text") -> Column:
    """Boolean of a loosely typed cell; null is false.

    Of text, true, 1 and yes count, whatever the case and the white space around; a number counts
    if it is not zero (NaN is not zero); a boolean is itself.
    """
    if kind == "text":
        found = F.lower(F.regexp_replace(value, r"^\s+|\s+$", "")).isin("true", "1", "yes")
    elif kind == "number":
        found = value != 0
    elif kind == "boolean":
        found = value
    else:
        raise ValueError(f"kind is text, number or boolean, not {kind!r}")
    return F.coalesce(found, F.lit(False))


def confidence_percent(conf: Column) -> Column:
    return F.when(conf <= 1.0, conf * 100).otherwise(conf)


def percent_text(pct: Column) -> Column:
    return F.format_string("%.1f%%", pct)


def risk_band(pct: Column) -> Column:
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), pct))
    return F.when(clipped >= 95, "high").when(clipped >= 85, "medium").otherwise("low")


def log_summary(score: Column, suspect: Column, sev: Column) -> Column:
    flag = F.when(suspect, "True").otherwise("False")
    return F.concat(F.lit("anomaly="), F.format_string("%.4f", score), F.lit(" zero_day="), flag,
                    F.lit(" severity="), sev)


def batch_hit_text(category: Column) -> Column:
    return F.concat(F.lit("Batch score hit: "), category)


# ---------------------------------------------------------------------------
# Explanations. Each rule is (class, condition, text); the texts are fixed values.
# ---------------------------------------------------------------------------

def _rules(col) -> list[tuple[str, Column, Column]]:
    def two(name):
        return F.format_string("%.2f", col(name).cast("double"))

    def text(before, value, after=""):
        return F.concat(F.lit(before), value, F.lit(after))

    return [
        ("DoS", col("serror_rate") > 0.5,
         text("High SYN error rate (", two("serror_rate"), ") indicating connection floods")),
        ("DoS", col("count") > 100,
         text("Abnormally high connection count (", col("count").cast("string"), ") to same host")),
        ("DoS", col("flag") == "S0", F.lit("Connection flag S0 (SYN sent, no response acknowledged)")),
        ("Probe", col("rerror_rate") > 0.5,
         text("High REJ/RST error rate (", two("rerror_rate"), ") from rejected port probes")),
        ("Probe", col("dst_host_diff_srv_rate") > 0.3,
         text("Scanning multiple distinct services on target (", two("dst_host_diff_srv_rate"), ")")),
        ("Probe", (col("src_bytes") < 20) & (col("dst_bytes") < 20),
         F.lit("Minimal packet payload bytes sent during port sweep")),
        ("R2L", col("num_failed_logins") > 2,
         text("Multiple failed authentication attempts (", col("num_failed_logins").cast("string"), ")")),
        ("R2L", col("is_guest_login") == 1, F.lit("Unusual guest account privilege escalation attempt")),
        ("R2L", col("service").isin("ftp", "telnet", "smtp"),
         text("Targeting remote access service (", col("service"), ")")),
        ("U2R", col("root_shell") == 1, F.lit("Root shell access spawned during session")),
        ("U2R", col("num_compromised") > 0, F.lit("System file compromise indicator present")),
        ("U2R", col("src_bytes") > 1000,
         text("Large payload size (", col("src_bytes").cast("string"),
              " bytes) matching exploit buffer overflow")),
    ]


NORMAL_REASON = "Traffic characteristics match standard baseline operations"
FALLBACK_REASON = "Multi-feature statistical pattern matching trained decision boundaries"


def explanation_reasons(category: Column, available: set[str]) -> Column:
    """Array of reasons that hold for a flow; absent features count as zero."""

    def col(name):
        if name in available:
            return F.col(name)
        return F.lit(None).cast("string") if name in ("flag", "service") else F.lit(0)

    hits = [F.when((category == cls) & cond, reason) for cls, cond, reason in _rules(col)]
    hits.append(F.when(~category.isin("DoS", "Probe", "R2L", "U2R"), F.lit(NORMAL_REASON)))
    found = F.array_compact(F.array(*hits))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(FALLBACK_REASON)))


def key_metrics(available: set[str]) -> Column:
    defaults = {"protocol_type": "tcp", "service": "http", "src_bytes": 0, "dst_bytes": 0, "count": 1}
    names = {"protocol_type": "protocol"}
    return F.struct(*[
        (F.col(c) if c in available else F.lit(d)).alias(names.get(c, c)) for c, d in defaults.items()
    ])
