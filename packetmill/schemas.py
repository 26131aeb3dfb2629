"""Column sets, defaults, domains and thresholds of the data model."""

from __future__ import annotations

import os

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# The 41 connection features in canonical order.
# ---------------------------------------------------------------------------
FEATURES = [
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes", "land", "wrong_fragment",
    "urgent", "hot", "num_failed_logins", "logged_in", "num_compromised", "root_shell", "su_attempted",
    "num_root", "num_file_creations", "num_shells", "num_access_files", "num_outbound_cmds", "is_host_login",
    "is_guest_login", "count", "srv_count", "serror_rate", "srv_serror_rate", "rerror_rate",
    "srv_rerror_rate", "same_srv_rate", "diff_srv_rate", "srv_diff_host_rate", "dst_host_count",
    "dst_host_srv_count", "dst_host_same_srv_rate", "dst_host_diff_srv_rate", "dst_host_same_src_port_rate",
    "dst_host_srv_diff_host_rate", "dst_host_serror_rate", "dst_host_srv_serror_rate", "dst_host_rerror_rate",
    "dst_host_srv_rerror_rate",
]
CATEGORICAL = ["protocol_type", "service", "flag"]
NUMERIC = [c for c in FEATURES if c not in CATEGORICAL]
RATES = [c for c in FEATURES if c.endswith("_rate")]
TARGETS = ["attack_category", "label", "difficulty"]

# Defaults of absent features that are neither 0 nor 0.0.
SPECIAL_DEFAULTS = {
    "protocol_type": "tcp", "service": "other", "flag": "SF",
    "count": 1, "srv_count": 1, "same_srv_rate": 1.0,
    "dst_host_count": 255, "dst_host_srv_count": 255, "dst_host_same_srv_rate": 1.0,
}

# Features that a flow assembled from packets always carries as zero.
CONTENT_FEATURES = [
    "hot", "num_failed_logins", "logged_in", "num_compromised", "root_shell", "su_attempted", "num_root",
    "num_file_creations", "num_shells", "num_access_files", "num_outbound_cmds", "is_host_login",
    "is_guest_login",
]

CLASSES = ["Normal", "DoS", "Probe", "R2L", "U2R"]
DRIFT_CLASS = "MODEL_DRIFT_ALERT"
ALERT_SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM"]


def _env(name: str, default: float) -> float:
    try:
        return float(os.environ.get(name, ""))
    except ValueError:
        return default


# Thresholds, each overridable from the environment.
CONFIDENCE_THRESHOLD = _env("CONFIDENCE_THRESHOLD", 0.90)
CRITICAL_THRESHOLD = _env("CRITICAL_CONFIDENCE_THRESHOLD", 0.95)
ANOMALY_THRESHOLD = _env("ANOMALY_THRESHOLD", -0.2)
PSI_THRESHOLD = _env("PSI_DRIFT_THRESHOLD", 0.25)
PSI_EPS = 1e-4
DISPATCH_CONFIDENCE = 0.95
RULE_START, RULE_END = 100, 199
BLOCK_TTL_HOURS = 24
IDLE_US = 30_000_000
ACTIVE_US = 120_000_000
CONN_WINDOW_US = 2_000_000
HOST_WINDOW_ROWS = 100
TTL_TAG_PREFIX = "block_ttl_"


def feature_default(name: str):
    if name in SPECIAL_DEFAULTS:
        return SPECIAL_DEFAULTS[name]
    return 0.0 if name in RATES else 0


def feature_type(name: str) -> T.DataType:
    if name in CATEGORICAL:
        return T.StringType()
    return T.DoubleType() if name in RATES else T.LongType()


ID_FIELDS = [
    T.StructField("flow_id", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
]

PACKETS = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("flags", T.StringType()),
    T.StructField("length", T.LongType()),
    T.StructField("fragment_offset", T.LongType()),
])

FLOW_FEATURES = T.StructType(
    ID_FIELDS
    + [T.StructField(c, feature_type(c)) for c in FEATURES]
    + [
        T.StructField("is_synthetic", T.BooleanType()),
        T.StructField("processed_flag", T.BooleanType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("processed_at", T.TimestampNTZType()),
    ]
)

# The 43-column labelled training layout (41 features, label, difficulty).
LABELLED = T.StructType(
    [T.StructField(c, feature_type(c)) for c in FEATURES]
    + [T.StructField("label", T.StringType()), T.StructField("difficulty", T.IntegerType())]
)

MITIGATION_DETAILS = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("rule_number", T.IntegerType()),
    T.StructField("ttl_epoch", T.LongType()),
])

ALERTS = T.StructType([
    T.StructField("alert_id", T.StringType()),
    T.StructField("alert_ts", T.TimestampNTZType()),
    T.StructField("flow_id", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("attack_type", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("anomaly_score", T.DoubleType()),
    T.StructField("severity", T.StringType()),
    T.StructField("is_zero_day_suspect", T.BooleanType()),
    T.StructField("is_synthetic", T.BooleanType()),
    T.StructField("mitigation_status", T.StringType()),
    T.StructField("mitigated_at", T.TimestampNTZType()),
    T.StructField("mitigation_details", MITIGATION_DETAILS),
    T.StructField("raw_features", T.StringType()),
])

REGISTRY = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("stage_path", T.StringType()),
    T.StructField("model_type", T.StringType()),
    T.StructField("training_metrics", T.StringType()),
    T.StructField("is_active", T.BooleanType()),
    T.StructField("registered_at", T.TimestampNTZType()),
])

DRIFT_REPORTS = T.StructType([
    T.StructField("report_id", T.StringType()),
    T.StructField("check_ts", T.TimestampNTZType()),
    T.StructField("window_start", T.TimestampNTZType()),
    T.StructField("window_end", T.TimestampNTZType()),
    T.StructField("max_psi", T.DoubleType()),
    T.StructField("drifted_features", T.ArrayType(T.StructType([
        T.StructField("feature", T.StringType()),
        T.StructField("psi", T.DoubleType()),
        T.StructField("threshold_exceeded", T.BooleanType()),
    ]))),
    T.StructField("feature_psi_details", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("status", T.StringType()),
])
