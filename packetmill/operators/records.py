"""From assembled flows to the 49-field flow record (8 ids and times, 41 features)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetmill.operators import conn, flows
from packetmill.schemas import CONTENT_FEATURES, FEATURES

IDS = ["flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "flow_start_time", "timestamp"]


def flow_records(packets: DataFrame, clock: str = "event_time", **windows) -> DataFrame:
    assembled = flows.describe(flows.assemble(packets, clock))
    return to_record(conn.connection_windows(assembled, **windows))


def to_record(windowed: DataFrame) -> DataFrame:
    """Project the record columns; content features are not observable and stay zero."""
    constant = {c: F.lit(0) for c in CONTENT_FEATURES}
    constant["srv_diff_host_rate"] = F.lit(0.0)
    constant["protocol_type"] = F.col("protocol")
    return windowed.withColumns(constant).select(*IDS, *FEATURES)
