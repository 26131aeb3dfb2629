from pyspark.sql import functions as F

from packetmill.operators import drift, mitigation as mt
from packetmill.operators.reports import moment

ENTRY = "rule_number int, cidr string, egress boolean"
ALERT = "alert_id string, alert_ts long, src_ip string, confidence double, attack_type string"


def plan(spark, alerts, entries=(), **kw):
    rows = [(f"a{i}", i, ip, conf, "DoS") for i, (ip, conf) in enumerate(alerts)]
    out = mt.plan_dispatch(spark.createDataFrame(rows, ALERT), spark.createDataFrame(list(entries), ENTRY), 1000, **kw)
    return [(r.status, r.reason, r.rule_number) for r in out.orderBy("alert_ts").collect()]


def test_outcome_table(spark):
    assert plan(spark, [("1.2.3.4", .95), ("1.2.3.4", .98), ("not-an-ip", .99), (None, .99), ("1.2.3.4", None), ("1.2.3.4", .97)]) == [
        ("SUPPRESSED", "below_confidence_threshold", None), ("ACTIONED", None, 100), ("FAILED", "invalid_ip", None),
        ("FAILED", "invalid_ip", None), ("SUPPRESSED", "below_confidence_threshold", None), ("SUPPRESSED", "already_blocked", 100)]


def test_existing_blocks_and_egress(spark):
    entries = [(111, "1.2.3.4/32", False), (100, "9.9.9.9/32", False), (101, "8.8.8.8/32", True)]
    assert plan(spark, [("1.2.3.4", .99), ("8.8.8.8", .97)], entries) == [
        ("SUPPRESSED", "already_blocked", 111), ("ACTIONED", None, 101)]


def test_same_address_three_times(spark):
    assert [s for s, *_ in plan(spark, [("192.168.1.34", c) for c in (.950285, .953653, .953992)])] == ["ACTIONED", "SUPPRESSED", "SUPPRESSED"]


def test_exhaustion(spark):
    got = plan(spark, [("1.1.1.1", .99), ("2.2.2.2", .99), ("2.2.2.2", .99), ("1.1.1.1", .99)], [(10, "7.7.7.7/32", False), (11, "6.6.6.6/32", False)],
               rule_start=10, rule_end=12)
    assert [(s, n) for s, _, n in got] == [("ACTIONED", 12), ("FAILED", None), ("FAILED", None), ("SUPPRESSED", 12)]
    assert got[1][1] == "No free NACL rule number in [10, 12]"


def test_ttl_is_at_least_one_hour(spark):
    rows = spark.createDataFrame([("a", 0, "1.1.1.1", .99, "DoS")], ALERT)
    out = mt.plan_dispatch(rows, spark.createDataFrame([], ENTRY), 1000, ttl_hours=0).first()
    assert out.ttl_epoch == 1000 + 3600


def test_expiry(spark):
    tags = spark.createDataFrame([("block_ttl_1.1.1.1", "100"), ("block_ttl_2.2.2.2", "9999999999"), ("block_ttl_bad-ip", "1"), ("other", "1"),
                                  ("block_ttl_3.3.3.3", "400"), ("block_ttl_4.4.4.4", "soon")], "key string, value string")
    entries = spark.createDataFrame([(100, "1.1.1.1/32", False), (101, "2.2.2.2/32", False), (102, "3.3.3.3/32", True)], ENTRY)
    rows = mt.plan_expiry(tags, entries, 500)
    assert [(r.src_ip, r.epoch, r.kind) for r in rows.collect()] == [("1.1.1.1", 100, "block"), ("3.3.3.3", 400, "orphan")]
    alerts = spark.createDataFrame([("a", "1.1.1.1", "ACTIONED"), ("b", "1.1.1.1", "FAILED"), ("c", "2.2.2.2", "ACTIONED")],
                                   "alert_id string, src_ip string, mitigation_status string").withColumns({
        "mitigated_at": F.lit(None).cast("timestamp_ntz"),
        "mitigation_details": F.lit(None).cast("struct<status:string,reason:string,rule_number:int,ttl_epoch:bigint>")})
    out = mt.expire_alerts(alerts, mt.expired_addresses(rows), moment("2024-01-01 00:00:00"))
    assert {r.alert_id: r.mitigation_status for r in out.collect()} == {"a": "EXPIRED", "b": "FAILED", "c": "ACTIONED"}


def test_drift_alert_is_not_dispatched(spark):
    report = spark.createDataFrame([("r", "ALERT")], "report_id string, status string").withColumn("check_ts", moment("2024-01-01 00:00:00"))
    alert = drift.drift_alerts(report)
    assert mt.qualifying(alert).count() == 0 and mt.qualifying(alert, compat=True).count() == 1
