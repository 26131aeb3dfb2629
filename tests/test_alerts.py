from pyspark.sql import functions as F

from packetmill.functions import alerts as fx
from packetmill.functions import net
from packetmill.functions.labels import macro_class
from packetmill.operators import alerts as al
from packetmill.operators import reports, updates

FLOW = "flow_id string, predicted_category string, confidence double, anomaly_score double"


def test_severity_truth_table(spark):
    table = [("Normal", .99, "INFO"), ("DoS", .91, "CRITICAL"), ("U2R", .95, "CRITICAL"), ("Probe", .91, "HIGH"),
             ("R2L", .91, "HIGH"), ("Probe", .96, "CRITICAL"), ("R2L", .80, "MEDIUM")]
    df = spark.createDataFrame(table, "c string, p double, want string")
    assert df.where(fx.severity(F.col("c"), F.col("p")) != F.col("want")).count() == 0
    # Inverted thresholds: critical below the confidence limit.
    low = fx.severity(F.lit("R2L"), F.lit(.6), conf=.9, critical=.5)
    assert spark.range(1).select(low).first()[0] == "CRITICAL"


def test_zero_day(spark):
    rows = [("Normal", -.5, True), ("Normal", -.1, False), ("DoS", -.5, False), ("Normal", None, False), ("Normal", float("nan"), False)]
    df = spark.createDataFrame(rows, "c string, s double, want boolean")
    assert df.where(fx.zero_day_suspect(F.col("c"), F.col("s")) != F.col("want")).count() == 0
    assert df.limit(1).select(fx.severity(F.col("c"), F.lit(.5), F.col("s"))).first()[0] == "HIGH"


def test_alert_rows_repeat_on_retry(spark):
    df = al.classify(spark.createDataFrame([("f1", "DoS", .9512345678, -.1), ("f2", "Normal", .9, -.1)], FLOW))
    one, two = (al.alert_rows(df, "v1").collect() for _ in range(2))
    assert one == two and len(one) == 1
    row = one[0]
    assert (row.confidence, row.severity, row.mitigation_status) == (.951235, "CRITICAL", "PENDING")
    assert row.raw_features == '{"flow_id":"f1"}'


def test_log_rows_use_class_severity(spark):
    df = al.classify(spark.createDataFrame([("f1", "R2L", .5, -.12345)], FLOW))
    row = al.log_rows(df, F.lit("now")).first()
    assert (row.severity, row.protocol, row.service) == ("CRITICAL", "tcp", "other")
    assert row.features_summary == "anomaly=-0.1235 zero_day=False severity=MEDIUM" or row.features_summary.startswith("anomaly=-0.123")


def test_explanations(spark):
    df = spark.createDataFrame([("DoS", .9876, .75, 150, "S0"), ("DoS", .5, 0., 1, "SF"), ("Normal", .5, 0., 1, "SF")],
                               "predicted_category string, confidence double, serror_rate double, count int, flag string")
    rows = al.explain(df).collect()
    assert rows[0].primary_reasons == [
        "High SYN error rate (0.75) indicating connection floods",
        "Abnormally high connection count (150) to same host",
        "Connection flag S0 (SYN sent, no response acknowledged)"]
    assert rows[0].confidence_pct == 98.8 and rows[0].key_metrics["service"] == "http"
    assert rows[1].primary_reasons == [fx.FALLBACK_REASON] and rows[2].primary_reasons == [fx.NORMAL_REASON]


def test_labels(spark):
    rows = [(" Neptune. ", "DoS"), ("normal", "Normal"), ("\tSATAN..", "Probe"), ("never-seen", "Normal"), ("xterm", "U2R"), ("spy", "R2L"), (None, "Normal")]
    df = spark.createDataFrame(rows, "l string, want string")
    assert df.where(macro_class(F.col("l")) != F.col("want")).count() == 0


def test_epoch_text_like_c_format(spark):
    us = [1704067200000500, 1704067200001500, 1704067200012345, 1704067201234500, 1704067200000499, 1704067299999501]
    df = spark.createDataFrame([(u, f"{u / 1e6:.3f}") for u in us], "u long, want string")
    assert df.where(net.epoch_millis_text(F.col("u")) != F.col("want")).count() == 0


def test_addresses(spark):
    rows = [("1.2.3.4", True), ("255.255.255.255", True), ("256.1.1.1", False), ("01.2.3.4", False), ("1.2.3", False), ("::1", False), (None, False)]
    df = spark.createDataFrame(rows, "ip string, want boolean")
    assert df.where(net.is_ipv4(F.col("ip")) != F.col("want")).count() == 0


def test_updates(spark):
    flows = spark.createDataFrame([("a", False, False), ("b", False, True)], "flow_id string, processed_flag boolean, is_synthetic boolean"
                                  ).withColumn("processed_at", F.lit(None).cast("timestamp_ntz"))
    done = updates.mark_processed(flows, flows.where("flow_id = 'a'"), reports.moment("2024-01-01 00:00:00"))
    assert {(r.flow_id, r.processed_flag, r.processed_at is not None) for r in done.collect()} == {("a", True, True), ("b", False, False)}
    alerts = spark.createDataFrame([("a", False), ("b", False)], "flow_id string, is_synthetic boolean")
    assert {tuple(r) for r in updates.inherit_synthetic(alerts, flows).select("flow_id", "is_synthetic").collect()} == {("a", False), ("b", True)}


def test_raw_features_keep_null_fields(spark):
    rows = spark.sql("select 'f1' flow_id, cast(null as string) src_ip, 'DoS' predicted_category, 0.99D confidence, -0.1D anomaly_score")
    raw = al.alert_rows(al.classify(rows), "v1").first().raw_features
    assert '"src_ip":null' in raw and '"flow_id":"f1"' in raw


def test_truthiness_follows_the_type(spark):
    row = spark.range(1).select(
        fx.truthy(F.lit("\t True\n")).alias("a"), fx.truthy(F.lit("2")).alias("b"), fx.truthy(F.lit(2), "number").alias("c"),
        fx.truthy(F.lit(0.0), "number").alias("d"), fx.truthy(F.lit(None).cast("boolean"), "boolean").alias("e")).first()
    assert tuple(row) == (True, False, True, False, False)
