"""Block planning and expiry as set operations on tables.

A batch of alerts is decided in one job: the first alert of each new address competes for
a free rule number, every other alert follows from the decision on its address. Only the
at most ``rule_end - rule_start + 1`` winners are ranked or broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetmill.functions import net
from packetmill.schemas import (
    BLOCK_TTL_HOURS, DISPATCH_CONFIDENCE, DRIFT_CLASS, RULE_END, RULE_START, TTL_TAG_PREFIX,
)


def qualifying(alerts: DataFrame, compat: bool = False) -> DataFrame:
    """Alerts to dispatch. Drift alerts carry no address and are left out unless ``compat``."""
    keep = (
        F.col("severity").isin("CRITICAL", "HIGH")
        & (F.col("confidence") > DISPATCH_CONFIDENCE)
        & (F.col("mitigation_status") == "PENDING")
        & ~F.col("is_synthetic")
    )
    if not compat:
        keep = keep & (F.col("attack_type") != DRIFT_CLASS)
    return alerts.where(keep)


def ingress(entries: DataFrame) -> DataFrame:
    return entries.where(~F.coalesce("egress", F.lit(False)))


def blocked_addresses(entries: DataFrame) -> DataFrame:
    """Address and lowest rule number of each /32 ingress entry."""
    return (
        ingress(entries).where(F.col("cidr").endswith("/32"))
        .groupBy(F.regexp_replace("cidr", "/32$", "").alias("src_ip"))
        .agg(F.min("rule_number").alias("rule_number"))
    )


def free_rules(spark: SparkSession, entries: DataFrame, start: int = RULE_START,
               end: int = RULE_END) -> DataFrame:
    """Unused rule numbers of the range, numbered from 1 in ascending order."""
    end = max(start, end)
    numbers = spark.range(start, end + 1).select(F.col("id").cast("int").alias("rule_number"))
    used = ingress(entries).select(F.col("rule_number").cast("int")).distinct()
    free = numbers.join(used, "rule_number", "left_anti")
    return free.withColumn("place", F.row_number().over(
        Window.partitionBy(F.lit(0)).orderBy("rule_number")))


def first_alerts(alerts: DataFrame) -> DataFrame:
    """First alert of each address by (time, id), combined on the map side."""
    return alerts.groupBy("src_ip").agg(F.min(F.struct("alert_ts", "alert_id")).alias("first"))


def _eligible(threshold: float) -> Column:
    return F.coalesce(F.col("confidence") > threshold, F.lit(False)) & net.is_ipv4(F.col("src_ip"))


def plan_dispatch(alerts: DataFrame, entries: DataFrame, now_epoch: int, *,
                  rule_start: int = RULE_START, rule_end: int = RULE_END,
                  ttl_hours: int = BLOCK_TTL_HOURS,
                  threshold: float = DISPATCH_CONFIDENCE) -> DataFrame:
    """One decision per alert: ACTIONED, SUPPRESSED or FAILED with reason, rule and TTL."""
    spark = alerts.sparkSession
    rule_end = max(rule_start, rule_end)
    blocked = blocked_addresses(entries).withColumnRenamed("rule_number", "held_rule")
    fresh = first_alerts(alerts.where(_eligible(threshold)).join(blocked, "src_ip", "left_anti"))
    # No more than the size of the range can win, so ranking runs on that many rows.
    contenders = fresh.orderBy("first").limit(rule_end - rule_start + 1)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("first"))
    winners = (
        contenders.withColumn("place", place)
        .join(free_rules(spark, entries, rule_start, rule_end), "place")
        .select("src_ip", F.col("first").alias("won_by"), F.col("rule_number").alias("won_rule"))
    )
    rows = alerts.join(blocked, "src_ip", "left").join(F.broadcast(winners), "src_ip", "left")
    opener = F.struct("alert_ts", "alert_id") == F.col("won_by")

    low = ~F.coalesce(F.col("confidence") > threshold, F.lit(False))
    bad_ip = ~net.is_ipv4(F.col("src_ip"))
    held = F.col("held_rule").isNotNull()
    won = F.col("won_rule").isNotNull()
    status = (
        F.when(low, "SUPPRESSED").when(bad_ip, "FAILED").when(held, "SUPPRESSED")
        .when(won & opener, "ACTIONED").when(won, "SUPPRESSED").otherwise("FAILED")
    )
    reason = (
        F.when(low, "below_confidence_threshold").when(bad_ip, "invalid_ip").when(held, "already_blocked")
        .when(won & opener, F.lit(None).cast("string")).when(won, "already_blocked")
        .otherwise(f"No free NACL rule number in [{rule_start}, {rule_end}]")
    )
    rule = F.when(~low & ~bad_ip, F.coalesce("held_rule", "won_rule")).cast("int")
    ttl = F.when(F.col("status") == "ACTIONED", net.ttl_epoch(F.lit(now_epoch), ttl_hours))
    return rows.select(
        "alert_id", "alert_ts", "src_ip", "attack_type", "confidence",
        status.alias("status"), reason.alias("reason"), rule.alias("rule_number"),
    ).withColumn("ttl_epoch", ttl)


def write_back(alerts: DataFrame, decisions: DataFrame, at: Column) -> DataFrame:
    """Alerts with the outcome of their decision; untouched where there is none."""
    outcome = decisions.select(
        "alert_id", F.lit(True).alias("_hit"), F.col("status").alias("_status"),
        F.struct("status", "reason", "rule_number", "ttl_epoch").alias("_details"))
    hit = F.col("_hit").isNotNull()
    joined = alerts.join(outcome, "alert_id", "left")
    return joined.withColumns({
        "mitigation_status": F.when(hit, F.coalesce("_status", F.lit("ACTIONED")))
        .otherwise(F.col("mitigation_status")),
        "mitigated_at": F.when(hit, at).otherwise(F.col("mitigated_at")),
        "mitigation_details": F.when(hit, F.col("_details")).otherwise(F.col("mitigation_details")),
    }).drop("_hit", "_status", "_details")


def ledger(decisions: DataFrame, at: Column) -> DataFrame:
    """Blocks to record: one row per ACTIONED decision, with a repeatable rule id."""
    return decisions.where("status = 'ACTIONED'").select(
        F.md5(F.concat("alert_id", F.lit("|"), "src_ip")).alias("rule_id"),
        "src_ip", "alert_id", "attack_type", "confidence", "status", "ttl_epoch",
        "rule_number", at.alias("created_at"))


def list_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.orderBy("created_at", "rule_id")


def live_blocks(decisions: DataFrame, now_epoch: int) -> DataFrame:
    """Rule entries that are still held: ACTIONED decisions whose time to live has not run out.

    An expired block gives back its rule number and its address, as the hourly expiry does.
    """
    return decisions.where((F.col("status") == "ACTIONED") & (F.col("ttl_epoch") > now_epoch)).select(
        "rule_number", net.cidr_of(F.col("src_ip")).alias("cidr"), F.lit(False).alias("egress"))


def expired_tags(tags: DataFrame, now_epoch: int, prefix: str = TTL_TAG_PREFIX) -> DataFrame:
    """Expired time-to-live tags; foreign keys, bad addresses and non-numbers are skipped."""
    return (
        tags.select(net.ip_of_ttl_tag(F.col("key"), prefix).alias("src_ip"),
                    F.col("value").try_cast("long").alias("epoch"))
        .where(F.col("src_ip").isNotNull() & (F.col("epoch") <= now_epoch))
    )


def plan_expiry(tags: DataFrame, entries: DataFrame, now_epoch: int,
                prefix: str = TTL_TAG_PREFIX) -> DataFrame:
    """Expired blocks with the rule to remove, and orphaned tags whose rule is gone."""
    held = blocked_addresses(entries)
    return (
        expired_tags(tags, now_epoch, prefix).join(held, "src_ip", "left")
        .withColumn("kind", F.when(F.col("rule_number").isNull(), "orphan").otherwise("block"))
        .orderBy(F.desc(F.col("kind") == "block"), "epoch", "src_ip")
    )


def expired_addresses(plan: DataFrame) -> DataFrame:
    """Blocks and orphans together, each address once."""
    blocks, orphans = plan.where("kind = 'block'"), plan.where("kind = 'orphan'")
    return blocks.select("src_ip").unionByName(orphans.select("src_ip")).distinct()


def expire_alerts(alerts: DataFrame, addresses: DataFrame, at: Column) -> DataFrame:
    """ACTIONED alerts of the given addresses become EXPIRED."""
    gone = addresses.select("src_ip", F.lit(True).alias("_gone"))
    hit = F.col("_gone").isNotNull() & (F.col("mitigation_status") == "ACTIONED")
    details = F.struct(F.lit("EXPIRED").alias("status"), F.lit("cleanup").alias("reason"),
                       F.lit(None).cast("int").alias("rule_number"),
                       F.lit(None).cast("long").alias("ttl_epoch"))
    return alerts.join(gone, "src_ip", "left").withColumns({
        "mitigated_at": F.when(hit, at).otherwise(F.col("mitigated_at")),
        "mitigation_details": F.when(hit, details).otherwise(F.col("mitigation_details")),
        "mitigation_status": F.when(hit, "EXPIRED").otherwise(F.col("mitigation_status")),
    }).drop("_gone")


def remaining_blocks(blocks: DataFrame, addresses: DataFrame) -> DataFrame:
    return blocks.join(addresses, "src_ip", "left_anti")
