"""Queries on scored flows, alerts, reports and mitigation."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetmill.functions import alerts as fx
from packetmill.functions import net
from packetmill.operators import alerts as al
from packetmill.operators import mitigation as mt
from packetmill.operators import reports as rp
from packetmill.operators import updates as up
from packetmill.schemas import ALERTS
from packetmill.session import scratch_path
from packetmill.sources import adapters as A
from packetmill.sources import sinks

AS_OF = "2024-01-30 12:00:00"
NOW_EPOCH = 1706616000  # AS_OF in seconds
VERSION = "v1"

# --- DuckDB building blocks ----------------------------------------------------

_SC = f"""
sc as ({A.duck(A.SCORED)}),
cl as (select *, coalesce(predicted_category = 'Normal' and anomaly_score < -0.2, false) as is_zero_day_suspect,
  case when predicted_category = 'Normal' then
    case when coalesce(anomaly_score < -0.2, false) then 'HIGH' else 'INFO' end
   when confidence >= 0.95 then 'CRITICAL'
   when confidence >= 0.90 then case when predicted_category in ('DoS', 'U2R') then 'CRITICAL' else 'HIGH' end
   else 'MEDIUM' end as severity from sc),
al as (select md5(flow_id || '|{VERSION}') as alert_id, alert_ts, flow_id, seq, src_ip, dst_ip, src_port, dst_port,
   predicted_category as attack_type, confidence, anomaly_score, severity, is_zero_day_suspect, is_synthetic
  from cl where severity in ('CRITICAL', 'HIGH', 'MEDIUM'))"""

# Entries held before the batch: addresses whose last number ends in 0, one in two egress.
_ENTRIES = """
en as (select distinct 100 + user_id as rule_number,
   '10.0.0.' || user_id || '/32' as cidr, user_id % 20 = 0 as egress
  from events where user_id < 250 and user_id % 10 = 0)"""

_PLAN = _SC + "," + _ENTRIES + """,
q as (select alert_id, alert_ts, case when seq % 97 = 0 then 'not-an-ip' else src_ip end as src_ip, attack_type, confidence,
   seq from al where severity in ('CRITICAL', 'HIGH') and not is_synthetic),
held as (select replace(cidr, '/32', '') as src_ip, min(rule_number) as held_rule from en where not egress group by 1),
firsts as (select src_ip, alert_id, alert_ts,
    row_number() over (partition by src_ip order by alert_ts, alert_id) as rn from q
   where confidence > 0.95 and src_ip <> 'not-an-ip' and src_ip not in (select src_ip from held)),
ranked as (select src_ip, alert_id as won_id, row_number() over (order by alert_ts, alert_id) as place
   from firsts where rn = 1),
free as (select n as won_rule, row_number() over (order by n) as place from range(100, 200) t(n)
   where n not in (select rule_number from en where not egress)),
won as (select src_ip, won_id, won_rule from ranked join free using (place)),
d as (select q.alert_id, q.alert_ts, q.src_ip, q.attack_type, q.confidence,
   case when q.confidence <= 0.95 then 'SUPPRESSED' when q.src_ip = 'not-an-ip' then 'FAILED'
     when held_rule is not null then 'SUPPRESSED' when q.alert_id = won_id then 'ACTIONED'
     when won_rule is not null then 'SUPPRESSED' else 'FAILED' end as status,
   case when q.confidence <= 0.95 then 'below_confidence_threshold' when q.src_ip = 'not-an-ip' then 'invalid_ip'
     when held_rule is not null then 'already_blocked' when q.alert_id = won_id then null
     when won_rule is not null then 'already_blocked'
     else 'No free NACL rule number in [100, 199]' end as reason,
   cast(case when q.confidence > 0.95 and q.src_ip <> 'not-an-ip' then coalesce(held_rule, won_rule) end as int) as rule_number
  from q left join held using (src_ip) left join won using (src_ip)),
""" + f"""
dec as (select *, cast(case when status = 'ACTIONED' then {NOW_EPOCH} + 86400 end as bigint) as ttl_epoch from d),
ast as (select al.*, coalesce(dec.status, 'PENDING') as mitigation_status, dec.reason, dec.rule_number, dec.ttl_epoch,
   case when dec.alert_id is not null then timestamp '{AS_OF}' end as mitigated_at
  from al left join dec using (alert_id))"""

# Tags as they may be found: good ones, a foreign prefix, bad addresses, non-numeric values.
_TAGS = """
tg as (select distinct
   case when user_id % 11 = 0 then 'other_' when user_id % 7 = 0 then 'block_ttl_x' else 'block_ttl_' end
     || '10.0.' || (user_id // 250) % 250 || '.' || user_id % 250 as key,
   case when user_id % 13 = 0 then 'soon' else cast(1706616000 + (user_id % 5 - 2) * 3600 as varchar) end as value
  from events)"""

_EXPIRY = _PLAN + "," + _TAGS + f""",
ex as (select key[11:] as src_ip, try_cast(value as bigint) as epoch from tg
  where key like 'block\\_ttl\\_%' escape '\\' and key not like 'block\\_ttl\\_x%' escape '\\'
   and try_cast(value as bigint) <= {NOW_EPOCH}),
exp as (select ex.src_ip, ex.epoch, cast(held.held_rule as bigint) as rule_number,
   case when held.held_rule is null then 'orphan' else 'block' end as kind
  from ex left join held on ex.src_ip = held.src_ip)"""


def _q(blocks, tail):
    """Named blocks and a final select; a tail that starts with a comma adds blocks."""
    return f"with {blocks.strip()}\n{tail.strip()}"


# --- Spark inputs ----------------------------------------------------------------


def _classified(spark, sf):
    return al.classify(A.scored(spark, sf))


def _alerts(spark, sf):
    return al.alert_rows(_classified(spark, sf), VERSION)


def _entries(spark, sf):
    users = A.table(spark, sf, "events").select("user_id").where("user_id < 250 and user_id % 10 = 0").distinct()
    return users.select(
        (F.lit(100) + F.col("user_id")).alias("rule_number"),
        net.cidr_of(F.concat(F.lit("10.0.0."), F.col("user_id").cast("string"))).alias("cidr"),
        (F.col("user_id") % 20 == 0).alias("egress"))


def _tags(spark, sf):
    uid = F.col("user_id")
    prefix = F.when(uid % 11 == 0, "other_").when(uid % 7 == 0, "block_ttl_x").otherwise("block_ttl_")
    ip = F.concat(F.lit("10.0."), F.expr("(user_id div 250) % 250").cast("string"), F.lit("."), (uid % 250).cast("string"))
    value = F.when(uid % 13 == 0, "soon").otherwise((F.lit(NOW_EPOCH) + (uid % 5 - 2) * 3600).cast("string"))
    return A.table(spark, sf, "events").select(F.concat(prefix, ip).alias("key"), value.alias("value")).distinct()


def _batch(spark, sf):
    """Alerts of the dispatch batch; some lose their address to exercise that check."""
    number = F.substring("flow_id", 2, 20).cast("long")
    return _alerts(spark, sf).where("severity in ('CRITICAL', 'HIGH') and not is_synthetic").withColumn(
        "src_ip", F.when(number % 97 == 0, "not-an-ip").otherwise(F.col("src_ip")))


def _decisions(spark, sf):
    return mt.plan_dispatch(_batch(spark, sf), _entries(spark, sf), NOW_EPOCH)


def _dispatched(spark, sf):
    return mt.write_back(_alerts(spark, sf), _decisions(spark, sf), rp.moment(AS_OF))


def _flat(alerts):
    d = F.col("mitigation_details")
    return alerts.select("alert_id", "mitigation_status", "mitigated_at", d["reason"].alias("reason"),
                         d["rule_number"].alias("rule_number"), d["ttl_epoch"].alias("ttl_epoch"))


# --- queries ------------------------------------------------------------------------


def severity(spark, sf):
    return _classified(spark, sf).select("flow_id", "severity")


def suspects(spark, sf):
    return _classified(spark, sf).select("flow_id", "is_zero_day_suspect")


def alert_filter(spark, sf):
    return _classified(spark, sf).where("is_alert").select("flow_id", "severity")


def live_views(spark, sf):
    return rp.live(_alerts(spark, sf)).select("alert_id", "flow_id", "severity")


def dispatchable(spark, sf):
    return mt.qualifying(_alerts(spark, sf)).select("alert_id", "flow_id", "severity", "confidence")


def confidence_display(spark, sf):
    pct = fx.confidence_percent(F.col("confidence"))
    return _alerts(spark, sf).select("alert_id", pct.alias("confidence_pct")).select(
        "alert_id", fx.percent_text(F.col("confidence_pct")).alias("confidence_text"),
        fx.risk_band(F.col("confidence_pct")).alias("band"))


def coerced_flags(spark, sf):
    words = ("true", "\t YES\n", "1", "no", "0", "False")
    cell = F.try_element_at(F.array(*map(F.lit, words)), (F.col("event_id") % 7 + 1).cast("int"))
    return A.table(spark, sf, "events").select(
        "event_id", fx.truthy(cell).alias("flag"), fx.truthy(F.col("event_id") % 3, "number").alias("number_flag"),
        fx.truthy(F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 2 == 0), "boolean").alias("boolean_flag"))


def log_severity(spark, sf):
    return A.scored(spark, sf).select("flow_id", fx.class_severity(F.col("predicted_category")).alias("severity"))


def alert_sink_rows(spark, sf):
    """The table after two appended halves, as it is read back. One flow in seven has lost its source port."""
    path = scratch_path(spark, "alert-table")
    flows = A.scored(spark, sf).withColumn("src_port", F.when(F.col("seq") % 7 != 0, F.col("src_port")))
    rows = al.alert_rows(al.classify(flows), VERSION)
    for half in (0, 1):
        sinks.append(rows.where(F.pmod(F.xxhash64("alert_id"), F.lit(2)) == half), path, ALERTS)
    return spark.read.schema(ALERTS).parquet(path).select(
        "alert_id", "alert_ts", "flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "attack_type",
        "confidence", "anomaly_score", "severity", "is_zero_day_suspect", "is_synthetic", "mitigation_status",
        F.array_join(F.array_sort(F.json_object_keys("raw_features")), ",").alias("raw_fields"),
        F.get_json_object("raw_features", "$.seq").cast("long").alias("raw_seq"),
        F.get_json_object("raw_features", "$.src_port").cast("int").alias("raw_src_port"))


def alert_log_rows(spark, sf):
    rows = _classified(spark, sf).withColumn("src_bytes", F.col("seq") % 1000)
    return al.log_rows(rows, F.col("alert_ts"), fx.batch_hit_text(F.col("predicted_category")))


def alert_log_recent(spark, sf):
    rows = al.log_rows(_classified(spark, sf), F.col("seq"), fx.batch_hit_text(F.col("predicted_category")))
    return rows.select(F.col("timestamp").alias("id"), "predicted_category", "severity").orderBy(F.desc("id")).limit(500)


def alert_log_cleared(spark, sf):
    """The log after rows, a clear, and the rows of odd flows: only the latter are there, under the same schema."""
    path = scratch_path(spark, "alert-log")
    rows = al.log_rows(_classified(spark, sf), F.col("seq"), fx.batch_hit_text(F.col("predicted_category")))
    rows.write.parquet(path)
    sinks.clear(rows, path)
    rows.where("timestamp % 2 = 1").write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path).select(F.col("timestamp").alias("id"), "predicted_category", "features_summary")


def run_summary(spark, sf):
    return rp.run_summary(_classified(spark, sf))


def run_summary_text(spark, sf):
    return rp.summary_text(rp.run_summary(_classified(spark, sf)))


def kpis(spark, sf):
    return rp.kpis(_dispatched(spark, sf))


def by_class(spark, sf):
    return rp.by_class(_alerts(spark, sf))


def timeline(spark, sf):
    return rp.timeline(_alerts(spark, sf), AS_OF)


def active_blocks(spark, sf):
    done = _dispatched(spark, sf).withColumn("mitigated_at", F.col("alert_ts"))
    return rp.active_blocks(done, AS_OF)


def state_counts(spark, sf):
    return rp.counts_by(_dispatched(spark, sf), "severity", "attack_type", "mitigation_status", "is_synthetic")


def status_totals(spark, sf):
    return _dispatched(spark, sf).groupBy("mitigation_status").agg(
        F.count(F.lit(1)).alias("n"), F.count("mitigated_at").alias("dated"),
        F.count("mitigation_details.rule_number").alias("ruled"))


def threat_stream(spark, sf):
    return rp.threat_stream(_dispatched(spark, sf))


def recent_flows(spark, sf):
    rows = A.scored(spark, sf).select("flow_id", "src_ip", F.col("alert_ts").alias("created_at"))
    return rp.latest(rows, "created_at", 100, "flow_id")


def batch_poll(spark, sf):
    rows = A.scored(spark, sf).select("flow_id", F.col("alert_ts").alias("created_at"), (F.col("seq") % 3 == 0).alias("processed_flag"))
    return up.unprocessed(rows)


def window_filter(spark, sf):
    rows = A.scored(spark, sf).select(
        "flow_id", F.col("alert_ts").alias("created_at"), (F.col("seq") % 3 == 0).alias("processed_flag"), "is_synthetic")
    return up.drift_window(rows, rp.moment(AS_OF), hours=24).select("flow_id", "created_at")


def marked(spark, sf):
    rows = A.scored(spark, sf).select(
        "flow_id", "seq", F.lit(False).alias("processed_flag"), F.lit(None).cast("timestamp_ntz").alias("processed_at"))
    return up.mark_processed(rows.drop("seq"), rows.where("seq % 3 = 0"), rp.moment(AS_OF))


def inherited(spark, sf):
    flows = A.scored(spark, sf).select("flow_id", (F.col("seq") % 17 == 0).alias("is_synthetic"))
    return up.inherit_synthetic(_alerts(spark, sf), flows).select("alert_id", "is_synthetic")


def first_per_address(spark, sf):
    return mt.first_alerts(_alerts(spark, sf)).select("src_ip", F.col("first.alert_id").alias("alert_id"))


def not_yet_blocked(spark, sf):
    blocked = mt.blocked_addresses(_entries(spark, sf))
    return _alerts(spark, sf).select("src_ip").join(blocked, "src_ip", "left_anti").distinct()


def free_slots(spark, sf):
    return mt.free_rules(spark, _entries(spark, sf))


def dispatch(spark, sf):
    return _decisions(spark, sf).drop("alert_ts")


def responses(spark, sf):
    """The reply per alert as JSON text, as a scalar function would give it."""
    reply = F.to_json(F.struct("alert_id", "attack_type", "status", "src_ip", "reason", "rule_number"))
    return _decisions(spark, sf).select("alert_id", reply.alias("response"))


def write_back(spark, sf):
    return _flat(_dispatched(spark, sf))


def block_ledger(spark, sf):
    return mt.list_blocks(mt.ledger(_decisions(spark, sf), rp.moment(AS_OF)))


def _expired(spark, sf):
    return mt.plan_expiry(_tags(spark, sf), _entries(spark, sf), NOW_EPOCH)


def expiry(spark, sf):
    return _expired(spark, sf)


def expired_union(spark, sf):
    return mt.expired_addresses(_expired(spark, sf))


def expired_alerts(spark, sf):
    return mt.expire_alerts(_dispatched(spark, sf), mt.expired_addresses(_expired(spark, sf)), rp.moment(AS_OF)).select(
        "alert_id", "mitigation_status")


def ledger_after_expiry(spark, sf):
    blocks = mt.ledger(_decisions(spark, sf), rp.moment(AS_OF))
    return mt.remaining_blocks(blocks, mt.expired_addresses(_expired(spark, sf))).select("rule_id", "src_ip", "rule_number")


def addresses(spark, sf):
    ip = _batch(spark, sf).select("src_ip").distinct()
    key = net.ttl_tag_of(F.col("src_ip"))
    return ip.select(
        "src_ip", net.is_ipv4(F.col("src_ip")).alias("valid"), net.cidr_of(F.col("src_ip")).alias("cidr"),
        key.alias("tag"), net.ip_of_ttl_tag(key).alias("back"))


def latest_status(spark, sf):
    """Latest status per alert from an append-only log of two events each."""
    first = _alerts(spark, sf).select("flow_id", "mitigation_status", F.lit(0).alias("step"))
    second = _flat(_dispatched(spark, sf)).join(_alerts(spark, sf).select("alert_id", "flow_id"), "alert_id").select(
        "flow_id", "mitigation_status", F.lit(1).alias("step"))
    return rp.latest_per_key(first.unionByName(second), ["flow_id"], ["step"])


def table_counts(spark, sf):
    names = ("events", "orders", "lineitem", "customer")
    return rp.row_counts({n: A.table(spark, sf, n) for n in names})


def explanations(spark, sf):
    """Explanations of flows whose features come from the event values."""
    n = F.col("seq")
    rows = A.scored(spark, sf).withColumns({
        "serror_rate": (n % 100) / F.lit(100.0), "count": n % 300,
        "flag": F.when(n % 4 == 0, "S0").otherwise("SF"),
        "rerror_rate": (n % 90) / F.lit(100.0), "dst_host_diff_srv_rate": (n % 70) / F.lit(100.0),
        "src_bytes": n % 2500, "dst_bytes": n % 50, "num_failed_logins": n % 5,
        "is_guest_login": (n % 6 == 0).cast("int"),
        "service": F.when(n % 3 == 0, "ftp").when(n % 3 == 1, "http").otherwise("telnet"),
        "root_shell": (n % 8 == 0).cast("int"), "num_compromised": n % 3,
    })
    return al.explain(rows)


def explained(spark, sf):
    m = F.col("key_metrics")
    return explanations(spark, sf).select(
        "flow_id", "confidence_pct", F.size("primary_reasons").alias("n_reasons"), m["protocol"].alias("protocol"),
        m["service"].alias("service"), m["count"].alias("count"))


def summaries(spark, sf):
    return explanations(spark, sf).select("flow_id", "summary")


_REASONS = f"""
with sc as ({A.duck(A.SCORED)}),
r as (select *, seq % 100 / 100.0::double as se, seq % 300 as cnt, seq % 90 / 100.0::double as re,
   seq % 70 / 100.0::double as ds, seq % 2500 as sb,
   case seq % 3 when 0 then 'ftp' when 1 then 'http' else 'telnet' end as service from sc),
x as (select *, list_filter(case predicted_category
  when 'DoS' then [case when se > 0.5 then 'High SYN error rate (' || printf('%.2f', se) || ') indicating connection floods' end,
    case when cnt > 100 then 'Abnormally high connection count (' || cnt || ') to same host' end,
    case when seq % 4 = 0 then 'Connection flag S0 (SYN sent, no response acknowledged)' end]
  when 'Probe' then [case when re > 0.5 then 'High REJ/RST error rate (' || printf('%.2f', re) || ') from rejected port probes' end,
    case when ds > 0.3 then 'Scanning multiple distinct services on target (' || printf('%.2f', ds) || ')' end,
    case when sb < 20 and seq % 50 < 20 then 'Minimal packet payload bytes sent during port sweep' end]
  when 'R2L' then [case when seq % 5 > 2 then 'Multiple failed authentication attempts (' || seq % 5 || ')' end,
    case when seq % 6 = 0 then 'Unusual guest account privilege escalation attempt' end,
    case when service in ('ftp', 'telnet') then 'Targeting remote access service (' || service || ')' end]
  when 'U2R' then [case when seq % 8 = 0 then 'Root shell access spawned during session' end,
    case when seq % 3 > 0 then 'System file compromise indicator present' end,
    case when sb > 1000 then 'Large payload size (' || sb || ' bytes) matching exploit buffer overflow' end]
  else ['Traffic characteristics match standard baseline operations'] end, lambda v: v is not null) as found from r),
y as (select *, case when len(found) = 0 then ['Multi-feature statistical pattern matching trained decision boundaries']
   else found end as reasons from x)
"""

QUERIES = {
    "p12_severity": (severity, _q(_SC, "select flow_id, severity from cl")),
    "p13_zero_day_suspect": (suspects, _q(_SC, "select flow_id, is_zero_day_suspect from cl")),
    "p14_alert_filter": (alert_filter, _q(_SC, "select flow_id, severity from al")),
    "p15_explanation": (explained, _REASONS + """
        select flow_id, round(confidence * 100, 1) as confidence_pct, cast(len(reasons) as int) as n_reasons,
          'tcp' as protocol, service, cnt as count from y"""),
    "p16_summary_text": (summaries, _REASONS + "select flow_id, array_to_string(reasons, '; ') as summary from y"),
    "p17_live_views": (live_views, _q(_SC, "select alert_id, flow_id, severity from al where not is_synthetic")),
    "p18_unprocessed_batch": (batch_poll, _q(_SC, """
        select flow_id, alert_ts as created_at, seq % 3 = 0 as processed_flag from sc where seq % 3 <> 0""")),
    "p19_drift_window": (window_filter, _q(_SC, f"""
        select flow_id, alert_ts as created_at from sc where seq % 3 = 0 and not is_synthetic
          and alert_ts >= timestamp '{AS_OF}' - interval 24 hour""")),
    "p20_dispatch_predicate": (dispatchable, _q(_SC, """
        select alert_id, flow_id, severity, confidence from al
        where severity in ('CRITICAL', 'HIGH') and confidence > 0.95 and not is_synthetic""")),
    "p21_confidence_display": (confidence_display, _q(_SC, """
        select alert_id, printf('%.1f%%', confidence * 100) as confidence_text,
          case when confidence * 100 >= 95 then 'high' when confidence * 100 >= 85 then 'medium' else 'low' end as band
        from al""")),
    "p22_boolean_coercion": (coerced_flags, """
        select event_id, event_id % 7 in (0, 1, 2) as flag, event_id % 3 <> 0 as number_flag,
          event_id % 5 <> 0 and event_id % 2 = 0 as boolean_flag from events"""),
    "x09_class_severity": (log_severity, _q(_SC, """
        select flow_id, case predicted_category when 'Normal' then 'INFO' when 'U2R' then 'CRITICAL'
          when 'R2L' then 'CRITICAL' when 'DoS' then 'HIGH' else 'MEDIUM' end as severity from sc""")),
    "x11_address_text": (addresses, _q(_PLAN, """
        select distinct src_ip, src_ip <> 'not-an-ip' as valid, src_ip || '/32' as cidr, 'block_ttl_' || src_ip as tag,
          case when src_ip <> 'not-an-ip' then src_ip end as back from q""")),
    "s06_alert_rows": (alert_sink_rows, _q(_SC, """
        select alert_id, alert_ts, flow_id, src_ip, dst_ip, cast(case when seq % 7 <> 0 then src_port else 0 end as int) as src_port,
          dst_port, attack_type, confidence, anomaly_score, severity, is_zero_day_suspect, is_synthetic,
          'PENDING' as mitigation_status, 'alert_ts,dst_ip,dst_port,flow_id,is_synthetic,seq,src_ip,src_port' as raw_fields,
          seq as raw_seq, cast(case when seq % 7 <> 0 then src_port end as int) as raw_src_port
        from al""")),
    "s07_alert_log_rows": (alert_log_rows, _q(_SC, """
        select alert_ts as timestamp, 'tcp' as protocol, 'other' as service, seq % 1000 as src_bytes,
          0::bigint as dst_bytes, predicted_category, confidence,
          case predicted_category when 'Normal' then 'INFO' when 'U2R' then 'CRITICAL' when 'R2L' then 'CRITICAL'
            when 'DoS' then 'HIGH' else 'MEDIUM' end as severity,
          'Batch score hit: ' || predicted_category as features_summary
        from cl where severity in ('CRITICAL', 'HIGH', 'MEDIUM')""")),
    "s08_alert_log_recent": (alert_log_recent, _q(_SC, """
        select seq as id, predicted_category, case predicted_category when 'Normal' then 'INFO' when 'U2R' then 'CRITICAL'
          when 'R2L' then 'CRITICAL' when 'DoS' then 'HIGH' else 'MEDIUM' end as severity
        from cl where severity in ('CRITICAL', 'HIGH', 'MEDIUM') order by seq desc limit 500""")),
    "s08_alert_log_cleared": (alert_log_cleared, _q(_SC, """
        select seq as id, predicted_category, 'Batch score hit: ' || predicted_category as features_summary
        from cl where severity in ('CRITICAL', 'HIGH', 'MEDIUM') and seq % 2 = 1""")),
    "j02_status_merge": (write_back, _q(_PLAN, """
        select alert_id, mitigation_status, mitigated_at, reason, rule_number, ttl_epoch from ast""")),
    "j03_mark_processed": (marked, _q(_SC, f"""
        select flow_id, seq % 3 = 0 as processed_flag, case when seq % 3 = 0 then timestamp '{AS_OF}' end as processed_at
        from sc""")),
    "j04_inherit_synthetic": (inherited, _q(_SC, """
        select alert_id, is_synthetic or seq % 17 = 0 as is_synthetic from al""")),
    "j05_expire_alerts": (expired_alerts, _q(_EXPIRY, """
        select alert_id, case when mitigation_status = 'ACTIONED' and src_ip in (select src_ip from exp)
          then 'EXPIRED' else mitigation_status end as mitigation_status from ast""")),
    "j06_not_yet_blocked": (not_yet_blocked, _q(_PLAN, """
        select distinct src_ip from al where src_ip not in (select src_ip from held)""")),
    "j07_free_rules": (free_slots, _q(_PLAN, "select cast(won_rule as int) as rule_number, cast(place as int) as place from free")),
    "j08_expired_tags": (expiry, _q(_EXPIRY, "select src_ip, epoch, rule_number, kind from exp")),
    "w08_first_alert_per_address": (first_per_address, _q(_SC, """
        select src_ip, arg_min(alert_id, (alert_ts, alert_id)) as alert_id from al group by 1""")),
    "a02_run_summary": (run_summary, _q(_SC, """
        select (select count(*) from cl) as scored, count(*) as alerts_raised,
          count(*) filter (where severity = 'CRITICAL') as critical from al""")),
    "d02_summary_text": (run_summary_text, _q(_SC, """
        select 'scored=' || (select count(*) from cl) || ' rows, alerts_raised=' || count(*) || ', critical=' ||
          count(*) filter (where severity = 'CRITICAL') as summary from al""")),
    "a03_kpis": (kpis, _q(_PLAN, """
        select count(*) filter (where not is_synthetic) as total_alerts,
          count(*) filter (where not is_synthetic and severity = 'CRITICAL') as critical,
          count(*) filter (where not is_synthetic and severity = 'HIGH') as high,
          count(distinct case when not is_synthetic and mitigation_status = 'ACTIONED' then src_ip end) as active_blocks,
          count(*) filter (where is_synthetic) as synthetic_alerts from ast""")),
    "a04_alerts_by_class": (by_class, _q(_SC, """
        select attack_type as classification, count(*) as count from al where not is_synthetic group by 1""")),
    "a05_hourly_timeline": (timeline, _q(_SC, f"""
        select date_trunc('hour', alert_ts) as hour_bucket, attack_type as classification, count(*) as count
        from al where not is_synthetic and alert_ts >= timestamp '{AS_OF}' - interval 72 hour group by 1, 2""")),
    "a06_active_blocks": (active_blocks, _q(_PLAN, f"""
        , b as (select src_ip, min(alert_ts) as first_alert_ts, max(alert_ts) as mitigated_at, count(*) as alert_count,
          max(alert_ts) + interval 24 hour as expires_at,
          epoch_us(date_trunc('second', max(alert_ts) + interval 24 hour)) // 1000000 - {NOW_EPOCH} as ttl_seconds
         from ast where mitigation_status = 'ACTIONED' and not is_synthetic group by 1)
        select *, case when ttl_seconds > 0 then (ttl_seconds // 3600) || 'h ' || ((ttl_seconds % 3600) // 60) || 'm'
          else 'EXPIRED' end as ttl_text from b""")),
    "a07_state_counts": (state_counts, _q(_PLAN, """
        select severity, attack_type, mitigation_status, is_synthetic, count(*) as n from ast group by all""")),
    "a17_table_counts": (table_counts, """
        select 'events' as table_name, count(*) as n from events union all select 'orders', count(*) from orders
        union all select 'lineitem', count(*) from lineitem union all select 'customer', count(*) from customer"""),
    "o01_threat_stream": (threat_stream, _q(_PLAN, """
        select alert_id, alert_ts, src_ip, dst_ip, src_port, dst_port, attack_type, confidence, anomaly_score, severity,
          mitigation_status from ast where not is_synthetic order by alert_ts desc, alert_id limit 100""")),
    "o03_recent_flows": (recent_flows, _q(_SC, """
        select flow_id, src_ip, alert_ts as created_at from sc order by alert_ts desc, flow_id limit 100""")),
    "o07_latest_status": (latest_status, _q(_PLAN, """
        select flow_id, mitigation_status, 1 as step from ast""")),
    "m01_dispatch_plan": (dispatch, _q(_PLAN, """
        select alert_id, src_ip, attack_type, confidence, status, reason, rule_number, ttl_epoch from dec""")),
    "d01_mitigation_response": (responses, _q(_PLAN, """
        select alert_id, '{"alert_id":"' || alert_id || '","attack_type":"' || attack_type || '","status":"' || status
          || '","src_ip":"' || src_ip || '"' || coalesce(',"reason":"' || reason || '"', '')
          || coalesce(',"rule_number":' || rule_number, '') || '}' as response from dec""")),
    "m02_status_write_back": (status_totals, _q(_PLAN, """
        select mitigation_status, count(*) as n, count(mitigated_at) as dated, count(rule_number) as ruled from ast group by 1""")),
    "m03_block_ledger": (block_ledger, _q(_PLAN, f"""
        select md5(alert_id || '|' || src_ip) as rule_id, src_ip, alert_id, attack_type, confidence, status, ttl_epoch,
          rule_number, timestamp '{AS_OF}' as created_at from dec where status = 'ACTIONED'""")),
    "m04_expiry": (ledger_after_expiry, _q(_EXPIRY, """
        select md5(alert_id || '|' || src_ip) as rule_id, src_ip, rule_number from dec
        where status = 'ACTIONED' and src_ip not in (select src_ip from exp)""")),
    "u01_expired_union": (expired_union, _q(_EXPIRY, "select distinct src_ip from exp")),
}
