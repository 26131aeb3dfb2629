"""Queries on landing, labels, baseline profiles and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetmill.functions.labels import macro_class
from packetmill.operators import alerts as al
from packetmill.operators import drift as dr
from packetmill.operators import flows, reports
from packetmill.plans import flow_queries as fq
from packetmill.schemas import CATEGORICAL, FEATURES, FLOW_FEATURES, RATES, feature_default
from packetmill.session import materialise, scratch_path
from packetmill.sources import adapters as A
from packetmill.sources import datasets, landing, sinks

CHECK_TS = "2024-01-30 12:00:00"
NUM, CAT = ["src_bytes", "count_"], ["service", "flag"]

# --- DuckDB building blocks ----------------------------------------------------

_LAND = f"""
ll as ({A.duck(A.LANDING_LINES)}),
ld as (select md5(file_name || '_' || file_row_number) as raw_id, file_name, file_row_number, line,
   json_valid(line) as ok, case when json_valid(line) then cast(line as json) end as doc from ll),
ex as (select raw_id, file_name, file_row_number, doc, cast(null as bigint) as flow_index, doc as src from ld
   where ok and coalesce(json_array_length(doc, '$.records'), 0) = 0
  union all
  select raw_id, file_name, file_row_number, doc, i as flow_index, json_extract(doc, '$.records[' || i || ']') as src
  from (select *, unnest(range(cast(json_array_length(doc, '$.records') as bigint))) as i from ld
   where ok and coalesce(json_array_length(doc, '$.records'), 0) > 0))"""


def _t(name):
    return f"src->>'$.{name}'"


def _typed(name):
    default = feature_default(name)
    if name in CATEGORICAL:
        return f"coalesce({_t(name)}, '{default}') as {name}"
    if name in RATES:
        return f"coalesce(cast({_t(name)} as double), {default}::double) as {name}"
    return f"coalesce(cast(round(cast({_t(name)} as double)) as bigint), {default}::bigint) as {name}"


_ID_SQL = "md5(coalesce(" + _t("flow_id") + ", " + " || '|' || ".join(
    f"coalesce({_t(c)}, '')" for c in ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")
) + f" || '|' || coalesce({_t('flow_start_time')}, {_t('timestamp')}, raw_id)))"
_SMOKE_SQL = f"(file_name ilike 'flows/smoke_%' or coalesce({_t('flow_id')} ilike 'smoke-%', false))"

# Written out here, so that an error in the library's own list shows.
_LABEL_CASES = """
  when c in ('neptune', 'back', 'land', 'pod', 'smurf', 'teardrop', 'mailbomb', 'apache2', 'processtable',
    'udpstorm') then 'DoS'
  when c in ('ipsweep', 'nmap', 'portsweep', 'satan', 'mscan', 'saint') then 'Probe'
  when c in ('ftp_write', 'guess_passwd', 'imap', 'multihop', 'phf', 'spy', 'warezclient', 'warezmaster',
    'sendmail', 'named', 'snmpgetattack', 'snmpguess', 'xlock', 'xsnoop', 'worm') then 'R2L'
  when c in ('buffer_overflow', 'loadmodule', 'perl', 'rootkit', 'httptunnel', 'ps', 'sqlattack',
    'xterm') then 'U2R'"""
_LABELS = f"""
lb as ({A.duck(A.LABELLED)}),
lm as (select event_id, label, case {_LABEL_CASES} else 'Normal' end as attack_category
  from (select *, regexp_replace(lower(trim(label)), '[.]+$', '') as c from lb))"""

_DRIFT = f"""
di as ({A.duck(A.DRIFT_INPUT)}),
nv as (select 'src_bytes' as feature, src_bytes as value, is_baseline from di
  union all select 'count_', count_, is_baseline from di),
cv as (select 'service' as feature, service as category, is_baseline from di
  union all select 'flag', flag, is_baseline from di),
qs as (select feature, unnest(list_distinct(quantile_cont(value, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) as edge
  from nv where is_baseline group by feature),
eb as (select feature, edge as lo, lead(edge) over w as hi, cast(row_number() over w - 1 as int) as bin,
   count(*) over (partition by feature) - 2 as last from qs window w as (partition by feature order by edge)),
bins as (select * from eb where hi is not null),
hist as (select b.feature, b.bin, b.lo, b.hi,
   count(v.value) filter (where v.is_baseline) as n, count(v.value) filter (where not v.is_baseline) as live_n
  from bins b left join nv v on v.feature = b.feature and v.value >= b.lo
    and (v.value < b.hi or (b.bin = b.last and v.value = b.hi)) group by all),
np as (select *, (n + 1e-4) / (sum(n) over w + 1e-4 * count(*) over w) as expected,
   (live_n + 1e-4) / (sum(live_n) over w + 1e-4 * count(*) over w) as actual
  from hist window w as (partition by feature)),
cn as (select feature, category, count(*) filter (where is_baseline) as n, count(*) filter (where not is_baseline) as live_n
  from cv group by 1, 2),
cs as (select *, n / sum(n) over w as share, live_n / sum(live_n) over w as actual from cn window w as (partition by feature)),
cp as (select feature, category, n, (share + 1e-4) / (sum(share) over w + 1e-4 * count(*) over w) as expected, actual
  from cs where n > 0 window w as (partition by feature)),
pr as (select feature, expected, actual from np union all
  select feature, expected, actual from cp union all
  select feature, 1e-4, sum(actual) from cs where n = 0 and live_n > 0 group by feature),
pe as (select feature, case when expected <= 0 then 1e-4 else expected end as e, case when actual <= 0 then 1e-4 else actual end as a from pr),
pn as (select feature, e / sum(e) over w as e, a / sum(a) over w as a from pe window w as (partition by feature)),
psi as (select feature, sum((a - e) * ln(a / e)) as psi from pn group by feature)"""


def _q(blocks, tail):
    """Named blocks and a final select; a tail that starts with a comma adds blocks."""
    return f"with {blocks.strip()}\n{tail.strip()}"


# --- Spark side --------------------------------------------------------------------


def _landed(spark, sf):
    return landing.land(A.landing_lines(spark, sf))


def _exploded(spark, sf):
    return landing.explode_records(_landed(spark, sf))


def landed(spark, sf):
    return _landed(spark, sf).select("raw_id", "file_name", "file_row_number",
                                     F.col("record_content").isNotNull().alias("parsed"))


def quarantined(spark, sf):
    return landing.quarantine(_landed(spark, sf))


def exploded(spark, sf):
    return _exploded(spark, sf).select(
        "raw_id", F.col("flow_index").cast("bigint").alias("flow_index"),
        F.try_variant_get("src", "$.src_ip", "string").alias("src_ip"))


def flattened(spark, sf):
    return landing.flatten(_exploded(spark, sf)).drop("processed_flag", "created_at", "processed_at")


def table_ids(spark, sf):
    return _exploded(spark, sf).select(
        "raw_id", F.col("flow_index").cast("bigint").alias("flow_index"), landing.table_flow_id().alias("flow_id"))


def synthetic_marks(spark, sf):
    marks = _exploded(spark, sf).select("file_name", landing.is_synthetic().alias("is_synthetic"))
    return reports.counts_by(marks, "file_name", "is_synthetic")


def accepted_counts(spark, sf):
    """Contract check: rows accepted by and rejected from the typed table."""
    flat = landing.flatten(_exploded(spark, sf))
    checked = sinks.check_contract(flat, FLOW_FEATURES)
    complete = F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull()
    return checked.agg(F.count_if(complete).alias("accepted"), F.count_if(~complete).alias("rejected"))


def recent_landings(spark, sf):
    rows = _landed(spark, sf).select("raw_id", "file_name", "file_row_number")
    return reports.latest(rows, "file_row_number", 10, "raw_id")


def json_round_trip(spark, sf):
    """Write flows as JSON lines and read them back."""
    rows = flows.describe(flows.assemble(A.packets(spark, sf))).select(
        "flow_id", "src_ip", "dst_ip", "src_bytes", "dst_bytes", "flag", "timestamp")
    path = scratch_path(spark, "json-lines")
    sinks.write_json_lines(rows, path)
    return spark.read.schema(rows.schema).json(path)


def labelled_file(spark, sf):
    """Write the labels to a headed CSV folder and read it through the dataset reader."""
    path = scratch_path(spark, "labelled") + ".csv"
    src = A.labelled(spark, sf).select("event_id", "label")
    src.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return datasets.read_labelled(spark, path, src.schema).select("event_id", "attack_category")


def labels(spark, sf):
    return A.labelled(spark, sf).select("event_id", macro_class(F.col("label")).alias("attack_category"))


def label_lookup(spark, sf):
    return reports.counts_by(labels(spark, sf), "attack_category")


def normalised_names(spark, sf):
    upper = datasets.with_attack_category(A.labelled(spark, sf)).withColumn("difficulty", F.lit(21)).toDF(
        "EVENT_ID", "LABEL", "ATTACK_CATEGORY", "DIFFICULTY")
    return al.without_targets(upper)


def target(spark, sf):
    table, name = datasets.split_target(datasets.with_attack_category(A.labelled(spark, sf)))
    return table.select("event_id", "target", F.lit(name).alias("target_column"))


def completed(spark, sf):
    few = A.scored(spark, sf).select("flow_id", (F.col("seq") % 10).alias("duration"))
    return datasets.complete(few).select("flow_id", "duration", "service", "count", "serror_rate")


def _split(spark, sf):
    rows = A.drift_input(spark, sf)
    return rows.where("is_baseline"), rows.where("not is_baseline")


def _baseline(spark, sf):
    base, _ = _split(spark, sf)
    return dr.baseline_table(dr.numeric_profile(base, NUM), dr.categorical_profile(base, CAT))


def numeric_profile(spark, sf):
    base, _ = _split(spark, sf)
    return dr.numeric_profile(base, NUM).select(
        "feature", "bin", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), "n",
        F.round("expected", 9).alias("expected"))


def categorical_profile(spark, sf):
    base, _ = _split(spark, sf)
    return dr.categorical_profile(base, CAT).select("feature", "category", "n", F.round("expected", 9).alias("expected"))


def live_histogram(spark, sf):
    _, live = _split(spark, sf)
    edges = _baseline(spark, sf).where("kind = 'numeric'").select("feature", F.col("bins").alias("edges"))
    # Binned before anything is grouped, as the drift report does.
    counts = dr.long_numeric(live, NUM).where("value is not null").withColumn("cnt", F.lit(1))
    inside = (F.col("bin") >= 0) & (F.col("bin") < F.size("edges") - 1)
    return dr.histogram(counts, edges).join(edges, "feature").where(inside).select("feature", "bin", "n")


def category_match(spark, sf):
    _, live = _split(spark, sf)
    base = _baseline(spark, sf)
    return dr.distributions(live, base, [], CAT).select(
        "feature", "slot", F.round("expected", 9).alias("expected"), F.round("actual", 9).alias("actual"))


def feature_psi(spark, sf, overflow_bins=False):
    _, live = _split(spark, sf)
    return dr.feature_psi(live, materialise(_baseline(spark, sf), "baseline"), NUM, CAT, overflow_bins).select(
        "feature", F.round("psi", 6).alias("psi"))


def psi_with_overflow(spark, sf):
    return feature_psi(spark, sf, overflow_bins=True)


def _report(spark, sf):
    _, live = _split(spark, sf)
    scores = dr.feature_psi(live, materialise(_baseline(spark, sf), "baseline"), NUM, CAT, overflow_bins=False)
    ts = A.table(spark, sf, "orders").where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    window = dr.report_window(ts, "o_orderdate", reports.moment(CHECK_TS))
    # A low threshold, so that this sample raises an alert.
    return dr.drift_report(scores, window, reports.moment(CHECK_TS), threshold=0.0)


def drift_report(spark, sf):
    return _report(spark, sf).select(
        "check_ts", "window_start", "window_end", "max_psi", F.size("drifted_features").alias("n_drifted"),
        F.size("feature_psi_details").alias("n_features"), "status")


def drifted_features(spark, sf):
    return _report(spark, sf).select(F.explode("drifted_features").alias("d")).select("d.*")


def report_details(spark, sf):
    return _report(spark, sf).select(F.explode("feature_psi_details").alias("feature", "psi"))


def drift_alert(spark, sf):
    return dr.drift_alerts(_report(spark, sf)).drop("alert_id")


def latest_drift(spark, sf):
    """Newest of the daily PSI reports over the event types."""
    base, hist = _event_baseline(spark, sf), _event_hours(spark, sf)
    scores = dr.hourly_psi(hist, base).withColumn("psi", F.round("psi", 6))
    return reports.latest(scores, "hour", 20)


def _event_baseline(spark, sf):
    """Event types of every other user, before the type signup was known."""
    rows = A.table(spark, sf, "events").where("user_id % 2 = 0 and event_type <> 'signup'")
    return dr.categorical_profile(rows, ["event_type"]).select("category", "expected")


def _event_hours(spark, sf):
    return dr.hourly_histogram(A.table(spark, sf, "events"), "ts", "event_type")


def hourly_drift(spark, sf):
    scores = dr.hourly_psi(_event_hours(spark, sf), _event_baseline(spark, sf))
    return scores.select("hour", F.round("psi", 6).alias("psi"))


def _drift_runs(spark, sf):
    """The drift job at three moments, 24 hours of events each, against a baseline that lacks a type."""
    path = scratch_path(spark, "drift-reports")
    events = A.table(spark, sf, "events")
    profile = dr.categorical_profile(events.where("user_id % 2 = 0 and event_type <> 'signup'"), ["event_type"])
    base = materialise(profile.groupBy("feature").agg(
        F.lit("categorical").alias("kind"), F.lit(None).cast("array<double>").alias("bins"),
        F.collect_list("category").alias("categories"), F.collect_list("expected").alias("expected")), "baseline")
    alerts = [dr.monitor(events, base, "ts", reports.moment(at), path, [], ["event_type"], hours=24) for at in _RUNS]
    return spark.read.parquet(path), alerts


def drift_job(spark, sf):
    """Every stored report, with the alert that its run raised."""
    stored, alerts = _drift_runs(spark, sf)
    raised = alerts[0].unionByName(alerts[1]).unionByName(alerts[2]).select(
        F.col("alert_ts").alias("check_ts"), F.col("severity").alias("alert_severity"))
    return stored.join(raised, "check_ts", "left").select(
        "check_ts", "window_start", "window_end", F.round("max_psi", 5).alias("max_psi"), "status",
        F.size("drifted_features").alias("n_drifted"), "alert_severity")


def latest_report(spark, sf):
    """The newest stored report and its line of text."""
    stored, _ = _drift_runs(spark, sf)
    text = F.regexp_replace(dr.monitor_line(), "max_psi=[0-9.]+, ", "")
    return reports.latest(stored, "check_ts", 1).select(
        "check_ts", F.round("max_psi", 5).alias("max_psi"), "status", text.alias("summary"))


# Moments of the drift job.
_RUNS = ["2024-01-10 00:00:00", "2024-01-20 06:00:00", "2024-01-30 00:00:00"]


def perturbed(spark, sf):
    rows = A.packets(spark, sf).select(
        F.col("seq").alias("flow_id"), F.col("protocol").alias("protocol_type"),
        F.when(F.col("dst_port") == 80, "http").otherwise("other").alias("service"))
    return dr.perturb(rows, 0.3)


# The same PSI with one more bin on either side of the baseline range.
_OVERFLOW = """,
rg as (select feature, min(lo) as lo, max(hi) as hi from bins group by 1),
oc as (select feature, expected, live_n as n from np
  union all select r.feature, 1e-4, (select count(*) from nv v where v.feature = r.feature and not v.is_baseline and v.value < r.lo) from rg r
  union all select r.feature, 1e-4, (select count(*) from nv v where v.feature = r.feature and not v.is_baseline and v.value > r.hi) from rg r),
oa as (select feature, expected, (n + 1e-4) / (sum(n) over w + 1e-4 * count(*) over w) as actual from oc window w as (partition by feature)),
oe as (select feature, expected as e, actual as a from oa
  union all select feature, expected, actual from cp
  union all select feature, 1e-4, sum(actual) from cs where n = 0 and live_n > 0 group by feature),
om as (select feature, case when e <= 0 then 1e-4 else e end as e, case when a <= 0 then 1e-4 else a end as a from oe),
on2 as (select feature, e / sum(e) over w as e, a / sum(a) over w as a from om window w as (partition by feature))"""

_HOURLY = """
tot as (select event_type as category, count(*) / sum(count(*)) over () as share from events
  where user_id % 2 = 0 and event_type <> 'signup' group by 1),
bl as (select category, (share + 1e-4) / (sum(share) over () + 1e-4 * count(*) over ()) as e from tot),
hh as (select date_trunc('hour', ts) as hour, event_type as category, count(*) as n from events group by 1, 2),
ha as (select hour, category, n / sum(n) over (partition by hour) as a from hh),
hg as (select h.hour, bl.e, case when coalesce(ha.a, 0) <= 0 then 1e-4 else ha.a end as a
  from (select distinct hour from hh) h cross join bl left join ha on ha.hour = h.hour and ha.category = bl.category
  union all select hour, 1e-4, sum(a) from ha where category not in (select category from bl) group by hour),
hn as (select hour, e / sum(e) over w as e, a / sum(a) over w as a from hg window w as (partition by hour)),
hp as (select hour, round(sum((a - e) * ln(a / e)), 6) as psi from hn group by 1)"""

_DRIFT_RUNS = f"""
bt as (select event_type as category, count(*) / sum(count(*)) over () as share from events
  where user_id % 2 = 0 and event_type <> 'signup' group by 1),
bl as (select category, (share + 1e-4) / (sum(share) over () + 1e-4 * count(*) over ()) as e from bt),
rn as (select unnest([{', '.join(f"timestamp '{t}'" for t in _RUNS)}]) as check_ts),
ev as (select check_ts, ts, event_type as category from rn join events on ts >= check_ts - interval 24 hour and ts < check_ts),
ha as (select check_ts, category, count(*) / sum(count(*)) over (partition by check_ts) as a from ev group by 1, 2),
hg as (select r.check_ts, bl.e, case when coalesce(ha.a, 0) <= 0 then 1e-4 else ha.a end as a
  from rn r cross join bl left join ha on ha.check_ts = r.check_ts and ha.category = bl.category
  union all select check_ts, 1e-4, sum(a) from ha where category not in (select category from bl) group by check_ts),
hn as (select check_ts, e / sum(e) over w as e, a / sum(a) over w as a from hg window w as (partition by check_ts)),
hp as (select check_ts, round(round(sum((a - e) * ln(a / e)), 6), 5) as max_psi from hn group by 1),
rp as (select hp.*, case when max_psi > 0.25 then 'ALERT' else 'OK' end as status, (select min(ts) from ev where ev.check_ts = hp.check_ts) as window_start,
  (select max(ts) from ev where ev.check_ts = hp.check_ts) as window_end from hp)"""

QUERIES = {
    "d02_drift_job": (drift_job, _q(_DRIFT_RUNS, """
        select check_ts, window_start, window_end, max_psi, status, cast(status = 'ALERT' as int) as n_drifted,
          case when status = 'ALERT' then 'HIGH' end as alert_severity from rp""")),
    "o02_latest_report": (latest_report, _q(_DRIFT_RUNS, """
        select check_ts, max_psi, status, 'drift monitor: status=' || status || ', drifted_features=' || cast(status = 'ALERT' as int) as summary
        from rp order by check_ts desc limit 1""")),
    "s02_json_round_trip": (json_round_trip, fq._with(fq._FLOWS + "," + fq._IDS, f"""
        select flow_id, src_ip, dst_ip, src_bytes, dst_bytes, flag, {fq._ISO.format(c='last_us')} as timestamp from ids""", True)),
    "s03_landing": (landed, _q(_LAND, "select raw_id, file_name, file_row_number, ok as parsed from ld")),
    "s03_quarantine": (quarantined, _q(_LAND, "select raw_id, file_name, file_row_number, line from ld where not ok")),
    "s04_labelled_reader": (labelled_file, _q(_LABELS, "select event_id, attack_category from lm")),
    "j01_lateral_flatten": (exploded, _q(_LAND, f"select raw_id, flow_index, {_t('src_ip')} as src_ip from ex")),
    "p01_flatten_types": (flattened, _q(_LAND, f"""
        select {_ID_SQL} as flow_id, {_t('src_ip')} as src_ip, {_t('dst_ip')} as dst_ip,
          cast({_t('src_port')} as int) as src_port, cast({_t('dst_port')} as int) as dst_port, {_t('protocol')} as protocol,
          {', '.join(_typed(c) for c in FEATURES)}, {_SMOKE_SQL} as is_synthetic from ex""")),
    "p02_table_flow_id": (table_ids, _q(_LAND, f"select raw_id, flow_index, {_ID_SQL} as flow_id from ex")),
    "p04_synthetic_marker": (synthetic_marks, _q(_LAND, f"""
        select file_name, is_synthetic, count(*) as n from (select file_name, {_SMOKE_SQL} as is_synthetic from ex) group by 1, 2""")),
    "u02_schema_contract": (accepted_counts, _q(_LAND, f"""
        select count(*) filter (where {_t('src_ip')} is not null and {_t('dst_ip')} is not null) as accepted,
          count(*) filter (where {_t('src_ip')} is null or {_t('dst_ip')} is null) as rejected from ex""")),
    "o03_recent_landings": (recent_landings, _q(_LAND, """
        select raw_id, file_name, file_row_number from ld order by file_row_number desc, raw_id limit 10""")),
    "p05_label_class": (labels, _q(_LABELS, "select event_id, attack_category from lm")),
    "j10_label_lookup": (label_lookup, _q(_LABELS, "select attack_category, count(*) as n from lm group by 1")),
    "p06_drop_targets": (normalised_names, "select event_id from events"),
    "p07_target_selection": (target, _q(_LABELS, """
        select event_id, attack_category as target, 'attack_category' as target_column from lm""")),
    "p08_schema_completion": (completed, """
        select 'f' || event_id as flow_id, event_id % 10 as duration, 'other' as service, 0 as count, 0 as serror_rate
        from events"""),
    "a11_numeric_profile": (numeric_profile, _q(_DRIFT, """
        select feature, bin, round(lo, 4) as lo, round(hi, 4) as hi, n, round(expected, 9) as expected from np""")),
    "a12_categorical_profile": (categorical_profile, _q(_DRIFT, """
        select feature, category, n, round(expected, 9) as expected from cp""")),
    "a13_live_histogram": (live_histogram, _q(_DRIFT, """
        select feature, bin, live_n as n from np where live_n > 0""")),
    "j09_distribution_join": (category_match, _q(_DRIFT, """
        select feature, category as slot, round(expected, 9) as expected, round(actual, 9) as actual from cp
        union all select feature, null, 1e-4, round(sum(actual), 9) from cs where n = 0 and live_n > 0 group by 1""")),
    "a14_feature_psi": (feature_psi, _q(_DRIFT, "select feature, round(psi, 6) as psi from psi")),
    "d05_psi_with_overflow": (psi_with_overflow, _q(_DRIFT + _OVERFLOW, "select feature, round(sum((a - e) * ln(a / e)), 6) as psi from on2 group by 1")),
    "a15_drift_report": (drift_report, _q(_DRIFT, f"""
        select timestamp '{CHECK_TS}' as check_ts,
          (select min(o_orderdate) from orders where o_orderdate >= timestamp '1997-01-01') as window_start,
          (select max(o_orderdate) from orders where o_orderdate >= timestamp '1997-01-01') as window_end,
          max(round(psi, 6)) as max_psi, cast(count(*) filter (where psi > 0) as int) as n_drifted,
          cast(count(*) as int) as n_features, 'ALERT' as status from psi""")),
    "d03_drifted_features": (drifted_features, _q(_DRIFT, """
        select feature, round(psi, 6) as psi, true as threshold_exceeded from psi where psi > 0""")),
    "s09_report_details": (report_details, _q(_DRIFT, "select feature, round(psi, 6) as psi from psi")),
    "m05_drift_alert": (drift_alert, f"""
        select timestamp '{CHECK_TS}' as alert_ts, cast(null as varchar) as flow_id, '0.0.0.0' as src_ip,
          '0.0.0.0' as dst_ip, cast(null as int) as src_port, cast(null as int) as dst_port,
          'MODEL_DRIFT_ALERT' as attack_type, 1.0::double as confidence, cast(null as double) as anomaly_score,
          'HIGH' as severity, false as is_zero_day_suspect, false as is_synthetic, 'PENDING' as mitigation_status"""),
    "o02_latest_drift": (latest_drift, _q(_HOURLY, "select hour, psi from hp order by hour desc limit 20")),
    "t06_hourly_drift": (hourly_drift, _q(_HOURLY, "select hour, psi from hp")),
    "p23_perturbation": (perturbed, _q(f"pk as ({A.duck(A.PACKETS)})", """
        , h as (select seq as flow_id, protocol, case when dst_port = 80 then 'http' else 'other' end as svc,
           cast('0x' || substr(md5(cast(seq as varchar)), 1, 8) as bigint) % 1000000 < 300000 as hit from pk)
        select flow_id, case when hit and protocol = 'tcp' then 'icmp' else protocol end as protocol_type,
          case when hit and svc = 'http' then 'private' else svc end as service from h""")),
}
