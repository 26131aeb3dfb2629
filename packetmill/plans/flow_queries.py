"""Queries on packets and flows, each with the DuckDB text that must return the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetmill.functions import net
from packetmill.operators import clock, conn, flows, records
from packetmill.sources import adapters as A
from packetmill.sources import packets as packet_source

# --- DuckDB building blocks --------------------------------------------------

_PK = A.duck(A.PACKETS)
_KEYED = f"""
pk as ({_PK}),
k as (select *, (src_ip, src_port) <= (dst_ip, dst_port) as from_a,
  case when (src_ip, src_port) <= (dst_ip, dst_port)
   then src_ip || ':' || src_port || '|' || dst_ip || ':' || dst_port
   else dst_ip || ':' || dst_port || '|' || src_ip || ':' || src_port end || '|' || protocol as conn_key
 from pk)"""

_SESSIONS = _KEYED + """,
g as (select *, lag(ts_us) over w as prev_us from k window w as (partition by conn_key order by ts_us, seq)),
s as (select *, sum(case when prev_us is null or ts_us - prev_us >= 30000000 then 1 else 0 end)
   over (partition by conn_key order by ts_us, seq) as sess from g)"""

_FLOWS = _SESSIONS + """,
st(conn_key, sess, start_us) as (
  select conn_key, sess, min(ts_us) from s group by 1, 2
  union all
  select st.conn_key, st.sess, min(s.ts_us) from st join s
    on s.conn_key = st.conn_key and s.sess = st.sess and s.ts_us >= st.start_us + 120000000
  group by st.conn_key, st.sess, st.start_us),
f as (select s.*, st.start_us from s asof join st
   on s.conn_key = st.conn_key and s.sess = st.sess and s.ts_us >= st.start_us),
a as (select conn_key, start_us, max(ts_us) as last_us, count(*) as packets,
   first(src_ip order by ts_us, seq) as src_ip, first(dst_ip order by ts_us, seq) as dst_ip,
   first(src_port order by ts_us, seq) as src_port, first(dst_port order by ts_us, seq) as dst_port,
   first(protocol) as protocol, min(seq) as first_seq,
   first(from_a order by ts_us, seq) as first_from_a,
   cast(sum(case when from_a then greatest(length, 0) else 0 end) as bigint) as bytes_a,
   cast(sum(case when from_a then 0 else greatest(length, 0) end) as bigint) as bytes_b,
   count(*) filter (where fragment_offset > 0) as wrong_fragment,
   bool_or(flags like '%S%' and flags not like '%F%' and flags not like '%A%') as syn,
   bool_or(flags like '%S%' and flags like '%A%') as synack,
   bool_or(flags like '%R%') as rst, bool_or(flags like '%F%') as fin, bool_or(flags like '%U%') as urg
  from f group by 1, 2),
fl as (select *, case when first_from_a then bytes_a else bytes_b end as src_bytes,
   case when first_from_a then bytes_b else bytes_a end as dst_bytes,
   least(last_us + 30000000, start_us + 120000000) as emit_us,
   case when protocol <> 'tcp' then 'other' else case dst_port when 20 then 'ftp_data' when 21 then 'ftp'
     when 22 then 'ssh' when 23 then 'telnet' when 25 then 'smtp' when 53 then 'domain_u' when 80 then 'http'
     when 8080 then 'http' else 'private' end end as service,
   case when rst and not synack then 'REJ' when syn and not synack then 'S0' when rst then 'RSTO' else 'SF' end as flag,
   ((rst and not synack) or (syn and not synack)) as syn_error from a)"""

_MILLIS = """case when start_us % 1000 > 500 then start_us // 1000 + 1
  when start_us % 1000 < 500 then start_us // 1000
  when cast(cast(start_us / 1e6 * 4194304.0 as bigint) as hugeint) * 1000000 > cast(start_us as hugeint) * 4194304
   then start_us // 1000 + 1
  when cast(cast(start_us / 1e6 * 4194304.0 as bigint) as hugeint) * 1000000 < cast(start_us as hugeint) * 4194304
   then start_us // 1000
  else start_us // 1000 + (start_us // 1000) % 2 end"""

_IDS = f"""
idf as (select *, {_MILLIS} as ms from fl),
ids as (select *, md5(conn_key || '|' || (ms // 1000) || '.' || lpad(cast(ms % 1000 as varchar), 3, '0')) as flow_id
  from idf)"""

# Window features by definition: compare each flow with all flows of its destination.
_WINDOWS = """
pairs as (select x.conn_key, x.start_us, y.service = x.service as srv, y.syn_error as syn, y.rst as rst,
   y.src_port = x.src_port as port, y.src_ip <> x.src_ip as other,
   row_number() over (partition by x.conn_key, x.start_us order by y.emit_us desc, y.first_seq desc) as back
  from fl x join fl y on x.dst_ip = y.dst_ip and y.emit_us between x.emit_us - 2000000 and x.emit_us
   and (y.emit_us < x.emit_us or y.first_seq <= x.first_seq)),
win as (select conn_key, start_us, count(*) as n, count(*) filter (where srv) as sn,
   count(*) filter (where syn) as e, count(*) filter (where srv and syn) as se,
   count(*) filter (where rst) as r, count(*) filter (where srv and rst) as sr,
   count(*) filter (where back <= 100) as hn, count(*) filter (where back <= 100 and srv) as hsn,
   count(*) filter (where back <= 100 and port) as hport,
   count(*) filter (where back <= 100 and srv and other) as hother,
   count(*) filter (where back <= 100 and syn) as he, count(*) filter (where back <= 100 and srv and syn) as hse,
   count(*) filter (where back <= 100 and rst) as hr, count(*) filter (where back <= 100 and srv and rst) as hsr
  from pairs group by 1, 2)"""


def _with(blocks: str, tail: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{blocks.strip()}\n{tail.strip()}"


_ISO = """strftime(make_timestamp({c}), '%Y-%m-%dT%H:%M:%S') || case when {c} % 1000000 = 0 then ''
  else '.' || lpad(cast({c} % 1000000 as varchar), 6, '0') end || '+00:00'"""

# --- Spark side ----------------------------------------------------------------


def _flows(spark, sf, clock_name="event_time"):
    return flows.describe(flows.assemble(A.packets(spark, sf), clock_name))


def _windows(spark, sf):
    return conn.connection_windows(_flows(spark, sf), digits=None)


def packet_table(spark, sf):
    return packet_source.normalise(A.packets(spark, sf))


def idle_sessions(spark, sf):
    """Idle sessions alone: the assembly with an active timeout no session reaches."""
    return flows.assemble(A.packets(spark, sf), active=1 << 60).select(
        "conn_key", "start_us", "last_us", "packets")


def active_splits(spark, sf):
    return _flows(spark, sf).select("conn_key", "start_us", "last_us", "packets", "emit_us")


def flow_aggregate(spark, sf):
    return _flows(spark, sf).select(
        "conn_key", "start_us", "last_us", "src_ip", "dst_ip", "src_port", "dst_port", "packets",
        "src_bytes", "dst_bytes", "wrong_fragment", "syn", "synack", "rst", "fin", "urg")


def flow_ids(spark, sf):
    return _flows(spark, sf).select("conn_key", "start_us", "flow_id")


def derived(spark, sf):
    return _flows(spark, sf).select(
        "conn_key", "start_us", "duration", "land", "urgent", "flow_start_time", "timestamp")


def flags(spark, sf):
    return _flows(spark, sf).select("conn_key", "start_us", "flag", "syn_error")


def services(spark, sf):
    return _flows(spark, sf).groupBy("service", "protocol").agg(F.count(F.lit(1)).alias("flows"))


def flag_letters(spark, sf):
    f = F.col("flags")
    return A.packets(spark, sf).groupBy("flags").agg(
        F.count_if(net.is_syn(f)).alias("syn"), F.count_if(net.is_synack(f)).alias("synack"),
        F.count_if(net.has_letter(f, "R")).alias("rst"), F.count_if(net.has_letter(f, "F")).alias("fin"))


def conn_counts(spark, sf):
    return _windows(spark, sf).select("conn_key", "start_us", "count", "srv_count")


def error_rates(spark, sf):
    return _windows(spark, sf).select(
        "conn_key", "start_us", "serror_rate", "srv_serror_rate", "rerror_rate", "srv_rerror_rate")


def service_rates(spark, sf):
    return _windows(spark, sf).select("conn_key", "start_us", "same_srv_rate", "diff_srv_rate")


def host_windows(spark, sf):
    return _windows(spark, sf).select(
        "conn_key", "start_us", "dst_host_count", "dst_host_srv_count", "dst_host_same_srv_rate",
        "dst_host_diff_srv_rate", "dst_host_serror_rate", "dst_host_srv_serror_rate",
        "dst_host_rerror_rate", "dst_host_srv_rerror_rate")


def host_sources(spark, sf):
    return _windows(spark, sf).select(
        "conn_key", "start_us", "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate")


def full_records(spark, sf):
    """The flagship: packets to complete flow records, unrounded rates."""
    return records.flow_records(A.packets(spark, sf), digits=None)


def previous_packets(spark, sf):
    pk = A.packets(spark, sf).select("seq", "ts_us")
    return clock.previous_packet_time(pk, pk).select("seq", "ts_us", "prev_global_us")


def next_packets(spark, sf):
    pk = A.packets(spark, sf)
    due = _flows(spark, sf).select(
        "conn_key", "start_us", F.least(F.col("last_us") + 30_000_000, F.col("start_us") + 120_000_000).alias("due_us"))
    return clock.next_packet(due, "due_us", pk).drop("next_seq")


def arrival_flows(spark, sf):
    return _flows(spark, sf, "arrival").select(
        "conn_key", "start_us", "first_seq", "last_us", "packets", "emit_us", "is_flush")


_ARRIVAL = _KEYED + """,
gl as (select *, lag(ts_us) over (order by ts_us, seq) as gp from k),
ow as (select *, lag(ts_us) over w as prev_us from gl window w as (partition by conn_key order by ts_us, seq)),
se as (select *, sum(case when prev_us is null or gp >= prev_us + 30000000 then 1 else 0 end)
   over (partition by conn_key order by ts_us, seq) as sess from ow),
s as (select *, row_number() over (partition by conn_key, sess order by ts_us, seq) as rn from se),
st(conn_key, sess, start_us, rn, first_seq) as (
  select conn_key, sess, ts_us, rn, seq from s where rn = 1
  union all
  select n.conn_key, n.sess, n.ts_us, n.rn, n.seq from
   (select st.conn_key, st.sess, st.start_us, min(s.rn) as p_rn, arg_min(s.gp, s.rn) as gp from st join s
     on s.conn_key = st.conn_key and s.sess = st.sess and s.rn > st.rn and s.ts_us >= st.start_us + 120000000
    group by 1, 2, 3) q
   join s n on n.conn_key = q.conn_key and n.sess = q.sess
    and n.rn = q.p_rn + case when q.gp >= q.start_us + 120000000 then 0 else 1 end),
f as (select s.conn_key, s.ts_us, st.start_us, st.first_seq from s asof join st
   on s.conn_key = st.conn_key and s.sess = st.sess and s.rn >= st.rn),
fl as (select conn_key, start_us, first_seq, max(ts_us) as last_us, count(*) as packets,
   least(max(ts_us) + 30000000, start_us + 120000000) as due from f group by 1, 2, 3)"""

QUERIES = {
    "s01_packet_source": (packet_table, _PK),
    "w01_idle_sessions": (idle_sessions, _with(_SESSIONS, """
        select conn_key, min(ts_us) as start_us, max(ts_us) as last_us, count(*) as packets
        from s group by conn_key, sess""")),
    "w02_active_splits": (active_splits, _with(
        _FLOWS, "select conn_key, start_us, last_us, packets, emit_us from fl", True)),
    "a01_flow_aggregate": (flow_aggregate, _with(_FLOWS, """
        select conn_key, start_us, last_us, src_ip, dst_ip, src_port, dst_port, packets, src_bytes, dst_bytes,
          wrong_fragment, syn, synack, rst, fin, urg from fl""", True)),
    "p03_record_flow_id": (flow_ids, _with(_FLOWS + "," + _IDS, "select conn_key, start_us, flow_id from ids", True)),
    "p09_derived_columns": (derived, _with(_FLOWS, f"""
        select conn_key, start_us, (last_us - start_us) // 1000000 as duration,
          cast(src_ip = dst_ip as int) as land, cast(urg as int) as urgent,
          {_ISO.format(c='start_us')} as flow_start_time, {_ISO.format(c='last_us')} as timestamp from fl""", True)),
    "p10_connection_flag": (flags, _with(_FLOWS, "select conn_key, start_us, flag, syn_error from fl", True)),
    "p11_service": (services, _with(
        _FLOWS, "select service, protocol, count(*) as flows from fl group by 1, 2", True)),
    "x10_flag_letters": (flag_letters, _with(_KEYED, """
        select flags, count(*) filter (where flags = 'S') as syn, count(*) filter (where flags = 'SA') as synack,
          count(*) filter (where flags = 'R') as rst, count(*) filter (where flags = 'FA') as fin
        from pk group by flags""")),
    "w03_conn_count": (conn_counts, _with(
        _FLOWS + "," + _WINDOWS, "select conn_key, start_us, n as count, sn as srv_count from win", True)),
    "w04_error_rates": (error_rates, _with(_FLOWS + "," + _WINDOWS, """
        select conn_key, start_us, e / n as serror_rate, se / greatest(1, sn) as srv_serror_rate,
          r / n as rerror_rate, sr / greatest(1, sn) as srv_rerror_rate from win""", True)),
    "w05_service_rates": (service_rates, _with(_FLOWS + "," + _WINDOWS, """
        select conn_key, start_us, sn / n as same_srv_rate, 1.0::double - sn / n as diff_srv_rate from win""", True)),
    "w06_host_windows": (host_windows, _with(_FLOWS + "," + _WINDOWS, """
        select conn_key, start_us, hn as dst_host_count, hsn as dst_host_srv_count,
          hsn / hn as dst_host_same_srv_rate, 1.0::double - hsn / hn as dst_host_diff_srv_rate,
          he / hn as dst_host_serror_rate, hse / greatest(1, hsn) as dst_host_srv_serror_rate,
          hr / hn as dst_host_rerror_rate, hsr / greatest(1, hsn) as dst_host_srv_rerror_rate from win""", True)),
    "w07_host_sources": (host_sources, _with(_FLOWS + "," + _WINDOWS, """
        select conn_key, start_us, hport / hn as dst_host_same_src_port_rate,
          hother / greatest(1, hsn) as dst_host_srv_diff_host_rate from win""", True)),
    "w00_flow_records": (full_records, _with(_FLOWS + "," + _IDS + "," + _WINDOWS, f"""
        select flow_id, src_ip, dst_ip, src_port, dst_port, protocol,
          {_ISO.format(c='i.start_us')} as flow_start_time, {_ISO.format(c='i.last_us')} as timestamp,
          (i.last_us - i.start_us) // 1000000 as duration, protocol as protocol_type, service, flag,
          src_bytes, dst_bytes, cast(src_ip = dst_ip as int) as land, wrong_fragment, cast(urg as int) as urgent,
          0 as hot, 0 as num_failed_logins, 0 as logged_in, 0 as num_compromised, 0 as root_shell,
          0 as su_attempted, 0 as num_root, 0 as num_file_creations, 0 as num_shells, 0 as num_access_files,
          0 as num_outbound_cmds, 0 as is_host_login, 0 as is_guest_login, n as count, sn as srv_count,
          e / n as serror_rate, se / greatest(1, sn) as srv_serror_rate, r / n as rerror_rate,
          sr / greatest(1, sn) as srv_rerror_rate, sn / n as same_srv_rate, 1.0::double - sn / n as diff_srv_rate,
          0.0::double as srv_diff_host_rate, hn as dst_host_count, hsn as dst_host_srv_count,
          hsn / hn as dst_host_same_srv_rate, 1.0::double - hsn / hn as dst_host_diff_srv_rate,
          hport / hn as dst_host_same_src_port_rate, hother / greatest(1, hsn) as dst_host_srv_diff_host_rate,
          he / hn as dst_host_serror_rate, hse / greatest(1, hsn) as dst_host_srv_serror_rate,
          hr / hn as dst_host_rerror_rate, hsr / greatest(1, hsn) as dst_host_srv_rerror_rate
        from ids i join win w on i.conn_key = w.conn_key and i.start_us = w.start_us""", True)),
    "w02_arrival_clock": (arrival_flows, _with(_ARRIVAL, """
        select conn_key, start_us, first_seq, last_us, packets, coalesce(nx, last_us) as emit_us, nx is null as is_flush
        from (select *, (select min(p.ts_us) from pk p where p.ts_us >= fl.due) as nx from fl)""", True)),
    "w09_previous_packet": (previous_packets, _with(_KEYED, """
        select seq, ts_us, lag(ts_us) over (order by ts_us, seq) as prev_global_us from pk""")),
    "j11_next_packet": (next_packets, _with(_FLOWS, """
        select d.conn_key, d.start_us, d.due_us, (select min(p.ts_us) from pk p where p.ts_us >= d.due_us) as next_us
        from (select conn_key, start_us, emit_us as due_us from fl) d""", True)),
}
