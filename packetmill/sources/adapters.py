"""Views that present the supplied tables as packets, scored flows, landing lines,
labelled records and drift samples. Each is one SQL text for Spark and DuckDB;
only the tokens below differ, so both engines start from identical rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SPARK = {"{US}": "unix_micros(cast(ts as timestamp))", "{DIV}": "div", "{STR}": "string",
          "{TS}": "timestamp_ntz"}
_DUCK = {"{US}": "epoch_us(ts)", "{DIV}": "//", "{STR}": "varchar", "{TS}": "timestamp "}

PACKETS = """
select event_id as seq,
 ({US} - 1704067200000000) {DIV} 2000 + 1704067200000000 as ts_us,
 case when event_id % 3 = 1 then srv else cli end as src_ip,
 case when event_id % 3 = 1 then cli else srv end as dst_ip,
 cast(case when proto='icmp' then 0 when event_id % 3 = 1 then sport else cport end as int) as src_port,
 cast(case when proto='icmp' then 0 when event_id % 3 = 1 then cport else sport end as int) as dst_port,
 proto as protocol,
 case when proto <> 'tcp' then '' when event_type='signup' then 'S' when event_type='view' then 'SA'
      when event_type='click' then 'PA' when event_type='purchase' then 'FA' else 'R' end as flags,
 cast(floor(value*10) as bigint) as length,
 cast(case when event_id % 97 = 0 then 8 else 0 end as bigint) as fragment_offset
from (select *,
  concat('10.0.', cast((user_id {DIV} 250) % 250 as {STR}), '.', cast(user_id % 250 as {STR})) cli,
  concat('192.168.1.', cast(10 + user_id % 2 as {STR})) srv,
  40000 + user_id % 20000 cport,
  case user_id % 6 when 0 then 80 when 1 then 443 when 2 then 22 when 3 then 53 when 4 then 8080 else 9999 end sport,
  case when user_id % 10 = 3 then 'udp' when user_id % 25 = 7 then 'icmp' else 'tcp' end proto
 from events) e
"""

SCORED = """
select event_id as seq, concat('f', cast(event_id as {STR})) as flow_id, ts as alert_ts,
 concat('10.0.', cast((user_id {DIV} 250) % 250 as {STR}), '.', cast(user_id % 250 as {STR})) as src_ip,
 concat('192.168.1.', cast(10 + user_id % 2 as {STR})) as dst_ip,
 cast(40000 + user_id % 20000 as int) as src_port, 80 as dst_port,
 case when user_id % 13 = 0 then 'U2R' when event_type = 'signup' then 'R2L' when event_type = 'error' then 'Probe'
      when event_type = 'purchase' then 'DoS' else 'Normal' end as predicted_category,
 cast((event_id * 7919) % 1000 as double) / 1000 as confidence,
 case when event_id % 50 = 0 then null else -cast((event_id * 104729) % 1000 as double) / 1000 end as anomaly_score,
 event_id % 31 = 0 as is_synthetic
from events
"""

LANDING_LINES = """
select event_id,
 concat('flows/', case when user_id % 17 = 0 then 'smoke_' else 'part_' end, cast(user_id as {STR}), '.json') as file_name,
 cast(row_number() over (partition by user_id order by event_id) as bigint) as file_row_number,
 case event_id % 4
  when 0 then concat('{"records":[{"src_ip":"10.0.0.', cast(user_id % 250 as {STR}),
       '","dst_ip":"192.168.1.10","src_port":', cast(40000+user_id % 20000 as {STR}),
       ',"dst_port":80,"protocol":"tcp","duration":2.7,"src_bytes":', cast(cast(floor(value*10) as bigint) as {STR}), '},',
       '{"src_ip":"10.0.0.9","dst_ip":"192.168.1.11","service":"http","flow_id":"smoke-', cast(event_id as {STR}), '"}]}')
  when 1 then concat('{"flow_id":"f', cast(event_id as {STR}), '","src_ip":"10.0.0.1","dst_ip":"192.168.1.10","count":',
       cast(event_id % 300 as {STR}), ',"serror_rate":0.5,"flag":"S0"}')
  when 2 then '{"records":[]}'
  else case when event_id % 40 = 3 then '{broken' else props end end as line
from events
"""

LABELLED = """
select event_id, concat(case when event_id % 3 = 0 then ' ' else '' end,
  case when event_id % 5 = 0 then upper(l) else l end, case when event_id % 7 = 0 then '.' else '' end) as label
from (select event_id, case event_id % 9 when 0 then 'normal' when 1 then 'neptune' when 2 then 'satan' when 3 then 'guess_passwd'
  when 4 then 'buffer_overflow' when 5 then 'smurf' when 6 then 'nmap' when 7 then 'rootkit' else 'mystery' end l from events) x
"""

DRIFT_INPUT = """
select o_orderkey as flow_id, o_totalprice as src_bytes, cast(o_custkey as double) as count_,
 o_orderpriority as service, o_orderstatus as flag, o_orderdate < {TS}'1997-01-01 00:00:00' as is_baseline
from orders
"""


def _render(text: str, tokens: dict[str, str]) -> str:
    for token, value in tokens.items():
        text = text.replace(token, value)
    return text.strip()


def duck(text: str) -> str:
    return _render(text, _DUCK)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run an adapter over the table it names without registering anything globally."""
    source = "orders" if "from orders" in text else "events"
    sql = _render(text, _SPARK).replace(f"from {source}", "from {src}")
    # Literal braces of the landing lines must survive the placeholder syntax.
    sql = sql.replace("{", "{{").replace("}", "}}").replace("{{src}}", "{src}")
    return spark.sql(sql, src=table(spark, sf_dir, source))


def packets(spark, sf_dir):
    return view(spark, sf_dir, PACKETS)


def scored(spark, sf_dir):
    return view(spark, sf_dir, SCORED)


def landing_lines(spark, sf_dir):
    return view(spark, sf_dir, LANDING_LINES)


def labelled(spark, sf_dir):
    return view(spark, sf_dir, LABELLED)


def drift_input(spark, sf_dir):
    return view(spark, sf_dir, DRIFT_INPUT)
