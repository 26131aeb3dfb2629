"""Flow assembly: hand-made captures, and random ones against a packet-by-packet replay."""

import random

import pytest
from pyspark.sql import functions as F

from packetmill.operators import flows, records
from packetmill.schemas import FEATURES, PACKETS
from packetmill.sources.packets import normalise

CLIENT, SERVER = ("10.0.0.1", 40000), ("192.168.1.10", 80)


def packet(seq, t, src=CLIENT, dst=SERVER, flags="", length=60, protocol="tcp", frag=0):
    return (seq, int(round(t * 1e6)), src[0], dst[0], src[1], dst[1], protocol, flags, length, frag)


def frame(spark, rows):
    return spark.createDataFrame(rows, PACKETS)


def run(spark, rows, clock="event_time"):
    return [r.asDict() for r in flows.describe(flows.assemble(frame(spark, rows), clock)).orderBy("first_seq").collect()]


BASIC = [packet(0, 0, flags="S"), packet(1, 1, SERVER, CLIENT, "SA", 40), packet(2, 2, flags="A"), packet(3, 3, flags="F")]


def test_basic_flow(spark):
    (f,) = run(spark, BASIC)
    assert (f["service"], f["flag"], f["src_bytes"], f["dst_bytes"], f["duration"]) == ("http", "SF", 180, 40, 3)
    assert (f["src_ip"], f["dst_port"], f["packets"], f["land"]) == ("10.0.0.1", 80, 4, 0)
    assert f["emit_us"] == 33_000_000 and f["timestamp"] == "1970-01-01T00:00:03+00:00"


def test_record_has_all_features(spark):
    record = records.flow_records(frame(spark, BASIC)).first().asDict()
    assert set(FEATURES) <= set(record) and record["hot"] == 0 and record["srv_diff_host_rate"] == 0.0
    assert record["protocol_type"] == "tcp" and record["count"] == 1


def test_flag_states(spark):
    other = lambda n: (f"10.0.0.{n}", 40000)
    rows = [
        packet(0, 0, other(2), flags="S"), packet(1, 1, SERVER, other(2), "R"),
        packet(2, 0, other(3), flags="s"),
        packet(3, 0, other(4), flags="S"), packet(4, 1, SERVER, other(4), "SA"), packet(5, 2, other(4), flags="R"),
        packet(6, 0, other(5), flags="SF"), packet(7, 1, other(5), flags="U"),
    ]
    assert [(f["flag"], f["syn_error"], f["urgent"]) for f in run(spark, rows)] == [
        ("REJ", True, 0), ("S0", True, 0), ("RSTO", False, 0), ("SF", False, 1)]


def test_services_land_and_orientation(spark):
    rows = [packet(i, 0, ("10.0.0.9", 50000 + i), ("10.0.0.8", p)) for i, p in enumerate((80, 22, 53, 9999))]
    rows += [packet(4, 0, ("10.0.0.9", 1), ("10.0.0.9", 2)), packet(5, 0, ("10.0.0.9", 7), ("10.0.0.8", 53), protocol="udp")]
    found = run(spark, rows)
    assert [f["service"] for f in found] == ["http", "ssh", "domain_u", "private", "private", "other"]
    assert [f["land"] for f in found] == [0, 0, 0, 0, 1, 0]
    assert {f["src_ip"] for f in found} == {"10.0.0.9"}


def test_boundaries(spark):
    assert len(run(spark, [packet(0, 0), packet(1, 29.999999)])) == 1
    assert len(run(spark, [packet(0, 0), packet(1, 30)])) == 2
    steady = [packet(i, 20 * i) for i in range(7)]  # 0..120
    assert [f["packets"] for f in run(spark, steady)] == [6, 1]
    # On the arrival clock the connection's own overdue packet still belongs to the flow.
    assert [f["packets"] for f in run(spark, steady, "arrival")] == [7]
    assert [f["packets"] for f in run(spark, [packet(0, 0), packet(1, 31)], "arrival")] == [2]


def test_normalise_fills_and_filters(spark):
    raw = spark.createDataFrame(
        [(0, 0, "1.1.1.1", None, "TCP", -5), (1, 0, None, "2.2.2.2", None, 7), (2, 0, "a", "b", "gre", 1)],
        "seq long, ts_us long, src_ip string, dst_ip string, protocol string, length long")
    rows = normalise(raw).orderBy("seq").collect()
    assert [(r.src_ip, r.dst_ip, r.protocol, r.src_port, r.flags) for r in rows] == [
        ("1.1.1.1", "0.0.0.0", "tcp", 0, ""), ("0.0.0.0", "2.2.2.2", "tcp", 0, "")]
    assert flows.assemble(normalise(raw)).agg(F.sum("src_bytes")).first()[0] == 7


# --- random captures --------------------------------------------------------------


def replay(rows, clock):
    """Membership and emission by walking the packets one at a time."""
    live, done = {}, []

    def close(key, at, flush=False):
        f = live.pop(key)
        done.append((key, f[0], f[1], f[2], at, flush))

    for seq, ts, s, d, sp, dp, proto, *_ in rows:
        ends = sorted([(s, sp), (d, dp)])
        key = "|".join(f"{ip}:{port}" for ip, port in ends) + "|" + proto
        if clock == "event_time" and key in live:
            due = min(live[key][1] + 30_000_000, live[key][0] + 120_000_000)
            if ts >= due:
                close(key, due)
        first, _, n = live.get(key, (ts, ts, 0))
        live[key] = (first, ts, n + 1)
        if clock == "arrival":
            for k in [k for k, f in live.items() if ts - f[1] >= 30_000_000 or ts - f[0] >= 120_000_000]:
                close(k, ts)
    for k in list(live):
        due = min(live[k][1] + 30_000_000, live[k][0] + 120_000_000)
        close(k, due if clock == "event_time" else live[k][1], clock == "arrival")
    return sorted(done)


def capture(seed):
    """Sparse and dense connections, ties, and one that owns most of the packets."""
    rng = random.Random(seed)
    times = []
    for c in range(6):
        t = rng.uniform(0, 100)
        for _ in range(rng.randint(1, 60)):
            t += rng.choice([0, 0.5, 3, 12, 29.999999, 30, 31, 47])
            times.append((t, c))
    t = 5.0
    while t < 900:  # the hot connection: dense, longer than many active timeouts
        times.append((t, 99))
        t += rng.choice([0.2, 0.3, 1.7])
    times.sort(key=lambda x: x[0])
    return [packet(i, t, ("10.0.0.1", 1000 + c), ("10.0.0.2", 80)) if rng.random() < 0.6
            else packet(i, t, ("10.0.0.2", 80), ("10.0.0.1", 1000 + c)) for i, (t, c) in enumerate(times)]


@pytest.mark.parametrize("clock", ["event_time", "arrival"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_captures_match_replay(spark, clock, seed):
    rows = capture(seed)
    got = flows.assemble(frame(spark, rows).repartition(4), clock).select(
        "conn_key", "start_us", "last_us", "packets", "emit_us", "is_flush").collect()
    assert sorted(map(tuple, got)) == replay(rows, clock)


@pytest.mark.parametrize("clock", ["event_time", "arrival"])
def test_bursty_hour_in_small_batches(spark, clock):
    """Bursts every 20 s make every packet a candidate; the walk keeps one start across many batches."""
    rows = [packet(40 * b + i, 20 * b + i / 1000, *((CLIENT, SERVER) if i % 3 else (SERVER, CLIENT))) for b in range(180) for i in range(40)]
    rows += [packet(7200 + i, 3570.5 + i, ("10.0.0.7", 5), ("10.0.0.8", 6)) for i in range(5)]
    rows.sort(key=lambda r: r[1])
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "97")
    try:
        got = flows.assemble(frame(spark, rows).repartition(3), clock).select(
            "conn_key", "start_us", "last_us", "packets", "emit_us", "is_flush").collect()
    finally:
        spark.conf.set(name, before)
    assert sorted(map(tuple, got)) == replay(rows, clock)
