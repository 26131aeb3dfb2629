"""Connection windows against a direct count over all earlier flows."""

import random

from packetmill.operators import conn

SCHEMA = ("conn_key string, emit_us long, first_seq long, dst_ip string, service string, src_ip string, "
          "src_port int, syn_error boolean, rst boolean")


def direct(rows):
    out = {}
    for r in rows:
        k, t, seq, dst, srv, src, port, *_ = r
        pool = sorted((x for x in rows if x[3] == dst and t - 2_000_000 <= x[1] and (x[1], x[2]) <= (t, seq)),
                      key=lambda x: (x[1], x[2]))
        host = pool[-100:]
        same = [x for x in pool if x[4] == srv]
        hsame = [x for x in host if x[4] == srv]

        def share(part, whole):
            return round(len(part) / max(1, len(whole)), 6)

        out[k] = (
            len(pool), len(same), share([x for x in pool if x[7]], pool), share([x for x in same if x[7]], same),
            share([x for x in pool if x[8]], pool), share(same, pool), len(host), len(hsame),
            share([x for x in host if x[6] == port], host), share([x for x in hsame if x[5] != src], hsame),
            share([x for x in hsame if x[8]], hsame))
    return out


def flows_of(seed, n):
    rng = random.Random(seed)
    rows, t = [], 1_000_000_000
    for i in range(n):
        t += rng.choice([0, 0, 1, 5_000, 20_000, 1_999_999, 2_000_000, 2_000_001] if i % 3 else [0, 2_000])
        rows.append((f"k{i}", t, i, "victim" if rng.random() < 0.8 else f"h{i % 3}", rng.choice(["http", "ssh"]),
                     f"s{rng.randint(0, 4)}", rng.randint(1, 5), rng.random() < 0.4, rng.random() < 0.3))
    return rows


def check(spark, rows, **kw):
    df = conn.connection_windows(spark.createDataFrame(rows, SCHEMA).repartition(3), **kw)
    got = {r.conn_key: (r["count"], r.srv_count, r.serror_rate, r.srv_serror_rate, r.rerror_rate, r.same_srv_rate,
                        r.dst_host_count, r.dst_host_srv_count, r.dst_host_same_src_port_rate,
                        r.dst_host_srv_diff_host_rate, r.dst_host_srv_rerror_rate) for r in df.collect()}
    want = direct(rows)
    assert got.keys() == want.keys()
    for k in want:
        assert all(abs(a - b) < 2e-6 for a, b in zip(got[k], want[k])), (k, got[k], want[k])


def test_random_flows(spark):
    check(spark, flows_of(7, 300))


def test_small_buckets_change_nothing(spark):
    check(spark, flows_of(8, 200), bucket_us=3_000_000)


def test_more_than_the_host_window(spark):
    """A burst of 250 flows within two seconds: host frames stop at 100 rows."""
    rows = [(f"k{i}", 9_999_000 + i * 4_000, i, "victim", "http" if i % 3 else "ssh", f"s{i % 7}", i % 5, i % 2 == 0, i % 4 == 0)
            for i in range(250)]
    check(spark, rows)


def test_edges_of_the_window(spark):
    rows = [("a", 0, 0, "v", "http", "s", 1, True, False), ("b", 2_000_000, 1, "v", "http", "s", 1, False, False),
            ("c", 2_000_001, 2, "v", "http", "s", 1, False, False)]
    got = {r.conn_key: r["count"] for r in conn.connection_windows(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"a": 1, "b": 2, "c": 2}
