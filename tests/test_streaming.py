"""Streams fed in several micro-batches must give what the batch operators give."""

import os

from pyspark.sql import functions as F

from packetmill.operators import conn, flows
from packetmill.operators import alerts as al
from packetmill.schemas import PACKETS
from packetmill.streaming import assembly, jobs
from test_flows import capture, frame, packet


def feed(spark, path, parts, schema):
    for i, rows in enumerate(parts):
        out = f"{path}/tmp{i}"
        df = rows if not isinstance(rows, list) else spark.createDataFrame(rows, schema)
        df.coalesce(1).write.parquet(out)
        os.makedirs(f"{path}/in", exist_ok=True)
        part = next(f for f in os.listdir(out) if f.endswith(".parquet"))
        os.rename(f"{out}/{part}", f"{path}/in/{i:03d}.parquet")
        os.utime(f"{path}/in/{i:03d}.parquet", (1_000_000 + i, 1_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def finish(writer):
    jobs.start(writer).awaitTermination()


def test_stream_equals_batch(spark, tmp_path):
    rows = capture(11)
    # A packet far in the future moves the watermark past every open flow.
    rows.append(packet(len(rows), 5000, ("10.9.9.9", 1)))
    cut = len(rows) // 3
    parts = [rows[:cut], rows[cut:2 * cut], rows[2 * cut:-1], rows[-1:]]
    closed = assembly.stream_flows(feed(spark, str(tmp_path), parts, PACKETS), "1 seconds")
    out, cols = str(tmp_path / "out"), ["conn_key", "start_us", "last_us", "packets", "src_bytes", "dst_bytes", "emit_us", "src_ip"]
    finish(jobs.sink(closed, out, out + "-cp"))
    want = flows.assemble(frame(spark, rows[:-1])).select(*cols)
    got = spark.read.schema(closed.schema).parquet(out).select(*cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_windows_equal_batch(spark, tmp_path):
    done = flows.describe(flows.assemble(frame(spark, capture(12)))).orderBy("emit_us").persist()
    last = done.agg(F.max("emit_us")).first()[0]
    middle = last // 2
    tail = done.limit(1).withColumns({"emit_us": F.lit(last + 100_000_000), "dst_ip": F.lit("z"), "conn_key": F.lit("z")})
    parts = [done.where(F.col("emit_us") < middle), done.where(F.col("emit_us") >= middle), tail]
    stream = feed(spark, str(tmp_path), parts, done.schema)
    counts = assembly.stream_windows(stream, "1 seconds")
    out = str(tmp_path / "out")
    finish(jobs.sink(counts, out, out + "-cp"))
    got = spark.read.schema(counts.schema).parquet(out).select("conn_key", "start_us", "n", "sn", "hn", "hsn")
    want = conn.connection_windows(done).select("conn_key", "start_us", "count", "srv_count", "dst_host_count", "dst_host_srv_count")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_late_packets_are_kept(spark, tmp_path):
    parts = [[packet(0, 100)], [packet(1, 50), packet(2, 99.5), packet(3, 200)], [packet(4, 150)]]
    path = str(tmp_path / "out")
    finish(jobs.separate_late(feed(spark, str(tmp_path), parts, PACKETS), 1_000_000, path, path + "-cp"))
    assert {r.seq for r in spark.read.parquet(path + "/late").collect()} == {1, 4}
    assert {r.seq for r in spark.read.parquet(path + "/on_time").collect()} == {0, 2, 3}


def test_scoring_then_dispatch(spark, tmp_path):
    schema = "flow_id string, predicted_category string, confidence double, anomaly_score double, src_ip string, alert_ts timestamp_ntz"
    base = "timestamp_ntz'2024-01-01 00:00:00'"
    def part(rows):
        return spark.createDataFrame(rows, "flow_id string, predicted_category string, confidence double, anomaly_score double, src_ip string"
                                     ).withColumn("alert_ts", F.expr(base))
    parts = [part([("a", "DoS", .99, -.1, "1.1.1.1"), ("b", "Normal", .99, -.1, "2.2.2.2")]), part([("c", "DoS", .98, -.1, "1.1.1.1"), ("d", "U2R", .97, -.1, "3.3.3.3")])]
    scored, blocks = str(tmp_path / "scored"), str(tmp_path / "blocks")
    finish(jobs.scoring(feed(spark, str(tmp_path), parts, parts[0].schema), al.classify, "v1", scored, scored + "-cp"))
    alerts = spark.read.parquet(scored + "/alerts")
    assert {r.flow_id for r in alerts.collect()} == {"a", "c", "d"}
    assert {r.flow_id for r in spark.read.parquet(scored + "/processed").collect()} == {"a", "b", "c", "d"}
    stream = spark.readStream.schema(alerts.schema).option("maxFilesPerTrigger", 1).parquet(scored + "/alerts")
    finish(jobs.dispatch(stream, blocks, blocks + "-cp", lambda number: 1000))
    got = spark.read.parquet(blocks + "/decisions").groupBy("src_ip").agg(
        F.sort_array(F.collect_list("status")).alias("s"), F.max("rule_number").alias("n")).collect()
    assert {r.src_ip: (r.s, r.n) for r in got} == {"1.1.1.1": (["ACTIONED", "SUPPRESSED"], 100), "3.3.3.3": (["ACTIONED"], 101)}


def deliver(folder, files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / name).write_text(text)


def test_a_file_is_loaded_once_across_a_restart(spark, tmp_path):
    from packetmill.sources import landing
    out, days = str(tmp_path / "out"), {"at": "2024-01-01"}
    first = {f"f{i}.json": f'{{"n":{i}}}\n' * (i + 1) for i in range(6)}

    def load(folder, checkpoint):
        stream = landing.stream_files(spark, str(folder), max_files_per_trigger=20)
        jobs.start(jobs.load_files(stream, out, str(tmp_path / checkpoint), lambda _: F.lit(days["at"]).cast("timestamp"))).awaitTermination()
        return spark.read.parquet(f"{out}/records").count(), spark.read.parquet(f"{out}/files").count()

    deliver(tmp_path / "in", first)
    assert load(tmp_path / "in", "a") == (21, 6)
    assert load(tmp_path / "in", "a") == (21, 6)  # the stream remembers its files
    assert load(tmp_path / "in", "b") == (21, 6)  # the record remembers them for a stream that has forgotten
    deliver(tmp_path / "in", {"g.json": '[\n{"n": 1},\n{"n":\n2}\n]\n', "empty.json": ""})
    assert load(tmp_path / "in", "b") == (23, 7)
    (tmp_path / "again").mkdir()
    deliver(tmp_path / "again" / "in", {**first, "f0.json": '{"n":7}\n{"n":8}\n'})  # one has another size
    assert load(tmp_path / "again" / "in", "c") == (25, 8)
    days["at"] = "2024-01-15"
    assert load(tmp_path / "in", "d") == (25, 8)
    days["at"] = "2024-01-16"
    assert load(tmp_path / "in", "e")[0] > 25  # forgotten after two weeks


def test_a_batch_run_again_keeps_its_files(spark, tmp_path):
    """The record of a failed batch must not hide the files from its second run."""
    import shutil
    from packetmill.sources import landing
    deliver(tmp_path / "in", {"f.json": '{"n":1}\n', "g.json": '{"n":2}\n'})

    def load():
        stream = landing.stream_files(spark, str(tmp_path / "in"))
        jobs.start(jobs.load_files(stream, str(tmp_path / "out"), str(tmp_path / "cp"), lambda _: F.lit("2024-01-01").cast("timestamp"))).awaitTermination()

    load()
    shutil.rmtree(tmp_path / "cp" / "commits")  # as if the stream had ended before its batch was committed
    load()
    assert sorted(r.line for r in spark.read.parquet(str(tmp_path / "out" / "records")).collect()) == ['{"n":1}', '{"n":2}']


def test_hours_of_numbers_drift_as_in_a_batch(spark, tmp_path):
    import datetime
    import random
    from packetmill.operators import drift
    rng = random.Random(6)
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(minutes=i), rng.gauss(i // 120, 1), None if i % 3 else rng.random()) for i in range(420)]
    rows.append((start + datetime.timedelta(days=2), 0.0, 0.0))  # moves the watermark; its own hour stays open
    schema = "ts timestamp, a double, b double"
    table = spark.createDataFrame(rows, schema)
    profile = drift.numeric_profile(table.where("ts < '2024-01-01 02:00:00'"), ["a", "b"])
    none = spark.createDataFrame([], "feature string, n long, category string, expected double")
    stored = drift.baseline_table(profile, none)
    baseline = spark.createDataFrame(stored.collect(), stored.schema)
    feed(spark, str(tmp_path), [rows[:150], rows[150:300], rows[300:]], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.start(jobs.hourly_drift(stream, "ts", ["a", "b"], baseline, str(tmp_path / "out"), str(tmp_path / "cp"), "0 seconds")).awaitTermination()
    got = {(r.hour, r.feature): r.psi for r in spark.read.parquet(str(tmp_path / "out" / "scores")).collect()}
    assert len(got) == 14
    for h in range(7):
        hour = start + datetime.timedelta(hours=h)
        live = table.where(F.date_trunc("hour", "ts") == F.lit(hour))
        for r in drift.feature_psi(live, baseline, ["a", "b"], []).collect():
            assert abs(got[hour, r.feature] - r.psi) < 1e-9
    reports = spark.read.parquet(str(tmp_path / "out" / "reports"))
    assert reports.count() == 7 and reports.where("status = 'ALERT'").count() == spark.read.parquet(str(tmp_path / "out" / "alerts")).count() > 0


def test_delivery_is_written_by_many_tasks_and_batches_do_not_follow_the_files(spark):
    from packetmill.plans import stream_queries as sq
    rows = spark.range(3000).selectExpr("concat('flows/part_', id % 1500, '.json') as file_name", "id as file_row_number", "'x' as line")
    assert -(-1500 // sq._files_a_batch(rows, 40)) <= sq._BATCHES
    assert sq._files_a_batch(rows.limit(30), 40) == 40
    tasks = {f.rsplit("/", 1)[1][:10] for f in spark.read.text(sq._deliver(rows)).inputFiles()}
    assert len(tasks) == sq._writers(spark)


def test_a_group_that_closes_no_flow_sends_nothing():
    import pandas as pd

    from packetmill.streaming import assembly

    class State:
        exists, hasTimedOut, kept = False, False, None

        def getCurrentWatermarkMs(self):
            return 0

        def update(self, value):
            self.kept = dict(zip(assembly._NAMES, value))

        def setTimeoutTimestamp(self, at):
            self.at = at

    rows = [(50, 2, False, 7, None, True, False, False, False, False), (10, 1, True, 5, True, False, False, False, None, False)]
    state, frame = State(), pd.DataFrame(rows, columns=assembly._PACKET)
    assert list(assembly._stepper(10 ** 7, 10 ** 8)(("k",), iter([frame]), state)) == []
    assert (state.kept["start_us"], state.kept["last_us"], state.kept["packets"], state.kept["bytes_a"], state.kept["bytes_b"]) == (10, 50, 2, 5, 7)
    assert state.kept["ahead"] and state.kept["syn"] and state.kept["wrong_fragment"] == 1


def test_windows_are_held_in_few_groups_whatever_the_number_of_destinations(spark, tmp_path):
    """A group costs milliseconds a batch, so destinations of one bucket share groups; counts are those of the batch."""
    rows = [packet(i, i % 9 * 0.5, (f"10.0.{i % 7}.{i % 200}", 1000 + i % 5)) for i in range(600)]
    done = flows.describe(flows.assemble(frame(spark, rows))).withColumn(
        "dst_ip", F.concat(F.lit("10.1.0."), (F.col("first_seq") % 150).cast("string"))).persist()
    assert done.select("dst_ip").distinct().count() > 100
    far = done.agg(F.max("emit_us")).first()[0] + 100_000_000
    parts = [done.where("first_seq % 2 = 0"), done.where("first_seq % 2 = 1"), done.limit(1).withColumns({"emit_us": F.lit(far), "conn_key": F.lit("z")})]
    counts = assembly.stream_windows(feed(spark, str(tmp_path), parts, done.schema), "100 seconds", shares=4)
    out = str(tmp_path / "out")
    query = jobs.start(jobs.sink(counts, out, out + "-cp"))
    query.awaitTermination()
    held = max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress)
    buckets = conn.with_halo(done).select("bucket").distinct().count()
    assert held <= 4 * (buckets + 1)


def test_counts_of_a_bucket_keep_destinations_apart():
    import pandas as pd
    import pyarrow as pa
    names = ("conn_key", "start_us", "emit_us", "first_seq", "dst_ip", "service", "src_ip", "src_port", "syn_error", "rst", "is_halo")
    rows = [("h", 0, 100, 0, "a", "x", "s", 1, True, False, True), ("p", 0, 200, 1, "a", "x", "s", 1, False, True, False),
            ("q", 0, 200, 2, "b", "x", "s", 1, True, False, False), ("r", 0, 300, 3, "a", None, "t", 2, False, False, False),
            ("s", 0, 2_000_250, 4, "a", "x", "t", 1, False, False, False), ("t", 0, 300, 5, None, "x", "s", 1, False, False, False)]
    chunks = [assembly._chunk(pd.DataFrame(part, columns=names)) for part in (rows[3:], rows[:3])]
    got = assembly._bucket_counts(pa.concat_tables([pa.ipc.open_stream(c).read_all() for c in chunks]))
    counts = {r.conn_key: (r.n, r.sn, r.syn, r.rst, r.hport, r.hother) for r in got.itertuples()}
    assert counts == {"p": (2, 2, 1, 1, 2, 0), "q": (1, 1, 1, 0, 1, 0), "r": (3, 1, 1, 1, 1, 0), "s": (2, 1, 0, 0, 1, 0), "t": (1, 1, 0, 0, 1, 0)}
