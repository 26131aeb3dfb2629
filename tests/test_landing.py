from pyspark.sql import functions as F

from packetmill.schemas import FEATURES, REGISTRY, feature_default
from packetmill.sources import datasets, landing, sinks
import pytest

LINES = [
    '{"records":[{"src_ip":"1.1.1.1","dst_ip":"2.2.2.2","duration":2.7,"src_port":443},{"src_ip":"1.1.1.1","dst_ip":"2.2.2.2","flow_id":"smoke-1"}]}',
    '{"src_ip":"3.3.3.3","dst_ip":"4.4.4.4","count":7,"serror_rate":0.5}',
    '{"records":[]}', '{broken', '[{"src_ip":"5.5.5.5","dst_ip":"6.6.6.6"},{"src_ip":"7.7.7.7","dst_ip":"8.8.8.8"}]',
    '{"src_ip":"9.9.9.9","dst_ip":"1.1.1.1","duration":"many"}',
]


def lines(spark, name="flows/part_1.json"):
    return spark.createDataFrame([(name, i + 1, l) for i, l in enumerate(LINES)], "file_name string, file_row_number long, line string")


def test_landing_and_quarantine(spark):
    landed = landing.land(lines(spark))
    assert landed.count() == len(LINES) + 1  # the array line becomes two rows
    assert landed.select("raw_id").distinct().count() == len(LINES) + 1
    assert [r.file_row_number for r in landing.quarantine(landed).collect()] == [4]


def test_flatten(spark):
    flat = landing.load_flows(lines(spark))
    rows = {(r.src_ip, r.flow_id): r for r in flat.collect()}
    by_ip = {}
    for (ip, _), r in rows.items():
        by_ip.setdefault(ip, []).append(r)
    assert {ip: len(v) for ip, v in by_ip.items()} == {"1.1.1.1": 2, "3.3.3.3": 1, None: 1, "5.5.5.5": 1, "7.7.7.7": 1, "9.9.9.9": 1}
    first = next(r for r in by_ip["1.1.1.1"] if r.src_port == 443)
    assert first.duration == 3 and first.dst_host_count == 255 and not first.is_synthetic
    assert next(r for r in by_ip["1.1.1.1"] if r.src_port is None).is_synthetic
    assert by_ip["3.3.3.3"][0]["count"] == 7 and by_ip["9.9.9.9"][0].duration == 0
    blank = by_ip[None][0]
    assert all(blank[c] == feature_default(c) for c in FEATURES)
    assert landing.accepted(flat).count() == 6 and landing.rejected(flat).count() == 1
    assert landing.load_flows(lines(spark, "flows/smoke_7.json")).where("not is_synthetic").count() == 0


def test_line_numbers_of_split_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, n in (("a", 500), ("b", 3)):
        (tmp_path / "in" / f"{name}.json").write_text("".join(f'{{"n":{i}}}\n' for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        got = landing.read_lines(spark, str(tmp_path / "in"))
        assert got.count() == 503
        assert got.where(F.get_json_object("line", "$.n").cast("long") != F.col("file_row_number")).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_labelled_reader(spark, tmp_path):
    schema = "duration int, label string"
    (tmp_path / "x.csv").write_text("duration,label\n1,neptune\n")
    (tmp_path / "x.txt").write_text("1,neptune\n2,normal.\n")
    assert [r.attack_category for r in datasets.read_labelled(spark, str(tmp_path / "x.csv"), schema).collect()] == ["DoS"]
    assert [r.attack_category for r in datasets.read_labelled(spark, str(tmp_path / "x.txt"), schema).collect()] == ["DoS", "Normal"]
    with pytest.raises(ValueError):
        datasets.target_column(spark.range(1))


def test_contract_and_sinks(spark, tmp_path):
    path = str(tmp_path / "registry")
    sinks.append(spark.createDataFrame([("m", "v1")], "model_name string, version string"), path, REGISTRY)
    table = spark.read.parquet(path)
    assert table.columns == REGISTRY.fieldNames() and table.first().stage_path is None
    with pytest.raises(sinks.ContractError):
        sinks.check_contract(spark.range(1), REGISTRY)
    sinks.clear(table, str(tmp_path / "empty"))
    assert spark.read.parquet(str(tmp_path / "empty")).count() == 0
    assert sinks.json_line(spark.createDataFrame([(1, None)], "b int, a string")).first().value == '{"a":null,"b":1}'


def plain_elements(text):
    """Elements of arrays over several lines, character by character."""
    out, now, depth, inside, escaped = [], "", 0, False, False
    for c in text:
        if inside and c != "\n":
            inside, escaped = escaped or c != '"', c == "\\" and not escaped
            now += c
            continue
        inside, escaped = c == '"', False
        if c in "]}":
            depth -= 1
        if (c == "," and depth <= 1) or (c == "]" and depth == 0):
            out.append(now)
            now = ""
        elif not (c == "[" and depth == 0):
            now += c
        if c in "[{":
            depth += 1
    return [e.strip(" ").strip("\n ") for e in [*out, now] if e.strip()]


def test_arrays_over_lines(spark, tmp_path):
    import json
    import random
    rng = random.Random(3)
    folder = tmp_path / "in"
    folder.mkdir()
    expected = {}
    for k in range(12):
        made = [rng.choice([{"a": i, "s": "x ] } , \\ \" [", "l": [1, [2, {"b": None}]]}, [i], i, "text, [", None, {}]) for i in range(rng.randrange(1, 60))]
        text = json.dumps(made, indent=rng.choice([1, 4]))
        if k % 4 == 1:
            text = text.replace("2,", "2, oops,", 1)
        if k % 4 == 2:
            text = "\n  \n" + text + "\n"
        if k % 4 == 3:
            text = "[\n" + ",\n\n".join(json.dumps(m) + " " for m in made) + "\n,\n]"
        (folder / f"f{k}.json").write_text(text)
        expected[f"f{k}"] = [" ".join(e.split()) for e in plain_elements(text)]
    (folder / "lines.json").write_text('{"a":1}\n[1,2]\n{broken\n')
    expected["lines"] = ['{"a":1}', "[1,2]", "{broken"]
    for size in ("256", "1g"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = {}
            for r in landing.read_records(spark, str(folder)).orderBy("file_name", "file_row_number").collect():
                got.setdefault(r.file_name.rsplit("/")[-1][:-5], []).append((r.file_row_number, " ".join(r.line.split())))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert {k: [t for _, t in v] for k, v in got.items()} == expected
        assert all([n for n, _ in v] == list(range(1, len(v) + 1)) for v in got.values())


def test_array_elements_carry_over_blocks_and_long_ones_are_not_gathered(spark):
    text = ["[", *[x for i in range(50) for x in ("{", f'"n": {i}', "},")], '{"never": [1,', *['"closed",'] * 200]
    lines = spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(text)], "file_name string, file_row_number long, line string")
    for block in (7, 1 << 16):
        got = landing.array_elements(lines, longest=500, block_lines=block).orderBy("file_row_number").collect()
        assert [r.file_row_number for r in got] == list(range(1, 52)) and got[-1].line is None
        landed = landing.land(spark.createDataFrame(got)).orderBy("file_row_number")
        values = [r.n for r in landed.select(F.try_variant_get("record_content", "$.n", "long").alias("n")).collect()]
        assert values == [*range(50), None]
    assert landing.array_elements(lines.where("false")).count() == 0


def test_records_read_their_lines_once(spark):
    read = spark.sparkContext.accumulator(0)
    rows = [("a", i + 1, t) for i, t in enumerate(["[", " {\"k\": 1,", " \"l\": 2},", "3", "]"])] + [("b", 1, "{}"), ("b", 2, "7")]

    def through(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    lines = spark.createDataFrame(rows, "file_name string, file_row_number long, line string").mapInArrow(
        through, "file_name string, file_row_number long, line string")
    got = sorted((r.file_name, r.file_row_number, r.line) for r in landing.records_of(lines).collect())
    assert [(f, n, t.strip()) for f, n, t in got] == [("a", 1, "{\"k\": 1,\n \"l\": 2}"), ("a", 2, "3"), ("b", 1, "{}"), ("b", 2, "7")]
    assert read.value == len(rows)


def test_small_files_are_opened_once_and_many_by_a_task(spark, tmp_path):
    """Numbering reads the lines twice; the files must not be read twice, nor four by four."""
    from packetmill import session
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(120):
        (folder / f"f{i}.json").write_text('{"n":1}\n{"n":2}\n')
    key, before = "spark.sql.files.openCostInBytes", spark.conf.get("spark.sql.files.openCostInBytes")
    numbered = landing.read_lines(spark, str(folder))
    assert spark.conf.get(key) == before
    kept = numbered.inputFiles()
    assert kept and all("landing-scan-" in f for f in kept) and len(kept) <= 4 * spark.sparkContext.defaultParallelism
    assert sorted({r.file_row_number for r in numbered.collect()}) == [1, 2] and numbered.count() == 240
    stored = landing.placed_lines(spark.read.text(str(folder)).select(*landing._where(), "value"))
    with session.passing_tables(spark):
        again = landing.number_lines(stored)
        assert not session._passing[-1] and again.count() == 240  # lines that are stored are not stored again
