import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from packetmill.models import ensemble, iforest, training
from packetmill.operators import features as ft
from packetmill.operators import metrics as mx
from packetmill.operators.reports import moment


def test_scaling_matches_population_formulas(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0)], "x double, c double")
    x = np.array([1.0, 2.0, 6.0])
    got = ft.standard_scale(df, ["x", "c"]).orderBy("x").collect()
    assert np.allclose([r.x for r in got], (x - x.mean()) / x.std()) and [r.c for r in got] == [0.0] * 3
    assert [r.x for r in ft.minmax_scale(df, ["x", "c"]).orderBy("x").collect()] == [0.0, .2, 1.0]


def test_preprocessor(spark):
    rows = spark.createDataFrame([(1.0, "tcp"), (2.0, "udp"), (6.0, "icmp")], "x double, p string")
    model = ft.preprocessor(["x"], ["p"], 3).fit(rows)
    got = model.transform(rows.unionByName(spark.createDataFrame([(3.0, "odd")], rows.schema))).select(
        "p", vector_to_array("features").alias("v")).collect()
    by = {r.p: list(r.v) for r in got}
    assert [by[k][1:] for k in ("icmp", "tcp", "udp", "odd")] == [[1, 0, 0], [0, 1, 0], [0, 0, 1], [0, 0, 0]]
    x = np.array([1.0, 2.0, 6.0])
    assert np.isclose(by["udp"][0], (2 - x.mean()) / x.std())


def test_split_is_exact_and_repeatable(spark):
    df = spark.range(203).select(F.col("id"), F.when(F.col("id") < 150, "a").when(F.col("id") < 200, "b").otherwise("c").alias("k"))
    split = ft.stratified_split(df, "id", "k")
    got = {r.k: (r.n, r.t) for r in split.groupBy("k").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert got == {"a": (150, 30), "b": (50, 10), "c": (3, 1)}
    again = ft.stratified_split(df.repartition(5), "id", "k")
    assert split.where("is_test").select("id").exceptAll(again.where("is_test").select("id")).count() == 0
    lone = ft.stratified_split(df.where("id < 9 or id = 202"), "id", "k")
    assert lone.where("is_test").count() == 2  # one stratum when a class has a single row


def test_confusion_metrics(spark):
    y, p = [0, 0, 1, 1, 2, 2, 2], [0, 1, 1, 1, 2, 0, 3]
    df = spark.createDataFrame(list(zip(map(str, y), map(str, p))), "label string, prediction string")
    by = {r["class"]: r for r in mx.per_class(mx.confusion(df)).collect()}
    assert (by["0"].tp, by["0"].fp, by["0"].fn, by["0"].tn) == (1, 1, 1, 4)
    assert by["3"].recall == 0 and by["3"].precision == 0
    s = mx.summary(mx.per_class(mx.confusion(df))).first()
    assert np.isclose(s.accuracy, 4 / 7) and np.isclose(s.recall, 4 / 7) and s.samples == 7


def test_isolation_forest_finds_outliers(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(a), float(b)]) for i, (a, b) in enumerate(rng.normal(0, 1, (600, 2)))]
    df = spark.createDataFrame(rows + [(9999, [9.0, -9.0])], "flow_id long, x array<double>")
    nodes = iforest.fit(df, trees=40, psi=64)
    assert nodes.select("tree").distinct().count() == 40
    assert nodes.groupBy("tree").count().agg(F.max("count")).first()[0] <= 2 * 64
    scores = {r.flow_id: r.s for r in df.select("flow_id", iforest.scorer(nodes)("x").alias("s")).collect()}
    assert min(scores, key=scores.get) == 9999 and all(-1 <= s < 0 for s in scores.values())
    again = iforest.fit(df.repartition(6), trees=40, psi=64)
    assert nodes.exceptAll(again).count() == 0


def test_train_save_load_score(spark, tmp_path):
    rng = np.random.default_rng(4)
    names = ["Normal", "DoS", "Probe"]
    rows = [(i, names[i % 3], float(i % 3 * 5 + rng.normal()), ["http", "ssh", "ftp"][i % 3]) for i in range(240)]
    df = spark.createDataFrame(rows, "flow_id long, target string, x double, service string")
    params = ensemble.EnsembleParams(boosted_trees=2, boosted_depth=2, forest_trees=4, forest_depth=4)
    models = training.train(df, ["x"], ["service"], params=params, trees=10)
    assert models.metrics["accuracy"] > .95 and set(models.metrics["per_class_recall"]) == set(names)
    path = str(tmp_path / "models")
    training.save(models, path, "v1", moment("2024-01-01 00:00:00"))
    flows = df.withColumnRenamed("target", "label")
    a = training.score(flows, models).select("flow_id", "predicted_category", "confidence", "anomaly_score", "severity")
    b = training.score(flows, training.load(spark, path)).select(*a.columns)
    assert a.exceptAll(b).count() == 0
    got = training.score(flows, models).agg(F.min("confidence"), F.max("confidence"), F.max("anomaly_score")).first()
    assert 1 / 3 <= got[0] <= got[1] <= 1 and got[2] < 0
    # A flow without the feature columns is completed with defaults.
    assert training.score(spark.createDataFrame([(1,)], "flow_id long"), models).count() == 1


def test_correlation_is_pairwise(spark):
    """A null in one column takes its row out of that column's pairs only."""
    rows = [(1.0, 2.0, None, 5.0), (2.0, 1.0, 3.0, 5.0), (3.0, 5.0, 1.0, 5.0), (4.0, 3.0, 4.0, 5.0), (5.0, 4.5, None, 5.0)]
    table = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = {(r.a, r.b): r.abs_r for r in ft.correlations(table, ["a", "b", "c", "d"]).collect()}
    frame = table.toPandas()
    for pair in (("a", "b"), ("a", "c"), ("b", "c")):
        assert abs(got[pair] - abs(frame[list(pair)].corr().iloc[0, 1])) < 1e-9
    assert got["a", "d"] is None


def plain_information(x, y, neighbours=3):
    """The estimator over all pairs of rows."""
    def digamma(n):
        return -np.euler_gamma + sum(1 / i for i in range(1, n))

    keep = np.array([(y == c).sum() > 1 for c in y])
    x, y = x[keep], y[keep]
    parts = []
    for i in range(len(x)):
        k, others = min(neighbours, (y == y[i]).sum() - 1), [j for j in range(len(x)) if y[j] == y[i] and j != i]
        last = sorted(others, key=lambda j: abs(x[j] - x[i]))[k - 1]
        r = abs(x[last] - x[i])
        m = (x == x[i]).sum() if r == 0 else (np.abs(x - x[i]) < r).sum()
        parts.append(digamma(int(k)) - digamma(int((y == y[i]).sum())) - digamma(int(m)))
    return max(0.0, digamma(len(x)) + np.mean(parts))


def test_neighbour_information_like_all_pairs(spark):
    rng = np.random.default_rng(8)
    y = np.array(["a", "b", "a", "c"])[rng.integers(0, 4, 130)]
    y[:1], y[1:3] = "alone", "two"
    columns = {"near": (y == "a") * 2.0 + rng.integers(0, 4096, 130) / 1024, "ties": rng.integers(0, 4, 130).astype(float),
               "noise": rng.integers(-4096, 4096, 130) / 512, "same": np.ones(130)}  # binary fractions: distances are exact
    rows = [(str(c), *[float(v[i]) for v in columns.values()]) for i, c in enumerate(y)]
    table = spark.createDataFrame(rows, "y string, " + ", ".join(f"{c} double" for c in columns))
    for block in (8, 1 << 16):
        got = ft.neighbour_information(table.repartition(5), list(columns), "y", block=block).collect()
        assert {r.feature for r in got} == set(columns) and got[0].feature == "near"
        for r in got:
            assert abs(r.mi_score - plain_information(columns[r.feature], y)) < 1e-9


def test_correlation_plan_is_small(spark):
    columns = [f"x{i}" for i in range(38)]
    rng = np.random.default_rng(9)
    data = rng.normal(1e6, 1, (200, 38)) + rng.normal(0, 2, (200, 1))
    rows = [tuple(None if (i * 7 + j) % 11 == 0 else float(v) for j, v in enumerate(r)) for i, r in enumerate(data)]
    table = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))
    found = ft.correlations(table, columns)
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 60_000
    got = {(r.a, r.b): r.abs_r for r in found.collect()}
    expected = table.toPandas().corr().abs()
    assert len(got) == 703 and all(abs(v - expected.loc[a, b]) < 1e-9 for (a, b), v in got.items())
    empty = ft.correlations(table.where("false"), columns[:3]).collect()
    assert [r.abs_r for r in empty] == [None] * 3


def _counted(spark, table):
    """The table, and how many of its rows have been read so far."""
    read = spark.sparkContext.accumulator(0)

    def through(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    return table.mapInArrow(through, table.schema), read


def test_correlations_read_their_rows_once_and_meet_from_tasks_with_other_means(spark):
    rows = [(float(i) + 1e6 * (i // 50), (i * 37 % 101) / 7.0 if i % 9 else None, 5.0, float("nan") if i == 3 else 1.0 * i) for i in range(200)]
    table, read = _counted(spark, spark.createDataFrame(rows, "a double, b double, c double, d double").coalesce(1).repartition(7))
    got = {(r.a, r.b): r.abs_r for r in ft.correlations(table, ["a", "b", "c", "d"]).collect()}
    assert read.value == len(rows)
    a, b = np.array([r[:2] for r in rows if r[1] is not None]).T
    assert abs(got["a", "b"] - abs(np.corrcoef(a, b)[0, 1])) < 1e-9
    assert got["a", "c"] is None and got["a", "d"] is None


def test_neighbour_information_reads_its_rows_once(spark):
    rows = [("xy"[i % 2], float(i * i % 17)) for i in range(300)]
    table, read = _counted(spark, spark.createDataFrame(rows, "y string, v double"))
    assert ft.neighbour_information(table, ["v"], "y").count() == 1
    assert read.value == len(rows)
