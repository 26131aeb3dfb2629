import numpy as np
import pytest
from pyspark.sql import functions as F

from packetmill.operators import drift as dr
from packetmill.operators import quantiles as qt
from packetmill.operators.reports import moment


def pairs(spark, expected, actual):
    return spark.createDataFrame([("f", float(e), float(a)) for e, a in zip(expected, actual)], "feature string, expected double, actual double")


def value(df):
    return df.first().psi


def test_psi_vectors(spark):
    assert abs(value(dr.psi(pairs(spark, [.5, .3, .2], [.5, .3, .2])))) < 1e-12
    assert value(dr.psi(pairs(spark, [.95, .03, .02], [.05, .60, .35]))) > .5
    assert value(dr.psi(pairs(spark, [1] * 10, [1] * 10))) == 0
    e, a = np.array([.5, .5, 1e-4]), np.array([.7, .3, 1e-4])
    e, a = e / e.sum(), a / a.sum()
    assert abs(value(dr.psi(pairs(spark, [.5, .5, 0], [.7, .3, 0]))) - ((a - e) * np.log(a / e)).sum()) < 1e-12


@pytest.mark.parametrize("intervals", [3, 16, 100])
def test_quantiles_equal_numpy(spark, intervals):
    rng = np.random.default_rng(5)
    data = {"skew": rng.exponential(10, 777), "hot": np.where(rng.random(900) < .4, 5.0, rng.normal(0, 3, 900)),
            "few": rng.integers(0, 3, 50).astype(float), "one": np.array([4.0, 4.0])}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs]
    counts = qt.value_counts(spark.createDataFrame(rows, "feature string, value double").repartition(5))
    probs = [i / 10 for i in range(11)]
    got = {(r.feature, r.q): r.value for r in qt.quantiles(counts, probs, intervals).collect()}
    for k, vs in data.items():
        for q in probs:
            assert abs(got[(k, q)] - np.quantile(vs, q)) < 1e-9, (k, q)


def test_numeric_profile_is_numpy_histogram(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.exponential(20, 500))
    df = spark.createDataFrame([(float(v), 3.0) for v in x], "x double, c double")
    rows = {(r.feature, r.bin): r for r in dr.numeric_profile(df, ["x", "c"]).collect()}
    edges = np.unique(np.quantile(x, np.linspace(0, 1, 11)))
    counts, _ = np.histogram(x, edges)
    assert [rows[("x", i)].n for i in range(len(counts))] == counts.tolist()
    want = (counts + 1e-4) / (counts.sum() + 1e-4 * len(counts))
    assert np.allclose([rows[("x", i)].expected for i in range(len(counts))], want)
    assert (rows[("c", 0)].lo, rows[("c", 0)].hi, rows[("c", 0)].n) == (2.0, 4.0, 500)


def test_blind_spot_and_overflow_bins(spark):
    base = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    far = base.select((F.col("x") + 1e6).alias("x"))
    baseline = dr.baseline_table(dr.numeric_profile(base, ["x"]), dr.categorical_profile(base.withColumn("k", F.lit("a")), ["k"]))
    assert dr.feature_psi(far, baseline, ["x"], [], overflow_bins=True).first().psi > 1
    assert abs(dr.feature_psi(base, baseline, ["x"], [], overflow_bins=True).first().psi) < .01
    # A live column without any number scores zero.
    assert dr.feature_psi(base.withColumn("x", F.lit(None).cast("double")), baseline, ["x"], []).first().psi == 0


def test_unseen_categories_are_pooled(spark):
    base = spark.createDataFrame([("a",)] * 8 + [("b",)] * 2, "k string")
    live = spark.createDataFrame([("a",)] * 4 + [("x",)] * 3 + [("y",)] * 3, "k string")
    baseline = dr.baseline_table(dr.numeric_profile(spark.range(5).withColumn("x", F.col("id") * 1.0), ["x"]),
                                 dr.categorical_profile(base, ["k"]))
    got = {r.slot: (r.expected, r.actual) for r in dr.distributions(live, baseline, [], ["k"]).collect()}
    assert got[None] == (1e-4, pytest.approx(.6)) and got["b"][1] == 0.0
    assert got["a"][0] == pytest.approx((.8 + 1e-4) / (1 + 2e-4))


def test_report_and_alert(spark):
    scores = spark.createDataFrame([("a", .3), ("b", .1)], "feature string, psi double")
    window = spark.range(1).select(moment("2024-01-01 00:00:00").alias("window_start"), moment("2024-01-01 01:00:00").alias("window_end"))
    report = dr.drift_report(scores, window, moment("2024-01-01 02:00:00"))
    row = report.first()
    assert (row.status, row.max_psi, [d.feature for d in row.drifted_features]) == ("ALERT", .3, ["a"])
    assert row.feature_psi_details == {"a": .3, "b": .1}
    assert dr.drift_alerts(report).first().attack_type == "MODEL_DRIFT_ALERT"
    quiet = dr.drift_report(scores, window, moment("2024-01-01 02:00:00"), threshold=.3)
    assert quiet.first().status == "OK" and dr.drift_alerts(quiet).count() == 0
    assert dr.monitor_text(report).first()[0] == "drift monitor: max_psi=0.3000, status=ALERT, drifted_features=1"


def test_hourly_psi_pools_unseen_categories(spark):
    """Like the grid of all categories: each hour against the baseline, unknown categories as one slot."""
    import math
    hist = spark.createDataFrame([(1, "x", 1), (1, "new", 60), (1, "newer", 39), (2, "x", 50), (2, "y", 50), (3, "y", 7)],
                                 "hour int, category string, n long")
    base = {"x": 0.5, "y": 0.3, "z": 0.2}
    got = {r.hour: r.psi for r in dr.hourly_psi(hist, spark.createDataFrame(list(base.items()), "category string, expected double")).collect()}
    for hour, seen, unseen in ((1, {"x": .01}, .99), (2, {"x": .5, "y": .5}, 0), (3, {"y": 1.0}, 0)):
        pairs = [(e, seen.get(c, 1e-4)) for c, e in base.items()] + ([(1e-4, unseen)] if unseen else [])
        se, sa = (sum(p[k] for p in pairs) for k in (0, 1))
        assert abs(got[hour] - sum((a / sa - e / se) * math.log((a / sa) / (e / se)) for e, a in pairs)) < 1e-9
