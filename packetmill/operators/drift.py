"""Baseline profiles, live histograms and the population stability index (PSI).

All features go through one unpivot and one shuffle on (feature, bin) that combines on
the map side; nothing is computed per feature.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetmill.operators import quantiles as qt
from packetmill.schemas import DRIFT_CLASS, DRIFT_REPORTS, PSI_EPS, PSI_THRESHOLD
from packetmill.session import materialise
from packetmill.sources.sinks import append, check_contract


def long_numeric(table: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value) of the numeric columns; text that is no number becomes null."""
    types = dict(table.dtypes)
    cast = [(F.col(c).try_cast("double") if types[c] == "string" else F.col(c).cast("double")).alias(c)
            for c in columns]
    return table.select(*cast).unpivot([], columns, "feature", "value")


def long_categorical(table: DataFrame, columns: list[str]) -> DataFrame:
    return table.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], columns, "feature", "category")


def _smoothed(count: Column, total: Column, bins: Column) -> Column:
    return (count + PSI_EPS) / (total + PSI_EPS * bins)


# --- baseline -----------------------------------------------------------------


def numeric_edges(counts: DataFrame, bins: int = 10) -> DataFrame:
    """(feature, edges): distinct quantile edges of features with at least two values."""
    probs = [i / bins for i in range(bins + 1)]
    enough = counts.groupBy("feature").agg(F.sum("cnt").alias("total")).where("total >= 2").select("feature")
    edges = (
        qt.quantiles(counts, probs).groupBy("feature")
        .agg(F.array_sort(F.collect_set("value")).alias("edges")).join(enough, "feature")
    )
    lone = F.array(F.element_at("edges", 1) - 1.0, F.element_at("edges", 1) + 1.0)
    return edges.withColumn("edges", F.when(F.size("edges") < 2, lone).otherwise(F.col("edges")))


def bin_of(value: Column, edges: Column) -> Column:
    """Zero-based bin, right-most bin closed; -1 below the first edge, size-1 above the last."""
    last = F.size(edges) - 2
    below_or_at = F.size(F.filter(edges, lambda e: e <= value))
    return F.when(value == F.element_at(edges, -1), last).otherwise(below_or_at - 1)


def _grid(edges: DataFrame) -> DataFrame:
    """One row per feature and bin with its bounds, including empty bins."""
    bins = F.sequence(F.lit(0), F.size("edges") - 2)
    return edges.select("feature", "edges", F.explode(bins).alias("bin")).select(
        "feature", "bin", F.col("edges")[F.col("bin")].alias("lo"),
        F.col("edges")[F.col("bin") + 1].alias("hi"))


def histogram(counts: DataFrame, edges: DataFrame) -> DataFrame:
    """(feature, bin, n) of folded values; one edges row per feature is broadcast."""
    placed = counts.join(F.broadcast(edges), "feature").select(
        "feature", "cnt", bin_of(F.col("value"), F.col("edges")).alias("bin"))
    return placed.groupBy("feature", "bin").agg(F.sum("cnt").alias("n"))


def numeric_profile(table: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """(feature, bin, lo, hi, n, expected) of the baseline sample."""
    counts = materialise(qt.value_counts(long_numeric(table, columns)), "value-counts")
    edges = materialise(numeric_edges(counts, bins), "edges")
    filled = _grid(edges).join(histogram(counts, edges), ["feature", "bin"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0)))
    whole = Window.partitionBy("feature")
    return filled.withColumn("expected", _smoothed(
        F.col("n"), F.sum("n").over(whole), F.count(F.lit(1)).over(whole)))


def categorical_profile(table: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, category, n, expected), most frequent first; smoothing is on proportions."""
    counts = long_categorical(table, columns).where("category is not null").groupBy(
        "feature", "category").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("feature")
    share = F.col("n") / F.sum("n").over(whole)
    k = F.count(F.lit(1)).over(whole)
    return counts.withColumn("share", share).withColumn("k", k).withColumn(
        "expected", (F.col("share") + PSI_EPS) / (F.sum("share").over(whole) + PSI_EPS * F.col("k"))
    ).drop("share", "k").orderBy("feature", F.desc("n"), "category")


def baseline_table(numeric: DataFrame, categorical: DataFrame) -> DataFrame:
    """Both profiles in storage form: one row per feature."""
    by_bin = F.array_sort(F.collect_list(F.struct("bin", "lo", "hi", "expected")))
    num = numeric.groupBy("feature").agg(by_bin.alias("rows")).select(
        "feature", F.lit("numeric").alias("kind"),
        F.concat(F.transform("rows", lambda r: r["lo"]),
                 F.array(F.element_at("rows", -1)["hi"])).alias("bins"),
        F.lit(None).cast("array<string>").alias("categories"),
        F.transform("rows", lambda r: r["expected"]).alias("expected"))
    by_freq = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "category", "expected")))
    cat = categorical.groupBy("feature").agg(by_freq.alias("rows")).select(
        "feature", F.lit("categorical").alias("kind"),
        F.lit(None).cast("array<double>").alias("bins"),
        F.transform("rows", lambda r: r["category"]).alias("categories"),
        F.transform("rows", lambda r: r["expected"]).alias("expected"))
    return num.unionByName(cat)


# --- live distribution against the baseline ---------------------------------------


def _present(live: DataFrame, numeric, categorical):
    have = {c.lower() for c in live.columns}
    return [c for c in numeric if c.lower() in have], [c for c in categorical if c.lower() in have]


def distributions(live: DataFrame, baseline: DataFrame, numeric: list[str], categorical: list[str],
                  overflow_bins: bool = True) -> DataFrame:
    """(feature, slot, expected, actual) for every bin and category of the baseline.

    Values outside the baseline range go into two extra bins, expected to hold next to
    nothing. ``overflow_bins=False`` drops them, which hides a shift that leaves the
    range altogether. Unseen categories are pooled into one extra slot.
    """
    parts = []
    if numeric:
        edges = baseline.where("kind = 'numeric'").select("feature", F.col("bins").alias("edges"), "expected")
        # Edges are known, so values are binned before anything is grouped: a row per feature and bin leaves a task.
        values = long_numeric(live, numeric).where("value is not null and not isnan(value)").withColumn("cnt", F.lit(1))
        seen = materialise(histogram(values, edges.select("feature", "edges")), "live-histogram")
        inside = edges.select("feature", F.posexplode("expected").alias("bin", "expected"))
        if overflow_bins:
            outer = edges.select("feature", F.explode(F.array(F.lit(-1), F.size("edges") - 1)).alias("bin"),
                                 F.lit(PSI_EPS).alias("expected"))
            inside = inside.unionByName(outer)
        # A feature without a single live value has nothing to compare.
        present = seen.select("feature").distinct()
        grid = inside.join(present, "feature", "left_semi").join(seen, ["feature", "bin"], "left")
        whole = Window.partitionBy("feature")
        n = F.coalesce("n", F.lit(0))
        parts.append(grid.select(
            "feature", F.col("bin").cast("string").alias("slot"), "expected",
            _smoothed(n, F.sum(n).over(whole), F.count(F.lit(1)).over(whole)).alias("actual")))
    if categorical:
        known = baseline.where("kind = 'categorical'").select(
            "feature", F.explode(F.arrays_zip("categories", "expected")).alias("z")).select(
            "feature", F.col("z.categories").alias("category"), F.col("z.expected").alias("expected"))
        found = long_categorical(live, categorical).groupBy(
            "feature", F.coalesce("category", F.lit("nan")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
        found = found.withColumn("actual", F.col("n") / F.sum("n").over(Window.partitionBy("feature"))).drop("n")
        profiled = known.select("feature").distinct()
        both = known.join(found.join(profiled, "feature", "left_semi"), ["feature", "category"], "full")
        unseen = F.col("expected").isNull()
        parts.append(both.groupBy(
            "feature", F.when(unseen, F.lit(None)).otherwise(F.col("category")).alias("slot")
        ).agg(F.max(F.coalesce("expected", F.lit(PSI_EPS))).alias("expected"),
              F.sum(F.coalesce("actual", F.lit(0.0))).alias("actual")))
    return reduce(DataFrame.unionByName, parts)


def psi(pairs: DataFrame, *keys: str) -> DataFrame:
    """(feature, psi), or one per further keys, from expected and actual weights; zeros become eps, both sides sum to 1."""
    whole = Window.partitionBy(*keys, "feature")

    def weight(name):
        w = F.when(F.col(name) <= 0, F.lit(PSI_EPS)).otherwise(F.col(name))
        return w / F.sum(w).over(whole)

    norm = pairs.select(*keys, "feature", weight("expected").alias("e"), weight("actual").alias("a"))
    return norm.groupBy(*keys, "feature").agg(
        F.sum((F.col("a") - F.col("e")) * F.log(F.col("a") / F.col("e"))).alias("psi"))


def feature_psi(live: DataFrame, baseline: DataFrame, numeric: list[str], categorical: list[str],
                overflow_bins: bool = True) -> DataFrame:
    """PSI of each baseline feature present in the live table; no live values means 0."""
    numeric, categorical = _present(live, numeric, categorical)
    found = psi(distributions(live, baseline, numeric, categorical, overflow_bins))
    named = baseline.where(F.col("feature").isin(numeric + categorical)).select("feature")
    return named.join(found, "feature", "left").withColumn("psi", F.coalesce("psi", F.lit(0.0)))


def drift_report(scores: DataFrame, window: DataFrame, check_ts: Column,
                 threshold: float = PSI_THRESHOLD) -> DataFrame:
    """One report row from (feature, psi) and a one-row (window_start, window_end)."""
    one = F.lit(1).alias("one")
    report = scores.groupBy().agg(*_found(threshold)).select("*", one).join(window.select("*", one), "one")  # one row each
    return _reported(report, check_ts, threshold)


def _found(threshold: float) -> list[Column]:
    shown = F.bround("psi", 6)
    drifted = F.when(F.col("psi") > threshold, F.struct("feature", shown.alias("psi"), F.lit(True).alias("threshold_exceeded")))
    return [F.coalesce(F.max(shown), F.lit(0.0)).alias("max_psi"), F.array_sort(F.collect_list(drifted)).alias("drifted_features"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("feature"), shown.alias("shown"))))).alias("feature_psi_details")]


def _reported(report: DataFrame, check_ts: Column, threshold: float) -> DataFrame:
    return report.select(
        F.md5(F.concat_ws("|", "window_start", "window_end", check_ts.cast("string"))).alias("report_id"),
        check_ts.alias("check_ts"), "window_start", "window_end", "max_psi",
        "drifted_features", "feature_psi_details",
        F.when(F.col("max_psi") > threshold, "ALERT").otherwise("OK").alias("status"))


def report_window(live: DataFrame, ts: str, as_of: Column) -> DataFrame:
    """First and last load time of the live rows, or the hour before ``as_of``."""
    hour = F.expr("interval 1 hour")
    return live.agg(F.coalesce(F.min(ts), as_of - hour).alias("window_start"),
                    F.coalesce(F.max(ts), as_of).alias("window_end"))


def drift_alerts(reports: DataFrame) -> DataFrame:
    """Alert-table rows for reports in state ALERT."""
    text = F.lit(None).cast("string")
    return reports.where("status = 'ALERT'").select(
        F.md5(F.concat(F.lit("drift|"), "report_id")).alias("alert_id"),
        F.col("check_ts").alias("alert_ts"), text.alias("flow_id"),
        F.lit("0.0.0.0").alias("src_ip"), F.lit("0.0.0.0").alias("dst_ip"),
        F.lit(None).cast("int").alias("src_port"), F.lit(None).cast("int").alias("dst_port"),
        F.lit(DRIFT_CLASS).alias("attack_type"), F.lit(1.0).alias("confidence"),
        F.lit(None).cast("double").alias("anomaly_score"), F.lit("HIGH").alias("severity"),
        F.lit(False).alias("is_zero_day_suspect"), F.lit(False).alias("is_synthetic"),
        F.lit("PENDING").alias("mitigation_status"))


def monitor(live: DataFrame, baseline: DataFrame, ts: str, as_of: Column, path: str, numeric: list[str], categorical: list[str],
            hours: int = 1, threshold: float = PSI_THRESHOLD) -> DataFrame:
    """One run of the drift job: the trailing window against the stored baseline, the report appended, its alerts returned.

    The report is written first and read back by its id, so the alerts are those of the stored row.
    """
    recent = live.where((F.col(ts) >= as_of - F.expr(f"interval {int(hours)} hours")) & (F.col(ts) < as_of))
    report = drift_report(feature_psi(recent, baseline, numeric, categorical), report_window(recent, ts, as_of), as_of, threshold)
    report = materialise(check_contract(report, DRIFT_REPORTS), "drift-report")
    append(report, path, DRIFT_REPORTS)
    return drift_alerts(report)


def monitor_line() -> Column:
    return F.concat(
        F.lit("drift monitor: max_psi="), F.format_string("%.4f", "max_psi"),
        F.lit(", status="), "status", F.lit(", drifted_features="),
        F.size("drifted_features").cast("string"))


def monitor_text(reports: DataFrame) -> DataFrame:
    return reports.select(monitor_line().alias("summary"))


def hourly_histogram(rows: DataFrame, ts: str, feature: str) -> DataFrame:
    """Counts per hour of data and value; the same code serves a batch and a stream."""
    return rows.groupBy(F.window(ts, "1 hour").alias("w"), F.col(feature).alias("category")).agg(
        F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "category", "n")


def hourly_psi(histogram: DataFrame, baseline: DataFrame) -> DataFrame:
    """PSI of each hour against one categorical baseline (category, expected).

    As in ``distributions``, categories the baseline does not know are one more slot, expected to hold next to nothing.
    No hour is paired with categories it does not have: what those add follows from the sums of
    e, ln e and e ln e over the whole baseline less the same sums over the hour's own categories.
    """
    eps = F.lit(PSI_EPS)
    known = baseline.select("category", F.greatest("expected", eps).alias("e"))
    whole = known.agg(F.count("*").alias("k"), F.coalesce(F.sum("e"), F.lit(0.0)).alias("e"),
                      F.coalesce(F.sum(F.log("e")), F.lit(0.0)).alias("l"),
                      F.coalesce(F.sum(F.col("e") * F.log("e")), F.lit(0.0)).alias("el")).first()  # four numbers
    total = F.sum("n").over(Window.partitionBy("hour"))
    rows = histogram.withColumn("a", F.col("n") / total).join(known, "category", "left")
    seen = F.col("e").isNotNull()
    own = rows.groupBy("hour").agg(
        F.count_if(seen).alias("k"), *[F.coalesce(F.sum(F.when(seen, x)), F.lit(0.0)).alias(n) for n, x in (
            ("a", F.col("a")), ("e", F.col("e")), ("l", F.log("e")), ("el", F.col("e") * F.log("e")),
            ("p", F.col("a") * (F.log("a") - F.log("e"))), ("q", F.col("e") * (F.log("a") - F.log("e"))))],
        F.coalesce(F.sum(F.when(~seen, F.col("a"))), F.lit(0.0)).alias("u"))
    own = own.withColumns({
        "mk": F.lit(whole["k"]) - F.col("k"), "me": F.lit(whole["e"]) - F.col("e"),
        "ml": F.lit(whole["l"]) - F.col("l"), "mel": F.lit(whole["el"]) - F.col("el"),
        "extra": F.when(F.col("u") > 0, eps).otherwise(F.lit(0.0))})
    own = own.withColumns({"sa": F.col("a") + F.col("mk") * eps + F.col("u"), "se": F.lit(whole["e"]) + F.col("extra")})
    c = F.log("se") - F.log("sa")
    shift = c * (F.col("a") / F.col("sa") - F.col("e") / F.col("se"))
    here = F.col("p") / F.col("sa") - F.col("q") / F.col("se") + shift
    # Categories the hour lacks weigh eps: sums over (eps/sa - e/se) (ln eps - ln e + c).
    base = F.log(eps) + c
    lacking = (F.col("mk") * eps / F.col("sa") * base - eps / F.col("sa") * F.col("ml")
               - F.col("me") / F.col("se") * base + F.col("mel") / F.col("se"))
    x, y = F.col("u") / F.col("sa"), eps / F.col("se")
    unseen = F.when(F.col("u") > 0, (x - y) * F.log(x / y)).otherwise(F.lit(0.0))
    return own.select("hour", (here + lacking + unseen).alias("psi"))


def hourly_bins(rows: DataFrame, ts: str, columns: list[str], baseline: DataFrame) -> DataFrame:
    """``(hour, feature, bin, n)``: counts per hour of data and bin of the stored baseline; the same code serves a batch and a stream.

    A value finds its bin in the row before anything is grouped, so the state of a stream holds a count per hour, feature and bin.
    """
    types = dict(rows.dtypes)
    numbers = [(F.col(c).try_cast("double") if types[c] == "string" else F.col(c).cast("double")).alias(c) for c in columns]
    values = rows.select(F.col(ts).alias("_ts"), *numbers).unpivot(["_ts"], columns, "feature", "value").where("value is not null and not isnan(value)")
    edges = baseline.where("kind = 'numeric'").select("feature", F.col("bins").alias("edges"))  # a row per feature
    binned = values.join(F.broadcast(edges), "feature").select("_ts", "feature", bin_of(F.col("value"), F.col("edges")).alias("bin"))
    return binned.groupBy(F.window("_ts", "1 hour").alias("w"), "feature", "bin").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("hour"), "feature", "bin", "n")


def hourly_feature_psi(bins: DataFrame, baseline: DataFrame, overflow_bins: bool = True) -> DataFrame:
    """``(hour, feature, psi)`` from whole hours of ``hourly_bins``, as ``feature_psi`` gives it for the rows of one hour.

    An hour has the baseline's bins of each feature that it has values of, and two more for values outside of the baseline's range.
    """
    stored = baseline.where("kind = 'numeric'").select("feature", F.col("expected").alias("stored"))  # a row per feature
    last = F.size("stored")
    slots = F.transform("stored", lambda e, i: F.struct(i.alias("bin"), e.alias("expected")))
    if overflow_bins:
        slots = F.concat(slots, F.array(*[F.struct(b.alias("bin"), F.lit(PSI_EPS).alias("expected")) for b in (F.lit(-1), last)]))
    counted = bins.groupBy("hour", "feature").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("seen"))  # a bin each
    grid = counted.join(F.broadcast(stored), "feature").withColumn("slot", F.explode(slots))
    n = F.coalesce(F.try_element_at("seen", F.col("slot.bin")), F.lit(0))
    whole = Window.partitionBy("hour", "feature")
    pairs = grid.select("hour", "feature", F.col("slot.expected").alias("expected"), n.alias("n"))
    pairs = pairs.withColumn("actual", _smoothed(F.col("n"), F.sum("n").over(whole), F.count(F.lit(1)).over(whole)))
    return psi(pairs, "hour")


def hourly_reports(scores: DataFrame, threshold: float = PSI_THRESHOLD) -> DataFrame:
    """A report per hour of ``(hour, feature, psi)``, checked at the hour's end."""
    end = F.col("hour") + F.expr("interval 1 hour")
    found = scores.groupBy("hour").agg(*_found(threshold)).withColumns({"window_start": F.col("hour"), "window_end": end})
    return _reported(found, F.col("window_end"), threshold)


def perturb(flows: DataFrame, fraction: float, id_column: str = "flow_id") -> DataFrame:
    """What-if: for a repeatable share of flows turn tcp into icmp and http into private."""
    draw = F.conv(F.substring(F.md5(F.col(id_column).cast("string")), 1, 8), 16, 10).cast("long")
    hit = draw % 1_000_000 < int(fraction * 1_000_000)
    return flows.withColumns({
        "protocol_type": F.when(hit & (F.col("protocol_type") == "tcp"), "icmp").otherwise(F.col("protocol_type")),
        "service": F.when(hit & (F.col("service") == "http"), "private").otherwise(F.col("service")),
    })
