"""Feature preparation, selection and ranking."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import (
    ElementwiseProduct, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetmill.operators import quantiles as qt
from packetmill.session import materialise

# --- scaling ------------------------------------------------------------------


def standard_scale(table: DataFrame, columns: list[str]) -> DataFrame:
    """Zero mean and unit population deviation; constant columns become 0."""
    stats = table.agg(*[f(c).alias(f"{n}_{c}") for c in columns
                        for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()

    def scaled(c):
        return (F.col(c) - stats[f"m_{c}"]) / (stats[f"s_{c}"] or 1.0)

    return table.withColumns({c: scaled(c) for c in columns})


def minmax_scale(table: DataFrame, columns: list[str]) -> DataFrame:
    stats = table.agg(*[f(c).alias(f"{n}_{c}") for c in columns
                        for n, f in (("lo", F.min), ("hi", F.max))]).first()

    def scaled(c):
        low, span = stats[f"lo_{c}"], stats[f"hi_{c}"] - stats[f"lo_{c}"]
        return (F.col(c) - low) / (span or 1.0)

    return table.withColumns({c: scaled(c) for c in columns})


# --- encoding -----------------------------------------------------------------


def preprocessor(numeric: list[str], categorical: list[str], rows: int) -> Pipeline:
    """Scaled numbers beside one-hot categories; unknown categories are all zero.

    Spark scales by the sample deviation, so a constant factor turns it into the
    population deviation.
    """
    factor = (rows / (rows - 1)) ** 0.5 if rows > 1 else 1.0
    index = StringIndexer(inputCols=categorical, outputCols=[f"{c}_ix" for c in categorical],
                          stringOrderType="alphabetAsc", handleInvalid="keep")
    onehot = OneHotEncoder(inputCols=index.getOutputCols(), outputCols=[f"{c}_oh" for c in categorical],
                           dropLast=True)
    numbers = VectorAssembler(inputCols=numeric, outputCol="numbers")
    scale = StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True)
    adjust = ElementwiseProduct(inputCol="scaled", outputCol="standard",
                                scalingVec=Vectors.dense([factor] * len(numeric)))
    join = VectorAssembler(inputCols=["standard", *onehot.getOutputCols()], outputCol="features")
    return Pipeline(stages=[index, onehot, numbers, scale, adjust, join])


def label_indexer(column: str = "target", output: str = "label_ix") -> StringIndexer:
    return StringIndexer(inputCol=column, outputCol=output, stringOrderType="alphabetAsc", handleInvalid="error")


def encode_labels(table: DataFrame, column: str, classes: list[str]) -> DataFrame:
    """Alphabetical position of the class, as a constant lookup."""
    pairs = [F.lit(x) for i, c in enumerate(sorted(classes)) for x in (c, i)]
    return table.withColumn("code", F.try_element_at(F.create_map(*pairs), F.col(column)))


def decode_labels(table: DataFrame, code: str, classes: list[str]) -> DataFrame:
    names = F.array(*[F.lit(c) for c in sorted(classes)])
    return table.withColumn("class", F.try_element_at(names, F.col(code).cast("int") + 1))


# --- train/test split -----------------------------------------------------------


def stratified_split(table: DataFrame, id_column: str, class_column: str,
                     test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test`` for exactly round(test_size * n) rows of each class.

    The rows with the smallest draws of a class are taken. The draw that separates them
    is an order statistic found without sorting a class in one place; rows that share
    that very draw are settled by id. If a class has one row only, all rows form one
    stratum.
    """
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(id_column).cast("string"), F.lit(str(seed)))), 1, 13),
                  16, 10).cast("double")
    sizes = table.groupBy(class_column).agg(F.count(F.lit(1)).alias("n"))
    single = sizes.agg(F.min("n")).first()[0] or 0
    stratum = F.col(class_column).cast("string") if single >= 2 else F.lit("all")
    drawn = table.withColumn("_s", stratum).withColumn("_d", draw)

    counts = materialise(qt.value_counts(drawn.select(F.col("_s").alias("feature"), F.col("_d").alias("value"))),
                         "draws")
    take = F.floor(F.sum("cnt") * test_size + 0.5).cast("long")
    goal = counts.groupBy("feature").agg(take.alias("k")).where("k > 0")
    edge = qt.values_at_ranks(counts, goal.select("feature", (F.col("k") - 1).alias("r"))).select(
        F.col("feature").alias("_s"), F.col("value").alias("_edge"))
    below = counts.join(edge, F.col("feature") == F.col("_s")).groupBy("feature").agg(
        F.sum(F.when(F.col("value") < F.col("_edge"), F.col("cnt")).otherwise(0)).alias("under"))
    rule = edge.join(below.join(goal, "feature"), F.col("_s") == F.col("feature")).select(
        "_s", "_edge", (F.col("k") - F.col("under")).alias("_open"))

    # One rule row per class; the last id taken among the rows that share the edge draw completes it.
    rule = materialise(rule, "split-rule")
    ties = drawn.join(rule, "_s").where("_d = _edge").select("_s", "_open", F.col(id_column).alias("_last"), F.row_number().over(
        Window.partitionBy("_s").orderBy(id_column)).alias("_p")).where("_p = _open").select("_s", "_last")
    rule = materialise(rule.join(ties, "_s", "left").select("_s", "_edge", "_last"), "split-edges")
    low, same = F.col("_d") < F.col("_edge"), (F.col("_d") == F.col("_edge")) & (F.col(id_column) <= F.col("_last"))
    return drawn.join(rule, "_s", "left").withColumn("is_test", F.coalesce(low | same, F.lit(False))).drop(
        "_s", "_d", "_edge", "_last")


# --- selection and ranking ---------------------------------------------------------


def correlations(table: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, a_pos, b_pos, abs_r) for each pair a before b; null where a column is constant or holds a value that is not finite.

    Pairwise: a null takes its row out of the pairs of that column only. One pass for all pairs: every batch adds the matrix products
    of values, squares and presence to its task's sums, relative to the means of the task's first batch, which keeps the differences
    of large sums exact. A task sends one row a pair with its own means and centred sums; those are stored and meet by pair.
    """
    d = len(columns)
    nums = table.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    first, second = np.triu_indices(d, 1)
    names = ["n", "x", "y", "xx", "yy", "xy", "x_low", "x_high", "y_low", "y_high"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, middle = np.zeros((4, d, d)), None  # by [i, j]: rows with both, values of i there, their squares, products
        low, high = np.full((d, d), np.inf), np.full((d, d), -np.inf)
        for batch in batches:
            if not batch.num_rows or not d:
                continue
            there = np.stack([~np.asarray(c.is_null()) for c in batch.columns], axis=1)
            x = np.stack([np.asarray(c.fill_null(0.0)) for c in batch.columns], axis=1)
            if middle is None:
                middle = x.sum(axis=0) / np.maximum(there.sum(axis=0), 1)
                middle[~np.isfinite(middle)] = 0
            same = ~(low < high)  # pairs whose first column has not been seen to vary yet; the others need no more
            for j in np.flatnonzero(same.any(axis=0)):
                both, values = there[:, same[:, j]] & there[:, j:j + 1], x[:, same[:, j]]
                low[same[:, j], j] = np.minimum(low[same[:, j], j], np.where(both, values, np.inf).min(axis=0))
                high[same[:, j], j] = np.maximum(high[same[:, j], j], np.where(both, values, -np.inf).max(axis=0))
            x -= middle
            x[~there] = 0
            present = there.astype(float)
            total += [present.T @ present, x.T @ present, (x * x).T @ present, x.T @ x]
        middle = np.zeros(d) if middle is None else middle
        n, s, ss, p = total
        some = np.maximum(n, 1)
        mean, squares, products = middle[:, None] + s / some, ss - s * s / some, p - s * s.T / some
        i, j = first, second
        values = [n[i, j], mean[i, j], mean[j, i], squares[i, j], squares[j, i], products[i, j], low[i, j], high[i, j], low[j, i], high[j, i]]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(v) for v in values]],
                                         names=["a_pos", "b_pos", *names])

    parts = nums.mapInArrow(sums, "a_pos int, b_pos int, " + ", ".join(f"{n} double" for n in names))
    none = table.sparkSession.range(d * d).select((F.col("id") / d).cast("int").alias("a_pos"), (F.col("id") % d).cast("int").alias("b_pos"), *[
        F.lit({"low": math.inf, "high": -math.inf}.get(n[2:], 0.0)).alias(n) for n in names]).where("a_pos < b_pos")
    parts = materialise(parts.unionByName(none), "correlation-parts")  # a row per task and pair
    means = parts.groupBy("a_pos", "b_pos").agg(*[F.try_divide(F.sum(F.col("n") * F.col(c)), F.sum("n")).alias(f"{c}_mean") for c in ("x", "y")])
    off = {c: F.col(c) - F.col(f"{c}_mean") for c in ("x", "y")}
    moved = {a + b: F.sum(F.col(a + b) + F.col("n") * off[a] * off[b]).alias(a + b) for a, b in ("xx", "yy", "xy")}
    met = parts.join(means, ["a_pos", "b_pos"]).groupBy("a_pos", "b_pos").agg(
        *moved.values(), *[{"low": F.min, "high": F.max}[n[2:]](n).alias(n) for n in names[6:]])
    r = F.abs(F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))))
    label = F.array(*[F.lit(c) for c in columns]) if d else F.array(F.lit(""))
    varies = (F.col("x_low") < F.col("x_high")) & (F.col("y_low") < F.col("y_high")) & ~F.isnan(r)
    return met.select(F.get(label, F.col("a_pos")).alias("a"), F.get(label, F.col("b_pos")).alias("b"), "a_pos", "b_pos",
                      F.when(varies, F.least(r, F.lit(1.0))).alias("abs_r"))


def correlated_columns(pairs: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Columns that correlate too strongly with an earlier one."""
    return pairs.where(F.col("abs_r") > threshold).groupBy(F.col("b").alias("column"), "b_pos").agg(
        F.count(F.lit(1)).alias("earlier")).orderBy("b_pos").select("column", "earlier")


def importances(table: DataFrame, columns: list[str], target: str, trees: int = 50, depth: int = 5,
                seed: int = 42) -> DataFrame:
    """Random-forest importance of each column, highest first."""
    stages = [label_indexer(target), VectorAssembler(inputCols=columns, outputCol="v"),
              RandomForestClassifier(featuresCol="v", labelCol="label_ix", numTrees=trees, maxDepth=depth, seed=seed)]
    found = Pipeline(stages=stages).fit(table).stages[-1].featureImportances
    rows = [(c, float(found[i])) for i, c in enumerate(columns)]
    return table.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature")


def mutual_information(table: DataFrame, columns: list[str], target: str, bins: int = 10) -> DataFrame:
    """Mutual information of each column, cut into equal-width bins, with the class."""
    stats = table.agg(*[f(c).alias(f"{n}_{c}") for c in columns
                        for n, f in (("lo", F.min), ("hi", F.max))]).first()

    def binned(c):
        low, span = float(stats[f"lo_{c}"]), float(stats[f"hi_{c}"] - stats[f"lo_{c}"])
        if span == 0:
            return F.lit(0).alias(c)
        return F.least(F.floor((F.col(c) - low) / span * bins), F.lit(bins - 1)).cast("int").alias(c)

    long = table.select(target, *[binned(c) for c in columns]).unpivot([target], columns, "feature", "bin")
    joint = long.groupBy("feature", "bin", target).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("feature"))
    by_bin = F.sum("n").over(Window.partitionBy("feature", "bin"))
    by_class = F.sum("n").over(Window.partitionBy("feature", target))
    term = F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("x") * F.col("y")))
    return (
        joint.withColumns({"t": total, "x": by_bin, "y": by_class}).groupBy("feature")
        .agg(F.sum(term).alias("mi_score")).orderBy(F.desc("mi_score"), "feature")
    )


def _digamma(x):
    """Digamma of a positive number: ten steps of its recurrence, then the asymptotic series (error below 1e-14)."""
    y = x + 10.0
    series = F.log(y) - 1 / (2 * y) - 1 / (12 * y ** 2) + 1 / (120 * y ** 4) - 1 / (252 * y ** 6) + 1 / (240 * y ** 8)
    for i in range(10):
        series = series - 1 / (x + float(i))
    return series


def neighbour_information(table: DataFrame, columns: list[str], target: str, neighbours: int = 3, block: int = 1 << 16) -> DataFrame:
    """Mutual information of each column with the class, estimated from nearest neighbours; highest first, never below 0.

    Published estimator (Ross: Mutual information between discrete and continuous data sets, 2014). For each row the distance to its
    ``neighbours``-th nearest value within the class (fewer in a smaller class) reaches ``m`` values of all classes that are
    strictly nearer, or equal to it where that distance is 0; the row counts itself. The score is
    digamma(N) + mean digamma(k) - mean digamma(class size) - mean digamma(m). Rows of a class of their own are left out, as are nulls.

    Equal values of a class are one row with their count: they share their reach. Only ``neighbours`` + 1 of them are ranked, since no value needs more.
    Nothing is compared pair by pair: values are ranked within their class over sorted ranges, neighbours are looked up in blocks of
    ranks with a halo of ``neighbours`` ranks at both sides, and ``m`` is the difference of two running counts over the sorted values.
    """
    long = table.select(F.col(target).alias("y"), *[F.col(c).cast("double").alias(c) for c in columns]).where("y is not null")
    long = long.unpivot(["y"], columns, "feature", "v").where("v is not null")
    counts = materialise(long.groupBy("feature", "y", "v").agg(F.count(F.lit(1)).alias("cnt")), "value-counts")
    sizes = counts.groupBy("feature", "y").agg(F.sum("cnt").alias("n_y")).where("n_y > 1")
    totals = sizes.groupBy("feature").agg(F.sum("n_y").alias("n"))
    points = materialise(counts.join(sizes, ["feature", "y"]).withColumn("id", F.monotonically_increasing_id()), "points")
    one = F.lit(1).cast("long")
    copies = points.withColumns({"one": one, "copy": F.explode(F.sequence(F.lit(1), F.least("cnt", F.lit(neighbours + 1)).cast("int")))})
    ranked = qt.running_sum(copies, ["feature", "y"], ["v", "id", "copy"], "one", "place").withColumn(
        "place", F.col("place") - 1).withColumn("block", F.floor(F.col("place") / block))
    inside = F.col("place") % block
    homes = F.array_compact(F.array(F.col("block"), F.when(inside < neighbours, F.col("block") - 1),
                                    F.when(inside >= block - neighbours, F.col("block") + 1)))
    spread = ranked.select("feature", "y", "v", "id", "copy", "cnt", "n_y", "place", "block", F.explode(homes).alias("home"))
    window = Window.partitionBy("feature", "y", "home").orderBy("place")
    k = F.least(F.lit(neighbours).cast("long"), F.col("n_y") - 1)
    # The k-th neighbour ends a stretch of k + 1 sorted values around the row: j of them before it, k - j after it.
    before, after = F.array(*[F.lag("v", j).over(window) for j in range(neighbours + 1)]), F.array(*[F.lead("v", j).over(window) for j in range(neighbours + 1)])
    near = spread.withColumns({"before": before, "after": after, "k": k}).where("home = block and copy = 1")
    choices = F.transform(F.sequence(F.lit(0).cast("long"), "k"), lambda j: F.struct(
        F.greatest(F.col("v") - F.get("before", j.cast("int")), F.get("after", (F.col("k") - j).cast("int")) - F.col("v")).alias("r"),
        F.get("before", j.cast("int")).alias("low"), F.get("after", (F.col("k") - j).cast("int")).alias("high")))
    whole = F.filter(choices, lambda c: c["low"].isNotNull() & c["high"].isNotNull())
    near = near.withColumn("best", F.array_min(whole)).select("feature", "id", "v", "cnt", "n_y", "k", "best.*")
    # The reach ends at the neighbour itself, so no rounding of v + r decides about it.
    low = F.when(F.col("v") - F.col("low") == F.col("r"), F.col("low")).otherwise(F.col("v") - F.col("r"))
    high = F.when(F.col("high") - F.col("v") == F.col("r"), F.col("high")).otherwise(F.col("v") + F.col("r"))
    near = materialise(near.select("feature", "id", "cnt", "n_y", "k", "v", low.alias("low"), high.alias("high"), (F.col("r") == 0).alias("tied")), "reaches")
    # Order at equal values: what excludes them, the values, what includes them.
    ends = near.select("feature", "id", F.explode(F.array(
        F.struct(F.col("low").alias("v"), F.when(F.col("tied"), 0).otherwise(2).alias("turn"), F.lit(-1).alias("sign"), F.lit(0).cast("long").alias("one")),
        F.struct(F.col("high").alias("v"), F.when(F.col("tied"), 2).otherwise(0).alias("turn"), F.lit(1).alias("sign"), F.lit(0).cast("long").alias("one")))).alias("e"))
    marks = ends.select("feature", "id", "e.*").unionByName(points.select("feature", "id", "v", F.lit(1).alias("turn"), F.lit(0).alias("sign"), F.col("cnt").alias("one")))
    counted = qt.running_sum(marks, ["feature"], ["v", "turn", "id", "sign"], "one", "upto").where("sign <> 0")
    m = counted.groupBy("feature", "id").agg(F.sum(F.col("upto") * F.col("sign")).alias("m"))
    term = _digamma(F.col("k").cast("double")) - _digamma(F.col("n_y").cast("double")) - _digamma(F.col("m").cast("double"))
    terms = near.join(m, ["feature", "id"]).groupBy("feature").agg((F.sum(F.col("cnt") * term) / F.sum("cnt")).alias("part"))
    score = F.greatest(F.lit(0.0), F.col("part") + _digamma(F.col("n").cast("double")))
    return terms.join(totals, "feature").select("feature", score.alias("mi_score")).orderBy(F.desc("mi_score"), "feature")


def best_model(results: DataFrame, metric: str = "recall", order: str = "position") -> DataFrame:
    """Highest metric; the model listed first wins a tie."""
    return results.orderBy(F.desc(metric), order).limit(1)
