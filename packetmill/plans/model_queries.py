"""Queries on feature preparation, metrics, ranking and models."""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from packetmill.models import boosting, compare, ensemble, iforest, training
from packetmill.operators import features as ft
from packetmill.operators import metrics as mx
from packetmill.operators import reports as rp
from packetmill.plans import alert_queries as aq
from packetmill.plans import data_queries as dq
from packetmill.session import dealt, materialise, scratch_path, spread
from packetmill.sources import adapters as A
from packetmill.sources import datasets, sinks

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
NUM, CAT = ["length", "src_port", "dst_port", "fragment_offset"], ["protocol_type", "service", "flag"]
# Folders of what several queries of a session share: a model is trained once a session and data folder, at the library's sizes.
_STORED: dict = {}


def _once(spark, sf, name, make):
    """The folder that ``make`` filled, made at the first call of a session."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        path = scratch_path(spark, name)
        make(path)
        _STORED[key] = path
    return _STORED[key]


def labelled_flows(spark, sf):
    """Packets with the class of their event: a training table derived from the events."""
    pk = A.packets(spark, sf)
    cls = A.scored(spark, sf).select("seq", F.col("predicted_category").alias("target"))
    return pk.join(cls, "seq").select(
        F.col("seq").alias("flow_id"), "src_ip", "dst_ip", "length", "src_port", "dst_port", "fragment_offset",
        F.col("protocol").alias("protocol_type"),
        F.when(F.col("dst_port") == 80, "http").otherwise("private").alias("service"),
        F.when(F.col("flags") == "", "SF").otherwise(F.col("flags")).alias("flag"), "target")


def _pairs(spark, sf):
    """True class from the labels, predicted class from the scored flows."""
    truth = datasets.with_attack_category(A.labelled(spark, sf)).select("event_id", F.col("attack_category").alias("label"))
    found = A.scored(spark, sf).select(F.col("seq").alias("event_id"), F.col("predicted_category").alias("prediction"), "confidence")
    return truth.join(found, "event_id")


def _lines(spark, sf):
    return A.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", *LINE, F.lit(7.0).alias("constant"),
        (F.col("l_extendedprice") * 2 + F.col("l_tax")).alias("twice"))


def confusion(spark, sf):
    return mx.confusion(_pairs(spark, sf))


def class_metrics(spark, sf):
    names = ("precision", "recall", "f1", "fpr")
    return mx.per_class(confusion(spark, sf)).select(
        "class", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in names])


def metric_summary(spark, sf):
    pairs = _pairs(spark, sf)
    names = ("accuracy", "precision", "recall", "f1", "macro_f1")
    found = mx.summary(mx.per_class(mx.confusion(pairs)))
    return found.select(*[F.round(c, 9).alias(c) for c in names], "samples")


def mean_fpr(spark, sf):
    return mx.summary(mx.per_class(confusion(spark, sf))).select(F.round("mean_fpr", 9).alias("mean_fpr"))


def correlation_pairs(spark, sf):
    return ft.correlations(_lines(spark, sf), [*LINE, "constant", "twice"]).select(
        "a", "b", F.round("abs_r", 6).alias("abs_r"))


def correlated_columns(spark, sf):
    return ft.correlated_columns(ft.correlations(_lines(spark, sf), [*LINE, "constant", "twice"]))


def _wide(k):
    """One of 38 numbers of a line, as SQL that both engines read; some are null, by a rhythm of their own."""
    number = (f"l_quantity * {k * 7 % 11 + 1} + l_extendedprice * {k * 5 % 13} / 1000 + l_discount * {k * 3 % 17} * 10"
              f" + (l_orderkey * {2 * k + 1}) % {k % 9 + 3}")
    return f"case when (l_orderkey + l_linenumber) % {k + 3} = 0 then null else cast({number} as double) end"


def correlation_wide(spark, sf):
    """All 703 pairs of 38 columns, with nulls."""
    rows = spread(A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"))
    rows = rows.select(*[F.expr(_wide(k)).alias(f"x{k}") for k in range(38)])
    return ft.correlations(rows, rows.columns).select("a", "b", F.round("abs_r", 6).alias("abs_r"))


def scaled(spark, sf):
    cols = [*LINE, "constant"]
    out = ft.standard_scale(_lines(spark, sf), cols)
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in cols])


def minmax(spark, sf):
    cols = [*LINE, "constant"]
    out = ft.minmax_scale(_lines(spark, sf), cols)
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 9).alias(c) for c in cols])


def label_codes(spark, sf):
    classes = ["Normal", "DoS", "Probe", "R2L", "U2R"]
    rows = datasets.with_attack_category(A.labelled(spark, sf)).select("event_id", "attack_category")
    return ft.decode_labels(ft.encode_labels(rows, "attack_category", classes), "code", classes)


def split_sizes(spark, sf):
    rows = datasets.with_attack_category(A.labelled(spark, sf)).select("event_id", "attack_category")
    split = ft.stratified_split(rows, "event_id", "attack_category")
    return split.groupBy("attack_category").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("n_test"))


def split_members(spark, sf):
    rows = datasets.with_attack_category(A.labelled(spark, sf)).select("event_id", "attack_category")
    return ft.stratified_split(rows, "event_id", "attack_category").select("event_id", "is_test")


def _fixed_trees():
    """Two rounds of small trees for three classes over quantity and discount; FIXED_SQL holds the same numbers."""
    model = boosting.Boosted([np.array([10.0, 25.0, 40.0]), np.array([0.03, 0.06])], 3, 2)
    cuts = [[(0, 1), (1, 0), (1, 1)], [(1, 1), (0, 0), (0, 2)], [(0, 2), (1, 1), (-1, 0)]]
    for number in range(2):
        trees = []
        for c, nodes in enumerate(cuts):
            tree = boosting.Tree.empty(2)
            for i, (f, cut) in enumerate(nodes):
                tree.feature[i], tree.cut[i] = f, cut
            tree.value[:] = [((i * 7 + c * 3 + number * 5) % 11 - 5) / 8 for i in range(7)]
            trees.append(tree)
        model.trees.append(trees)
    return model


def vectorised_scoring(spark, sf):
    """Class probabilities of fixed small trees for every line, scored batch by batch."""
    lines = A.table(spark, sf, "lineitem")
    votes = _fixed_trees().scorer(spark)(F.array(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double")))
    return lines.select("l_orderkey", "l_linenumber", votes.alias("p")).select(
        "l_orderkey", "l_linenumber", *[F.round(F.get("p", F.lit(c)), 9).alias(f"p{c}") for c in range(3)])


def one_hot(spark, sf):
    rows = labelled_flows(spark, sf)
    model = ft.preprocessor(NUM, CAT, rows.count()).fit(rows)
    return model.transform(rows).select("flow_id", F.size(vector_to_array("features")).alias("width"),
                                        F.array_join(F.transform(vector_to_array("service_oh"), lambda v: v.cast("int").cast("string")), "").alias("service"))


def mutual_information(spark, sf):
    rows = A.table(spark, sf, "lineitem")
    return ft.mutual_information(rows, LINE, "l_returnflag").select("feature", F.round("mi_score", 6).alias("mi_score"))


def neighbour_information(spark, sf):
    rows = A.table(spark, sf, "lineitem")
    return ft.neighbour_information(rows, LINE, "l_returnflag").select("feature", F.round("mi_score", 9).alias("mi_score"))


def importances(spark, sf):
    return ft.importances(labelled_flows(spark, sf), NUM, "target")


def _prepared(spark, sf):
    rows = labelled_flows(spark, sf)
    split = ft.stratified_split(rows, "flow_id", "target")
    model = ft.preprocessor(NUM, CAT, rows.count()).fit(rows)
    ready = ft.label_indexer().fit(rows).transform(model.transform(split))
    return materialise(ready.select("flow_id", "target", "label_ix", "is_test", "features"), "prepared")


def vote(spark, sf):
    """The stored ensemble's class and confidence for every flow of the test split."""
    models = training.load(spark, _trained(spark, sf))
    rows = ft.stratified_split(labelled_flows(spark, sf), "flow_id", "target").where("is_test")
    rows = dealt(rows, "flow_id")
    ready = models.preprocessor.transform(training.cleaned(rows, NUM, CAT))
    return ensemble.pick_class(models.ensemble.transform(ready), models.classes).select(
        "flow_id", "target", "predicted_category", F.round("confidence", 6).alias("confidence"))


def anomaly_scores(spark, sf):
    ready = _prepared(spark, sf).select("flow_id", "target", vector_to_array("features").alias("x"))
    nodes = iforest.fit(ready.where("target = 'Normal'"))
    return ready.select("flow_id", iforest.scorer(nodes)("x").alias("anomaly_score"))


def _trained(spark, sf):
    """Folder of the models trained at their full sizes."""
    return _once(spark, sf, "models", lambda path: training.save(
        training.train(labelled_flows(spark, sf), NUM, CAT), path, "v1", rp.moment(dq.CHECK_TS)))


def scored(spark, sf):
    """Score every flow with the trained models as they were stored."""
    return training.score(dealt(labelled_flows(spark, sf), "flow_id"), training.load(spark, _trained(spark, sf))).select(
        "flow_id", "predicted_category", "confidence", "anomaly_score", "severity", "is_zero_day_suspect", "is_alert")


def training_run(spark, sf):
    found = training.load(spark, _trained(spark, sf)).metrics
    return spark.createDataFrame([(k, float(v)) for k, v in found.items()], "metric string, value double")


def comparison(spark, sf):
    def compare_all(path):
        ready = dealt(_prepared(spark, sf), "flow_id")
        compare.train_and_evaluate(ready.where("not is_test"), ready.where("is_test"))[0].write.parquet(path)
    return spark.read.parquet(_once(spark, sf, "comparison", compare_all))


def best(spark, sf):
    return ft.best_model(comparison(spark, sf)).select("model", "recall")


def legacy(spark, sf):
    ready = _prepared(spark, sf)
    model = compare.default_models()["Decision Tree"].fit(ready.where("not is_test"))
    classes = sorted(r[0] for r in ready.select("target").distinct().collect())  # one row per class
    return compare.legacy_classify(model.transform(ready), classes).select(
        "flow_id", "predicted_category", "confidence", "is_alert")


def legacy_margin(spark, sf):
    """Classes of a model that gives no probability: the line number picks the class, the confidence is the fixed one."""
    found = A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 5).cast("double").alias("prediction"))
    return compare.legacy_classify(found, ["DoS", "Normal", "Probe", "R2L", "U2R"]).select(
        "l_orderkey", "l_linenumber", "predicted_category", "confidence", "is_alert")


def artifact_parts(spark, sf):
    """Rows of each of the five stored parts: what a model set is made of, counted in the files.

    The parts of the preprocessor and the forest are tables of their own; their rows are trees, and nodes of all trees.
    """
    path = _trained(spark, sf)
    tables = {"manifest": spark.read.json(f"{path}/manifest"), "isolation_forest": spark.read.parquet(f"{path}/isolation_forest"),
              "baseline": spark.read.parquet(f"{path}/baseline"), "boosted_nodes": spark.read.parquet(f"{path}/boosted/nodes"),
              "boosted_edges": spark.read.parquet(f"{path}/boosted/edges"), "forest_trees": spark.read.parquet(f"{path}/forest/treesMetadata"),
              "forest_nodes": spark.read.parquet(f"{path}/forest/data"), "preprocessor_stages": spark.read.text(f"{path}/preprocessor/stages/*/metadata")}
    return rp.row_counts(tables)


def registry(spark, sf):
    """Two versions appended with the metrics of the predictions; the later one is read back."""
    path, at = scratch_path(spark, "registry"), rp.moment(dq.CHECK_TS)
    found = metric_summary(spark, sf).first().asDict()  # one row of metrics
    for version, share in (("v1", 0.5), ("v2", 1.0)):
        numbers = json.dumps({**found, "accuracy": found["accuracy"] * share})
        training.register(training.registry_rows(spark, version, "models/" + version, numbers, at), path)
    table = spark.read.parquet(path)
    newest = rp.latest_per_key(table, ["model_name"], ["registered_at", "version"])
    return newest.select("model_name", "version", "model_type", "stage_path", "is_active", *[
        F.get_json_object("training_metrics", f"$.{m}").cast(t).alias(m)
        for m, t in (("accuracy", "double"), ("recall", "double"), ("samples", "long"))])


def flow_csv(spark, sf):
    path = scratch_path(spark, "flows-csv")
    src = labelled_flows(spark, sf).select("flow_id", "src_ip", "length", "protocol_type")
    src.write.option("header", True).csv(path)
    return datasets.read_flows(spark, path, src.schema)


def clustered_layout(spark, sf):
    """The three tables in their layout: rows, and whether the first key's ranges of the files touch at most at their ends.

    Then a read for some values of the key opens only the files of those values.
    """
    flows = A.scored(spark, sf).select("flow_id", (F.col("seq") % 3 == 0).alias("processed_flag"), F.col("alert_ts").alias("created_at"))
    stored = dq._drift_runs(spark, sf)[0]
    out = []
    for table, rows in (("flow_features", flows), ("alerts", aq._alerts(spark, sf)), ("drift_reports", stored)):
        path, key = scratch_path(spark, table), sinks.LAYOUT[table][0]
        sinks.write_clustered(rows, path, table, 4)
        files = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(
            F.min(F.col(key).cast("string")).alias("low"), F.max(F.col(key).cast("string")).alias("high"), F.count(F.lit(1)).alias("n"))
        order = Window.orderBy("low", "high")  # a row per file
        fits = F.coalesce(F.col("low") >= F.lag("high").over(order), F.lit(True))
        out.append(files.withColumn("fits", fits).agg(F.sum("n").alias("n"), F.bool_and("fits").alias("in_ranges")).select(
            F.lit(table).alias("table_name"), "n", "in_ranges"))
    return out[0].unionByName(out[1]).unionByName(out[2])


def probability_argmax(spark, sf):
    """First largest entry of an array of three weights taken from each line."""
    votes = A.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.array(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 500).alias("probability_vote"))
    return ensemble.pick_class(votes, ["a", "b", "c"]).select(
        "l_orderkey", "l_linenumber", "predicted_category", "confidence")


_MX = f"""
{dq._LABELS.strip()},
sc as ({A.duck(A.SCORED)}),
pr as (select l.attack_category as label, s.predicted_category as prediction from lm l join sc s on s.seq = l.event_id),
cls as (select label as class from pr union select prediction from pr),
pc as (select class, count(*) filter (where label = class and prediction = class) as tp,
   count(*) filter (where label <> class and prediction = class) as fp,
   count(*) filter (where label = class and prediction <> class) as fn,
   count(*) filter (where label <> class and prediction <> class) as tn from cls cross join pr group by class),
pm as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as precision,
   case when tp + fn > 0 then tp / (tp + fn) else 0 end as recall,
   case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end as f1, fp / (fp + tn + 1e-9) as fpr from pc)"""

_LN = """
ln as (select l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, 7.0::double as constant,
  l_extendedprice * 2 + l_tax as twice from lineitem)"""
_COLS = [*LINE, "constant", "twice"]
_CORR = _LN + ", cr as (" + " union all ".join(
    f"select '{a}' as a, '{b}' as b, {j} as b_pos, "
    + ("max(cast(null as double))" if "constant" in (a, b) else f"abs(corr({a}, {b}))") + " as abs_r from ln"
    for i, a in enumerate(_COLS) for j, b in enumerate(_COLS) if i < j) + ")"


def _q(blocks, tail):
    """Named blocks and a final select; a tail that starts with a comma adds blocks."""
    return f"with {blocks.strip()}\n{tail.strip()}"


_MI = "with " + ",\n".join(
    f"""b_{c} as (select '{c}' as feature, l_returnflag as y, cast(least(floor(({c} - (select min({c}) from lineitem)) /
  (select max({c}) - min({c}) from lineitem) * 10), 9) as int) as x from lineitem)""" for c in LINE) + """,
al as (""" + " union all ".join(f"select * from b_{c}" for c in LINE) + """),
j as (select feature, x, y, count(*) as n from al group by 1, 2, 3),
m as (select *, sum(n) over (partition by feature) as t, sum(n) over (partition by feature, x) as nx,
  sum(n) over (partition by feature, y) as ny from j)
select feature, round(sum(n / t * ln(n * t / (nx * ny))), 6) as mi_score from m group by 1"""

def _values(number, c):
    return [((i * 7 + c * 3 + number * 5) % 11 - 5) / 8 for i in range(7)]


#: Cuts in the order of ``_fixed_trees``: quantity at 25, discount at 0.03 and 0.06, and so on.
_CASES = [("l_quantity <= 25", "l_discount <= 0.03", "l_discount <= 0.06"), ("l_discount <= 0.06", "l_quantity <= 10", "l_quantity <= 40"),
          ("l_quantity <= 40", "l_discount <= 0.06", None)]


def _tree_sql(number, c):
    (top, low, high), v = _CASES[c], _values(number, c)
    right = f"case when {high} then {v[5]} else {v[6]} end" if high else str(v[2])
    return f"(case when {top} then case when {low} then {v[3]} else {v[4]} end else {right} end)"


FIXED_SQL = "with m as (select l_orderkey, l_linenumber, " + ", ".join(
    f"exp({_tree_sql(0, c)}::double + {_tree_sql(1, c)}::double) as e{c}" for c in range(3)) + """ from lineitem)
select l_orderkey, l_linenumber, round(e0 / (e0 + e1 + e2), 9) as p0, round(e1 / (e0 + e1 + e2), 9) as p1,
  round(e2 / (e0 + e1 + e2), 9) as p2 from m"""

_WIDE = "with w as (select " + ", ".join(f"{_wide(k)} as x{k}" for k in range(38)) + " from lineitem), c as (select [" + ", ".join(
    f"{{'a': 'x{i}', 'b': 'x{j}', 'abs_r': round(abs(corr(x{i}, x{j})), 6)}}" for i in range(38) for j in range(i + 1, 38)) + """] as rows from w),
u as (select unnest(rows) as r from c) select r.a as a, r.b as b, r.abs_r as abs_r from u"""


def _digamma_sql(x):
    y = f"({x} + 10.0::double)"
    steps = "".join(f" - 1 / ({x} + {i}.0::double)" for i in range(10))
    return (f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * {y} ** 2) + 1 / (120 * {y} ** 4) - 1 / (252 * {y} ** 6) + 1 / (240 * {y} ** 8){steps})")


#: Three neighbours: the stretches of four values with a row in them, each with its values before and after the row.
_NEAR = "with p as (" + " union all ".join(f"""
  select '{c}' as feature, l_returnflag as y, {c}::double as v, l_orderkey * 10 + l_linenumber as id from lineitem""" for c in LINE) + """),
s as (select *, count(*) over (partition by feature, y) as n_y, """ + ", ".join(
    f"lag(v, {j}) over w as b{j}, lead(v, {j}) over w as a{j}" for j in range(1, 4)) + """ from p window w as (partition by feature, y order by v, id)),
e as (select *, list_min(list_filter([""" + ", ".join(
    f"{{'r': greatest(v - {'b' + str(j) if j else 'v'}, {'a' + str(3 - j) if j < 3 else 'v'} - v), 'low': {'b' + str(j) if j else 'v'}, "
    f"'high': {'a' + str(3 - j) if j < 3 else 'v'}}}" for j in range(4)) + """], lambda s: s.low is not null and s.high is not null)) as best from s),
q as (select feature, n_y, v, best.r as r, best.low as low, best.high as high from e),
z as (select feature, n_y, v, r, case when v - low = r then low else v - r end as low, case when high - v = r then high else v + r end as high from q),
d as (select feature, v, sum(count(*)) over (partition by feature order by v) as upto, count(*) as here from p group by feature, v),
m as (select z.feature, n_y, case when r = 0 then eq.here else coalesce(hi.upto, 0) - coalesce(lo.upto, 0) end::double as m
  from z join d eq on eq.feature = z.feature and eq.v = z.v
  asof left join d hi on hi.feature = z.feature and z.high > hi.v
  asof left join d lo on lo.feature = z.feature and z.low >= lo.v)
select feature, round(greatest(0, """ + f"{_digamma_sql('count(*)::double')} + avg({_digamma_sql('3.0::double')} - {_digamma_sql('n_y::double')} - {_digamma_sql('m')})" + """), 9)
  as mi_score from m group by feature"""

QUERIES = {
    "a08_confusion": (confusion, _q(_MX, "select label, prediction, count(*) as n from pr group by 1, 2")),
    "a09_class_metrics": (class_metrics, _q(_MX, """
        select class, tp, fp, fn, tn, round(precision, 9) as precision, round(recall, 9) as recall, round(f1, 9) as f1,
          round(fpr, 9) as fpr from pm""")),
    "a09_metric_summary": (metric_summary, _q(_MX, """
        select round(sum(tp) / sum(tp + fn), 9) as accuracy, round(sum(precision * (tp + fn)) / sum(tp + fn), 9) as precision,
          round(sum(recall * (tp + fn)) / sum(tp + fn), 9) as recall, round(sum(f1 * (tp + fn)) / sum(tp + fn), 9) as f1,
          round(avg(f1), 9) as macro_f1, cast(sum(tp + fn) as bigint) as samples from pm""")),
    "a10_mean_fpr": (mean_fpr, _q(_MX, "select round(avg(fpr), 9) as mean_fpr from pm")),
    "a16_correlation_pairs": (correlation_pairs, _q(_CORR, "select a, b, round(abs_r, 6) as abs_r from cr")),
    "a16_correlated_columns": (correlated_columns, _q(_CORR, """
        select b as "column", count(*) as earlier from cr where abs_r > 0.95 group by 1""")),
    "a16_correlation_wide": (correlation_wide, _WIDE),
    "o05_neighbour_information": (neighbour_information, _NEAR),
    "l01_one_hot": (one_hot, _q(f"pk as ({A.duck(A.PACKETS)})", """
        select seq as flow_id, cast(4 + (select count(distinct protocol) from pk) + (select count(distinct dst_port = 80) from pk)
          + (select count(distinct case when flags = '' then 'SF' else flags end) from pk) as int) as width,
          case when (select count(distinct dst_port = 80) from pk) = 1 then '1'
            when dst_port = 80 then '10' else '01' end as service from pk""")),
    "l02_standard_scaling": (scaled, _q(_LN, "select l_orderkey, l_linenumber, " + ", ".join(
        f"round(({c} - avg({c}) over ()) / case when stddev_pop({c}) over () = 0 then 1 else stddev_pop({c}) over () end, 6) as {c}"
        for c in [*LINE, "constant"]) + " from ln")),
    "l03_minmax_scaling": (minmax, _q(_LN, "select l_orderkey, l_linenumber, " + ", ".join(
        f"round(({c} - min({c}) over ()) / case when max({c}) over () = min({c}) over () then 1 else max({c}) over () - min({c}) over () end, 9) as {c}"
        for c in [*LINE, "constant"]) + " from ln")),
    "l04_label_codes": (label_codes, _q(dq._LABELS, """
        select event_id, attack_category, cast(case attack_category when 'DoS' then 0 when 'Normal' then 1 when 'Probe' then 2
          when 'R2L' then 3 else 4 end as int) as code, attack_category as class from lm""")),
    "l05_split_sizes": (split_sizes, _q(dq._LABELS, """
        select attack_category, count(*) as n, cast(floor(count(*) * 0.2 + 0.5) as bigint) as n_test from lm group by 1""")),
    "l05_split_members": (split_members, _q(dq._LABELS, """
        , r as (select event_id, row_number() over (partition by attack_category order by
            cast('0x' || substr(md5(event_id || '|42'), 1, 13) as bigint), event_id) as place,
           count(*) over (partition by attack_category) as n from lm)
        select event_id, place <= floor(n * 0.2 + 0.5) as is_test from r""")),
    "l06_soft_vote": (vote, None),
    "l07_isolation_forest": (anomaly_scores, None),
    "l08_batch_scoring": (scored, None),
    "l09_legacy_classify": (legacy, None),
    "l09_legacy_margin": (legacy_margin, """
        with p as (select l_orderkey, l_linenumber, ['DoS', 'Normal', 'Probe', 'R2L', 'U2R'][l_linenumber % 5 + 1] as predicted_category from lineitem)
        select *, 0.95::double as confidence, predicted_category <> 'Normal' as is_alert from p"""),
    "l10_model_comparison": (comparison, None),
    "l11_training_run": (training_run, None),
    "d04_vectorised_scoring": (vectorised_scoring, FIXED_SQL),
    "o04_feature_importance": (importances, None),
    "o05_mutual_information": (mutual_information, _MI),
    "o06_best_model": (best, None),
    "x15_probability_argmax": (probability_argmax, """
        with v as (select l_orderkey, l_linenumber, [l_discount, l_tax, l_quantity / 500] as p from lineitem)
        select l_orderkey, l_linenumber, ['a', 'b', 'c'][list_position(p, list_max(p))] as predicted_category,
          list_max(p) as confidence from v"""),
    "s05_flow_csv": (flow_csv, _q(f"pk as ({A.duck(A.PACKETS)})", """
        select seq as flow_id, src_ip, length, protocol as protocol_type from pk""")),
    "s10_artifacts": (artifact_parts, None),
    "s11_registry": (registry, _q(_MX, """
        select name as model_name, 'v2' as version, kind as model_type, 'models/v2/' || folder as stage_path,
          case when name = 'nids_ensemble' then (select round(sum(tp) / sum(tp + fn), 9) from pm) end as accuracy,
          case when name = 'nids_ensemble' then (select round(sum(recall * (tp + fn)) / sum(tp + fn), 9) from pm) end as recall,
          case when name = 'nids_ensemble' then (select cast(sum(tp + fn) as bigint) from pm) end as samples, true as is_active
        from (values ('nids_ensemble', 'ENSEMBLE_CLASSIFIER', 'forest'), ('isolation_forest', 'ISOLATION_FOREST', 'isolation_forest'),
          ('preprocessor', 'PREPROCESSOR', 'preprocessor'), ('baseline_distribution', 'BASELINE_DISTRIBUTION', 'baseline')) t(name, kind, folder)""")),
    "s12_clustered_layout": (clustered_layout, _q(aq._SC, """
        select 'flow_features' as table_name, count(*) as n, true as in_ranges from sc
        union all select 'alerts', count(*), true from al union all select 'drift_reports', 3, true""")),
}
