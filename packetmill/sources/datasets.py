"""Readers for labelled training files and for flow files to score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetmill.functions.labels import macro_class
from packetmill.schemas import FEATURES, FLOW_FEATURES, LABELLED, feature_default


def with_attack_category(table: DataFrame) -> DataFrame:
    """Add the macro class from the label; without a label every row is Normal."""
    if "attack_category" in table.columns:
        return table
    found = macro_class(F.col("label")) if "label" in table.columns else F.lit("Normal")
    return table.withColumn("attack_category", found)


def read_labelled(spark: SparkSession, path: str, schema=LABELLED) -> DataFrame:
    """A ``.csv`` path has a header; anything else is headerless in the fixed column order."""
    header = path.rstrip("/").endswith(".csv")
    return with_attack_category(spark.read.schema(schema).option("header", header).csv(path))


def read_flows(spark: SparkSession, path: str, schema=FLOW_FEATURES) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def target_column(table: DataFrame) -> str:
    for name in ("attack_category", "label"):
        if name in table.columns:
            return name
    raise ValueError("neither attack_category nor label is a column of the table")


def split_target(table: DataFrame) -> tuple[DataFrame, str]:
    """Rename the target to ``target`` and drop the other label columns."""
    name = target_column(table)
    rest = [c for c in ("attack_category", "label", "difficulty") if c != name]
    return table.withColumnRenamed(name, "target").drop(*rest), name


def complete(flows: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """Add absent features: 0 for numbers, 'other' for categories."""
    have = set(flows.columns)
    missing = {
        c: F.lit("other") if isinstance(feature_default(c), str) else F.lit(0)
        for c in columns if c not in have
    }
    return flows.withColumns(missing) if missing else flows
