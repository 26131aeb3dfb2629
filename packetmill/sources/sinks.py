"""Writers: JSON lines, append-only tables, table layout and the column contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def json_line(flows: DataFrame) -> DataFrame:
    """One JSON object per flow with sorted keys, as text; nulls are kept."""
    return flows.select(F.to_json(
        F.struct(*sorted(flows.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(flows: DataFrame, path: str) -> None:
    json_line(flows).write.mode("append").text(path)


def stream_json_lines(flows: DataFrame, path: str, checkpoint: str):
    return (json_line(flows).writeStream.format("text").option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append"))


class ContractError(ValueError):
    """A frame does not fit the table it is appended to."""


def check_contract(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns must be a subset of the table's; missing ones are added as nulls, in order."""
    extra = sorted(set(df.columns) - set(schema.fieldNames()))
    if extra:
        raise ContractError(f"columns not in the table: {extra}")
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ])


def append(df: DataFrame, path: str, schema: StructType, partition_by: list[str] | None = None,
           sort_by: list[str] | None = None) -> None:
    out = check_contract(df, schema)
    if sort_by:
        out = out.sortWithinPartitions(*sort_by)
    out.write.mode("append").partitionBy(*(partition_by or [])).parquet(path)


def clear(df: DataFrame, path: str) -> None:
    """Delete all rows of a table, keeping its schema."""
    df.limit(0).write.mode("overwrite").parquet(path)


def clustered(df: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """Lay rows out by range of the keys so file statistics prune hot reads.

    The range boundaries come from a sample and include every key, so a frequent first
    key is cut by the next one instead of filling a single file.
    """
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


# How the three tables are read most: the batch poll, alert triage, and by check time.
LAYOUT = {
    "flow_features": ["processed_flag", "created_at"],
    "alerts": ["severity", "mitigation_status", "alert_ts"],
    "drift_reports": ["check_ts"],
}


def write_clustered(df: DataFrame, path: str, table: str, partitions: int | None = None) -> None:
    clustered(df, LAYOUT[table], partitions).write.mode("overwrite").parquet(path)
