"""Decoded packet tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetmill.schemas import PACKETS

PROTOCOLS = ("tcp", "udp", "icmp")


def normalise(raw: DataFrame) -> DataFrame:
    """Fill absent fields, lower-case the protocol and keep tcp, udp and icmp over IP."""
    have = set(raw.columns)

    def field(name, default):
        kind = PACKETS[name].dataType
        value = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        return F.coalesce(value, F.lit(default).cast(kind))

    protocol = F.lower(field("protocol", "tcp"))
    return raw.select(
        F.col("seq").cast("long").alias("seq"),
        F.col("ts_us").cast("long").alias("ts_us"),
        field("src_ip", "0.0.0.0").alias("src_ip"),
        field("dst_ip", "0.0.0.0").alias("dst_ip"),
        field("src_port", 0).alias("src_port"),
        field("dst_port", 0).alias("dst_port"),
        protocol.alias("protocol"),
        field("flags", "").alias("flags"),
        field("length", 0).alias("length"),
        field("fragment_offset", 0).alias("fragment_offset"),
    ).where(F.col("protocol").isin(*PROTOCOLS))


def read_packets(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return normalise(spark.read.schema(PACKETS).format(fmt).load(path))


def stream_packets(spark: SparkSession, path: str, fmt: str = "parquet",
                   max_files_per_trigger: int = 1000) -> DataFrame:
    stream = spark.readStream.schema(PACKETS).format(fmt).option("maxFilesPerTrigger", max_files_per_trigger)
    return normalise(stream.load(path))
