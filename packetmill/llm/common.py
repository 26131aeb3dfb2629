"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetmill.session import materialise, prepare

# Inside of a regular expression class: the six white-space characters that part words.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"


def tuned(spark: SparkSession) -> SparkSession:
    """The engine's settings, and small Arrow batches: texts may be long, so rows are a poor measure."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    # Shuffle files go when their query ends: results that are read again are written tables.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Larger Arrow batches for the queries run inside, whose rows are words or numbers, not texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, in that order.

    A column spelt exactly so is meant even if others differ from it in case alone.
    """
    places = []
    for name in names:
        same = [i for i, c in enumerate(df.columns) if c == name]
        alike = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
        if not alike:
            raise ValueError(f"no column {name!r} among {df.columns}")
        places.append((same or alike)[0])
    plain = df.toDF(*[f"__c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"__c{i}").alias(n) for i, n in zip(places, names)])


def with_key(docs: DataFrame, id_col: str = "doc_id", key: str = "__key", tie: str | None = "text") -> DataFrame:
    """Add a unique long ``key`` that ascends with the id.

    Unique ids without nulls are the keys themselves. Otherwise rows are numbered in the order of
    (id, nulls last; ``tie`` column), equal rows in any order: the numbering is a range partitioning with
    counts per partition, stored once, so that it is the same for every later reader.
    """
    odd = docs.groupBy(F.col(id_col).alias("i")).count().filter("count > 1 or i is null").limit(1)
    if odd.count() == 0:
        return docs.withColumn(key, F.col(id_col).cast("long"))
    order = [F.col(id_col).asc_nulls_last(), *([F.col(tie).asc_nulls_last()] if tie else []), F.col("__salt")]
    ranged = (docs.withColumn("__salt", F.rand(7)).repartitionByRange(*order)
              .withColumn("__part", F.spark_partition_id()))
    stored = materialise(ranged, "keyed")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = (stored.groupBy("__part").agg(F.count("*").alias("__n"))
              .select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return (stored.join(starts, "__part")
            .withColumn(key, F.col("__start") + place).drop("__part", "__salt", "__start"))


def append_columns(docs: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]],
                   fields: list[T.StructField]) -> DataFrame:
    """Every row with further columns, computed batch by batch.

    ``make`` runs once per task and returns the function from a batch to its new columns by
    name. An input column with the name of a new one is replaced, whatever its case.
    """
    names = {f.name.lower() for f in fields}
    keep = [f for f in docs.schema.fields if f.name.lower() not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            new = work(batch)
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
            yield pa.RecordBatch.from_arrays(columns + [new[f.name] for f in fields],
                                             names=[f.name for f in keep] + [f.name for f in fields])

    return docs.mapInArrow(run, T.StructType(keep + fields))


def texts_of(column: pa.Array) -> list[str]:
    """The texts of a batch, nulls as empty texts."""
    return [t or "" for t in column.to_pylist()]


def input_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts: what the number of blocks, buckets and shards follows."""
    return docs.select(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
