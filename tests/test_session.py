from pathlib import Path

import pytest

from packetmill.session import dealt, materialise, passing_tables


def place(df):
    return Path(df.inputFiles()[0].removeprefix("file:")).parent


def test_passing_tables_go_and_kept_ones_stay(spark):
    outside = materialise(spark.range(3), "outside")
    with passing_tables(spark):
        step = materialise(spark.range(5), "step")
        gone = place(step)
        with passing_tables(spark):
            inner = place(materialise(step.filter("id > 1"), "inner"))
        assert gone.exists() and not inner.exists()
        kept = materialise(step.filter("id > 2"), "kept", keep=True)
    assert not gone.exists()
    assert sorted(r.id for r in kept.collect()) == [3, 4] and outside.count() == 3


def test_tables_of_a_failed_block_stay(spark):
    with pytest.raises(ValueError):
        with passing_tables(spark):
            left = place(materialise(spark.range(2), "left"))
            raise ValueError
    assert left.exists()
    after = materialise(spark.range(2), "after")  # no block is open any more
    assert place(after).exists()


def test_rows_of_one_task_are_dealt_over_all_cores_and_sorted(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = dealt(spark.range(0, 2000, 1, 1).orderBy("id", ascending=False), "id")
    parts = rows.rdd.map(lambda r: r["id"]).glom().collect()
    assert len(parts) == cores and all(p and p == sorted(p) for p in parts)
    assert parts == dealt(spark.range(0, 2000, 1, 5), "id").rdd.map(lambda r: r["id"]).glom().collect()
