"""The registered corpus queries: names, and SQL results where SQL can express them."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from packetmill.llm import queries
from tools import check_oracle

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator_and_the_pipeline():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", [n for n, (_, sql) in queries.QUERIES.items() if sql])
def test_like_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    ok, text = check_oracle.compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, text


@pytest.mark.parametrize("name, columns", [
    ("op3_language_id", "doc_id held_out lang_pred score rejected"),
    ("op4_repeated_strings", "doc_id n_bytes n_removed n_spans kept_sha256"),
    ("op5_lattice_likelihood", "doc_id held_out n_tokens n_known train_tokens base_score score"),
    ("op7_token_store", "doc_id start n_tokens ids_crc32"),
    ("op8_winnowing", "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next"),
    ("op9_personal_data", "doc_id n_email n_ip n_card n_phone base_sha256 spans"),
    ("op10_simhash_groups", "doc_id fingerprint component_id"),
    ("op13_periodic_runs", "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256"),
])
def test_columns(spark, name, columns):
    out = entry.queries()[name](spark, SF)
    assert out.columns == columns.split() and out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
