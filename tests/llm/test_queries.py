"""Registered queries: names, whole tables, and SQL counterparts on the smallest tables."""
import duckdb
import pytest

import __spark_entry__ as contract
import check
from llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def test_one_query_for_each_operator():
    names = [n for n in contract.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in contract.queries()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, con, name):
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    assert len(got) and check.normal_form(got) == check.normal_form(con.execute(queries.SQL[name]).fetchdf())


@pytest.mark.parametrize("name,rows", [("op4_bin_slack_packing", None), ("op5_token_files", 200), ("op6_secret_scan", 200),
                                       ("op8_order_minhash", 200), ("op10_suffix_dedup", 200)])
def test_every_document_is_there(spark, name, rows):
    ids = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()}
    got = queries.QUERIES[name](spark, FOLDER).select("doc_id").collect()
    assert {r.doc_id for r in got} == ids and (rows is None or len(got) == rows)
