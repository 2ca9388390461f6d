"""Queries of plans and their SQL on files of which some have one path: what is found in one of them counts for all."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

QUERIES = ["classify_content", "copy_plan", "dataset_clean", "gate_report", "links_and_unreadable", "status_summary", "top_k_per_status", "written_plan", "releasable", "release_report"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents 41, 328 and 615 have the path lib/.gitignore, and so on; some documents hold a key."""
    folder = str(tmp_path_factory.mktemp("tables"))
    key = "AK" + "IA" + "Q7" * 8
    text = F.when(F.col("doc_id") % 82 == 0, F.concat(F.lit("a\nb "), F.lit(key), F.lit(" c"))).otherwise(F.concat(F.lit("text "), F.col("doc_id").cast("string")))
    spark.range(1400).withColumnRenamed("id", "doc_id").select("doc_id", text.alias("text")).write.parquet(f"{folder}/documents.parquet")
    spark.range(60).select(F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey")).write.parquet(f"{folder}/orders.parquet")
    spark.range(9).select(F.col("id").alias("s_suppkey")).write.parquet(f"{folder}/supplier.parquet")
    return folder


@pytest.mark.parametrize("name", QUERIES)
def test_plans_agree_with_their_sql_where_paths_repeat(spark, tables, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__

    engine = duckdb.connect()
    for table in os.listdir(tables):
        engine.execute(f"CREATE VIEW {table.partition('.')[0]} AS SELECT * FROM read_parquet('{tables}/{table}/*.parquet')")
    rows = __spark_entry__.queries()[name](spark, tables)
    columns = ", ".join(rows.columns)
    want = engine.execute(f"SELECT {columns} FROM ({__spark_entry__.oracle_sql()[name]}) q").fetchall()
    assert want and Counter(tuple(r) for r in rows.collect()) == Counter(want)
