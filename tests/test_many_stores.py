"""Queries on stores whose numbers have more than four digits."""

import shutil

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.oracle_check import compare

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Every second store has a number from 10,000 on: these have one code of four digits."""
    path = tmp_path_factory.mktemp("stores")
    for name in ("nation", "region", "part"):
        shutil.copy(f"{DATA}/{name}.parquet", path)
    for name, key in (("supplier", "s_suppkey"), ("lineitem", "l_suppkey")):
        table = pq.read_table(f"{DATA}/{name}.parquet")
        moved = pa.array([k + 10_000 if k % 2 else k for k in table[key].to_pylist()], table.schema.field(key).type)
        pq.write_table(table.set_column(table.schema.get_field_index(key), key, moved), path / f"{name}.parquet")
    return str(path)


def test_streams_tell_stores_by_their_whole_code(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").where(F.year("l_shipdate") >= 1996)
    grains = lines.select(F.to_date("l_shipdate"), "l_suppkey", "l_partkey").distinct().collect()
    for name in ("stream_ingest", "stream_compact"):
        got = entry.queries()[name](spark, folder).collect()
        assert len(got) == len(grains) and {(r.date, r.store_id, r.product_id) for r in got} == set(map(tuple, grains))


def test_rows_are_shuffled_and_judged_before_the_stores_of_a_code_multiply_them(spark, folder, no_broadcast):
    con = duckdb.connect()
    for name in ("nation", "region", "part", "supplier", "lineitem"):
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    for name in ("resolve_keys", "ingest_accepted", "ingest_rejected"):
        df = entry.queries()[name](spark, folder)
        plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        # the plan reads from the result down: no join or aggregate comes after the rows are multiplied
        above = plan[: next(i for i, line in enumerate(plan) if "Generate" in line)]
        assert not any(word in line for line in above for word in ("Join", "Aggregate"))
        assert compare(df, con, entry.oracle_sql()[name]) is None
