"""Tables whose versions share their untouched partitions."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from shelfline.sources import sinks, versions

D = dt.date
SALES = "date date, store_id int, product_id int, quantity int"
MONTHS = versions.by_month()


@pytest.fixture
def table(spark, tmp_path):
    rows = [(D(2024, m, d), 1, p, 10 * m) for m in range(1, 13) for d in (1, 2) for p in range(5)]
    path = str(tmp_path / "sales")
    versions.create(spark.createDataFrame(rows, SALES), path, MONTHS)
    return path


def batch_of(spark, *rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{SALES}, row_index int")


def files(df):
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


def scan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_upsert_of_a_day_reads_and_writes_its_month(spark, table, rows):
    before = versions.current(spark, table)
    batch = batch_of(spark, (D(2024, 3, 2), 1, 1, 7), (D(2024, 3, 2), 1, 1, 8), (D(2024, 3, 5), 2, 9, 1))
    target = versions.read(spark, table, MONTHS, versions.touched(batch, MONTHS))
    assert {re.search(r"month=([\d-]+)", f).group(1) for f in files(target)} == {"2024-03"}
    assert re.search(r"PartitionFilters: \[[^\]]*month[^\]]*2024-03", scan_of(target))
    everything = versions.read(spark, table, MONTHS)
    expected = rows(sinks.upsert(everything, batch, columns=["quantity"]))
    after = versions.upsert_into(table, batch, MONTHS, columns=["quantity"])
    assert rows(versions.read(spark, table, MONTHS)) == expected and len(expected) == 121
    assert {m for m in after.folders if after.folders[m] != before.folders[m]} == {"2024-03"}
    # the same batch again, and the version before it
    versions.upsert_into(table, batch, MONTHS, columns=["quantity"])
    assert rows(versions.read(spark, table, MONTHS)) == expected
    assert versions.read(spark, table, MONTHS, version=before).count() == 120


def test_insert_new_writes_new_rows_only(spark, table, rows):
    batch = batch_of(spark, (D(2024, 3, 2), 1, 1, 7), (D(2024, 3, 5), 2, 9, 5), (D(2025, 1, 1), 2, 9, 6))
    expected = rows(sinks.insert_new(versions.read(spark, table, MONTHS), batch))
    before = versions.current(spark, table)
    after = versions.insert_new_into(table, batch, MONTHS)
    assert rows(versions.read(spark, table, MONTHS)) == expected and len(expected) == 122
    fresh = {f for m in after.folders for f in after.folders[m]} - {f for m in before.folders for f in before.folders[m]}
    assert [spark.read.parquet(f"{table}/data/commit={f}").count() for f in fresh] == [2]
    assert rows(versions.read(spark, table, MONTHS, ["2024-03", "1999-01"])) == [r for r in expected if r[0].month == 3]
    versions.insert_new_into(table, batch, MONTHS)
    assert rows(versions.read(spark, table, MONTHS)) == expected


def test_a_partition_may_lose_all_rows(spark, table, rows):
    before = versions.current(spark, table)
    versions.replace(versions.read(spark, table, MONTHS, ["2024-02"]).where("false"), table, MONTHS, ["2024-02"], before)
    assert versions.read(spark, table, MONTHS).where("month(date) = 2").count() == 0
    assert versions.read(spark, table, MONTHS, ["2024-02"]).count() == 0 and versions.read(spark, table, MONTHS).count() == 110
    with pytest.raises(ValueError):
        versions.replace(versions.read(spark, table, MONTHS), table, MONTHS, ["2024-02"], versions.current(spark, table))


def test_empty_tables_and_missing_dates(spark, tmp_path, rows):
    path = str(tmp_path / "empty")
    assert versions.current(spark, path) is None
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path, MONTHS)
    versions.create(spark.createDataFrame([], SALES), path, MONTHS, {"k": 1})
    assert versions.read(spark, path, MONTHS).count() == 0 and versions.current(spark, path).note == {"k": 1}
    versions.upsert_into(path, batch_of(spark, (None, 1, 1, 5), (D(2024, 1, 1), 1, 1, 6)), MONTHS, columns=["quantity"])
    assert rows(versions.read(spark, path, MONTHS), "quantity") == [(5,), (6,)] and versions.current(spark, path).note == {"k": 1}


def test_one_of_two_writers_fails(spark, table):
    before = versions.current(spark, table)
    rows = versions.read(spark, table, MONTHS, ["2024-02"])
    versions.replace(rows, table, MONTHS, ["2024-02"], before)
    with pytest.raises(Exception, match="(?i)exists"):
        versions.replace(rows, table, MONTHS, ["2024-02"], before)


def test_keys_must_fix_the_partition(spark, table):
    with pytest.raises(ValueError):
        versions.upsert_into(table, batch_of(spark, (D(2024, 1, 1), 1, 1, 6)), MONTHS, keys=["store_id", "product_id"], columns=["quantity"])


def test_buckets(spark, tmp_path, rows):
    layout, path = versions.by_bucket(["k"], 8), str(tmp_path / "t")
    table = spark.range(100).select(F.col("id").alias("k"), F.lit(0).alias("v"))
    versions.create(table, path, layout)
    batch = spark.createDataFrame([(3, 1, 0), (500, 2, 1)], "k long, v int, row_index int")
    after = versions.upsert_into(path, batch, layout, ["k"], ["v"])
    assert rows(versions.read(spark, path, layout).where("v > 0")) == [(3, 1), (500, 2)] and versions.read(spark, path, layout).count() == 101
    assert len({f for fs in after.folders.values() for f in fs}) == 2


def test_rewrite_joins_the_folders_of_a_partition(spark, table, rows):
    for day in (10, 11, 12):
        versions.insert_new_into(table, batch_of(spark, (D(2024, 3, day), 1, 1, day)), MONTHS)
    before, expected = versions.current(spark, table), rows(versions.read(spark, table, MONTHS))
    assert len(before.folders["2024-03"]) == 4
    assert versions.rewrite(spark, table, MONTHS) == before
    after = versions.rewrite(spark, table, MONTHS, most=3)
    assert {len(f) for f in after.folders.values()} == {1} and rows(versions.read(spark, table, MONTHS)) == expected
    assert {m for m in after.folders if after.folders[m] != before.folders[m]} == {"2024-03"}
