"""Skewed and large inputs give the very same rows."""

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfline.operators import exog, scale, sweep
from shelfline.operators.scale import (
    HotKeys,
    fits_broadcast,
    global_row_number,
    page_of,
    salted_join,
    shared_dir,
)


@pytest.fixture
def skewed(spark):
    """A third of the rows share one key, one key is unknown to the right side, some keys are NULL."""
    rng = random.Random(5)
    data = []
    for i in range(3000):
        key = 7 if i % 3 == 0 else rng.choice([*range(400), None])
        data.append((i, key))
    return spark.createDataFrame(data, "id long, key int")


@pytest.fixture
def right(spark):
    return spark.createDataFrame([(k, f"v{k}-{j}") for k in range(0, 400, 2) for j in range(2)] + [(7, "hot")], "key int, v string")


def hash_of(spark, value, kind="int"):
    return spark.createDataFrame([(value,)], f"key {kind}").select(scale.key_hash([F.col("key")])).first()[0]


def test_hot_keys_finds_the_third(skewed):
    found = HotKeys(skewed, "key", ("id", "key")).parts("key")
    assert [h for h, _ in found] == [hash_of(skewed.sparkSession, 7)] and abs(found[0][1] - 1 / 3) < 0.01


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, no_broadcast, skewed, right, rows, how):
    assert not fits_broadcast(right)
    assert rows(salted_join(skewed, right, ["key"], how)) == rows(skewed.join(right, "key", how).select(
        *salted_join(skewed, right, ["key"], how).columns))


def test_salted_join_spreads_the_hot_key(spark, no_broadcast, skewed, right):
    joined = salted_join(skewed, right, ["key"], "left")
    assert "_salt" in joined._jdf.queryExecution().optimizedPlan().toString()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [len(p) for p in salted_join(skewed, right, ["key"], "left").rdd.glom().collect()]
        plain = [len(p) for p in skewed.join(right, "key", "left").rdd.glom().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == sum(plain) and max(sizes) < max(plain) / 3


def test_hot_null_key(spark, no_broadcast, rows):
    left = spark.createDataFrame([(i, None if i % 2 else i % 50) for i in range(1000)], "id int, key int")
    right = spark.createDataFrame([(k, k * 10) for k in range(50)] + [(None, -1)], "key int, v int")
    assert hash_of(spark, None) in [h for h, _ in HotKeys(left, "key").parts("key")]
    for how in ("left", "inner", "left_anti"):
        plain = left.join(right, "key", how)
        assert rows(salted_join(left, right, ["key"], how).select(plain.columns)) == rows(plain)


def test_salted_join_on_two_keys(spark, no_broadcast, rows):
    left = spark.createDataFrame([(i, 1, i % 2) for i in range(500)] + [(900, 2, 0)], "id int, a int, b int")
    right = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (1, 1, "z")], "a int, b int, v string")
    found = collections.Counter(r.v for r in salted_join(left, right, ["a", "b"], "left").collect())
    assert found == {"x": 250, "y": 250, "z": 250, None: 1}


def test_salted_join_refuses_full(skewed, right):
    with pytest.raises(ValueError):
        salted_join(skewed, right, ["key"], "full")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("partitions", ["4", "40"])
def test_swept_interval_join_equals_brute_force(spark, no_broadcast, monkeypatch, how, partitions):
    """Windows of stores and of all, open ones, those before and after all rows, rows without a day, store or product."""
    monkeypatch.setattr(sweep, "MATCHES", 50)
    rng = random.Random(3)
    day0 = dt.date(2024, 1, 1)
    sales = [(day0 + dt.timedelta(days=rng.randrange(700)), rng.randrange(4), 1 if i % 3 else rng.randrange(5), i)
             for i in range(400)]
    sales += [(None, 1, 1, 1000), (day0, None, 1, 1001), (day0, 1, None, 1002)] + [(day0 + dt.timedelta(days=50), 1, 1, 2000 + i) for i in range(200)]
    windows = [(1, None, None, None, "never"), (None, None, day0, None, "no product"), (1, 1, day0 + dt.timedelta(days=9), day0, "backwards")]
    for i in range(60):
        first = day0 + dt.timedelta(days=rng.randrange(-300, 800))
        last = None if i % 6 == 0 else first + dt.timedelta(days=rng.randrange(0, 400))
        windows.append((rng.randrange(5), rng.choice([None, None, 0, 1, 2]), first, last, f"w{i}"))
    s = spark.createDataFrame(sales, "date date, store_id int, product_id int, n int")
    w = spark.createDataFrame(windows, "product_id int, store_id int, first date, last date, tag string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = exog.interval_join(s.repartition(3), w, "first", "last", how)
        found = got.select(*["n"] if how.startswith("left_") else ["n", "tag"]).collect()
        assert got.columns == [*s.columns, *([] if how.startswith("left_") else ["first", "last", "tag"])]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = []
    for d, st, p, n in sales:
        hits = [t for wp, ws, a, b, t in windows if d and a and p is not None and wp == p and (ws is None or ws == st) and a <= d and (b is None or d <= b)]
        if how == "left_semi":
            want += [(n,)] * bool(hits)
        elif how == "left_anti":
            want += [(n,)] * (not hits)
        else:
            want += [(n, t) for t in hits] or ([(n, None)] if how == "left" else [])
    assert sorted(str(tuple(r)) for r in found) == sorted(map(str, want))


def test_a_product_of_many_windows_is_swept(spark, no_broadcast):
    """A hundred thousand windows and as many sales of one product: the work follows the matches."""
    day0 = dt.date(2000, 1, 1)
    n = 100_000
    at = F.date_add(F.lit(day0), (F.col("id") % 5000).cast("int"))
    s = spark.range(n).select(at.alias("date"), (F.col("id") % 50).cast("int").alias("store_id"), F.lit(1).alias("product_id"), F.col("id").alias("n"))
    w = spark.range(n).select(F.lit(1).alias("product_id"), (F.col("id") % 1000).cast("int").alias("store_id"), at.alias("first"), F.date_add(at, 1).alias("last"), F.col("id").alias("w"))
    out = exog.interval_join(s, w, "first", "last", "inner")
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    # a store below 50 has 100 windows, each on two days: one of them has sales of that store, 20 a day
    plain = s.join(F.broadcast(w.withColumnRenamed("store_id", "own").where("own < 50")).drop("product_id"), (F.col("own") == F.col("store_id")) & F.col("date").between(F.col("first"), F.col("last")))
    assert out.agg(F.count("*"), F.sum("n"), F.sum("w")).collect() == plain.agg(F.count("*"), F.sum("n"), F.sum("w")).collect()


def test_a_hot_product_is_cut_by_days(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 4 < 3, 1).otherwise(F.col("id")).cast("int").alias("product_id"), F.date_add(F.lit(dt.date(2024, 1, 1)), F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id") % 30).cast("int")).alias("date"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        cut = sweep.stretches(rows, "product_id", "date", HotKeys(rows, "product_id")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r["_key"] for r in cut} == {1} and max(r["_salts"] for r in cut) > 1 and [r["_part"] for r in sorted(cut)] == list(range(1, len(cut) + 1))
    assert sweep.stretches(rows.where("product_id > 1"), "product_id", "date", HotKeys(rows.where("product_id > 1"), "product_id")) is None


def test_global_row_number_is_exact_and_spread(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"), (F.col("id") % 3).alias("y")).repartition(5)
    out = global_row_number(df, [F.col("y"), F.col("x")], "n")
    got = [(r.y, r.x) for r in out.orderBy("n").collect()]
    assert got == sorted(got) and len(got) == 5000
    assert sorted(r.n for r in out.select("n").collect()) == list(range(1, 5001))
    assert "Window [row_number() windowspecdefinition(y" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("fetch", [10_000, 50])
@pytest.mark.parametrize("page,size", [(1, 10), (3, 100), (21, 500), (30, 1000), (13, 1000), (14, 1000)])
def test_pages_early_and_deep(spark, monkeypatch, fetch, page, size):
    monkeypatch.setattr(scale, "FETCH", fetch)
    df = spark.range(12345).select((F.lit(20000) - F.col("id")).alias("v"))
    got = [r.v for r in page_of(df, ["v"], page, size).collect()]
    every = sorted(20000 - i for i in range(12345))
    assert got == every[(page - 1) * size : page * size]
    assert "Scan" not in page_of(df, ["v"], page, size)._jdf.queryExecution().optimizedPlan().toString()  # nothing was written


@pytest.mark.parametrize("order", [["a", "b", "id"], ["-a", "b", "-id"], ["-b", "-a", "id"]])
def test_pages_with_ties_and_nulls(spark, monkeypatch, order):
    monkeypatch.setattr(scale, "FETCH", 20)
    rng = random.Random(4)
    data = [(i, None if rng.random() < 0.3 else rng.randrange(3), rng.choice([None, "x", "é", "yy", ""])) for i in range(700)]
    df = spark.createDataFrame(data, "id int, a int, b string").repartition(3)
    every = [tuple(r) for r in df.orderBy(*scale.sort_columns(order)).collect()]
    assert [tuple(r) for page in range(1, 9) for r in page_of(df, order, page, 100).collect()] == every


def test_pages_of_equal_keys(spark, monkeypatch):
    monkeypatch.setattr(scale, "FETCH", 20)
    df = spark.range(500).select(F.lit(1).alias("v"))
    assert page_of(df, ["v"], 3, 100).count() == 100 and page_of(df, ["v"], 6, 100).count() == 0


@pytest.mark.parametrize("rows,fetch", [(0, 100), (1, 100), (3, 100), (10, 100), (1003, 100), (1003, 10_000)])
def test_tiles_are_those_of_ntile(spark, monkeypatch, rows, fetch):
    monkeypatch.setattr(scale, "FETCH", fetch)
    df = spark.range(rows).select((F.col("id") % 7).alias("v"), F.col("id")).repartition(3)
    tile = F.lit(1)
    for border in scale.tile_borders(df, ["v", "id"], 4):
        tile = tile + (~scale.stands_before(df, ["v", "id"], border)).cast("int")
    ours = {(r.id, r.t) for r in df.select("id", tile.alias("t")).collect()}
    assert ours == {(r.id, r.t) for r in df.select("id", F.ntile(4).over(Window.orderBy("v", "id")).alias("t")).collect()}


def test_pages_start_at_one(spark):
    with pytest.raises(ValueError):
        page_of(spark.range(3), ["id"], 0, 5)


class _Session:
    """Just the parts of a session that name its shared folder."""

    def __init__(self, master, folder):
        self.sparkContext, self.conf, self.master, self.folder = self, self, master, folder

    def get(self, name, default):
        return self.folder if name == "spark.checkpoint.dir" else default

    def getCheckpointDir(self):
        return None

    def setCheckpointDir(self, folder):
        self.used = folder


def test_shared_dir_comes_from_the_session():
    session = _Session("spark://host", "hdfs://shared/checkpoints")
    assert shared_dir(session) == session.used == "hdfs://shared/checkpoints"


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        shared_dir(_Session("yarn", None))


def test_hot_keys_are_measured_once_for_all_joins(spark, no_broadcast, skewed, monkeypatch):
    runs = []
    once = HotKeys._measure
    monkeypatch.setattr(HotKeys, "_measure", lambda self, share: runs.append(self) or once(self, share))
    other = skewed.select("key").distinct().withColumn("x", F.lit(1))
    measure = HotKeys(skewed, "key")
    joined = salted_join(skewed, other, ["key"], "left", measure=measure)
    salted_join(joined, other.withColumnRenamed("x", "y"), ["key"], "left", measure=measure)
    assert runs == [measure]


def test_measuring_shuffles_sketches_only(spark, no_broadcast, tmp_path):
    """A unique column of the rows is not touched, and a unique key costs a sketch a task."""
    rows = spark.range(0, 200_000, 1, 8).select(F.col("id").alias("row_index"), (F.col("id") * 3).alias("key"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("name"))
    plans, first = [], type(rows).first

    def noted(self):
        plans.append(self)
        return first(self)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(rows), "first", noted)
        measure = HotKeys(rows, "key", "name")
        unique, named = measure.parts("key"), measure.parts("name")
    assert unique == [] and [h for h, _ in named] == [hash_of(spark, "hot", "string")] and len(plans) == 1
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    # a row for each task, then one for each group of them
    assert plan.count("Exchange hashpartitioning") == 2
    assert "row_index" not in plan and "approx_top_k_accumulate" in plan


def test_keys_of_two_types(spark, no_broadcast, rows):
    """Both sides hash the type that the join compares."""
    left = spark.createDataFrame([(i, 7 if i % 2 else i) for i in range(600)], "id int, key int")
    right = spark.createDataFrame([(k, f"v{k}") for k in range(0, 600, 7)] + [(7, "x")], "key long, v string")
    plain = left.join(right, "key", "left")
    assert rows(salted_join(left, right, ["key"], "left", measure=HotKeys(left, "key")).select(plain.columns)) == rows(plain)


def test_limit_follows_the_partitions(spark, no_broadcast):
    """A key between 1 / partitions and 1 / 200 of the rows is split where partitions are many."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2000")
    try:
        rows = spark.range(10_000).select(F.when(F.col("id") < 40, F.lit(-1)).otherwise(F.col("id")).alias("key"))
        assert [h for h, _ in HotKeys(rows, "key").parts("key")] == [hash_of(spark, -1, "long")]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_exploded_sides_are_counted(spark):
    small = spark.range(100).select(F.explode(F.sequence(F.lit(0), F.lit(200_000))).alias("key"))
    assert not fits_broadcast(small)


def test_a_side_that_only_looks_small_is_not_broadcast(spark):
    left = spark.range(1000).select((F.col("id") % 100).alias("k"), "id")
    large = spark.range(100).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(20_000))).alias("x"))
    assert not fits_broadcast(large)
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert "BroadcastExchange" not in salted_join(left, large, ["k"], how)._jdf.queryExecution().executedPlan().toString()


def test_a_chain_of_joins_measures_its_facts_once(spark, no_broadcast, monkeypatch):
    from shelfline.sources.star import load_star

    star = load_star(spark, "/root/testdata/sf0.001")
    runs, once = [], HotKeys._measure
    monkeypatch.setattr(HotKeys, "_measure", lambda self, share: runs.append(self) or once(self, share))
    exog.exogenous_set(
        star.sales_daily, star.store, star.product, star.calendar, star.price_history, star.promotion,
        star.inventory_snapshot_daily,
    )
    assert len(runs) == 1


@pytest.mark.parametrize("few", [10_000, 2])
@pytest.mark.filterwarnings("ignore::UserWarning")
def test_orphans_with_few_and_many_unknown_keys(spark, no_broadcast, rows, monkeypatch, few):
    monkeypatch.setattr(exog, "FEW_KEYS", few)
    day = dt.date(2024, 1, 1)
    sales = spark.createDataFrame([(day + dt.timedelta(days=i % 9), i % 7, None if i % 50 == 0 else i % 11, i) for i in range(300)], "date date, store_id int, product_id int, n int")
    store = spark.createDataFrame([(i,) for i in range(5)], "id int")
    product = spark.createDataFrame([(i,) for i in range(2, 11)], "id long")
    calendar = spark.createDataFrame([(day + dt.timedelta(days=i),) for i in range(8)], "date date")
    marked = exog.marked_orphans(sales, store, product, calendar)
    for r in marked.collect():
        assert (r.no_store, r.no_product, r.no_date) == (r.store_id >= 5, r.product_id is None or r.product_id < 2, r.date == day + dt.timedelta(days=8))
    # with known keys the rows are not shuffled
    whole = exog.orphans(sales.where("store_id < 5 and product_id >= 2 and n % 9 < 8"), store, product, calendar)
    assert whole.count() == 0 and ("Exchange" in whole._jdf.queryExecution().executedPlan().toString()) is False


def test_broadcast_limit_is_read_in_bytes(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    try:
        for text, size in (("-1", -1), ("10485760b", 10 << 20), ("10MB", 10 << 20), ("2g", 2 << 30), ("7", 7)):
            spark.conf.set(name, text)
            assert scale.broadcast_limit(spark) == size
    finally:
        spark.conf.set(name, before)


def test_a_side_without_an_estimate_is_counted(spark):
    class Remote:
        """A table as a remote session shows it: without a plan."""

        def __init__(self, df, rows):
            self.sparkSession, self.schema, self.rows = df.sparkSession, df.schema, rows

        def count(self):
            return self.rows

    df = spark.createDataFrame([], "a int, b string, c array<struct<x: long, y: double>>")
    assert scale.row_size(df.schema) == 4 + 20 + 16 + 8
    assert fits_broadcast(Remote(df, 1000)) and not fits_broadcast(Remote(df, 1_000_000))
