"""Registered queries: ingest, data quality, calendar, demand and streaming."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from shelfline.operators import demand, exog, quality
from shelfline.operators.scale import new_path
from shelfline.plans.common import r, rounded
from shelfline.plans.features import BRAND, brand_daily
from shelfline.plans.views import with_views
from shelfline.sources import sinks, versions
from shelfline.sources.star import load_star
from shelfline.streaming import ingest

KNOWN_SINCE = 1996  # the ingest calendar starts here, so 1995 rows have an unknown date


def raw_batch(star):
    """All sales as an ingest batch in natural keys, some of them faulty."""
    p = F.col("product_id")
    return star.sales_daily.select(
        ((F.unix_date("date").cast("long") * 1_000_000 + p) * 10_000 + F.col("store_id")).alias("row_index"),
        "date",
        F.when(p % 50 == 0, F.lit("S-unknown"))
        .when(p % 50 == 1, F.lit(""))
        .otherwise(F.concat(F.lit("S"), F.lpad(F.col("store_id").cast("string"), 4, "0")))
        .alias("store_code"),
        F.when(p % 50 == 2, F.lit("SKU-?")).otherwise(F.concat(F.lit("SKU-"), p.cast("string"))).alias("sku"),
        F.when(p % 50 == 3, -F.col("quantity")).otherwise(F.col("quantity")).alias("quantity"),
        F.when(p % 50 == 4, F.col("unit_price") + F.lit(0.001).cast("decimal(10,3)"))
        .otherwise(F.col("unit_price"))
        .alias("unit_price"),
        "total_amount",
    )


def judged(spark, folder):
    star = load_star(spark, folder)
    days = star.calendar.where(F.col("year") >= KNOWN_SINCE)
    return quality.judge(raw_batch(star), star.store, star.product, days)


def resolved_keys(spark, folder):
    star = load_star(spark, folder)
    days = star.calendar.where(F.col("year") >= KNOWN_SINCE)
    out = exog.resolve_keys(raw_batch(star), star.store, star.product, days)
    return out.select("row_index", "store_id", "product_id", "date_exists")


def rule_errors(spark, folder):
    batch = raw_batch(load_star(spark, folder))
    rows = batch.withColumn("error_code", quality.row_rule_error(batch.schema))
    return rows.groupBy("error_code").agg(F.count(F.lit(1)).alias("rows"))


def rejects(spark, folder):
    return quality.rejected(judged(spark, folder))


def accepted(spark, folder):
    return rounded(quality.accepted(judged(spark, folder)), "unit_price", "total_amount")


def summary(spark, folder):
    return quality.batch_summary(judged(spark, folder))


def _sales_batch(star):
    """Raw order lines as sales rows: several lines may hit one grain."""
    return star.raw("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_index"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_suppkey").alias("store_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.lit(1).cast("decimal(10,2)").alias("unit_price"),
        F.col("l_quantity").cast("decimal(12,2)").alias("total_amount"),
    )


def _old_sales_and_batch(spark, folder):
    star = load_star(spark, folder)
    return star.sales(None, dt.date(1999, 12, 31)), _sales_batch(star).where(F.col("date") >= dt.date(1999, 1, 1))


def upserted(spark, folder):
    """Sales up to 1999 merged with all lines since 1999: both new and known grains."""
    return rounded(sinks.upsert(*_old_sales_and_batch(spark, folder)), "unit_price", "total_amount")


def upserted_months(spark, folder):
    """The same in a stored table, whose months before 1999 are not touched."""
    target, batch = _old_sales_and_batch(spark, folder)
    path, months = new_path(spark, "sales"), versions.by_month()
    versions.create(target, path, months)
    return rounded(versions.read(spark, path, months, version=versions.upsert_into(path, batch, months)), "unit_price", "total_amount")


def _old_and_raised_sales(spark, folder):
    star = load_star(spark, folder)
    raised = star.sales(dt.date(1999, 1, 1)).withColumn("quantity", F.col("quantity") + 1)
    return star.sales(None, dt.date(1999, 12, 31)), raised


def inserted(spark, folder):
    """The same batch, known grains left alone."""
    return rounded(sinks.insert_new(*_old_and_raised_sales(spark, folder)), "unit_price", "total_amount")


def inserted_months(spark, folder):
    """The same in a stored table: only the new rows are written."""
    target, batch = _old_and_raised_sales(spark, folder)
    path, months = new_path(spark, "sales"), versions.by_month()
    versions.create(target, path, months)
    return rounded(versions.read(spark, path, months, version=versions.insert_new_into(path, batch, months)), "unit_price", "total_amount")


def _whole_code(key):
    """A store's code that no other store has; those of the store table keep four digits."""
    return F.format_string("S%04d", F.col(key))


def _coded_stores(star):
    return star.store.withColumn("code", _whole_code("id"))


def _natural_keys(batch):
    """Order lines as sales rows with whole store codes and SKUs."""
    return batch.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_index"),
        F.col("l_shipdate").cast("date").alias("date"),
        _whole_code("l_suppkey").alias("store_code"),
        F.concat(F.lit("SKU-"), F.col("l_partkey").cast("string")).alias("sku"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.lit(1).cast("decimal(10,2)").alias("unit_price"),
        F.col("l_quantity").cast("decimal(12,2)").alias("total_amount"),
    )


def stream_ingest(spark, folder):
    """The order lines read as a stream, validated, logged and folded into the current table."""
    star = load_star(spark, folder)
    stream = ingest.read_files(spark, folder, star.raw("lineitem").schema, "parquet", 1, "lineitem*.parquet")
    log = new_path(spark, "ingest-log")
    days = star.calendar.where(F.col("year") >= KNOWN_SINCE)
    query = ingest.start_ingest(
        stream, _coded_stores(star), star.product, days, log, new_path(spark, "ingest-checkpoint"), _natural_keys
    )
    query.awaitTermination()
    return rounded(ingest.current_sales(spark, log), "unit_price", "total_amount")


def stream_compacted(spark, folder):
    """Two streams into one table: all lines, then first lines by the other stream, then second lines by the first again.

    The table is compacted after each; the last batch is one that an older stream wrote after the mark of a newer one.
    """
    star = load_star(spark, folder)
    lines = star.raw("lineitem")
    log, table = new_path(spark, "ingest-log"), new_path(spark, "sales")
    ingest.create_table(star.sales_daily.where("false"), table)
    places = {name: (new_path(spark, f"ingest-{name}"), new_path(spark, "ingest-checkpoint")) for name in ("a", "b")}
    batches = (("a", lines), ("b", lines.where("l_linenumber = 1")), ("a", lines.where("l_linenumber = 2")))
    for more, (name, rows) in enumerate(batches):
        incoming, marks = places[name]
        rows.withColumn("l_quantity", F.col("l_quantity") + 100 * more).write.mode("append").parquet(incoming)
        stream = spark.readStream.schema(lines.schema).parquet(incoming)
        days = star.calendar.where(F.col("year") >= KNOWN_SINCE)
        ingest.start_ingest(stream, _coded_stores(star), star.product, days, log, marks, _natural_keys).awaitTermination()
        ingest.compact(spark, log, table)
    return rounded(ingest.read_table(spark, table), "unit_price", "total_amount")


def duplicate_grains(spark, folder):
    star = load_star(spark, folder)
    grain = ["day", "l_suppkey", "l_partkey"]
    lines = star.raw("lineitem").select(F.col("l_shipdate").cast("date").alias("day"), *grain[1:])
    return quality.grain_report(
        {
            "raw_lines": (star.dealt(lines, *grain), grain),
            "sales_daily": (star.sales_daily, ["date", "store_id", "product_id"]),
            "inventory": (star.inventory_snapshot_daily, ["date", "store_id", "product_id"]),
            "store_code": (star.store, ["code"]),
            "product_sku": (star.product, ["sku"]),
            "product_name": (star.product, ["name"]),
        }
    )


def _shifted(star):
    """The tables with values moved so that some rows break each rule."""
    return {
        "calendar": star.calendar.withColumn("month", F.col("month") + 1),
        "sales_daily": star.sales_daily.select(
            (F.col("quantity") - 10).alias("quantity"),
            (F.col("unit_price") - 1500).alias("unit_price"),
            (F.col("total_amount") - 20000).alias("total_amount"),
        ),
        "price_history": star.price_history.select(
            (F.col("price") - 1000).alias("price"),
            "valid_from",
            F.date_sub("valid_to", F.col("product_id").cast("int")).alias("valid_to"),
        ),
        "promotion": star.promotion.select(
            (F.col("discount_pct") * 3).alias("discount_pct"),
            (F.col("discount_amount") - 2).alias("discount_amount"),
            "start_date",
            F.date_sub("end_date", 20).alias("end_date"),
        ),
        "inventory_snapshot_daily": star.inventory_snapshot_daily.select(
            (F.col("on_hand_qty") - 50).alias("on_hand_qty"), (F.col("on_order_qty") - 100).alias("on_order_qty")
        ),
    }


def violations(spark, folder):
    star = load_star(spark, folder)
    return quality.constraint_violations({t: star.table(t) for t in quality.CONSTRAINTS})


def violations_shifted(spark, folder):
    return quality.constraint_violations(_shifted(load_star(spark, folder)))


def integrity(spark, folder):
    star = load_star(spark, folder)
    # days without 1995 and without Sundays: orphans and calendar gaps to be found
    days = star.calendar.where((F.col("year") >= KNOWN_SINCE) & (F.col("day_of_week") < 6))
    return quality.integrity_report(star.sales_daily, star.store, star.product, days)


def calendar_dimension(spark, folder):
    """Days of the sales period with US holidays and the units sold on each."""
    star = load_star(spark, folder)
    sold = star.sales_daily.groupBy("date").agg(F.sum("quantity").cast("long").alias("units"))
    span = star.sales_daily.select(F.col("date").alias("first"), F.col("date").alias("last"))
    days = demand.calendar_dimension(span, {dt.date(1998, 11, 27): "Black Friday", dt.date(1999, 12, 25): "Xmas"})
    return days.join(sold, "date", "left")


def price_windows(spark, folder):
    star = load_star(spark, folder)
    events = star.price_history.select("product_id", "store_id", "price", "valid_from")
    return rounded(demand.price_windows(events), "price")


def promotion_days(spark, folder):
    return demand.promotion_days(load_star(spark, folder).promotion)


def promotion_store_days(spark, folder):
    """Promoted product days per store and month, over the products each store carries."""
    star = load_star(spark, folder)
    days = demand.promotion_store_days(star.promotion, star.sales_daily.select("store_id", "product_id"))
    return days.groupBy("store_id", F.trunc("date", "month").alias("month")).agg(
        F.count(F.lit(1)).alias("promo_days")
    )


def _expected(spark, folder):
    star = load_star(spark, folder)
    return demand.expected_demand(star.sales_daily, star.promotion, star.calendar)


def expected_demand(spark, folder):
    """Units sold and expected for every sales row, from factors counted in the sales themselves."""
    return rounded(_expected(spark, folder), "expected_demand", digits=3)


def demand_totals(spark, folder):
    """Units sold and expected per year next to the number of rows."""
    per = _expected(spark, folder).groupBy(F.year("date").alias("year")).agg(
        F.sum("quantity").alias("quantity"), F.sum("expected_demand").alias("expected_demand"), F.count(F.lit(1)).alias("rows")
    )
    return rounded(per, "expected_demand", digits=2)


def missing_share(spark, folder):
    star = load_star(spark, folder)
    return rounded(demand.missing_share(star.sales_daily, star.store, star.product), "missing_share", digits=6)


def series_gaps(spark, folder):
    return demand.gaps(brand_daily(spark, folder), BRAND)


QUERIES = {
    "resolve_keys": resolved_keys,
    "ingest_rule_errors": rule_errors,
    "ingest_rejected": rejects,
    "ingest_accepted": accepted,
    "ingest_summary": summary,
    "upsert_sales": upserted,
    "upsert_sales_months": upserted_months,
    "insert_new_sales": inserted,
    "insert_new_sales_months": inserted_months,
    "stream_ingest": stream_ingest,
    "stream_compact": stream_compacted,
    "duplicate_grains": duplicate_grains,
    "constraint_violations": violations,
    "constraint_violations_shifted": violations_shifted,
    "integrity_report": integrity,
    "calendar_dimension": calendar_dimension,
    "price_windows": price_windows,
    "promotion_days": promotion_days,
    "promotion_store_days": promotion_store_days,
    "expected_demand": expected_demand,
    "expected_demand_by_year": demand_totals,
    "missing_pairs": missing_share,
    "series_gaps": series_gaps,
}

# -- SQL twins ---------------------------------------------------------------------

_BATCH = """
select (cast(date - date '1970-01-01' as bigint) * 1000000 + product_id) * 10000 + store_id as row_index, date,
       case when product_id % 50 = 0 then 'S-unknown' when product_id % 50 = 1 then ''
            else concat('S', lpad(cast(store_id as varchar), 4, '0')) end as store_code,
       case when product_id % 50 = 2 then 'SKU-?' else concat('SKU-', cast(product_id as varchar)) end as sku,
       case when product_id % 50 = 3 then -quantity else quantity end as quantity, unit_price, total_amount,
       product_id % 50 = 4 as odd_price from sales_daily"""
_RULE = """case when store_code = '' then 'BAD_STORE_CODE' when quantity < 0 then 'BAD_QUANTITY'
            when odd_price then 'BAD_UNIT_PRICE' end"""
_JUDGED = f"""
select b.*, st.id as store_id, p.id as product_id, year(date) >= {KNOWN_SINCE} as date_exists,
       coalesce({_RULE}, case when st.id is null then 'UNKNOWN_STORE' when p.id is null then 'UNKNOWN_PRODUCT'
                              when year(date) < {KNOWN_SINCE} then 'UNKNOWN_DATE' end) as error_code
from batch b left join store st on st.code = store_code left join product p on p.sku = b.sku"""


def _judged_sql(query):
    return with_views("sales_daily store product", query, batch=_BATCH, judged=_JUDGED)


_LINES = """select l_orderkey * 10 + l_linenumber as row_index, cast(l_shipdate as date) as date, l_suppkey as store_id,
       l_partkey as product_id, cast(l_quantity as int) as quantity, 1.0 as unit_price, cast(l_quantity as double) as total_amount
from lineitem"""
_LAST = """select * from (select *, row_number() over (partition by date, store_id, product_id order by row_index desc) as rn
from lines where {where}) t where rn = 1"""


def _violations_sql(shift: bool) -> str:
    s = shift
    sources = {
        "calendar": ("calendar", {
            "day_of_week": "day_of_week between 0 and 6", "month": f"month + {int(s)} between 1 and 12", "quarter": "quarter between 1 and 4"}),
        "sales_daily": ("sales_daily", {
            "quantity_positive": f"quantity - {10 * s} >= 0", "price_positive": f"unit_price - {1500 * s} >= 0",
            "amount_positive": f"total_amount - {20000 * s} >= 0"}),
        "price_history": ("price_history", {
            "price_positive": f"price - {1000 * s} >= 0",
            "valid_dates": "valid_to is null or valid_to" + (" - cast(product_id as int)" if s else "") + " >= valid_from"}),
        "promotion": ("promotion", {
            "valid_dates": f"end_date - {20 * s} >= start_date",
            "discount_pct_range": f"discount_pct is null or discount_pct * {3 if s else 1} between 0 and 1",
            "discount_amount_positive": f"discount_amount is null or discount_amount - {2 * s} >= 0"}),
        "inventory_snapshot_daily": ("inventory_snapshot_daily", {
            "on_hand_positive": f"on_hand_qty - {50 * s} >= 0", "on_order_positive": f"on_order_qty - {100 * s} >= 0"}),
    }
    parts = [
        f"select '{table}' as table_name, count(*) as rows, '{name}' as rule, count(*) filter (not ({rule})) as violations from {view}"
        for table, (view, rules) in sources.items()
        for name, rule in rules.items()
    ]
    return with_views("calendar sales_daily price_history promotion inventory_snapshot_daily", " union all ".join(parts))


def _duplicate_sql(check, table, keys):
    return (
        f"select '{check}' as \"check\", count(*) as duplicate_keys, cast(coalesce(sum(n - 1), 0) as bigint) as surplus_rows "
        f"from (select {keys}, count(*) as n from {table} group by {keys} having count(*) > 1) t"
    )


def _holiday_sql():
    nth = lambda m, wd, n: f"month(d) = {m} and isodow(d) = {wd + 1} and day(d) between {7 * n - 6} and {7 * n}"
    cases = [
        ("d = date '1998-11-27'", "Black Friday"), ("d = date '1999-12-25'", "Xmas"),
        (nth(1, 0, 3), "Martin Luther King Jr. Day"), (nth(2, 0, 3), "Presidents Day"),
        ("month(d) = 5 and isodow(d) = 1 and month(d + 7) = 6", "Memorial Day"),
        (nth(9, 0, 1), "Labor Day"), (nth(10, 0, 2), "Columbus Day"), (nth(11, 3, 4), "Thanksgiving"),
        ("month(d) = 1 and day(d) = 1", "New Year''s Day"), ("month(d) = 6 and day(d) = 19", "Juneteenth"),
        ("month(d) = 7 and day(d) = 4", "Independence Day"), ("month(d) = 11 and day(d) = 11", "Veterans Day"),
        ("month(d) = 12 and day(d) = 25", "Christmas Day"),
    ]
    return "case " + " ".join(f"when {c} then '{n}'" for c, n in cases) + " end"


_PRICE_ON = """price_history ph on ph.product_id = s.product_id and (ph.store_id is null or ph.store_id = s.store_id)
  and s.date >= ph.valid_from and (ph.valid_to is null or s.date <= ph.valid_to)"""
_EXPECTED = """select date, store_id, product_id, quantity, year,
       level * sum(quantity) over (partition by dow)::double / sum(level) over (partition by dow)
             * sum(quantity) over (partition by is_holiday)::double / sum(level) over (partition by is_holiday)
             * sum(quantity) over (partition by promo)::double / sum(level) over (partition by promo) as expected_demand
from (select s.*, weekday, cast(year(date) as int) as year, isodow(date) as dow, c.is_holiday, avg(quantity) over (partition by product_id) as level,
             exists (select 1 from promotion m where m.product_id = s.product_id and (m.store_id is null or m.store_id = s.store_id)
                     and s.date between m.start_date and m.end_date) as promo
      from sales_daily s join (select date, day_of_week as weekday, is_holiday from calendar) c using (date)) t"""


def _demand_sql(query):
    return with_views("sales_daily promotion calendar", query, demand=_EXPECTED)


_NEW_ROWS = f"{r('unit_price', 'unit_price')}, {r('total_amount', 'total_amount')}"

ORACLES = {
    "resolve_keys": _judged_sql("select row_index, store_id, product_id, date_exists from judged"),
    "ingest_rule_errors": with_views("sales_daily", f"select {_RULE} as error_code, count(*) as rows from batch group by 1", batch=_BATCH),
    "ingest_rejected": _judged_sql(
        """select row_index, store_code, sku, date, error_code,
       case error_code when 'UNKNOWN_STORE' then 'Store code ''' || store_code || ''' not found'
            when 'UNKNOWN_PRODUCT' then 'SKU ''' || sku || ''' not found'
            when 'UNKNOWN_DATE' then 'Date ''' || cast(date as varchar) || ''' not found in calendar'
            else lower(replace(error_code, '_', ' ')) || ' value' end as error_message
from judged where error_code is not null"""
    ),
    "ingest_accepted": _judged_sql(
        f"select row_index, date, store_id, product_id, quantity, {_NEW_ROWS} from judged where error_code is null"
    ),
    "ingest_summary": _judged_sql(
        """select count(*) filter (error_code is null) as processed_count, count(*) filter (error_code is not null) as rejected_count,
       count(*) as total_received from judged"""
    ),
    "upsert_sales": with_views(
        "sales_daily",
        f"""select date, store_id, product_id, coalesce(n.quantity, s.quantity) as quantity,
       {r('coalesce(n.unit_price, s.unit_price)', 'unit_price')}, {r('coalesce(n.total_amount, s.total_amount)', 'total_amount')}
from (select * from sales_daily where date < date '2000-01-01') s full join newest n using (date, store_id, product_id)""",
        lines=_LINES,
        newest=_LAST.format(where="date >= date '1999-01-01'"),
    ),
    "insert_new_sales": with_views(
        "sales_daily",
        f"""select date, store_id, product_id, quantity + cast(date >= date '2000-01-01' as int) as quantity, {_NEW_ROWS} from sales_daily""",
    ),
    "stream_ingest": with_views(
        "",
        f"select date, store_id, product_id, quantity, {_NEW_ROWS} from newest",
        lines=_LINES,
        newest=_LAST.format(where=f"year(date) >= {KNOWN_SINCE}"),
    ),
    "stream_compact": with_views(
        "",
        f"select date, store_id, product_id, quantity, {_NEW_ROWS} from newest",
        lines=f"""select 0 as batch, * from ({_LINES}) t union all
select batch, row_index, date, store_id, product_id, quantity + 100 * batch, unit_price, total_amount + 100 * batch
from ({_LINES}) t join (select unnest([1, 2]) as batch) b on batch = row_index % 10""",
        newest=_LAST.format(where=f"year(date) >= {KNOWN_SINCE}").replace("order by row_index", "order by batch desc, row_index"),
    ),
    "duplicate_grains": with_views(
        "sales_daily inventory_snapshot_daily store product",
        " union all ".join(
            _duplicate_sql(*a)
            for a in (
                ("raw_lines", "lineitem", "l_shipdate, l_suppkey, l_partkey"),
                ("sales_daily", "sales_daily", "date, store_id, product_id"),
                ("inventory", "inventory_snapshot_daily", "date, store_id, product_id"),
                ("store_code", "store", "code"),
                ("product_sku", "product", "sku"),
                ("product_name", "product", "name"),
            )
        ),
    ),
    "constraint_violations": _violations_sql(False),
    "constraint_violations_shifted": _violations_sql(True),
    "integrity_report": with_views(
        "sales_daily store product calendar",
        """select "check", case when good then 'passed' else bad end as status, found from (
select 'foreign_keys' as "check", count(*) as found, count(*) = 0 as good, 'failed' as bad from sales_daily s
  left join store st on st.id = s.store_id left join product p on p.id = s.product_id left join days c on c.date = s.date
  where st.id is null or p.id is null or c.date is null
union all select 'non_negative', count(*), count(*) = 0, 'failed' from sales_daily where quantity < 0
union all select 'calendar_coverage', max(date) - min(date) + 1 - count(*), max(date) - min(date) + 1 = count(*), 'warning' from days
union all select 'data_presence', count(*), count(*) > 0, 'warning' from sales_daily
union all select 'dimension_completeness', min(n), min(n) > 0, 'warning' from (
  select count(*) as n from store union all select count(*) from product union all select count(*) from days) t) u""",
        days=f"select * from calendar where year >= {KNOWN_SINCE} and day_of_week < 6",
    ),
    "calendar_dimension": with_views(
        "sales_daily",
        f"""select d as date, cast(isodow(d) - 1 as int) as day_of_week, cast(month(d) as int) as month, cast(quarter(d) as int) as quarter,
       cast(year(d) as int) as year, {_holiday_sql()} as holiday_name, holiday_name is not null as is_holiday, units
from (select cast(unnest(generate_series((select min(date) from sales_daily), (select max(date) from sales_daily), interval 1 day)) as date) as d) t
left join (select date, cast(sum(quantity) as bigint) as units from sales_daily group by 1) s on s.date = d""",
    ),
    "price_windows": with_views(
        "price_history",
        f"""select product_id, store_id, {r('price', 'price')}, valid_from,
       lead(valid_from) over (partition by product_id, store_id order by valid_from) - 1 as valid_to from price_history""",
    ),
    "promotion_days": with_views(
        "promotion",
        """select distinct product_id, store_id, cast(unnest(generate_series(start_date, end_date, interval 1 day)) as date) as date
from promotion""",
    ),
    "promotion_store_days": with_views(
        "promotion sales_daily",
        """select store_id, cast(date_trunc('month', date) as date) as month, count(*) as promo_days from (
select distinct store_id, product_id, cast(unnest(generate_series(start_date, end_date, interval 1 day)) as date) as date
from (select store_id, product_id, start_date, end_date from promotion where store_id is not null
      union all
      select a.store_id, product_id, start_date, end_date from (select product_id, start_date, end_date from promotion where store_id is null) c
      join (select distinct store_id, product_id from sales_daily) a using (product_id)) t) u group by 1, 2""",
    ),
    "expected_demand": _demand_sql(f"select date, store_id, product_id, quantity, {r('expected_demand', 'expected_demand', 3)} from demand"),
    "expected_demand_by_year": _demand_sql(
        f"""select year, cast(sum(quantity) as bigint) as quantity, {r('sum(expected_demand)', 'expected_demand', 2)}, count(*) as rows
from demand group by 1"""
    ),
    "missing_pairs": with_views(
        "sales_daily store product",
        f"""select a as active_pairs, s * p as possible_pairs, {r('1 - a / cast(s * p as double)', 'missing_share', 6)}
from (select (select count(*) from (select distinct store_id, product_id from sales_daily) t) as a,
             (select count(*) from store) as s, (select count(*) from product) as p) u""",
    ),
    "series_gaps": with_views(
        "brand_daily",
        """select region, brand, before + 1 as gap_start, cast(date - before - 1 as int) as gap_days
from (select *, lag(date) over (partition by region, brand order by date) as before from brand_daily) t where date - before > 1""",
    ),
}
ORACLES |= {f"{name}_months": ORACLES[name] for name in ("upsert_sales", "insert_new_sales")}
