"""Registered queries: readers, filters, KPI reports and exogenous joins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from shelfline.operators import exog, filters, reports
from shelfline.plans.common import AS_OF, END, START, r, rounded
from shelfline.plans.views import with_views
from shelfline.sources.star import load_calendar, load_series, load_star

BETWEEN = f"date between date '{START}' and date '{END}'"
RATIOS = (
    f"{r('total_revenue / nullif(total_units, 0)', 'avg_unit_price')}, "
    f"{r('total_revenue / nullif(total_transactions, 0)', 'avg_basket_value')}"
)
MONEY = ("total_revenue", "avg_unit_price", "avg_basket_value")


# -- readers and filters --------------------------------------------------------


def series_between(spark, folder):
    star = load_star(spark, folder)
    active = star.store.where(F.col("store_type") != "warehouse").select(F.col("id").alias("store_id"))
    wanted = load_series(star.sales(START, END), START, END)
    return rounded(
        load_series(wanted, START, END, active, ("store_id",), ("product_id", "quantity", "unit_price", "total_amount")),
        "unit_price",
        "total_amount",
    )


def calendar_days(spark, folder):
    """Calendar rows of the period, each with the sales rows of its day."""
    star = load_star(spark, folder)
    per_day = star.sales(START, END).groupBy("date").agg(F.count(F.lit(1)).alias("sales_rows"))
    days = load_calendar(star.calendar, START, END)
    return days.join(per_day, "date", "left").withColumn("sales_rows", F.coalesce("sales_rows", F.lit(0)))


def product_search(spark, folder):
    found = filters.search(load_star(spark, folder).product, ["sku", "name"], "wid_et")
    return rounded(found, "base_price", "base_cost")


def product_page(spark, folder):
    products = filters.equals(load_star(spark, folder).product, category="ECONOMY", brand=None)
    page = filters.paginate(products.select("id", "sku", "name", "category"), ["sku"], 3, 25)
    return page


def product_deep_page(spark, folder):
    """A page far out, found by its ranks."""
    sales = load_star(spark, folder).sales_daily.select("date", "store_id", "product_id", "quantity")
    return filters.paginate(sales, ["date", "store_id", "product_id"], 11, 5_000)


def order_lookup(spark, folder):
    """Stores by natural key and by membership, over all their sales."""
    star = load_star(spark, folder)
    stores = filters.member_of(filters.not_null(star.store, "region"), "store_type", ["express", "warehouse"])
    one = filters.lookup(stores, code="S0007")
    # the id goes into the scan of the facts: the sales of one store stay spread over all tasks
    row = one.first()
    sales = star.sales_daily.where(F.col("store_id") == F.lit(row["id"] if row else None))
    sales = sales.select(F.col("store_id").alias("id"), "date", "product_id", "quantity")
    return sales.join(F.broadcast(one), "id")  # the key is unique, so this is one row


def json_event_filter(spark, folder):
    events = star_events(spark, folder)
    return filters.json_equals(events, "props", "k", "42").select("event_id", "user_id", "event_type")


def star_events(spark, folder):
    return load_star(spark, folder).raw("events")


# -- reports ------------------------------------------------------------------


def kpis_total(spark, folder):
    return rounded(reports.kpis(load_star(spark, folder).sales(START, END), START, END), *MONEY)


def kpis_category(spark, folder):
    star = load_star(spark, folder)
    out = reports.kpis(star.sales(START, END), START, END, category="PROMO", product=star.product)
    return rounded(out, *MONEY)


def kpis_empty(spark, folder):
    """A product that does not exist: sums are 0, ratios NULL."""
    star = load_star(spark, folder)
    return rounded(reports.kpis(star.sales(START, END), START, END, product_id=-1), *MONEY)


def drilldown(dimension):
    def run(spark, folder):
        star = load_star(spark, folder)
        table = reports.DIMENSIONS[dimension][0]
        out = reports.drilldown(
            star.sales(START, END), dimension, START, END, table and star.table(table)
        )
        return rounded(out, *MONEY, "revenue_share_pct")

    return run


def daily_store_summary(spark, folder):
    star = load_star(spark, folder)
    out = reports.daily_store_summary(star.sales(START, END), star.store, START, END)
    return rounded(out, "total_revenue")


def category_trend(grain):
    def run(spark, folder):
        star = load_star(spark, folder)
        since = AS_OF - dt.timedelta(weeks=12)
        out = reports.category_trend(star.sales(since, AS_OF), star.product, AS_OF, grain=grain)
        return rounded(rounded(out, "total_revenue"), "avg_price", digits=6)

    return run


def top_products(spark, folder):
    star = load_star(spark, folder)
    out = reports.top_products(star.sales(AS_OF - dt.timedelta(days=30), AS_OF), star.product, AS_OF)
    return rounded(out, "total_revenue")


def year_over_year(spark, folder):
    star = load_star(spark, folder)
    out = reports.year_over_year(star.sales(dt.date(AS_OF.year - 1, 1, 1), AS_OF), star.store, AS_OF)
    return rounded(out, "current_year_revenue", "prior_year_revenue", "yoy_growth_pct")


def weekday_profile(spark, folder):
    star = load_star(spark, folder)
    out = reports.weekday_profile(star.sales(AS_OF - dt.timedelta(days=90), AS_OF), star.calendar, AS_OF)
    return rounded(out, "avg_daily_revenue")


def holiday_comparison(spark, folder):
    star = load_star(spark, folder)
    out = reports.holiday_comparison(star.sales(AS_OF - dt.timedelta(days=365), AS_OF), star.calendar, AS_OF)
    return rounded(out, "total_revenue", "avg_revenue_per_record")


def store_quartiles(spark, folder):
    star = load_star(spark, folder)
    out = reports.store_quartiles(star.sales(AS_OF - dt.timedelta(days=30), AS_OF), star.store, AS_OF)
    return rounded(out, "total_revenue")


def category_mix(spark, folder):
    star = load_star(spark, folder)
    out = reports.category_mix(star.sales(AS_OF - dt.timedelta(days=30), AS_OF), star.store, star.product, AS_OF)
    return rounded(out, "category_revenue", "revenue_share_pct")


def promotion_lift(spark, folder):
    star = load_star(spark, folder)
    out = reports.promotion_lift(exog.active_promotions(star.sales_daily, star.promotion), star.product)
    return rounded(out, "promo_daily_avg", "baseline_daily_avg", "lift_pct", digits=2)


def stockout_impact(spark, folder):
    star = load_star(spark, folder)
    out = reports.stockout_impact(star.inventory_snapshot_daily, star.sales_daily, star.store, star.product, tasks=star.tasks)
    return rounded(out, "expected_sales", "estimated_lost_sales")


def table_profile(spark, folder):
    star = load_star(spark, folder)
    return reports.table_profile({name: star.table(name) for name in (
        "store", "product", "calendar", "sales_daily", "price_history", "promotion", "inventory_snapshot_daily")})


# -- exogenous joins ----------------------------------------------------------------


def sales_active_price(spark, folder):
    star = load_star(spark, folder)
    out = exog.active_price(star.sales_daily, star.price_history)
    return rounded(out, "sale_price", "list_price", "discount_pct")


def sales_best_price(spark, folder):
    star = load_star(spark, folder)
    out = exog.best_price(star.sales_daily, star.price_history)
    return rounded(out, "sale_price", "list_price", "discount_pct")


def sales_promotions(spark, folder):
    star = load_star(spark, folder)
    out = exog.active_promotions(star.sales_daily, star.promotion).select(
        "date", "store_id", "product_id", "quantity", "total_amount", "promo_name",
        "promo_discount_pct", "promo_discount_amount", "on_promotion",
    )
    return rounded(out, "total_amount", "promo_discount_pct", "promo_discount_amount")


def sales_without_promotion(spark, folder):
    star = load_star(spark, folder)
    out = exog.without_promotion(star.sales_daily, star.promotion)
    return out.select("date", "store_id", "product_id", "quantity")


def sales_stock_status(spark, folder):
    star = load_star(spark, folder)
    return exog.stock_status(star.sales_daily, star.inventory_snapshot_daily)


def exogenous_set(spark, folder):
    star = load_star(spark, folder)
    out = exog.exogenous_set(
        star.sales_daily, star.store, star.product, star.calendar,
        star.price_history, star.promotion, star.inventory_snapshot_daily,
    )
    return rounded(out, "unit_price", "total_amount", "list_price", "promo_discount_pct")


def orphan_sales(spark, folder):
    """Sales against the products of small sizes, stores with credit and days since 1996."""
    star = load_star(spark, folder)
    products = star.raw("part").where("p_size <= 25").select(F.col("p_partkey").alias("id"))
    stores = star.raw("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"))
    out = exog.orphans(star.sales_daily, stores, products, star.calendar.where("year >= 1996"))
    return out.groupBy("no_store", "no_product", "no_date").agg(F.count(F.lit(1)).alias("rows"))


def holiday_sales(spark, folder):
    star = load_star(spark, folder)
    out = exog.with_holidays(star.sales_daily, star.calendar)
    return out.select("date", "store_id", "product_id", "quantity", "is_holiday")


QUERIES = {
    "load_series": series_between,
    "load_calendar": calendar_days,
    "search_products": product_search,
    "paginate_products": product_page,
    "paginate_deep": product_deep_page,
    "lookup_store_sales": order_lookup,
    "json_field_filter": json_event_filter,
    "kpis": kpis_total,
    "kpis_category": kpis_category,
    "kpis_empty": kpis_empty,
    **{f"drilldown_{d}": drilldown(d) for d in reports.DIMENSIONS},
    "daily_store_summary": daily_store_summary,
    **{f"category_trend_{g}": category_trend(g) for g in reports.GRAINS},
    "top_products": top_products,
    "year_over_year": year_over_year,
    "weekday_profile": weekday_profile,
    "holiday_comparison": holiday_comparison,
    "store_quartiles": store_quartiles,
    "category_mix": category_mix,
    "promotion_lift": promotion_lift,
    "stockout_impact": stockout_impact,
    "table_profile": table_profile,
    "sales_active_price": sales_active_price,
    "sales_best_price": sales_best_price,
    "sales_promotions": sales_promotions,
    "sales_without_promotion": sales_without_promotion,
    "sales_stock_status": sales_stock_status,
    "exogenous_set": exogenous_set,
    "orphan_sales": orphan_sales,
    "holiday_sales": holiday_sales,
}


def _drill_sql(dimension: str) -> str:
    table, key, shown, with_id = reports.DIMENSIONS[dimension]
    value = "date" if table is None else f"{table}.{shown}"
    join = "" if table is None else f"join {table} on {key} = {table}.id"
    ids = f", {table}.id as dimension_id" if with_id else ""
    views = "sales_daily" + (f" {table}" if table else "")
    return with_views(
        views,
        f"""select cast(dimension_value as varchar) as dimension_value, {'dimension_id,' if with_id else ''}
       {r('total_revenue', 'total_revenue')}, total_units, total_transactions, cast(rank as int) as rank, total_items,
       {r('round(total_revenue * 100 / revenue_all, 2)', 'revenue_share_pct')}, {RATIOS}
from (select *, row_number() over (order by total_revenue desc, dimension_value) as rank,
             count(*) over () as total_items, cast(sum(total_revenue) over () as double) as revenue_all from groups) t
where rank <= 20""",
        groups=f"""select {value} as dimension_value{ids}, sum(total_amount) as total_revenue,
       cast(sum(quantity) as bigint) as total_units, count(*) as total_transactions
from sales_daily {join} where {BETWEEN} and {value} is not null group by all""",
    )


def _kpi_sql(where: str, views: str = "sales_daily", join: str = "") -> str:
    return with_views(
        views,
        f"""select {r('total_revenue', 'total_revenue')}, total_units, total_transactions, {RATIOS}
from (select coalesce(sum(total_amount), 0) as total_revenue, cast(coalesce(sum(quantity), 0) as bigint) as total_units,
             count(*) as total_transactions from sales_daily {join} where {BETWEEN} and {where}) t""",
    )


_PRICE_ON = """price_history ph on ph.product_id = s.product_id and (ph.store_id is null or ph.store_id = s.store_id)
  and s.date >= ph.valid_from and (ph.valid_to is null or s.date <= ph.valid_to)"""
_PROMO_ON = """promotion pr on pr.product_id = s.product_id and (pr.store_id is null or pr.store_id = s.store_id)
  and s.date between pr.start_date and pr.end_date"""
# exact half-away rounding in whole cents, since the other engine divides decimals as doubles
_DISCOUNT = """case when price is null then null when price = 0 then 0 else
       sign(price - unit_price) * ((2 * abs(cast((price - unit_price) * 100 as bigint)) * 10000 + cast(price * 100 as bigint))
       // (2 * cast(price * 100 as bigint))) / 100.0 end as discount_pct"""


def _since(days: int) -> str:
    return f"date between date '{AS_OF - dt.timedelta(days=days)}' and date '{AS_OF}'"


ORACLES = {
    "load_series": with_views(
        "sales_daily store",
        f"""select store_id, date, product_id, quantity, {r('unit_price', 'unit_price')}, {r('total_amount', 'total_amount')}
from sales_daily join store on store_id = store.id where {BETWEEN} and store_type <> 'warehouse'""",
    ),
    "load_calendar": with_views(
        "sales_daily calendar",
        f"""select date, cast(day_of_week as int) as day_of_week, cast(month as int) as month, cast(quarter as int) as quarter,
       cast(year as int) as year, is_holiday, (select count(*) from sales_daily s where s.date = c.date) as sales_rows
from calendar c where {BETWEEN}""",
    ),
    "search_products": with_views(
        "product",
        f"""select id, sku, name, category, brand, {r('base_price', 'base_price')}, {r('base_cost', 'base_cost')}
from product where sku ilike '%wid_et%' or name ilike '%wid_et%'""",
    ),
    "paginate_products": with_views(
        "product",
        """select id, sku, name, category, (select count(*) from product where category = 'ECONOMY') as total
from product where category = 'ECONOMY' order by sku limit 25 offset 50""",
    ),
    "paginate_deep": with_views(
        "sales_daily",
        """select date, store_id, product_id, quantity, (select count(*) from sales_daily) as total
from sales_daily order by date, store_id, product_id limit 5000 offset 50000""",
    ),
    "lookup_store_sales": with_views(
        "sales_daily store",
        """select store.id, code, name, region, city, store_type, date, product_id, quantity
from store join sales_daily on store_id = store.id
where code = 'S0007' and store_type in ('express', 'warehouse') and region is not null""",
    ),
    "json_field_filter": "select event_id, user_id, event_type from events where json_extract_string(props, '$.k') = '42'",
    "kpis": _kpi_sql("true"),
    "kpis_category": _kpi_sql("category = 'PROMO'", "sales_daily product", "join product on product_id = product.id"),
    "kpis_empty": _kpi_sql("product_id = -1"),
    **{f"drilldown_{d}": _drill_sql(d) for d in reports.DIMENSIONS},
    "daily_store_summary": with_views(
        "sales_daily store",
        f"""select date, code as store_code, name as store_name, count(distinct product_id) as products_sold,
       cast(sum(quantity) as bigint) as total_units, {r('sum(total_amount)', 'total_revenue')}
from sales_daily join store on store_id = store.id where {BETWEEN} group by date, code, name""",
    ),
    **{
        f"category_trend_{g}": with_views(
            "sales_daily product",
            f"""select cast(date_trunc('{g}', date) as date) as period_start, category,
       cast(sum(quantity) as bigint) as total_units, {r('sum(total_amount)', 'total_revenue')}, {r('avg(unit_price)', 'avg_price', 6)}
from sales_daily join product on product_id = product.id where {_since(84)} group by 1, 2""",
        )
        for g in reports.GRAINS
    },
    "top_products": with_views(
        "sales_daily product",
        f"""select sku, name, category, total_units, {r('revenue', 'total_revenue')}, revenue_rank from (
select sku, name, category, cast(sum(quantity) as bigint) as total_units, sum(total_amount) as revenue,
       cast(rank() over (order by sum(total_amount) desc) as int) as revenue_rank
from sales_daily join product on product_id = product.id where {_since(30)} group by sku, name, category
order by revenue desc, sku limit 10) t""",
    ),
    "year_over_year": with_views(
        "sales_daily store",
        f"""select code as store_code, name as store_name, {r('c.revenue', 'current_year_revenue')},
       {r('p.revenue', 'prior_year_revenue')},
       {r('round(cast((c.revenue - p.revenue) * 100 as double) / nullif(cast(p.revenue as double), 0), 2)', 'yoy_growth_pct')}
from (select store_id, sum(total_amount) as revenue from sales_daily
      where date between date '{AS_OF.year}-01-01' and date '{AS_OF}' group by 1) c
join (select store_id, sum(total_amount) as revenue from sales_daily
      where date >= date '{AS_OF.year - 1}-01-01' and date < date '{AS_OF.year}-01-01' group by 1) p using (store_id)
join store on store_id = store.id""",
    ),
    "weekday_profile": with_views(
        "sales_daily calendar",
        f"""select cast(day_of_week as int) as day_of_week, count(distinct s.date) as num_days, {r('avg(daily_revenue)', 'avg_daily_revenue')},
       case day_of_week when 0 then 'Monday' when 1 then 'Tuesday' when 2 then 'Wednesday' when 3 then 'Thursday'
            when 4 then 'Friday' when 5 then 'Saturday' else 'Sunday' end as day_name
from (select date, sum(total_amount) as daily_revenue from sales_daily where {_since(90)} group by date) s
join calendar c on s.date = c.date group by day_of_week""",
    ),
    "holiday_comparison": with_views(
        "sales_daily calendar",
        f"""select case when is_holiday then 'Holiday' else 'Regular Day' end as day_type, count(distinct s.date) as num_days,
       {r('sum(total_amount)', 'total_revenue')}, cast(sum(quantity) as bigint) as total_units,
       {r('avg(total_amount)', 'avg_revenue_per_record')}
from sales_daily s join calendar c on s.date = c.date where s.{_since(365)} group by is_holiday""",
    ),
    "store_quartiles": with_views(
        "sales_daily store",
        f"""select {r('revenue', 'total_revenue')}, code as store_code, name as store_name, region,
       cast(ntile(4) over (order by revenue, store_id) as int) as performance_quartile
from (select store_id, sum(total_amount) as revenue from sales_daily where {_since(30)} group by 1) t
join store on store_id = store.id""",
    ),
    "category_mix": with_views(
        "sales_daily store product",
        f"""select category, {r('revenue', 'category_revenue')}, code as store_code,
       {r('cast(revenue as double) * 100 / cast(sum(revenue) over (partition by code) as double)', 'revenue_share_pct')}
from (select store.code, category, sum(total_amount) as revenue from sales_daily
      join store on store_id = store.id join product on product_id = product.id
      where {_since(30)} group by 1, 2) t""",
    ),
    "promotion_lift": with_views(
        "sales_daily product promotion",
        f"""select sku, product_name, promo_name, start_date, end_date, promo_units, promo_days,
       {r('promo_units * 1.0 / promo_days', 'promo_daily_avg', 2)}, {r('baseline', 'baseline_daily_avg', 2)},
       {r('(cast(promo_units as double) / promo_days - baseline) / nullif(baseline, 0) * 100', 'lift_pct', 2)}
from promo join base using (product_id)""",
        promo=f"""select s.product_id, p.sku, p.name as product_name, pr.name as promo_name, pr.start_date, pr.end_date,
       cast(sum(s.quantity) as bigint) as promo_units, count(distinct s.date) as promo_days
from sales_daily s join product p on s.product_id = p.id join {_PROMO_ON} group by all""",
        base=f"""select s.product_id, avg(s.quantity) as baseline
from sales_daily s left join {_PROMO_ON} where pr.id is null group by s.product_id""",
    ),
    "stockout_impact": with_views(
        "sales_daily store product inventory_snapshot_daily",
        f"""select date, store_code, sku, is_stockout, actual_sales, {r('expected', 'expected_sales')}, {r('lost', 'estimated_lost_sales')}
from (select i.date, st.code as store_code, p.sku, i.is_stockout, coalesce(s.quantity, 0) as actual_sales, a.expected,
             round(a.expected - coalesce(s.quantity, 0), 0) as lost
      from inventory_snapshot_daily i join store st on i.store_id = st.id join product p on i.product_id = p.id
      join (select store_id, product_id, avg(quantity) as expected from sales_daily group by 1, 2) a
        on a.store_id = i.store_id and a.product_id = i.product_id
      left join sales_daily s on s.date = i.date and s.store_id = i.store_id and s.product_id = i.product_id
      where i.is_stockout) t
order by lost desc, date, store_code, sku limit 100""",
    ),
    "table_profile": with_views(
        "store product calendar sales_daily price_history promotion inventory_snapshot_daily",
        " union all ".join(
            f"select '{t}' as table_name, count(*) as row_count, "
            + ("min(date) as first_date, max(date) as last_date" if t == "sales_daily" else "cast(null as date), cast(null as date)")
            + f", cast(null as timestamp) as last_update from {t}"
            for t in ("sales_daily", "store", "product", "calendar", "price_history", "promotion", "inventory_snapshot_daily")
        ),
    ),
    "sales_active_price": with_views(
        "sales_daily price_history",
        f"""select s.date, s.store_id, s.product_id, s.quantity, {r('s.unit_price', 'sale_price')}, {r('price', 'list_price')}, {_DISCOUNT}
from sales_daily s left join {_PRICE_ON}""",
    ),
    "sales_best_price": with_views(
        "sales_daily price_history",
        f"""select date, store_id, product_id, quantity, {r('unit_price', 'sale_price')}, {r('price', 'list_price')}, {_DISCOUNT}
from (select s.*, price, row_number() over (partition by s.date, s.store_id, s.product_id
        order by ph.store_id is null, valid_from desc, price desc) as rn from sales_daily s left join {_PRICE_ON}) t
where rn = 1""",
    ),
    "sales_promotions": with_views(
        "sales_daily promotion",
        f"""select s.date, s.store_id, s.product_id, s.quantity, {r('total_amount', 'total_amount')}, pr.name as promo_name,
       {r('discount_pct', 'promo_discount_pct')}, {r('discount_amount', 'promo_discount_amount')}, pr.id is not null as on_promotion
from sales_daily s left join {_PROMO_ON}""",
    ),
    "sales_without_promotion": with_views(
        "sales_daily promotion",
        f"select s.date, s.store_id, s.product_id, s.quantity from sales_daily s left join {_PROMO_ON} where pr.id is null",
    ),
    "sales_stock_status": with_views(
        "sales_daily inventory_snapshot_daily",
        """select s.date, s.store_id, s.product_id, s.quantity as units_sold, i.on_hand_qty as eod_inventory, i.is_stockout,
       case when i.on_hand_qty < s.quantity * 2 then 'LOW' when i.on_hand_qty < s.quantity * 7 then 'MEDIUM' else 'OK' end as inventory_status
from sales_daily s left join inventory_snapshot_daily i
  on i.date = s.date and i.store_id = s.store_id and i.product_id = s.product_id""",
    ),
    "exogenous_set": with_views(
        "sales_daily store product calendar price_history promotion inventory_snapshot_daily",
        f"""select s.date, st.code as store_code, st.region, st.store_type, p.sku, p.category, p.brand,
       cast(c.day_of_week as int) as day_of_week, cast(c.month as int) as month, cast(c.quarter as int) as quarter, c.is_holiday,
       s.quantity, {r('s.unit_price', 'unit_price')}, {r('s.total_amount', 'total_amount')}, {r('ph.price', 'list_price')},
       {r('coalesce(pr.discount_pct, 0)', 'promo_discount_pct')}, case when pr.id is not null then 1 else 0 end as on_promotion,
       i.on_hand_qty, case when i.is_stockout then 1 else 0 end as stockout_flag
from sales_daily s join store st on s.store_id = st.id join product p on s.product_id = p.id join calendar c on s.date = c.date
left join {_PRICE_ON} left join {_PROMO_ON}
left join inventory_snapshot_daily i on i.date = s.date and i.store_id = s.store_id and i.product_id = s.product_id""",
    ),
    "orphan_sales": with_views(
        "sales_daily",
        """select st.id is null as no_store, p.id is null as no_product, year(s.date) < 1996 as no_date, count(*) as rows
from sales_daily s left join (select s_suppkey as id from supplier where s_acctbal > 0) st on s.store_id = st.id
left join (select p_partkey as id from part where p_size <= 25) p on s.product_id = p.id
where st.id is null or p.id is null or year(s.date) < 1996 group by 1, 2, 3""",
    ),
    "holiday_sales": with_views(
        "sales_daily calendar",
        "select s.date, store_id, product_id, quantity, is_holiday from sales_daily s left join calendar c on s.date = c.date",
    ),
}
