"""The star schema as SQL common table expressions, for checks on another engine."""

from __future__ import annotations

VIEWS = {
    "store": """
select s_suppkey as id, concat('S', lpad(cast(s_suppkey as string), 4, '0')) as code, s_name as name,
       r_name as region, n_name as city,
       case s_suppkey % 3 when 0 then 'supermarket' when 1 then 'express' else 'warehouse' end as store_type
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "product": """
select p_partkey as id, concat('SKU-', cast(p_partkey as string)) as sku, p_name as name, p_type as category,
       p_brand as brand, cast(p_retailprice as decimal(10,2)) as base_price,
       cast(p_retailprice * 0.6 as decimal(10,2)) as base_cost
from part""",
    "sales_daily": """
select cast(l_shipdate as date) as date, l_suppkey as store_id, l_partkey as product_id,
       cast(sum(l_quantity) as int) as quantity,
       cast(floor(sum(l_extendedprice) * 100 / sum(l_quantity)) / 100 as decimal(10,2)) as unit_price,
       cast(sum(l_extendedprice) as decimal(12,2)) as total_amount
from lineitem group by cast(l_shipdate as date), l_suppkey, l_partkey""",
    "price_history": """
select p_partkey as product_id, case when p_partkey % 10 = 0 then p_partkey % 7 end as store_id,
       cast(round(p_retailprice * (100 + (p_partkey % 5 - 2) * k) / 100, 2) as decimal(10,2)) as price,
       date '1995-01-01' + k * 600 as valid_from,
       case when k < 4 then date '1995-01-01' + (k * 600 + 599) end as valid_to
from part cross join (values (0),(1),(2),(3),(4)) t(k)""",
    "promotion": """
select p_partkey * 10 + k as id, p_partkey as product_id,
       case when p_partkey % 9 = 0 then p_partkey % 7 end as store_id,
       case k % 4 when 0 then 'Weekly Special' when 1 then 'Flash Sale' when 2 then 'Clearance'
                  else 'Holiday Promo' end as name,
       case when p_partkey % 2 = 0 then cast((1 + k % 5) / 10.0 as decimal(5,4)) end as discount_pct,
       case when p_partkey % 2 = 1 then cast(1 + k % 5 as decimal(10,2)) end as discount_amount,
       date '1995-01-01' + (k * 240 + cast(p_partkey * 37 % 200 as int)) as start_date,
       date '1995-01-01' + (k * 240 + cast(p_partkey * 37 % 200 as int) + 13 + cast(p_partkey % 20 as int)) as end_date
from part cross join (values (0),(1),(2),(3),(4),(5),(6),(7),(8),(9)) t(k)
where p_partkey % 3 = 0""",
    "inventory_snapshot_daily": """
select date, store_id, product_id,
       cast(case when (store_id * 31 + product_id * 17 + quantity) % 20 = 0 then 0
                 else (store_id * 31 + product_id * 17 + quantity) % 400 end as int) as on_hand_qty,
       cast(case when (store_id * 31 + product_id * 17 + quantity) % 20 = 0 then 200 else 0 end as int) as on_order_qty,
       (store_id * 31 + product_id * 17 + quantity) % 20 = 0 as is_stockout
from sales_daily""",
    "model_run": """
select md5(cast(o_orderkey as string)) as run_id,
       case o_orderstatus when 'P' then 'pending' when 'F' then 'failed' else 'success' end as status,
       case o_orderkey % 3 when 0 then 'naive' when 1 then 'seasonal_naive' else 'moving_average' end as model_type,
       substring(md5(concat(cast(o_orderkey % 3 as string), '-', cast(o_orderkey % 4 as string))), 1, 16) as config_hash,
       o_custkey % 10 as store_id, o_custkey % 20 as product_id,
       cast(o_orderdate as date) as data_window_start, cast(o_orderdate as date) + 90 as data_window_end,
       cast(o_totalprice / 1000 as double) as mae, o_orderdate as created_at
from orders""",
    "calendar": """
select cast(d as date) as date, isodow(d)-1 as day_of_week, month(d) as month, quarter(d) as quarter, year(d) as year,
       (month(d)*100+day(d)) in (101,704,1225) as is_holiday
from (select unnest(generate_series(date_trunc('year', min(l_shipdate)), date_trunc('year', max(l_shipdate)) + interval 1 year - interval 1 day,
             interval 1 day)) as d from lineitem) t""",
    # sales by region, brand and day
    "brand_daily": """
select region, brand, date, cast(sum(quantity) as bigint) as quantity,
       cast(sum(total_amount) as double) / sum(quantity) as unit_price,
       sum(total_amount) as total_amount
from sales_daily join store on store_id = store.id join product on product_id = product.id
group by region, brand, date""",
    # every fifth brand day has no quantity, every seventh no price: input for imputation
    "brand_gaps": """
select region, brand, date,
       case when (day(date) + month(date)) % 5 <> 0 then cast(quantity as double) end as quantity,
       case when day(date) % 7 <> 0 then unit_price end as unit_price
from brand_daily""",
}
NEEDS = {
    "inventory_snapshot_daily": ("sales_daily",),
    "brand_daily": ("sales_daily", "store", "product"),
    "brand_gaps": ("brand_daily",),
}


def with_views(names: str, query: str, **extra: str) -> str:
    """``query`` with the named views (and what they need) in front; ``extra`` adds further ones."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        for other in NEEDS.get(name, ()):
            add(other)
        done.setdefault(name, VIEWS[name])

    for name in names.split():
        add(name)
    done.update(extra)
    parts = ",\n".join(f"{name} as materialized ({sql.strip()})" for name, sql in done.items())
    return f"with {parts}\n{query.strip()}" if parts else query.strip()
