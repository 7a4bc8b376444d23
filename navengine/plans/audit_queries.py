"""Queries of the catalog, of diagnoses and of what a run or merge did, in the registry of ``queries``.

Updates are orders' dates, a code's source is the priority of its last order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import series
from ..operators import audit, store
from ..sources import catalog
from .queries import ASOF, JUMP, LR_SQL, NAV_SQL, PAIRS_SQL, TRAIL_SQL, _pairs, _panel, nav_of, query, read
from .store_queries import ORDERS_SQL, SCHEME_SQL, order_prices, schemes

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
SMALL_JUMP = 2.0
HORIZONS = (1, 3, 5)


def _funds(spark, sf):
    return read(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("fund_id"), F.col("s_nationkey").cast("long").alias("category"))


@query(f"select table_name, cast(ordinal_position as bigint) as position, column_name from information_schema.columns where table_name in ({', '.join(repr(t) for t in TABLES)})")
def catalog_columns(spark, sf):
    return catalog.describe(spark, {t: read(spark, sf, t) for t in TABLES}).drop("column_type")


@query("select s.*, n_columns from (" + " union all ".join(f"select '{t}' as table_name, count(*) as n_rows from {t}" for t in TABLES) + ") s join (select table_name, count(*) as n_columns from information_schema.columns group by 1) using (table_name)")
def catalog_sizes(spark, sf):
    return catalog.sizes({t: read(spark, sf, t) for t in TABLES})


@query(f"with {SCHEME_SQL}, u as (select o_custkey as amfi_code, max(cast(o_orderdate as date)) as day, arg_max(o_orderpriority, o_orderkey) as source from orders group by 1) select day, source, count(*) as n, count(*) - count(category) as n_missing, round(100.0::double * (count(*) - count(category)) / count(*), 1) as pct_missing from scheme left join u using (amfi_code) group by 1, 2")
def category_gaps_by_day(spark, sf):
    orders = read(spark, sf, "orders")
    updates = orders.groupBy(F.col("o_custkey").alias("amfi_code")).agg(F.max("o_orderdate").alias("updated_at"), F.max_by("o_orderpriority", "o_orderkey").alias("source"))
    return audit.gaps_by_day(schemes(spark, sf).join(updates, "amfi_code", "left"))


LINEAGE_SQL = f"{TRAIL_SQL}, h as (select fund_id, min(d) as first_d, max(d) as last_d from nav group by 1), y as (select cast(s_nationkey as bigint) as category, cast(s_suppkey as varchar) as fund_id, h.first_d, h.last_d, case when is_dead is null then 'no anchor' when is_dead then 'dead' else 'alive' end as status, case when not is_dead then round(cagr, 6) + 0.0 end as cagr from supplier left join h on h.fund_id = cast(s_suppkey as varchar) left join tr on tr.fund_id = cast(s_suppkey as varchar))"


@query(f"{LINEAGE_SQL} select * from y")
def label_lineage(spark, sf):
    return audit.label_lineage(nav_of(spark, sf), _funds(spark, sf), ASOF, 3)


@query(f"{LINEAGE_SQL} select category, count(*) filter (status = 'alive') as n_alive, count(*) filter (status = 'dead') as n_dead, count(*) filter (status = 'no anchor') as n_no_anchor from y group by 1")
def label_status(spark, sf):
    return audit.label_status(audit.label_lineage(nav_of(spark, sf), _funds(spark, sf), ASOF, 3))


@query(f"{LR_SQL} select fund_id, count(*) as n, min(d) as first_d, max(d) as last_d, round(max(abs(lr)), 6) + 0.0 as largest from r where abs(lr) > {SMALL_JUMP} group by 1 having count(*) >= 2")
def jump_offenders(spark, sf):
    return audit.repeat_offenders(series.splice_jumps(nav_of(spark, sf), SMALL_JUMP))


@query(f"{LR_SQL} select n.fund_id, j.d as jump_d, n.d, round(n.nav, 6) + 0.0 as nav from nav n join r j on n.fund_id = j.fund_id and abs(n.d - j.d) <= 10 where abs(j.lr) > {JUMP}")
def jump_rows_around(spark, sf):
    nav = nav_of(spark, sf)
    return audit.rows_around(nav, series.splice_jumps(nav, JUMP))


@query(f"with {NAV_SQL}, {ORDERS_SQL}, b as (select distinct amfi_code, nav_date from o), c as (select cast(fund_id as bigint) as amfi_code, d as nav_date, true as old from nav) select count(*) as n_batch, count(*) - count(old) as n_new, count(old) as n_replaced from b left join c using (amfi_code, nav_date)")
def nav_upsert_counts(spark, sf):
    old = nav_of(spark, sf).select(F.col("fund_id").cast("long").alias("amfi_code"), F.col("d").alias("nav_date"))
    return audit.merge_counts(old, order_prices(spark, sf), "amfi_code", "nav_date")


@query(f"with {SCHEME_SQL} select count(*) as n_missing, count(s_suppkey) as n_filled, count(*) - count(s_suppkey) as n_left from scheme left join supplier on s_suppkey = amfi_code where category is null")
def fill_category_counts(spark, sf):
    mapping = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("amfi_code"), F.col("s_name").alias("category"))
    before = schemes(spark, sf)
    return audit.fill_counts(before, store.fill_category(before, mapping), "amfi_code", "category")


@query(f"{PAIRS_SQL}, held as (select horizon_y, count(*) as n_windows from panel group by 1), met as (select horizon_y, count(*) as n_pairs, count(distinct fy) as n_years from pairs group by 1) select cast(horizon_y as bigint) as horizon_y, n_windows, coalesce(n_pairs, 0) as n_pairs, coalesce(n_years, 0) as n_years, round(coalesce(n_pairs, 0) / n_windows, 6) + 0.0 as eligible_share, coalesce(n_pairs, 0) >= 50 as testable from held left join met using (horizon_y)")
def persistence_run(spark, sf):
    return audit.persistence_run(_panel(spark, sf), _pairs(spark, sf))


@query(f"{PAIRS_SQL} select cast(horizon_y as bigint) as horizon_y, cast(fy as bigint) as fy, count(*) as n from pairs group by 1, 2")
def persistence_pairs_by_year(spark, sf):
    return audit.pairs_by_year(_pairs(spark, sf))


DAYS = f"(date '{ASOF}' - case y when 1 then 365 when 3 then 1096 else 1826 end)"
WINDOWS_SQL = f"""with {NAV_SQL}, l as (select fund_id, max(d) as last_d, arg_max(nav, d) as last_nav from nav where d <= date '{ASOF}' group by fund_id), hz as (select unnest([1, 3, 5]) as y),
t as (select l.*, y, n.d as anchor_d, n.nav as anchor_nav from l cross join hz join nav n on l.fund_id = n.fund_id and abs(n.d - {DAYS}) <= 45 qualify row_number() over (partition by l.fund_id, y order by abs(n.d - {DAYS}), n.d desc) = 1),
fw as (select fund_id, cast(y as bigint) as horizon_y, date '{ASOF}' - last_d > 15 as is_dead, case when date '{ASOF}' - last_d > 15 then year(last_d) end as death_year, anchor_d, last_d, date '{ASOF}' - last_d as stale_days,
  case when date '{ASOF}' - last_d <= 15 then round(last_nav / anchor_nav - 1, 6) + 0.0 end as window_return, case when date '{ASOF}' - last_d <= 15 then pow(last_nav / anchor_nav, 365.25 / (last_d - anchor_d)) - 1 end as cagr, case when date '{ASOF}' - last_d <= 15 then round((last_d - anchor_d) / 365.25, 6) + 0.0 end as actual_years from t)"""


@query(f"{WINDOWS_SQL} select * replace (round(cagr, 6) + 0.0 as cagr) from fw")
def fund_windows(spark, sf):
    return audit.fund_windows(nav_of(spark, sf), ASOF, HORIZONS)


@query(f"{WINDOWS_SQL}, pr as (select fw.*, cast(s_nationkey as bigint) as category, count(*) filter (not is_dead) over (partition by s_nationkey, horizon_y) as n_peers, count(*) filter (is_dead) over (partition by s_nationkey, horizon_y) as n_dead_peers from fw join supplier on fund_id = cast(s_suppkey as varchar)), rk as (select fund_id, horizon_y, rank() over (partition by category, horizon_y order by cagr desc) as rank from pr where not is_dead) select fund_id, category, horizon_y, is_dead, death_year, window_return, round(cagr, 6) + 0.0 as cagr, rank, n_peers, n_dead_peers, case when rank is not null then case when n_peers <= 1 then 100.0::double else round(100.0::double * (n_peers - rank) / (n_peers - 1), 1) end end as percentile from pr left join rk using (fund_id, horizon_y)")
def peer_table(spark, sf):
    return audit.peer_table(nav_of(spark, sf), _funds(spark, sf), ASOF, HORIZONS)
