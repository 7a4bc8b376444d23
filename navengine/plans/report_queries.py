"""Queries of the tables for readers and of the store's diagnoses, in the registry of ``queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import series
from ..operators import reports, store, trailing
from .queries import ASOF, JUMP, LR_SQL, NAV_SQL, PANEL_SQL, SQL, TRAIL_SQL, _pairs, _panel, _peers, nav_of, query, read
from .store_queries import BOUND_SQL, SCHEME_SQL, order_prices, schemes

PEER_SQL = f"{TRAIL_SQL}, pr as (select tr.*, cast(s_nationkey as bigint) as category, s_name as name from tr join supplier on tr.fund_id = cast(s_suppkey as varchar)), rk as (select *, rank() over (partition by category order by cagr desc) as rank, count(*) over (partition by category) as n_peers from pr where not is_dead), pc as (select *, case when n_peers <= 1 then 100.0::double else round(100.0::double * (n_peers - rank) / (n_peers - 1), 1) end as percentile from rk)"
SINCE = "1998-01-01"


def _funds(spark, sf):
    return read(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("fund_id"), F.col("s_nationkey").cast("long").alias("category"))


def _bounded(spark, sf):
    return store.bounds(schemes(spark, sf), order_prices(spark, sf))


@query(f"{PEER_SQL}, lost as (select category, round(100.0::double * count(*) filter (is_dead) / count(*), 1) as attrition_pct from pr group by 1) select category, row_number() over (partition by category order by cagr desc, fund_id) as position, fund_id, name, round(cagr, 6) + 0.0 as cagr, percentile, attrition_pct from pc join lost using (category)")
def category_browse(spark, sf):
    names = read(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("fund_id"), F.col("s_name").alias("name"))
    return reports.browse(_peers(spark, sf), names)


# The distribution functions have no name in SQL: Simpson's rule over their densities.
SIMPSON = "case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end"


@query(SQL["quartile_transition"].rpartition("select cast(horizon_y")[0] + f""", k as (select horizon_y, fq, hq, count(*) as o from t group by all), mm as (select *, sum(o) over (partition by horizon_y, fq) as r, sum(o) over (partition by horizon_y, hq) as c from k),
s as (select horizon_y, sum(o) * (sum(o * o / (r * c)) - 1) as chi2, (count(distinct fq) - 1) * (count(distinct hq) - 1) as dof from mm group by horizon_y), steps as (select *, sqrt(greatest(chi2, 0)) / 2000 as step from s where dof > 0),
y as (select horizon_y, sum(step / 3 * {SIMPSON} * pow(2, 1 - dof / 2.0) / gamma(dof / 2.0) * pow(i * step, dof - 1) * exp(-pow(i * step, 2) / 2)) as a from steps, (select unnest(range(2001)) as i) group by 1)
select cast(horizon_y as bigint) as horizon_y, round(chi2, 6) + 0.0 as chi2, cast(dof as bigint) as dof, round(1 - coalesce(a, 0), 6) + 0.0 as p from s left join y using (horizon_y)""")
def transition_p_value(spark, sf):
    return reports.transition_test(trailing.transitions(_pairs(spark, sf)))


@query(SQL["spearman_by_year"].rpartition("select cast(horizon_y")[0] + f""", s as (select horizon_y, fy, count(*) as n, corr(ra, rb) as rho from r group by horizon_y, fy having count(*) >= 10), steps as (select *, abs(rho) * sqrt((n - 2) / (1 - rho * rho)) / 2000 as step from s),
y as (select horizon_y, fy, 2 * sum(step / 3 * {SIMPSON} * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt((n - 2) * pi()) * pow(1 + pow(i * step, 2) / (n - 2), -(n - 1) / 2.0)) as a from steps, (select unnest(range(2001)) as i) group by 1, 2)
select cast(horizon_y as bigint) as horizon_y, cast(fy as bigint) as fy, n, round(rho, 6) + 0.0 as rho, round(1 - a, 6) + 0.0 as p from s join y using (horizon_y, fy)""")
def spearman_p_value(spark, sf):
    return reports.rank_correlation_test(trailing.spearman(_pairs(spark, sf)))


@query(f"with {SCHEME_SQL}, {BOUND_SQL} select case when last_nav_date < date '{ASOF}' - 30 then 'STALE' else status end as status, case when last_nav_date is null then 'never' when date '{ASOF}' - last_nav_date <= 365 then 'recent' else 'older' end as era, count(*) as n, count(*) filter (coalesce(nullif(isin_growth, '-'), nullif(isin_div, '-')) is null) as n_without from bounded group by 1, 2")
def isinless_by_era(spark, sf):
    return reports.without_isin(store.mark_stale(_bounded(spark, sf), ASOF), ASOF)


@query(f"{PANEL_SQL}, c as (select horizon_y, survived, cast(s_nationkey as bigint) as category, count(*) as n from panel join supplier on fund_id = cast(s_suppkey as varchar) where fy_start = 1997 group by all) select cast(horizon_y as bigint) as horizon_y, survived, category, n, round(n / sum(n) over (partition by horizon_y, survived), 6) + 0.0 as share from c")
def survivor_mix(spark, sf):
    return reports.survivor_mix(_panel(spark, sf), _funds(spark, sf), 1997)


@query(f"{LR_SQL} select fund_id, d, round(nav, 6) + 0.0 as nav, round(lr, 6) + 0.0 as lr from r where d between date '1997-01-01' and date '1997-06-30'")
def nav_trajectory(spark, sf):
    return reports.trajectory(nav_of(spark, sf), None, "1997-01-01", "1997-06-30")


@query(f"with {SCHEME_SQL} select plan, option, count(*) as n, count(category) as n_filled, round(100.0::double * count(category) / count(*), 1) as pct_filled from scheme group by 1, 2")
def category_fill_rate(spark, sf):
    return reports.category_fill(schemes(spark, sf), "plan", "option")


@query(f"with {SCHEME_SQL}, {BOUND_SQL}, k as (select distinct isin_growth from scheme where category is not null and isin_growth <> '-') select case when last_nav_date >= date '{SINCE}' then 'recent' else 'older or never' end as era, k.isin_growth is not null as has_sibling, count(*) as n from bounded b left join k on k.isin_growth = b.isin_growth where category is null group by 1, 2")
def category_gap_siblings(spark, sf):
    return reports.category_gaps(_bounded(spark, sf), SINCE)


@query(f"with {SCHEME_SQL} select amfi_code, scheme_name from scheme where category is null and plan = 'DIRECT' and option = 'GROWTH'")
def category_worklist(spark, sf):
    return reports.category_worklist(schemes(spark, sf), True)


NAME = "concat(scheme_name, case amfi_code % 4 when 0 then ' Dividend' when 1 then ' Growth' else '' end)"


@query(f"with {SCHEME_SQL} select amfi_code, option as was, case amfi_code % 4 when 0 then 'IDCW' when 1 then 'GROWTH' else 'UNKNOWN' end as option from scheme where was <> case amfi_code % 4 when 0 then 'IDCW' when 1 then 'GROWTH' else 'UNKNOWN' end")
def option_rederived(spark, sf):
    named = schemes(spark, sf).withColumn("scheme_name", F.expr(NAME))
    return reports.rederived_option(named).where("option <> was").select("amfi_code", "was", "option")


@query(f"with {SCHEME_SQL} select term, count(*) as n, min(scheme_name) as first_name from scheme join (select unnest(['customer', '#00', '99']) as term) on contains(lower(scheme_name), term) group by term")
def name_term_hits(spark, sf):
    return reports.name_hits(schemes(spark, sf), ["Customer", "#00", "99"])


@query(f"{LR_SQL} select fund_id, d, round(nav, 6) + 0.0 as nav from r where coalesce(abs(lr), 0) <= {JUMP}")
def delete_by_keys(spark, sf):
    nav = nav_of(spark, sf)
    return reports.without_keys(nav, series.splice_jumps(nav, JUMP))
