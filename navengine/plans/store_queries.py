"""Queries of the keyed store, reports, portfolios and checks, in the registry of ``queries``.

Schemes are customers: amfi_code, name, plan, option, isin and category by fixed expressions of their columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import series
from ..operators import diagnostics, identity, jumps, store, trailing
from ..sources import reports
from .queries import ASOF, FUNDS, JUMP, NAV_SQL, PAIRS_SQL, RETURNS_SQL, SQL, _pairs, nav_of, query, read

# The same expressions in both dialects.
SCHEME = {
    "amfi_code": "c_custkey", "scheme_name": "c_name", "plan": "case c_custkey % 3 when 0 then 'DIRECT' when 1 then 'REGULAR' else 'UNKNOWN' end",
    "option": "case c_custkey % 5 when 0 then 'IDCW' else 'GROWTH' end", "isin_growth": "case c_custkey % 7 when 0 then '-' else concat('INF', c_nationkey) end",
    "isin_div": "case c_custkey % 4 when 0 then null else concat('IND', c_custkey) end", "category": "case c_custkey % 6 when 0 then null else c_mktsegment end", "status": "'ACTIVE'",
}
SCHEME_SQL = "scheme as (select " + ", ".join(f"{e} as {n}" for n, e in SCHEME.items()) + " from customer)"
ORDERS_SQL = "o as (select o_custkey as amfi_code, cast(o_orderdate as date) as nav_date, o_totalprice as nav from orders)"
BOUND_SQL = f"{ORDERS_SQL}, bounded as (select s.*, first_nav_date, last_nav_date from scheme s left join (select amfi_code, min(nav_date) as first_nav_date, max(nav_date) as last_nav_date from o group by all) using (amfi_code))"


def schemes(spark, sf):
    return read(spark, sf, "customer").select(*(F.expr(e).alias(n) for n, e in SCHEME.items()))


def order_prices(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_custkey").alias("amfi_code"), F.col("o_orderdate").cast("date").alias("nav_date"), F.col("o_totalprice").alias("nav"))


@query(f"with {SCHEME_SQL}, b as (select s_suppkey as amfi_code, s_name as scheme_name, case s_nationkey % 2 when 0 then 'UNKNOWN' else 'DIRECT' end as plan, case s_nationkey % 3 when 0 then null else 'X' end as category from supplier) select coalesce(b.amfi_code, c.amfi_code) as amfi_code, coalesce(b.scheme_name, c.scheme_name) as scheme_name, case when b.plan is null or (b.plan = 'UNKNOWN' and c.plan <> 'UNKNOWN') then coalesce(c.plan, b.plan) else b.plan end as plan, coalesce(b.category, c.category) as category from scheme c full join b on b.amfi_code = c.amfi_code")
def scheme_upsert(spark, sf):
    new = read(spark, sf, "supplier").selectExpr("s_suppkey as amfi_code", "s_name as scheme_name", "case s_nationkey % 2 when 0 then 'UNKNOWN' else 'DIRECT' end as plan", "case s_nationkey % 3 when 0 then null else 'X' end as category")
    return store.upsert_schemes(schemes(spark, sf).select("amfi_code", "scheme_name", "plan", "category"), new)


@query(f"with {ORDERS_SQL}, u as (select l_suppkey as amfi_code, cast(l_shipdate as date) as nav_date, max(l_extendedprice) as nav, 0 as side, 0 as pos from lineitem group by all union all select o_custkey, cast(o_orderdate as date), o_totalprice, 1, o_orderkey from orders) select amfi_code, nav_date, round(nav, 6) + 0.0 as nav from u qualify row_number() over (partition by amfi_code, nav_date order by side desc, pos desc) = 1")
def nav_upsert(spark, sf):
    old = nav_of(spark, sf).select(F.col("fund_id").cast("long").alias("amfi_code"), F.col("d").alias("nav_date"), "nav")
    new = read(spark, sf, "orders").select(F.col("o_custkey").alias("amfi_code"), F.col("o_orderdate").cast("date").alias("nav_date"), F.col("o_totalprice").alias("nav"), F.col("o_orderkey").alias("pos"))
    return store.upsert_nav(old, new)


@query("select o_custkey as amfi_code, cast(o_orderdate as date) as snap_date from orders union select l_suppkey, cast(l_shipdate as date) from lineitem")
def snapshot_insert_ignore(spark, sf):
    old = order_prices(spark, sf).select("amfi_code", F.col("nav_date").alias("snap_date")).distinct()
    new = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("amfi_code"), F.col("l_shipdate").cast("date").alias("snap_date"))
    return store.insert_ignore(old, new, "amfi_code", "snap_date")


@query(f"with {SCHEME_SQL}, {BOUND_SQL} select amfi_code, case when last_nav_date < date '{ASOF}' - 30 then 'STALE' else status end as status from bounded")
def mark_stale(spark, sf):
    return store.mark_stale(store.bounds(schemes(spark, sf), order_prices(spark, sf)), ASOF).select("amfi_code", "status")


@query(f"with {SCHEME_SQL} select amfi_code, coalesce(category, case when isin_growth <> '-' then max(category) over (partition by isin_growth) end) as category from scheme")
def isin_inherit(spark, sf):
    return store.inherit_category(schemes(spark, sf)).select("amfi_code", "category")


@query(f"with {SCHEME_SQL} select amfi_code, coalesce(category, 'nation ' || s_nationkey) as category from scheme left join supplier on s_suppkey = amfi_code")
def fill_category(spark, sf):
    given = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("amfi_code"), F.concat(F.lit("nation "), "s_nationkey").alias("category"))
    return store.fill_category(schemes(spark, sf), given).select("amfi_code", "category")


CURATED = [(6, ["%nothing%", "%#%8"]), (12, ["customer%1"]), (1, ["%"]), (18, ["zzz"])]


@query(f"with {SCHEME_SQL}, t(amfi_code, place, pattern) as (values (6, 0, '%nothing%'), (6, 1, '%#%8'), (12, 0, 'customer%1'), (1, 0, '%'), (18, 0, 'zzz')) select cast(t.amfi_code as bigint) as amfi_code, d.category from t join scheme s on s.amfi_code = t.amfi_code and s.category is null join scheme d on d.category is not null and d.scheme_name ilike t.pattern qualify row_number() over (partition by t.amfi_code order by place, d.amfi_code) = 1")
def manual_mapping(spark, sf):
    return store.manual_mapping(schemes(spark, sf), spark.createDataFrame(CURATED, "amfi_code long, candidates array<string>"))


@query(f"with {SCHEME_SQL} select cast(amfi_code as varchar) as scheme_code, scheme_name, category, case when plan = 'DIRECT' then 'DIRECT' else 'REGULAR' end as plan, option as option_type, coalesce(nullif(isin_growth, '-'), isin_div, 'CODE:' || amfi_code) as fund_id, isin_growth = '-' and isin_div is null as no_isin from scheme where plan <> 'DIRECT' and option = 'GROWTH' and category is not null")
def fund_map(spark, sf):
    return identity.fund_map(schemes(spark, sf))


# The same expressions in both dialects.
RAW = "concat(case p_partkey % 3 when 0 then 'Other Schemes - ' when 1 then 'Other Scheme - ' else '' end, p_brand, case p_partkey % 2 when 0 then ' Fund' else '' end)"


@query(f"with c as (select raw, trim(regexp_replace(regexp_replace(replace(lower(trim(raw)), 'schemes', 'scheme'), '\\bfund\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) as k from (select distinct {RAW} as raw from part)) select raw as raw_category, case when count(*) filter (not contains(lower(raw), 'schemes')) over w = 1 then max(raw) filter (not contains(lower(raw), 'schemes')) over w else first_value(raw) over (partition by k order by length(raw), raw rows between unbounded preceding and unbounded following) end as canonical_category from c window w as (partition by k)")
def category_map(spark, sf):
    return identity.category_map(read(spark, sf, "part").selectExpr(f"{RAW} as category"))


# Lines of reports made of orders: one file for each remainder of the customer, in the order of their keys.
HISTORY = """case when o_orderkey % 10 = 0 then concat('House ', o_custkey % 7) when o_orderkey % 10 = 1 then 'x;y' else concat_ws(';', cast(o_custkey as string),
concat('Scheme ', o_custkey, case o_custkey % 3 when 0 then ' Direct Growth' when 1 then ' Regular' else '' end), case o_custkey % 2 when 0 then 'Direct' else '' end, case o_custkey % 5 when 0 then 'IDCW' when 1 then 'Payout' else '' end,
case o_custkey % 4 when 0 then '-' else concat('INF', o_custkey) end, '', case o_orderkey % 7 when 0 then 'N.A.' when 1 then '0' else cast(o_custkey % 50 + 0.5 as string) end, case o_orderkey % 3 when 0 then {long} when 1 then {short} else 'bad' end) end"""
LISTING = "case o_orderkey % 10 when 0 then concat('Open(Category ', o_orderkey % 13, ')') when 5 then 'House' when 6 then 'Dangling' else concat(o_custkey, ';INF') end"
DATES = {"long": "date_format(o_orderdate, 'dd-MMM-yyyy')", "short": "date_format(o_orderdate, 'dd-MM-yyyy')"}
DATES_SQL = {"long": "strftime(o_orderdate, '%d-%b-%Y')", "short": "strftime(o_orderdate, '%d-%m-%Y')"}


def _lines_sql(text):
    return f"l as (select cast(o_custkey % 7 as varchar) as file, o_orderkey as pos, {text.format(**DATES_SQL)} as value from orders)"


def _lines(spark, sf, text):
    return read(spark, sf, "orders").selectExpr("cast(o_custkey % 7 as string) as file", "o_orderkey as pos", f"{text.format(**DATES)} as value")


@query(f"""with {_lines_sql(HISTORY)}, p as (select string_split(value, ';') as f from l), g as (select f, coalesce(try_strptime(f[8], '%d-%m-%Y'), try_strptime(f[8], '%d-%b-%Y'))::date as nav_date, try_cast(f[7] as double) as nav from p where len(f) = 8)
select cast(f[1] as bigint) as amfi_code, f[2] as scheme_name, case when f[2] like '%Direct%' then 'DIRECT' when f[2] like '%Regular%' then 'REGULAR' when f[3] = 'Direct' then 'DIRECT' else 'UNKNOWN' end as plan,
case when f[2] like '%Growth%' then 'GROWTH' when f[4] <> '' then 'IDCW' else 'UNKNOWN' end as option, nullif(nullif(f[5], '-'), '') as isin_growth, nullif(nullif(f[6], '-'), '') as isin_div, round(nav, 6) + 0.0 as nav, nav_date from g where nav > 0 and nav_date is not null""")
def history_parse(spark, sf):
    return reports.history_report(_lines(spark, sf, HISTORY).select("value"))


@query(f"with {_lines_sql(LISTING)}, g as (select file, pos, value, last_value(case when value not like '%;%' then nullif(regexp_extract(value, '\\((.*)\\)\\s*$', 1), '') end ignore nulls) over (partition by file order by pos) as category from l), r as (select cast(split_part(value, ';', 1) as bigint) as amfi_code, category, pos from g where value like '%;%') select amfi_code, category from r where category is not null qualify row_number() over (partition by amfi_code order by pos desc) = 1")
def navlist_parse(spark, sf):
    return reports.current_list(_lines(spark, sf, LISTING)).where("category is not null")


@query(f"with {_lines_sql(HISTORY)}, g as (select file, pos, value, last_value(case when value not like '%;%' then value end ignore nulls) over (partition by file order by pos) as house from l) select file, pos, cast(split_part(value, ';', 1) as bigint) as amfi_code, house from g where regexp_matches(value, '^[0-9]+;')")
def house_parse(spark, sf):
    return reports.house_of_rows(_lines(spark, sf, HISTORY))


# A payload for each customer: its orders as prices, some without a date or a price.
@query("""with x as (select o_custkey, o_orderkey, cast(o_orderdate as date) as d, case o_orderkey % 6 when 0 then 'N.A.' when 1 then '0' else cast(o_custkey % 90 + o_orderkey % 4 + 0.5 as varchar) end as nav from orders where o_orderkey % 5 <> 0)
select o_custkey as amfi_code, concat('Scheme ', o_custkey, ' Direct Growth') as scheme_name, concat('Category ', o_custkey % 4) as category, 'DIRECT' as plan, 'GROWTH' as option, d as nav_date, round(cast(nav as double), 6) + 0.0 as nav
from x where nav not in ('N.A.', '0') qualify row_number() over (partition by o_custkey, d order by o_orderkey) = 1""")
def json_parse(spark, sf):
    date = F.when(F.col("o_orderkey") % 5 == 0, "bad").otherwise(F.date_format("o_orderdate", "dd-MM-yyyy"))
    price = F.expr("case o_orderkey % 6 when 0 then 'N.A.' when 1 then '0' else cast(o_custkey % 90 + o_orderkey % 4 + 0.5 as string) end")
    data = F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", date.alias("date"), price.alias("nav")))), lambda x: F.struct(x["date"].alias("date"), x["nav"].alias("nav")))
    each = read(spark, sf, "orders").groupBy("o_custkey").agg(data.alias("data"))  # a customer's orders are few
    meta = F.struct(F.col("o_custkey").alias("scheme_code"), F.concat(F.lit("Scheme "), "o_custkey", F.lit(" Direct Growth")).alias("scheme_name"), F.concat(F.lit("Category "), (F.col("o_custkey") % 4).cast("string")).alias("scheme_category"))
    return reports.json_payloads(each.select(F.to_json(F.struct(meta.alias("meta"), "data")).alias("value")))


@query(f"with {SCHEME_SQL}, {ORDERS_SQL} select (select count(*) from scheme) as n_codes, (select count(*) from scheme where status <> 'ACTIVE') as n_not_active, count(*) as n_nav, count(distinct amfi_code) as n_priced, min(nav_date) as first_date, max(nav_date) as last_date from o")
def coverage(spark, sf):
    return diagnostics.coverage(schemes(spark, sf), order_prices(spark, sf))


@query("with x as (select max(cast(l_shipdate as date)) as last_date from lineitem) select last_date, date '2001-12-01' - last_date as days_behind, case when date '2001-12-01' - last_date <= 2 then 'current' when date '2001-12-01' - last_date <= 5 then 'slightly behind' else 'stale' end as verdict from x")
def freshness(spark, sf):
    return diagnostics.freshness(nav_of(spark, sf), "2001-12-01")


@query(f"with {NAV_SQL}, e as (select fund_id, min(d) as a, max(d) as b from nav where fund_id in ('1', '2') group by all) select max(a) as start_date, min(b) as end_date from e having max(a) < min(b) and count(*) = 2")
def common_range(spark, sf):
    return diagnostics.common_range(nav_of(spark, sf), FUNDS)


WEIGHTS = dict.fromkeys(FUNDS, 0.5)


@query(f"""{RETURNS_SQL}, q as (select d, r, exp(sum(ln(1 + r)) over (order by d)) as nav from (select d, sum(r * 0.5) as r from c group by d)), z as (select *, max(nav) over (order by d) as top from q),
v as (select sum(0.5 * vol) as wv from (select stddev_samp(ln(1 + r)) * sqrt(252) as vol from c group by fund_id)), s as (select count(*) as n_obs, stddev_samp(ln(1 + r)) * sqrt(252) as vol, min(nav / top - 1) as dd, max(d) - min(d) as days, arg_max(nav, d) as final from z)
select n_obs, round(wv, 6) + 0.0 as weighted_vol, round(vol, 6) + 0.0 as portfolio_vol, round(wv / vol, 6) + 0.0 as diversification_ratio, round(dd, 6) + 0.0 as max_dd, round(365.25 / days * ln(final), 6) + 0.0 as log_growth from s, v where n_obs >= 20""")
def portfolio_summary(spark, sf):
    s = trailing.portfolio_summary(trailing.common_returns(nav_of(spark, sf), FUNDS), WEIGHTS)
    return s.select("n_obs", "weighted_vol", "portfolio_vol", "diversification_ratio", "max_dd", F.log1p("cagr").alias("log_growth"))


@query(f"{RETURNS_SQL}, k as (select x.fund_id, sum(0.25 * cov) as part from (select x.fund_id, y.fund_id as b, covar_samp(x.r, y.r) as cov from c x join c y using (d) group by all) x group by all) select fund_id, round(part / sum(part) over (), 6) + 0.0 as contribution from k")
def risk_contribution(spark, sf):
    return trailing.risk_contribution(trailing.common_returns(nav_of(spark, sf), FUNDS), WEIGHTS)


@query(SQL["quartile_transition"].rpartition("select cast(horizon_y")[0] + ", k as (select horizon_y, fq, hq, count(*) as o from t group by all), mm as (select *, sum(o) over (partition by horizon_y, fq) as r, sum(o) over (partition by horizon_y, hq) as c from k), s as (select horizon_y, sum(o) as n, sum(o * o / (r * c)) - 1 as x, least(count(distinct fq), count(distinct hq)) as d from mm group by horizon_y) select cast(horizon_y as bigint) as horizon_y, cast(n as bigint) as n, round(n * x, 6) + 0.0 as chi2, case when d > 1 then round(sqrt(greatest(x, 0) / (d - 1)), 6) + 0.0 end as v from s")
def cramers_v(spark, sf):
    return trailing.cramers_v(trailing.transitions(_pairs(spark, sf)))


def _horizon_sql(years: int, metric: str) -> str:
    at = f"date '{ASOF}' - {series.horizon_days(years)}"
    return f"""select b.fund_id, b.category, cast({years} as bigint) as horizon_y, v.value, avg(v.value) over (partition by b.category) as cat_avg, case when v.value is not null then rank() over (partition by b.category order by v.value desc nulls last) end as rank, count(v.value) over (partition by b.category) as n_peers, case when v.value is null then case when coalesce(dead, true) then 'Died' else 'Too new' end end as label
    from base b left join (select l.fund_id, {metric} as value from l join nav n on l.fund_id = n.fund_id and abs(n.d - ({at})) <= 45 where not dead qualify row_number() over (partition by l.fund_id order by abs(n.d - ({at})), n.d desc) = 1) v using (fund_id)"""


@query(f"""with {NAV_SQL}, l as (select fund_id, max(d) as last_d, arg_max(nav, d) as last_nav, date '{ASOF}' - max(d) > 15 as dead from nav where d <= date '{ASOF}' group by fund_id),
base as (select cast(s_suppkey as varchar) as fund_id, cast(s_nationkey as bigint) as category, dead from supplier left join l on l.fund_id = cast(s_suppkey as varchar)), u as ({_horizon_sql(1, 'last_nav / n.nav - 1')} union all {_horizon_sql(3, 'pow(last_nav / n.nav, 365.25 / (last_d - n.d)) - 1')} union all {_horizon_sql(10, 'pow(last_nav / n.nav, 365.25 / (last_d - n.d)) - 1')})
select fund_id, category, horizon_y, round(value, 6) + 0.0 as value, round(cat_avg, 6) + 0.0 as cat_avg, rank, n_peers, label from u""")
def office_snapshot(spark, sf):
    funds = read(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("fund_id"), F.col("s_nationkey").cast("long").alias("category"))
    return trailing.snapshot(nav_of(spark, sf), funds, ASOF, (1, 3, 10))


@query(f"with {NAV_SQL}, j as (select fund_id, abs(ln(nav / lag(nav) over (partition by fund_id order by d))) as x from nav) select case when x > 2 then 'over 2' when x > 1 then '1 to 2' when x > 0.5 then '0.5 to 1' else 'to 0.5' end as band, count(*) as n, count(distinct fund_id) as funds from j where x > 0.35 group by all")
def jump_bands(spark, sf):
    return diagnostics.jump_bands(series.splice_jumps(nav_of(spark, sf)))


@query("""with c as (select cast(l_suppkey as varchar) as scheme_code, cast(l_shipdate as date) as d, l_extendedprice as nav from lineitem), k as (select scheme_code, count(*) as n from c group by all), m as (select cast(s_suppkey as varchar) as scheme_code, cast(s_nationkey as varchar) as fund_id from supplier),
s as (select fund_id, d, nav from c join k using (scheme_code) join m using (scheme_code) qualify row_number() over (partition by fund_id, d order by n desc, scheme_code, nav desc) = 1), j as (select * from (select *, ln(nav / lag(nav) over (partition by fund_id order by d)) as lr from s) where abs(lr) > 2),
b as (select fund_id, e from (select fund_id, scheme_code, max(d) as e from c join m using (scheme_code) group by all) qualify row_number() over (partition by fund_id order by e, scheme_code) < count(*) over (partition by fund_id)), g as (select j.fund_id, j.d, lr, min(abs(j.d - e)) as gap from j left join b on b.fund_id = j.fund_id group by all)
select case when gap is null then 'single code' when gap <= 7 then 'near handoff' else 'mid series' end as bucket, count(*) as n, round(avg(lr), 6) + 0.0 as avg_lr from g group by all""")
def jump_handoff_bucket(spark, sf):
    n = read(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("scheme_code"), F.col("l_shipdate").cast("date").alias("d"), F.col("l_extendedprice").alias("nav"))
    m = read(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("scheme_code"), F.col("s_nationkey").cast("string").alias("fund_id"))
    return diagnostics.handoff_buckets(series.splice_jumps(identity.spliced_nav(n, m), 2.0), n, m)


@query(f"with {SCHEME_SQL}, {BOUND_SQL}, x as (select plan, category, date '{ASOF}' - last_nav_date as age from bounded) select plan, case when age is null then 'never' when age <= 30 then 'to 30 days' when age <= 365 then 'to a year' else 'older' end as age, count(*) as n, count(*) - count(category) as n_missing, round(100.0::double * (count(*) - count(category)) / count(*), 1) as pct_missing from x group by 1, 2")
def null_bucket(spark, sf):
    return diagnostics.missing_category(store.bounds(schemes(spark, sf), order_prices(spark, sf)), ASOF)


@query(f"with {SCHEME_SQL} select amfi_code, isin_growth, plan from scheme where isin_growth in (select isin_growth from scheme group by 1 having count(distinct plan) filter (where plan <> 'UNKNOWN') > 1)")
def isin_conflict_having(spark, sf):
    return diagnostics.conflicting_isins(schemes(spark, sf), "plan").select("amfi_code", "isin_growth", "plan")


@query(f"with {NAV_SQL} select cast(year(d) as bigint) as year, count(*) as n, count(distinct fund_id) as funds, count(*) filter (nav is null or nav <= 0) as n_bad from nav group by 1")
def rows_by_year(spark, sf):
    return diagnostics.rows_by_year(nav_of(spark, sf))


@query(f"""with {NAV_SQL}, f as (select * from nav where (fund_id, d) not in (select fund_id, d from (select *, ln(nav / lag(nav) over (partition by fund_id order by d)) as lr from nav) where abs(lr) > {JUMP})),
c as (select (select count(*) from nav) as rows_before, (select count(distinct fund_id) from nav) as funds_before, count(*) as rows_after, count(distinct fund_id) as funds_after from f)
select *, rows_before = rows_after and funds_before = funds_after as ok from c""")
def publish_gate(spark, sf):
    nav = nav_of(spark, sf)
    return diagnostics.same_shape(nav, nav.join(series.splice_jumps(nav, JUMP).select("fund_id", "d"), ["fund_id", "d"], "left_anti"))


@query(f"with {NAV_SQL} select d, round(max(nav) filter (fund_id = '1'), 4) + 0.0 as \"1\", round(max(nav) filter (fund_id = '2'), 4) + 0.0 as \"2\" from nav where fund_id in ('1', '2') group by d")
def nav_wide_pivot(spark, sf):
    return diagnostics.wide_history(nav_of(spark, sf), FUNDS)


@query("select r_name, string_agg(distinct n_name, ' | ' order by n_name) as nations from nation join region on n_regionkey = r_regionkey group by r_name")
def distinct_list(spark, sf):
    n, r = read(spark, sf, "nation"), read(spark, sf, "region")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_set("n_name")), " | ").alias("nations"))
