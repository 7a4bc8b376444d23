"""Queries of runs, walks, ledgers, profiles, name searches and snapshots, in the registry of ``queries``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, corrections, diagnostics, identity, jumps, names, panel, profile, reports, runs, scan, selection, store, trailing
from ..sources import catalog
from ..sources.shared import folder
from ..streaming import walk
from .queries import ASOF, LR_SQL, NAV_SQL, PAIRS_SQL, PANEL_SQL, SQL, _pairs, _panel, nav_of, query, read, windows_of
from .report_queries import SIMPSON, SINCE
from .selection_queries import LABEL_SQL, MAP_SQL, STEPS_SQL, fund_map, scheme, steps_of
from .store_queries import BOUND_SQL, ORDERS_SQL, SCHEME_SQL, order_prices, schemes

ROUND = lambda *cols: ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in cols)

# ---------------------------------------------------------------- runs and walks


@query(f"""{LABEL_SQL}, e as (select fund_id, d, exp(sum(lr) over (partition by fund_id order by d)) as factor from c where label = 'REBASE' and abs(ri - ten) / ten < 0.1 and abs(log10(ri)) > 0.5),
k as (select (select count(*) from s) as prices, (select count(*) from c) as found, (select count(*) from c where label = 'REVERT') as bad, (select count(*) from c where label = 'AMBIGUOUS') as open)
select * from (values (1, 'prices', 'ok', (select prices from k), null), (2, 'jumps', 'ok', (select found from k), null), (3, 'corrected', 'ok', (select prices from k), null),
(4, 'excluded', case when (select open from k) > 0 then 'needs review' else 'ok' end, (select prices - bad from k), case when (select open from k) > 0 then (select open from k) || ' jumps to look at' end),
(5, 'months', case when (select open from k) > 0 then 'not run' else 'ok' end, case when (select open from k) > 0 then null else (select count(distinct (fund_id, date_trunc('month', d))) from s) end, null)) t(position, stage, state, n_rows, note)""")
def run_states(spark, sf):
    """The repair chain as a run: prices, jumps, corrections that must keep all rows, an exclusion that stops for jumps that nobody has looked at, and a table made of the rest."""
    return runs.run(spark, folder(spark, "run"), "nightly", repair_stages(spark, sf))


def repair_stages(spark, sf) -> list[runs.Stage]:
    corrected = lambda t: jumps.correct_rebases(t["prices"], jumps.rebase_events(t["jumps"]))
    return [
        runs.Stage("prices", lambda t: steps_of(spark, sf)),
        runs.Stage("jumps", lambda t: jumps.classify_jumps(t["prices"])),
        runs.Stage("corrected", corrected, [runs.same_counts("prices", "fund_id")]),
        runs.Stage("excluded", lambda t: jumps.drop_reverts(t["corrected"], t["jumps"])[0], [runs.none_of(lambda rows, t: t["jumps"].where("label = 'AMBIGUOUS'"), "jumps to look at")]),
        runs.Stage("months", lambda t: t["excluded"].groupBy("fund_id", F.trunc("d", "month").alias("month")).agg(F.max_by("nav", "d").alias("nav"))),
    ]


@query(f"with {NAV_SQL} select strftime(d, '%Y-%m') as month, count(*) as n, round(sum(nav), 2) + 0.0 as total, cast(2 as bigint) as batches_of_first_year from nav group by 1")
def incremental_walk(spark, sf):
    """Prices walked in windows of a year into a store by month, the first window twice, and what the store then has."""
    at = folder(spark, "walk")
    nav = nav_of(spark, sf).select(F.col("fund_id").cast("int").alias("amfi_code"), F.col("d").alias("nav_date"), "nav", F.lit(0).alias("pos"))
    first, last = nav.agg(F.min("nav_date"), F.max("nav_date")).first()
    again = [(first, first + dt.timedelta(365), "again")]
    for a, b, name in [(a, b, f"{a}") for a, b in walk.plan(spark, at, first, last, days=366)] + again:
        walk.merge(spark, at, nav.where(F.col("nav_date").between(F.lit(a), F.lit(b))), name, a, b)
    twice = walk.batches(spark, at).where(F.col("first_day") == F.lit(first)).agg(F.count(F.lit(1)).alias("batches_of_first_year"))
    months = walk.read_prices(spark, at).groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("nav"), 2).alias("total"))
    return months.crossJoin(F.broadcast(twice))  # one row


# ------------------------------------------------------ series longer than a task

MARKET_SQL = "m as (select cast(l_shipdate as date) as d, l_orderkey as o, l_linenumber as i, l_extendedprice as nav from lineitem), x as (select *, max(nav) over w as top, sum(nav) over w as total from m window w as (order by d, o, i rows unbounded preceding))"


@query(f"with {MARKET_SQL} select year(d) as year, month(d) as month, count(*) as n, round(min(nav / top - 1), 6) + 0.0 as worst_fall, round(max(top), 6) + 0.0 as top, round(max(total), 2) + 0.0 as total from x group by 1, 2")
def market_drawdown(spark, sf):
    """All prices as one series: its running maximum and total by segments of days."""
    m = read(spark, sf, "lineitem").select(F.lit("market").alias("fund_id"), F.col("l_shipdate").cast("date").alias("d"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("i"), F.col("l_extendedprice").alias("nav"))
    order, by = ["d", "o", "i"], scan.of_days(days=30)
    x = scan.running(scan.running(m, F.col("nav"), "top", "max", ["fund_id"], order, by), F.col("nav"), "total", "sum", ["fund_id"], order, by)
    out = x.groupBy(F.year("d").alias("year"), F.month("d").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.min(F.col("nav") / F.col("top") - 1).alias("worst_fall"), F.max("top").alias("top"), F.round(F.max("total"), 2).alias("total"))
    return out


@query(f"{LR_SQL} select fund_id, d, {ROUND('lr', 'fall')} from (select fund_id, d, lr, nav / top - 1 as fall from r)")
def scanned_series(spark, sf):
    return scan.drawdowns(scan.log_returns(nav_of(spark, sf), days=365), days=365).select("fund_id", "d", "lr", "fall")


# ------------------------------------------------------------------- persistence


@query(SQL["spearman_pooled"].rpartition("select cast(horizon_y")[0] + f""", s as (select horizon_y, count(*) as n, corr(ra, rb) as rho from r group by horizon_y), steps as (select *, abs(rho) * sqrt((n - 2) / (1 - rho * rho)) / 2000 as step from s),
y as (select horizon_y, 2 * sum(step / 3 * {SIMPSON} * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt((n - 2) * pi()) * pow(1 + pow(i * step, 2) / (n - 2), -(n - 1) / 2.0)) as a from steps, (select unnest(range(2001)) as i) group by 1)
select cast(horizon_y as bigint) as horizon_y, n, round(rho, 6) + 0.0 as rho, round(greatest(1 - a, 0), 6) + 0.0 as p from s join y using (horizon_y)""")
def spearman_pooled_p_value(spark, sf):
    return reports.rank_correlation_test(selection.pooled_spearman(_pairs(spark, sf)))


VOL_SQL = PAIRS_SQL.replace("and window_return is not null", "and ann_vol is not null").replace("a.window_return as formation, b.window_return as holding", "a.ann_vol as formation, b.ann_vol as holding")


@query(f"{VOL_SQL} select fund_id, cast(horizon_y as bigint) as horizon_y, cast(phase as bigint) as phase, cast(fy as bigint) as fy, {ROUND('formation', 'holding')} from pairs")
def persistence_volatility(spark, sf):
    return trailing.persistence_pairs(_panel(spark, sf), "ann_vol")


@query(f"{PANEL_SQL} select cast(fy_start as bigint) as fy_start, count(*) as n, cast(sum(survived::int) as bigint) as n_survived, round(median(window_return), 6) + 0.0 as med_return, round(median(ann_vol), 6) + 0.0 as med_vol, round(100.0::double * (count(*) - sum(survived::int)) / count(*), 1) as attrition_pct from panel where horizon_y = 1 group by 1")
def panel_attrition(spark, sf):
    return panel.attrition(_panel(spark, sf))


@query(f"""with {NAV_SQL}, st as (select fund_id, d, nav from (select *, row_number() over (partition by fund_id order by d) as rn from nav) where (rn - 1) % 5 = 0),
p as (select st.*, h, st.d + cast(days as int) as target from st, (values (1, 365), (3, 1096), (5, 1826)) v(h, days)),
e as (select p.fund_id, h, p.d, p.nav, n.d as ad, n.nav as an from p join nav n on n.fund_id = p.fund_id and n.d between p.target - 45 and p.target + 45 qualify row_number() over (partition by p.fund_id, h, p.d order by abs(n.d - p.target), n.d desc) = 1),
c as (select h, pow(an / nav, 365.25 / (ad - d)) - 1 as cagr from e where ad > d)
select cast(h as bigint) as horizon_y, count(*) as n, round(median(cagr), 6) + 0.0 as median, round(quantile_cont(cagr, 0.1), 6) + 0.0 as p10, round(quantile_cont(cagr, 0.9), 6) + 0.0 as p90, round(min(cagr), 6) + 0.0 as worst, round(max(cagr), 6) + 0.0 as best, round(100.0::double * count(*) filter (cagr < 0) / count(*), 6) + 0.0 as pct_negative from c group by 1""")
def rolling_horizons(spark, sf):
    return trailing.summary(trailing.rolling_all(nav_of(spark, sf)), "cagr", "horizon_y")


@query(f"""with {NAV_SQL}, y as (select min(year(d) - case when month(d) < 4 then 1 else 0 end) as a, max(year(d) - case when month(d) < 4 then 1 else 0 end) as b from nav),
w as (select h, fy, make_date(fy, 4, 1) as s, make_date(fy + h, 3, 31) as e from (values (1), (3), (5)) h(h), y, (select unnest(range(1980, 2040)) as fy) where fy >= a and fy + h <= b)
select cast(h as bigint) as horizon_y, cast(fy as bigint) as fy_start, s as start_date, e as end_date, count(distinct fund_id) as funds, count(*) as n_obs from w join nav on d > s and d <= e group by all""")
def fiscal_windows_found(spark, sf):
    """All windows that end by the last fiscal year that the prices reach, with what they hold."""
    nav = nav_of(spark, sf)
    first, last = panel.fiscal_years(nav)
    w = panel.fiscal_windows(spark, first, last, (1, 3, 5)).drop("phase")
    held = nav.join(F.broadcast(panel.by_year(w)), panel.fiscal_year() == F.col("__fy")).where("d > start_date and d <= end_date")
    return held.groupBy("horizon_y", "fy_start", "start_date", "end_date").agg(F.count_distinct("fund_id").alias("funds"), F.count(F.lit(1)).alias("n_obs"))


# ------------------------------------------------------------- snapshots, one-pager

TRAILS_SQL = f"""with {NAV_SQL}, hz(h, days) as (values (1, 365), (3, 1096), (5, 1826), (10, 3652)), l as (select fund_id, max(d) as last_d, arg_max(nav, d) as last_nav from nav where d <= date '{ASOF}' group by fund_id),
t as (select l.*, h, n.d as anchor_d, n.nav as anchor_nav from l, hz join nav n on n.fund_id = l.fund_id and n.d between date '{ASOF}' - cast(days as int) - 45 and date '{ASOF}' - cast(days as int) + 45
  qualify row_number() over (partition by l.fund_id, h order by abs(n.d - (date '{ASOF}' - cast(days as int))), n.d desc) = 1),
tr as (select *, date '{ASOF}' - last_d > 15 as is_dead, last_nav / anchor_nav - 1 as window_return, case when last_d > anchor_d then pow(last_nav / anchor_nav, 365.25 / (last_d - anchor_d)) - 1 end as cagr, (last_d - anchor_d) / 365.25 as actual_years from t where anchor_nav > 0)"""
RISK_SQL = """vx as (select tr.fund_id, tr.h, ln(n.nav / lag(n.nav) over (partition by tr.fund_id, tr.h order by n.d)) as lr from tr join nav n on n.fund_id = tr.fund_id and n.d > tr.anchor_d and n.d <= tr.last_d where not is_dead),
vo as (select fund_id, h, stddev_samp(lr) * sqrt(252) as ann_vol, count(lr) as n_obs from vx group by all),
dx as (select tr.fund_id, tr.h, n.nav / max(n.nav) over (partition by tr.fund_id, tr.h order by n.d rows unbounded preceding) - 1 as fall from tr join nav n on n.fund_id = tr.fund_id and n.d between tr.anchor_d and tr.last_d where not is_dead),
dd as (select fund_id, h, min(fall) as max_dd from dx group by all),
ri as (select tr.*, ann_vol, coalesce(n_obs, 0) as n_obs, max_dd, (cagr - 0.065) / nullif(ann_vol, 0) as sharpe from tr left join vo using (fund_id, h) left join dd using (fund_id, h))"""
# Two spellings of each category: odd funds have another one.
SPELT = "case when cast(s_suppkey as int) % 2 = 0 then concat('Equity Scheme - Group ', s_nationkey % 5, ' Fund') else concat('Equity Schemes - Group ', s_nationkey % 5, ' Fund') end"
CANON = "concat('Equity Scheme - Group ', s_nationkey % 5, ' Fund')"


def _spelt(spark, sf) -> DataFrame:
    return read(spark, sf, "supplier").selectExpr("cast(s_suppkey as string) as fund_id", f"{SPELT} as category")


def _canonical(spark, sf) -> DataFrame:
    funds = _spelt(spark, sf)
    return trailing.canonical(funds, identity.category_map(funds.select("category")))


CANON_SQL = f"{TRAILS_SQL}, {RISK_SQL}, funds as (select cast(s_suppkey as varchar) as fund_id, case when count(*) filter (s_suppkey % 2 = 0) over (partition by s_nationkey % 5) = 0 then {SPELT} else {CANON} end as category from supplier), pr as (select f.category, ri.* from ri join funds f using (fund_id))"


@query(f"{CANON_SQL} select category, cast(h as bigint) as horizon_y, fund_id, {ROUND('window_return', 'cagr', 'actual_years', 'ann_vol')}, n_obs, {ROUND('sharpe', 'max_dd')} from pr where not is_dead")
def category_snapshot(spark, sf):
    return trailing.category_snapshot(nav_of(spark, sf), _canonical(spark, sf), ASOF, (1, 3, 5, 10))[0]


@query(f"{CANON_SQL} select category, cast(h as bigint) as horizon_y, count(*) as n_considered, count(*) filter (is_dead) as n_dead from pr group by all")
def category_snapshot_counts(spark, sf):
    return trailing.category_snapshot(nav_of(spark, sf), _canonical(spark, sf), ASOF, (1, 3, 5, 10))[1]


PAGER_SQL = f"""{TRAILS_SQL}, {RISK_SQL}, funds as (select cast(s_suppkey as varchar) as fund_id, cast(s_nationkey as bigint) as category from supplier), pr as (select f.category, ri.*, case when h <= 1 then window_return else cagr end as value from ri join funds f using (fund_id)),
al as (select category, h, fund_id, value, ann_vol, n_obs, sharpe, max_dd, rank() over (partition by category, h order by value desc nulls last) as rank, case when sharpe is not null then rank() over (partition by category, h order by sharpe desc nulls last) end as sharpe_rank, count(*) over q as n_peers,
  avg(value) over q as cat_avg, avg(ann_vol) over q as cat_vol, avg(sharpe) over q as cat_sharpe from pr where not is_dead window q as (partition by category, h)),
ct as (select category, h, count(*) as n_considered, count(*) filter (is_dead) as n_dead from pr group by all),
pg as (select f.category, f.fund_id, hz.h, al.* exclude (category, h, fund_id), ct.n_considered, ct.n_dead, case when n_peers <= 1 then 100.0::double else round(100.0::double * (n_peers - rank) / (n_peers - 1), 1) end as percentile,
  case when sharpe_rank is not null then case when n_peers <= 1 then 100.0::double else round(100.0::double * (n_peers - sharpe_rank) / (n_peers - 1), 1) end end as sharpe_percentile,
  case when tr.is_dead is null then 'insufficient history' when tr.is_dead then 'died ' || year(tr.last_d) else 'alive' end as state
  from funds f cross join hz left join tr on tr.fund_id = f.fund_id and tr.h = hz.h left join al on al.fund_id = f.fund_id and al.h = hz.h and al.category = f.category left join ct on ct.category = f.category and ct.h = hz.h and al.fund_id is not null)"""


def _pager(spark, sf) -> DataFrame:
    funds = read(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("fund_id"), F.col("s_nationkey").cast("long").alias("category"))
    return reports.one_pager(nav_of(spark, sf), funds, ASOF)


@query(f"""{PAGER_SQL} select category, fund_id, cast(h as bigint) as horizon_y, {ROUND('value', 'cat_avg')}, rank, n_peers, case when rank is not null then percentile end as percentile, {ROUND('ann_vol')}, n_obs, {ROUND('cat_vol', 'sharpe', 'cat_sharpe')}, sharpe_rank, sharpe_percentile, {ROUND('max_dd')}, n_considered, n_dead, state,
case when state = 'alive' then concat_ws('; ', case when n_dead > 0 then n_dead || ' of ' || n_considered || ' peers had died' end, case when n_obs < 20 then 'only ' || n_obs || ' returns' end) end as notes from pg""")
def one_pager(spark, sf):
    return _pager(spark, sf)


@query(f"""{PAGER_SQL}, f as (select *, rank || '/' || n_peers as place from pg) select fund_id, cast(h as bigint) as horizon_y, case when state = 'alive' then concat_ws(' | ', case when value is null then 'n/a' else printf('%+.2f%%', value * 100) end, case when cat_avg is null then 'n/a' else printf('%+.2f%%', cat_avg * 100) end,
case when ann_vol is null then 'n/a' else printf('%+.2f%%', ann_vol * 100) end, place, case when percentile is not null then printf('%.0f', percentile) end) else state end as line from f""")
def one_pager_lines(spark, sf):
    return reports.lines_of(_pager(spark, sf))


TWO = ["1", "2"]


@query(f"""with {NAV_SQL}, e as (select fund_id, min(d) as a, max(d) as b from nav where fund_id in ('1', '2') and d <= date '{ASOF}' group by 1), g as (select max(a) as a, min(b) as b from e having count(*) filter (date '{ASOF}' - b <= 15) = 2)
select fund_id, d, round(nav / first_value(nav) over (partition by fund_id order by d) * 100, 6) + 0.0 as rebased from nav, g where fund_id in ('1', '2') and d between a and b""")
def rebased_together(spark, sf):
    return diagnostics.rebased_together(nav_of(spark, sf), TWO, ASOF)


@query(f"with {NAV_SQL} select fund_id, d, round(nav, 4) + 0.0 as nav from nav where fund_id in ('1', '2')")
def nav_long(spark, sf):
    return diagnostics.long_history(nav_of(spark, sf), TWO)


# ------------------------------------------------------------------------ ledger

# Smooth series with spikes, and with a bad price that is no jump itself but makes one a day later.
DIPS_SQL = f"""{NAV_SQL}, p as (select fund_id, d, row_number() over w as rn, count(*) over (partition by fund_id) as n, cast(fund_id as int) as f from nav window w as (partition by fund_id order by d)),
s as (select fund_id, d, 100.0::double * pow(1.0002::double, rn) * case when f % 5 = 0 and rn = n // 2 then 100.0 when f % 5 in (1, 2) and rn = n // 2 then 0.72 when f % 5 in (1, 2) and rn > n // 2 then 1.04 else 1.0 end as nav from p)"""
ENTRIES_SQL = f"""{LABEL_SQL.replace(STEPS_SQL, DIPS_SQL)}, allowed as (select fund_id, d as bad_d, 'bad print' as note from p where f % 5 = 2 and rn = n // 2),
tv as (select fund_id, d from c where label = 'REBASE' and abs(ri - ten) / ten < 0.1 and abs(log10(ri)) <= 0.5), rv as (select fund_id, d from c where label = 'REVERT'),
entries as (select fund_id, d, d as bad_d, 'revert' as origin, 'resolved' as state, null::varchar as note from rv
union all select tv.fund_id, tv.d, case when sp.fund_id is null then a.bad_d end, 'rebase', case when sp.fund_id is not null then 'resolved' when a.bad_d is not null then 'allowed' else 'to review' end, case when sp.fund_id is null then a.note end
from tv left join (select distinct fund_id from rv) sp using (fund_id) left join allowed a on a.fund_id = tv.fund_id)"""


def _dips(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(prices, ledger entries)."""
    from pyspark.sql import Window as W

    by = W.partitionBy("fund_id")
    p = nav_of(spark, sf).select("fund_id", "d", F.row_number().over(by.orderBy("d")).alias("rn"), F.count(F.lit(1)).over(by).alias("n"), (F.col("fund_id").cast("int") % 5).alias("f"))
    half = F.floor(F.col("n") / 2)
    dip = F.col("f").isin(1, 2)
    level = F.when((F.col("f") == 0) & (F.col("rn") == half), 100.0).when(dip & (F.col("rn") == half), 0.72).when(dip & (F.col("rn") > half), 1.04).otherwise(1.0)
    nav = p.select("fund_id", "d", (F.lit(100.0) * F.pow(F.lit(1.0002), F.col("rn")) * level).alias("nav"))
    allowed = p.where((F.col("f") == 2) & (F.col("rn") == half)).select("fund_id", F.col("d").alias("bad_date"), F.lit("bad print").alias("note"))
    return nav, corrections.ledger(jumps.classify_jumps(nav), allowed)


@query(f"{ENTRIES_SQL} select * from entries")
def correction_ledger(spark, sf):
    return _dips(spark, sf)[1]


@query(f"{ENTRIES_SQL} select fund_id, d, origin from entries where state = 'to review'")
def exclusion_review(spark, sf):
    return corrections.review(_dips(spark, sf)[1]).select("fund_id", "d", "origin")


@query(f"{ENTRIES_SQL} select fund_id, d, {ROUND('nav')} from s where (fund_id, d) not in (select fund_id, bad_d from entries where bad_d is not null and state <> 'to review')")
def exclusion_allowed(spark, sf):
    nav, entries = _dips(spark, sf)
    return corrections.apply(nav, entries)


@query(f"{ENTRIES_SQL} select origin, state, count(*) as n, count(distinct fund_id) as funds, count(distinct (fund_id, bad_d)) filter (bad_d is not null) as n_bad_days from entries group by all")
def ledger_summary(spark, sf):
    return corrections.summary(_dips(spark, sf)[1])


# ---------------------------------------------------------- profiles and bindings


def _profile_sql(table: str, columns: dict[str, str]) -> str:
    each = " union all ".join(f"select '{c}' as \"column\", {i} as position, cast({e} as varchar) as value from {table}" for i, (c, e) in enumerate(columns.items(), 1))
    return f"c as ({each})"


SCHEME_COLUMNS = {c: c for c in ("amfi_code", "scheme_name", "plan", "option", "isin_growth", "isin_div", "category", "status")}
ORDER_COLUMNS = {"o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority"}
FACTS_SQL = """select "column", cast(position as bigint) as position, count(*) as n, count(*) filter (value is null) as n_null, count(*) filter (trim(value) = '-') as n_dash, count(*) filter (trim(value) = '') as n_blank, count(k) as n_known,
cast(min(length(k)) as bigint) as shortest, cast(max(length(k)) as bigint) as longest, min(k) as low, max(k) as high from (select *, case when trim(value) not in ('-', '') then value end as k from c) group by all"""


@query(f"with {SCHEME_SQL}, {_profile_sql('scheme', SCHEME_COLUMNS)} {FACTS_SQL}")
def preflight_profile(spark, sf):
    return profile.columns(schemes(spark, sf).select(*SCHEME_COLUMNS))


@query(f"with {_profile_sql('orders', ORDER_COLUMNS)} {FACTS_SQL}")
def preflight_profile_prices(spark, sf):
    return profile.columns(read(spark, sf, "orders").select(*ORDER_COLUMNS))


@query(f"""with {SCHEME_SQL}, {_profile_sql('scheme', SCHEME_COLUMNS)}, g as (select "column", value, count(*) as n, sum(count(*)) over (partition by "column") as whole from c group by "column", value)
select "column", value, n, round(n / whole, 6) + 0.0 as share from g where n >= 0.02 * whole""")
def preflight_values(spark, sf):
    return profile.value_mix(schemes(spark, sf).select(*SCHEME_COLUMNS))


@query(f"with {SCHEME_SQL} select isin_growth as isin, count(distinct amfi_code) as codes, string_agg(distinct scheme_name, ' | ' order by scheme_name) as names from scheme where isin_growth <> '-' group by 1 having count(distinct amfi_code) > 1 order by codes desc, isin limit 10")
def preflight_splices(spark, sf):
    return profile.splices(schemes(spark, sf))


@query(f"with {MAP_SQL}, x as (select unnest([struct_pack(field := 'plan', value := case when lower(scheme_name) like '%direct%' then 'DIRECT' else 'REGULAR' end), struct_pack(field := 'option', value := case when regexp_matches(lower(scheme_name), 'idcw|dividend|income distribution') then 'IDCW' else 'GROWTH' end)]) as x from (select case when scheme_code::int % 3 = 0 then concat(scheme_name, ' Direct') when scheme_code::int % 7 = 0 then concat(scheme_name, ' Dividend') else scheme_name end as scheme_name from fund_map)) select x.field as field, x.value as value, count(*) as n from x group by all")
def preflight_inferred(spark, sf):
    name = F.when(F.col("scheme_code").cast("int") % 3 == 0, F.concat("scheme_name", F.lit(" Direct"))).when(F.col("scheme_code").cast("int") % 7 == 0, F.concat("scheme_name", F.lit(" Dividend"))).otherwise(F.col("scheme_name"))
    return profile.inferred(fund_map(spark, sf).withColumn("scheme_name", name))


@query("""select 'nation' as table_name, cast(rn - 1 as bigint) as row, c.k as column_name, c.v as value from (select *, row_number() over (order by n_nationkey) as rn from nation), unnest([struct_pack(k := 'n_nationkey', v := n_nationkey::varchar), struct_pack(k := 'n_name', v := n_name), struct_pack(k := 'n_regionkey', v := n_regionkey::varchar)]) as t(c) where rn <= 3
union all select 'region', cast(rn - 1 as bigint), c.k, c.v from (select *, row_number() over (order by r_regionkey) as rn from region), unnest([struct_pack(k := 'r_regionkey', v := r_regionkey::varchar), struct_pack(k := 'r_name', v := r_name)]) as t(c) where rn <= 3""")
def catalog_samples(spark, sf):
    return catalog.samples({"nation": read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), "region": read(spark, sf, "region").select("r_regionkey", "r_name")})


def two_stores(spark, sf) -> dict[str, dict[str, DataFrame]]:
    """The same funds in two stores that share no name of a table or a column; in the first only names tell plan and option."""
    s, n = read(spark, sf, "supplier"), nav_of(spark, sf)
    direct, payout = F.col("s_suppkey") % 4 == 0, F.col("s_suppkey") % 5 == 0
    name = F.concat("s_name", F.when(direct, " - Direct Plan").otherwise(""), F.when(payout, " - IDCW").otherwise(""))
    code = F.col("s_suppkey").cast("string")
    one = {
        "navs": n.select(F.col("fund_id").alias("code"), F.col("d").alias("nav_date"), F.col("nav").alias("nav_value")),
        "funds": s.select(code.alias("code"), name.alias("scheme"), F.lit(None).cast("string").alias("isin"), F.concat(F.lit("Group "), F.col("s_nationkey") % 5).alias("scheme_category")),
    }
    two = {
        "history": n.select(F.col("d").alias("Asof_Date"), F.col("fund_id").alias("SCHEME_CD"), F.col("nav").alias("net_asset_value")),
        "register": s.select(F.col("s_suppkey").alias("scheme_code"), F.col("s_name").alias("name"), F.lit("-").alias("isin_payout"), F.concat(F.lit("group "), F.col("s_nationkey") % 5).alias("cat"), F.when(direct, "Direct Plan").otherwise("Regular Plan").alias("plan_type"), F.when(payout, "IDCW").otherwise("Growth").alias("option_type"), F.lit("ACTIVE").alias("status")),
    }
    return {"one": one, "two": two}


@query(f"{PANEL_SQL}, kept as (select panel.* from panel join supplier on fund_id = cast(s_suppkey as varchar) where s_suppkey % 4 <> 0 and s_suppkey % 5 <> 0 and s_nationkey % 5 in (1, 3)), pl as (select cast(horizon_y as bigint) as horizon_y, count(*) as n, count(distinct fund_id) as funds, cast(sum(survived::int) as bigint) as n_survived, round(median(window_return), 6) + 0.0 as med_return from kept group by 1) select store, pl.* from pl, (values ('one'), ('two')) v(store)")
def panel_by_roles(spark, sf):
    out = None
    for name, tables in two_stores(spark, sf).items():
        rows = panel.store_panel(tables, windows_of(spark), "REGULAR", ["GROUP 1", "group 3"])
        kept = panel.panel_summary(rows).select(F.lit(name).alias("store"), "horizon_y", "n", "funds", "n_survived", "med_return")
        out = kept if out is None else out.unionByName(kept)
    return out


# ------------------------------------------------------------------ name searches

ASKED = [" INF000000007 ", "INF999999999", "midcap", "customer#000000012", "interval plan", "nothing like it", "#"]
ASKED_SQL = "q as (select unnest([' INF000000007 ', 'INF999999999', 'midcap', 'customer#000000012', 'interval plan', 'nothing like it', '#']) as query)"
ISIN_MAP_SQL = MAP_SQL.replace("cast(c_custkey % 100 + 1 as string) as fund_id", "concat('INF', lpad(cast(c_custkey % 100 + 1 as varchar), 9, '0')) as fund_id")


@query(f"""with {ISIN_MAP_SQL}, {ASKED_SQL}, f as (select distinct fund_id, scheme_name, category from fund_map), m as (select query, f.* from q join f on case when length(trim(query)) = 12 and upper(trim(query)) like 'INF%' then trim(query) = fund_id else contains(lower(scheme_name), lower(trim(query))) end),
g as (select query, count(m.fund_id) as n, min(fund_id) as fund_id, min(scheme_name) as scheme_name, min(category) as category from q left join m using (query) group by 1)
select query, case when n = 1 then fund_id end as fund_id, case when n = 1 then scheme_name end as scheme_name, case when n = 1 then category end as category, n as n_matches, case when n = 0 then 'no match' when n > 1 then n || ' matches' end as reason from g""")
def identifier_batch(spark, sf):
    funds = fund_map(spark, sf).withColumn("fund_id", F.concat(F.lit("INF"), F.lpad("fund_id", 9, "0")))
    return names.resolve(spark.createDataFrame([(x,) for x in ASKED], "query string"), funds)


@query(f"""with {MAP_SQL}, q as (select distinct concat(c_mktsegment, ' ', c_custkey % 50) as query, lpad(cast(c_custkey % 50 as varchar), 2, '0') as part from customer), n as (select distinct scheme_name as name from fund_map)
select part as query, count(*) as n, min(name) as first_name from (select distinct part from q) join n on contains(name, part) group by 1""")
def name_parts(spark, sf):
    """A list of queries that grows with the table: which names hold two digits."""
    asked = read(spark, sf, "customer").select(F.lpad((F.col("c_custkey") % 50).cast("string"), 2, "0").alias("query"))
    found = names.holding(fund_map(spark, sf).select(F.col("scheme_name").alias("name")), asked)
    return found.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first_name"))


@query(f"with {MAP_SQL}, q as (select unnest(['cap', 'MID cap', 'large & cap', 'interval plan', 'days', 'semi']) as query), w as (select query, string_split(lower(query), ' ') as ws from q), n as (select distinct scheme_name as name from fund_map) select query, name from w join n on len(list_filter(ws, lambda x: not regexp_matches(lower(name), '\\b' || replace(x, '&', '\\&') || '\\b'))) = 0")
def name_words(spark, sf):
    asked = spark.createDataFrame([(x,) for x in ("cap", "MID cap", "large & cap", "interval plan", "days", "semi")], "query string")
    return names.with_words(fund_map(spark, sf).select(F.col("scheme_name").alias("name")), asked)


@query(f"""with {SCHEME_SQL}, li as (select s_suppkey as amfi_code, concat('nation ', s_nationkey) as category from supplier where s_nationkey % 2 = 0), cu(amfi_code, place, pattern) as (values (6, 0, '%nothing%'), (6, 1, '%#%8'), (1, 0, '%'), (18, 0, '%#%_7')),
a as (select s.* replace (coalesce(s.category, li.category) as category), s.category as was, li.category as listed from scheme s left join li using (amfi_code)),
h as (select cast(cu.amfi_code as bigint) as amfi_code, d.category from cu join a s on s.amfi_code = cu.amfi_code and s.category is null join a d on d.category is not null and d.scheme_name ilike cu.pattern qualify row_number() over (partition by cu.amfi_code order by place, d.amfi_code) = 1),
b as (select a.* replace (coalesce(a.category, h.category) as category), h.category as by_hand from a left join h using (amfi_code)),
c as (select *, coalesce(category, case when isin_growth <> '-' then max(category) over (partition by isin_growth) end) as final from b)
select amfi_code, final as category, case when listed is not null then 'list' when by_hand is not null then 'curated' else 'sibling' end as origin from c where was is null and final is not null""")
def category_chain(spark, sf):
    listing = read(spark, sf, "supplier").where("s_nationkey % 2 = 0").select(F.col("s_suppkey").alias("amfi_code"), F.concat(F.lit("nation "), "s_nationkey").alias("category"))
    curated = spark.createDataFrame([(6, ["%nothing%", "%#%8"]), (1, ["%"]), (18, ["%#%_7"])], "amfi_code long, candidates array<string>")
    return store.category_chain(schemes(spark, sf), listing, curated)


# --------------------------------------------------------------------- diagnoses


@query(f"with {NAV_SQL} select fund_id, d, {ROUND('lr')} from (select fund_id, d, ln(nav / lag(nav) over (partition by fund_id order by d)) as lr from nav) where lr is not null order by abs(lr) desc, fund_id, d limit 15")
def worst_jump_days(spark, sf):
    from ..functions.series import splice_jumps

    return diagnostics.worst_days(splice_jumps(nav_of(spark, sf), 0.0), 15)


@query(SQL["jump_handoff_bucket"].rpartition("select case")[0] + " select fund_id, d, round(lr, 6) + 0.0 as lr, cast(gap as bigint) as gap, case when gap is null then 'single code' when gap <= 7 then 'near handoff' else 'mid series' end as bucket from g order by abs(lr) desc, fund_id, d limit 10")
def worst_handoffs(spark, sf):
    from ..functions.series import splice_jumps

    n = read(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("scheme_code"), F.col("l_shipdate").cast("date").alias("d"), F.col("l_extendedprice").alias("nav"))
    m = read(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("scheme_code"), F.col("s_nationkey").cast("string").alias("fund_id"))
    return diagnostics.worst_handoffs(diagnostics.handoff_gaps(splice_jumps(identity.spliced_nav(n, m), 2.0), n, m))


@query(f"with {SCHEME_SQL}, {ORDERS_SQL} select (select count(*) filter (nav <= 0) from o) as n_not_positive, (select count(*) filter (nav_date > date '{SINCE}') from o) as n_future, (select count(*) from (select distinct l_suppkey as amfi_code, l_shipdate from lineitem) where amfi_code not in (select amfi_code from scheme where amfi_code % 3 <> 0)) as n_orphans, (select count(*) from (select isin_growth from scheme where amfi_code % 3 <> 0 and isin_growth <> '-' group by 1 having count(distinct case when plan <> 'UNKNOWN' then plan end) > 1)) as n_conflicting_isins, (select count(*) from (select isin_growth from scheme where amfi_code % 3 <> 0 and isin_growth <> '-' group by 1 having count(distinct amfi_code) > 1)) as n_shared_isins")
def store_integrity(spark, sf):
    snapshot = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("amfi_code"), "l_shipdate").distinct()
    return diagnostics.integrity(order_prices(spark, sf), snapshot, schemes(spark, sf).where("amfi_code % 3 <> 0"), SINCE)


@query(f"with {SCHEME_SQL}, {BOUND_SQL}, x as (select *, case when last_nav_date < date '{ASOF}' - 30 then 'STALE' else status end as st from bounded), u as (select unnest([struct_pack(f := 'status', v := st), struct_pack(f := 'plan', v := plan), struct_pack(f := 'category', v := category)]) as u from x) select u.f as field, u.v as value, count(*) as n from u group by all")
def status_mix(spark, sf):
    return diagnostics.mix(store.mark_stale(store.bounds(schemes(spark, sf), order_prices(spark, sf)), ASOF), "status", "plan", "category")


@query("select o_orderpriority as source, count(*) as runs, count(*) filter (o_orderstatus = 'F') as n_failed, cast(sum(o_custkey) as bigint) as n_rows, cast(sum(o_orderkey % 7) as bigint) as n_added, max(cast(o_orderdate as date)) as last_at from orders group by 1")
def log_summary(spark, sf):
    log = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("source"), (F.col("o_orderstatus") != "F").alias("ok"), F.col("o_custkey").alias("n_rows"), (F.col("o_orderkey") % 7).alias("n_added"), F.col("o_orderdate").cast("date").alias("at"))
    return diagnostics.log_summary(log)


@query(f"with {SCHEME_SQL}, {BOUND_SQL} select scheme_name, amfi_code, last_nav_date, coalesce(isin_growth <> '-' and isin_growth in (select isin_growth from scheme where category is not null and isin_growth <> '-'), false) as has_sibling from bounded where category is null and last_nav_date >= date '{SINCE}' and lower(scheme_name) like '%7%'")
def uncategorised_list(spark, sf):
    return diagnostics.uncategorised(store.bounds(schemes(spark, sf), order_prices(spark, sf)), SINCE, "7")


@query(f"with {MAP_SQL}, x as (select case when scheme_code::int % 3 = 0 then 'DIRECT' else 'REGULAR' end as plan, * from fund_map) select plan, category, count(*) as n_codes, count(distinct fund_id) as n_funds from x group by all")
def codes_by_plan(spark, sf):
    plan = F.when(F.col("scheme_code").cast("int") % 3 == 0, "DIRECT").otherwise("REGULAR")
    return audit.codes_by_plan(fund_map(spark, sf).withColumn("plan", plan))

