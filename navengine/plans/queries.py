"""The queries over the driver's tables, with DuckDB SQL for the same rows.

Prices are lineitem by supplier and day: fund_id, d, nav = the day's highest extended price.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, series
from ..operators import asof, identity, jumps, panel, store, trailing

ASOF, JUMP = "2000-06-30", 4.0
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

NAV_SQL = "nav as (select cast(l_suppkey as varchar) as fund_id, cast(l_shipdate as date) as d, max(l_extendedprice) as nav from lineitem group by all)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nav_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("fund_id"), F.col("l_shipdate").cast("date").alias("d"), F.col("l_extendedprice").alias("nav"))
    return rows.groupBy("fund_id", "d").agg(F.max("nav").alias("nav"))


def windows_of(spark: SparkSession) -> DataFrame:
    return panel.fiscal_windows(spark, 1995, 2001)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, counts as long integers."""
    kinds = {"double": lambda c: F.round(c, 6) + 0.0, "int": lambda c: F.col(c).cast("long")}
    return df.select(*(kinds[t](c).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


LR_SQL = f"with {NAV_SQL}, r as (select *, ln(nav / lag(nav) over w) as lr, max(nav) over (partition by fund_id order by d rows unbounded preceding) as top from nav window w as (partition by fund_id order by d))"


@query(f"{LR_SQL} select fund_id, d, round(lr, 6) + 0.0 as lr from r")
def log_returns(spark, sf):
    return nav_of(spark, sf).select("fund_id", "d", series.log_return().alias("lr"))


@query(f"{LR_SQL} select fund_id, round(max(1 - nav / top), 6) + 0.0 as max_drawdown, round(stddev_samp(lr) * sqrt(252), 6) + 0.0 as ann_vol from r group by fund_id")
def drawdown_and_vol(spark, sf):
    n = nav_of(spark, sf).withColumns({"lr": series.log_return(), "top": series.running_max()})
    return n.groupBy("fund_id").agg(F.max(1 - F.col("nav") / F.col("top")).alias("max_drawdown"), series.annual_vol(F.col("lr")).alias("ann_vol"))


@query(f"{LR_SQL} select fund_id, d, round(nav, 6) + 0.0 as nav, round(lr, 6) + 0.0 as lr from r where abs(lr) > {JUMP}")
def splice_jumps(spark, sf):
    return series.splice_jumps(nav_of(spark, sf), JUMP)


@query(f"with {NAV_SQL} select fund_id, d, round(nav / first_value(nav) over (partition by fund_id order by d) * 100, 6) + 0.0 as rebased from nav")
def rebase_to_100(spark, sf):
    return series.rebase_to_100(nav_of(spark, sf)).select("fund_id", "d", "rebased")


@query(f"with {NAV_SQL} select fund_id, max(d) as last_d, round(arg_max(nav, d), 6) + 0.0 as last_nav from nav where d <= date '{ASOF}' group by fund_id")
def asof_last_nav(spark, sf):
    return asof.last_at_or_before(nav_of(spark, sf), ASOF)


PROBE_SQL = "p as (select f.fund_id, make_date(y, 4, 1) as probe from (select distinct fund_id from nav) f, (select unnest(range(1995, 2002)) as y))"


def _probes(spark, sf):
    years = spark.range(1995, 2002).select(F.make_date("id", F.lit(4), F.lit(1)).alias("probe"))
    return nav_of(spark, sf).select("fund_id").distinct().join(F.broadcast(years), how="cross")  # seven dates


@query(f"with {NAV_SQL}, {PROBE_SQL} select p.fund_id, p.probe, case when p.probe - n.d <= 15 then n.d end as anchor_d, case when p.probe - n.d <= 15 then round(n.nav, 6) + 0.0 end as anchor_nav from p asof left join nav n on p.fund_id = n.fund_id and p.probe >= n.d")
def asof_backward_anchor(spark, sf):
    return asof.asof_bounded(_probes(spark, sf), nav_of(spark, sf), "probe", 15)


@query(f"with {NAV_SQL}, {PROBE_SQL} select p.fund_id, p.probe, n.d as anchor_d, round(n.nav, 6) + 0.0 as anchor_nav from p join nav n on p.fund_id = n.fund_id and abs(n.d - p.probe) <= 45 qualify row_number() over (partition by p.fund_id, p.probe order by abs(n.d - p.probe), n.d desc) = 1")
def nearest_anchor(spark, sf):
    return asof.nearest_within(_probes(spark, sf), nav_of(spark, sf), "probe", 45)


PANEL_SQL = f"""with {NAV_SQL},
w as (select h, fy, make_date(fy, 4, 1) as s, make_date(fy + h, 3, 31) as e from (select unnest([1, 3]) as h), (select unnest(range(1995, 2001)) as fy) where fy + h <= 2001),
x as (select fund_id, h, fy, s, e, d, nav, ln(nav / lag(nav) over q) as lr, max(nav) over (partition by fund_id, h, fy order by d rows unbounded preceding) as top
      from nav join w on d > s and d <= e window q as (partition by fund_id, h, fy order by d)),
g as (select fund_id, h, fy, s, e, max(d) as last_date, arg_max(nav, d) as last_nav, count(*) as n, stddev_samp(lr) * sqrt(252) as vol, max(1 - nav / top) as dd, max(abs(lr)) as mx from x group by all),
m as (select *, least(n / median(n) over (partition by h, fy), 1.0) as cov from g),
a as (select m.*, n2.d as ad, n2.nav as an from m asof join nav n2 on m.fund_id = n2.fund_id and m.s >= n2.d),
panel as (select fund_id, h as horizon_y, fy as fy_start, fy % h as phase, s as start_date, e as end_date, ad as anchor_date, an as anchor_nav, s - ad as anchor_gap_days, last_date, last_nav, n as n_obs,
  cov as coverage_frac, last_nav / an - 1 as window_return, case when (last_date - ad) / 365.25 > 0.5 then pow(last_nav / an, 365.25 / (last_date - ad)) - 1 end as cagr, vol as ann_vol, dd as max_drawdown,
  (last_date - ad) / 365.25 as years_eff, last_date >= e - 15 as survived, mx as max_abs_daily_lr from a where s - ad <= 15)"""


def _panel(spark, sf):
    return panel.returns_panel(nav_of(spark, sf), windows_of(spark))


@query(f"{PANEL_SQL} select fund_id, cast(horizon_y as bigint) as horizon_y, cast(fy_start as bigint) as fy_start, cast(phase as bigint) as phase, start_date, end_date, anchor_date, round(anchor_nav, 6) + 0.0 as anchor_nav, cast(anchor_gap_days as bigint) as anchor_gap_days, last_date, round(last_nav, 6) + 0.0 as last_nav, cast(n_obs as bigint) as n_obs, round(coverage_frac, 6) + 0.0 as coverage_frac, round(window_return, 6) + 0.0 as window_return, round(cagr, 6) + 0.0 as cagr, round(ann_vol, 6) + 0.0 as ann_vol, round(max_drawdown, 6) + 0.0 as max_drawdown, round(years_eff, 6) + 0.0 as years_eff, survived, round(max_abs_daily_lr, 6) + 0.0 as max_abs_daily_lr from panel")
def returns_panel(spark, sf):
    return _panel(spark, sf)


@query(f"{PANEL_SQL} select cast(horizon_y as bigint) as horizon_y, count(*) as n, count(distinct fund_id) as funds, cast(sum(survived::int) as bigint) as n_survived, round(median(window_return), 6) + 0.0 as med_return, round(median(ann_vol), 6) + 0.0 as med_vol from panel group by horizon_y")
def panel_summary(spark, sf):
    return panel.panel_summary(_panel(spark, sf))


PAIRS_SQL = f"{PANEL_SQL}, good as (select * from panel where coverage_frac >= 0.9 and survived and window_return is not null), pairs as (select a.fund_id, a.horizon_y, a.phase, a.fy_start as fy, a.window_return as formation, b.window_return as holding from good a join good b on a.fund_id = b.fund_id and a.horizon_y = b.horizon_y and a.phase = b.phase and b.fy_start = a.fy_start + a.horizon_y)"


def _pairs(spark, sf):
    return trailing.persistence_pairs(_panel(spark, sf), "window_return")


@query(f"{PAIRS_SQL} select fund_id, cast(horizon_y as bigint) as horizon_y, cast(phase as bigint) as phase, cast(fy as bigint) as fy, round(formation, 6) + 0.0 as formation, round(holding, 6) + 0.0 as holding from pairs")
def persistence_pairs(spark, sf):
    return _pairs(spark, sf)


@query(f"{PAIRS_SQL}, wm as (select *, median(formation) over q as mf, median(holding) over q as mh from pairs window q as (partition by horizon_y, fy)) select cast(horizon_y as bigint) as horizon_y, cast(fy as bigint) as fy, count(*) as n, cast(sum((holding >= mh)::int) as bigint) as repeats, round(avg((holding >= mh)::int), 6) + 0.0 as rate, round((avg((holding >= mh)::int) - 0.5) / sqrt(0.25 / count(*)), 6) + 0.0 as z from wm where formation >= mf group by horizon_y, fy having count(*) >= 10")
def repeat_winner_z(spark, sf):
    return trailing.repeat_winners(_pairs(spark, sf))


@query(f"{PAIRS_SQL}, r as (select *, rank() over (partition by horizon_y, fy order by formation) + (count(*) over (partition by horizon_y, fy, formation) - 1) / 2 as ra, rank() over (partition by horizon_y, fy order by holding) + (count(*) over (partition by horizon_y, fy, holding) - 1) / 2 as rb from pairs) select cast(horizon_y as bigint) as horizon_y, cast(fy as bigint) as fy, count(*) as n, round(corr(ra, rb), 6) + 0.0 as rho from r group by horizon_y, fy having count(*) >= 10")
def spearman_by_year(spark, sf):
    return trailing.spearman(_pairs(spark, sf))


@query(f"{PAIRS_SQL}, q as (select horizon_y, fy, quantile_cont(formation, [0.25, 0.5, 0.75]) as fe, quantile_cont(holding, [0.25, 0.5, 0.75]) as he from pairs group by all), t as (select p.horizon_y, case when formation <= fe[1] then 1 when formation <= fe[2] then 2 when formation <= fe[3] then 3 else 4 end as fq, case when holding <= he[1] then 1 when holding <= he[2] then 2 when holding <= he[3] then 3 else 4 end as hq from pairs p join q using (horizon_y, fy)) select cast(horizon_y as bigint) as horizon_y, cast(fq as bigint) as fq, cast(hq as bigint) as hq, count(*) as n, round(count(*) / sum(count(*)) over (partition by horizon_y, fq), 6) + 0.0 as share from t group by horizon_y, fq, hq")
def quartile_transition(spark, sf):
    return trailing.transitions(_pairs(spark, sf))


TRAIL_SQL = f"""with {NAV_SQL}, l as (select fund_id, max(d) as last_d, arg_max(nav, d) as last_nav from nav where d <= date '{ASOF}' group by fund_id),
t as (select l.*, n.d as anchor_d, n.nav as anchor_nav from l join nav n on l.fund_id = n.fund_id and abs(n.d - (date '{ASOF}' - 1096)) <= 45
      qualify row_number() over (partition by l.fund_id order by abs(n.d - (date '{ASOF}' - 1096)), n.d desc) = 1),
tr as (select *, date '{ASOF}' - last_d as stale_days, date '{ASOF}' - last_d > 15 as is_dead, last_nav / anchor_nav - 1 as window_return, pow(last_nav / anchor_nav, 365.25 / (last_d - anchor_d)) - 1 as cagr from t)"""


@query(f"{TRAIL_SQL} select fund_id, last_d, round(last_nav, 6) + 0.0 as last_nav, anchor_d, round(anchor_nav, 6) + 0.0 as anchor_nav, cast(stale_days as bigint) as stale_days, is_dead, round(window_return, 6) + 0.0 as window_return, round(cagr, 6) + 0.0 as cagr from tr")
def trailing_window(spark, sf):
    return trailing.trailing(nav_of(spark, sf), ASOF, 3)


def _peers(spark, sf):
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("fund_id"), F.col("s_nationkey").cast("long").alias("category"))
    return trailing.trailing(nav_of(spark, sf), ASOF, 3).join(s, "fund_id")


@query(f"{TRAIL_SQL}, p as (select tr.fund_id, cast(s_nationkey as bigint) as category, cagr, rank() over (partition by s_nationkey order by cagr desc) as rank, count(*) over (partition by s_nationkey) as n_peers from tr join supplier on tr.fund_id = cast(s_suppkey as varchar) where not is_dead) select fund_id, category, round(cagr, 6) + 0.0 as cagr, rank, n_peers, case when n_peers <= 1 then 100.0::double else round(100.0::double * (n_peers - rank) / (n_peers - 1), 1) end as percentile from p")
def peer_rank_percentile(spark, sf):
    return trailing.peer_rank(_peers(spark, sf).where("not is_dead").select("fund_id", "category", "cagr"), "cagr", "category")


@query(f"{TRAIL_SQL} select cast(s_nationkey as bigint) as category, count(*) as n_considered, cast(sum(is_dead::int) as bigint) as n_dead, round(100.0::double * sum(is_dead::int) / count(*), 1) as attrition_pct from tr join supplier on tr.fund_id = cast(s_suppkey as varchar) group by s_nationkey having count(*) >= 2")
def survivorship_report(spark, sf):
    return trailing.survivorship(_peers(spark, sf), "category", 2)


ROLL_SQL = f"""with {NAV_SQL}, s as (select fund_id, d as start_d, nav as start_nav, d + 365 as target from nav qualify (row_number() over (partition by fund_id order by d) - 1) % 5 = 0),
e as (select s.*, n.d as end_d, n.nav as end_nav from s join nav n on s.fund_id = n.fund_id and n.d between s.target - 45 and s.target + 45 qualify row_number() over (partition by s.fund_id, s.start_d order by abs(n.d - s.target), n.d desc) = 1),
r as (select fund_id, start_d, end_d, pow(end_nav / start_nav, 365.25 / (end_d - start_d)) - 1 as cagr from e)"""


@query(f"{ROLL_SQL} select fund_id, start_d, end_d, round(cagr, 6) + 0.0 as cagr from r")
def rolling_returns(spark, sf):
    return trailing.rolling_returns(nav_of(spark, sf), 1)


@query(f"{ROLL_SQL} select fund_id, count(*) as n, round(quantile_cont(cagr, 0.5), 6) + 0.0 as median, round(quantile_cont(cagr, 0.1), 6) + 0.0 as p10, round(quantile_cont(cagr, 0.9), 6) + 0.0 as p90, round(min(cagr), 6) + 0.0 as worst, round(max(cagr), 6) + 0.0 as best, round(100.0::double * sum((cagr < 0)::int) / count(*), 6) + 0.0 as pct_negative from r group by fund_id")
def rolling_summary(spark, sf):
    return trailing.summary(trailing.rolling_returns(nav_of(spark, sf), 1), "cagr", "fund_id")


FUNDS = ["1", "2"]
RETURNS_SQL = f"with {NAV_SQL}, a as (select fund_id, d, nav / lag(nav) over (partition by fund_id order by d) - 1 as r from nav where fund_id in ('1', '2')), c as (select * from a where r is not null qualify count(*) over (partition by d) = 2)"


@query(f"{RETURNS_SQL} select x.fund_id as fund_a, y.fund_id as fund_b, round(corr(ln(1 + x.r), ln(1 + y.r)), 6) + 0.0 as corr, round(covar_samp(ln(1 + x.r), ln(1 + y.r)), 6) + 0.0 as cov from c x join c y using (d) group by all")
def portfolio_pairs(spark, sf):
    return trailing.pair_matrix(trailing.common_returns(nav_of(spark, sf), FUNDS))


@query(f"{RETURNS_SQL}, p as (select d, sum(r * 0.5) as r from c group by d) select d, round(r, 6) + 0.0 as r, round(ln(exp(sum(ln(1 + r)) over (order by d rows unbounded preceding))), 6) + 0.0 as log_nav from p")
def portfolio_path(spark, sf):
    p = trailing.portfolio_path(trailing.common_returns(nav_of(spark, sf), FUNDS), dict.fromkeys(FUNDS, 0.5))
    return p.select("d", "r", F.ln("nav").alias("log_nav"))


@query(f"""with {NAV_SQL}, x as (select *, ln(nav / lag(nav) over w) as lr, row_number() over w as rn from nav window w as (partition by fund_id order by d)),
j as (select * from x where abs(lr) > {JUMP}),
l as (select j.fund_id, j.d, j.nav, j.lr, median(n.nav) filter (n.rn < j.rn) as pre, median(n.nav) filter (n.rn >= j.rn + 15) as post, count(*) filter (n.rn >= j.rn + 15) as k from j join x n on n.fund_id = j.fund_id and n.rn between j.rn - 5 and j.rn + 40 group by all)
select fund_id, d, round(lr, 6) + 0.0 as lr, case when pre <> 0 then round(nav / pre, 6) + 0.0 end as ratio_immediate, case when pre <> 0 and k >= 8 then round(post / pre, 6) + 0.0 end as ratio_settled, case when coalesce(pre, 0) = 0 then 0 else k end as n_settled_obs,
case when coalesce(pre, 0) = 0 then 'NO_BASELINE' when k < 8 then 'INSUFFICIENT_FORWARD_DATA' when abs(post / pre - nav / pre) / greatest(abs(nav / pre), 1e-9) < 0.25 then 'REBASE' when abs(post / pre - 1) < 0.25 then 'REVERT' else 'AMBIGUOUS' end as label, case when pre > 0 then case when abs(nav / pre - pow(10.0, round_even(log10(nav / pre), 0))) / pow(10.0, round_even(log10(nav / pre), 0)) < 0.1 then 'round' else 'not round' end end as rebase_shape from l""")
def jump_classification(spark, sf):
    return jumps.classify_jumps(nav_of(spark, sf), JUMP).drop("nav")


@query(f"with {NAV_SQL}, e as (select fund_id, d, exp(sum(lr) over (partition by fund_id order by d)) as factor from (select *, ln(nav / lag(nav) over (partition by fund_id order by d)) as lr from nav) where abs(lr) > {JUMP}) select n.fund_id, n.d, round(ln(n.nav / coalesce(e.factor, 1)), 6) + 0.0 as log_nav from nav n asof left join e on n.fund_id = e.fund_id and n.d >= e.d")
def correction_asof(spark, sf):
    nav = nav_of(spark, sf)
    events = series.splice_jumps(nav, JUMP).select("fund_id", "d", F.exp(F.sum("lr").over(series.by_date())).alias("factor"))
    return jumps.correct_rebases(nav, events).select("fund_id", "d", F.ln("nav").alias("log_nav"))


@query("""with c as (select cast(l_suppkey as varchar) as scheme_code, cast(l_shipdate as date) as d, l_extendedprice as nav from lineitem),
k as (select scheme_code, count(*) as n from c group by all), m as (select cast(s_suppkey as varchar) as scheme_code, cast(s_nationkey as varchar) as fund_id from supplier)
select fund_id, d, round(nav, 6) + 0.0 as nav from c join k using (scheme_code) join m using (scheme_code) qualify row_number() over (partition by fund_id, d order by n desc, scheme_code, nav desc) = 1""")
def spliced_nav(spark, sf):
    n = read(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("scheme_code"), F.col("l_shipdate").cast("date").alias("d"), F.col("l_extendedprice").alias("nav"))
    m = read(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("scheme_code"), F.col("s_nationkey").cast("string").alias("fund_id"))
    return identity.spliced_nav(n, m)


# The same expression in both dialects.
NAME = "concat('Fund ', c_custkey, case c_custkey % 9 when 0 then ' FMP Series 3' when 1 then ' (370Days)' when 2 then ' Closeend' when 3 then ' ( 90 day )' when 4 then ' Mid Cap' when 5 then ' Midcap' when 6 then ' Close-Ended' else '' end, case c_custkey % 5 when 0 then ' Direct Growth' when 1 then ' Regular IDCW' when 2 then ' Bonus Growth' when 3 then ' Income Distribution cum Capital Withdrawal' else '' end)"
CLOSED_SQL = "regexp_matches({0}, '" + classify.CLOSED_END.replace("{", "{{").replace("}", "}}") + "')"  # the one pattern, in SQL


@query(f"with n as (select {NAME} as name from customer) select name, case when lower(name) like '%direct%' then 'DIRECT' when lower(name) like '%regular%' then 'REGULAR' else 'UNKNOWN' end as plan, case when regexp_matches(lower(name), 'idcw|dividend|payout|reinvest|bonus|income distribution|capital withdrawal') then 'IDCW' when lower(name) like '%growth%' then 'GROWTH' else 'UNKNOWN' end as option, {CLOSED_SQL.format('name')} as closed_end, regexp_matches(lower(name), '\\bcap\\b') as whole_word from n")
def plan_option_classify(spark, sf):
    n = F.col("name")
    return read(spark, sf, "customer").selectExpr(f"{NAME} as name").select("name", classify.plan_of(n).alias("plan"), classify.option_of(n).alias("option"), classify.is_closed_end(n).alias("closed_end"), classify.has_words(n, "cap").alias("whole_word"))


@query(f"with {NAV_SQL} select fund_id, cast(year(d) as bigint) as year, count(*) as n, round(median(gap), 6) + 0.0 as median_gap from (select *, d - lag(d) over (partition by fund_id order by d) as gap from nav) group by fund_id, year(d)")
def cadence_by_year(spark, sf):
    n = nav_of(spark, sf).withColumn("gap", series.gap_days())
    return n.groupBy("fund_id", F.year("d").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.median("gap").alias("median_gap"))


@query("select l_suppkey, cast(l_shipdate as date) as d, count(*) as n from lineitem group by all having count(*) > 1")
def dup_keys(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_suppkey", F.col("l_shipdate").cast("date").alias("d")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where year(o_orderdate) = 1996)")
def orphan_antijoin(spark, sf):
    c, o = read(spark, sf, "customer"), read(spark, sf, "orders").where(F.year("o_orderdate") == 1996)
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("select c_custkey as amfi_code, min(cast(o_orderdate as date)) as first_nav_date, max(cast(o_orderdate as date)) as last_nav_date from customer left join orders on c_custkey = o_custkey group by c_custkey")
def bounds_refresh(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("amfi_code"))
    return store.bounds(c, read(spark, sf, "orders").select(F.col("o_custkey").alias("amfi_code"), F.col("o_orderdate").cast("date").alias("nav_date")))


@query("select c_custkey as amfi_code from customer where c_custkey in (select o_custkey from orders where cast(o_orderdate as date) = date '1997-01-02')")
def universe_as_of(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("amfi_code"))
    return store.universe_as_of(c, read(spark, sf, "orders").select(F.col("o_custkey").alias("amfi_code"), F.col("o_orderdate").cast("date").alias("snap_date")), "1997-01-02")
