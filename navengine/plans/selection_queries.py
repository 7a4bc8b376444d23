"""Queries that choose funds, repair series and pool tests, in the registry of ``queries``.

A fund map is made of customers: two or more codes for each fund, with names of all kinds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify
from ..operators import jumps, selection, trailing
from .queries import ASOF, NAV_SQL, PAIRS_SQL, TRAIL_SQL, _pairs, nav_of, query, read
from .store_queries import BOUND_SQL, SCHEME, SCHEME_SQL

# The same expressions in both dialects.
ENDINGS = [" FMP Series 3", " (370Days) Plan", " Closeend Growth", " Semiclosed End", " ( 90 day )", " Quarterly Interval Plan", " Capital Protection Oriented", " Mid Cap Growth", " Midcap Fund", " Large & Mid Cap", " Infrastructure Debt Fund"]
MAP = {
    "scheme_code": "cast(c_custkey as string)", "fund_id": "cast(c_custkey % 100 + 1 as string)",
    "scheme_name": "concat(c_name, case c_custkey % 11 " + " ".join(f"when {i} then '{e}'" for i, e in enumerate(ENDINGS)) + " end)", "category": "c_mktsegment",
}
MAP_SQL = "fund_map as (select " + ", ".join(f"{e} as {n}" for n, e in MAP.items()) + " from customer)"
NAMES_SQL = f"{MAP_SQL}, names as (select fund_id, scheme_name, category from fund_map qualify row_number() over (partition by fund_id order by scheme_code desc) = 1)"
CLOSED_SQL = f"regexp_matches(scheme_name, '{classify.CLOSED_END}')"


def fund_map(spark, sf):
    return read(spark, sf, "customer").selectExpr(*(f"{e} as {n}" for n, e in MAP.items()))


def scheme(spark, sf):
    return read(spark, sf, "customer").selectExpr(*(f"{e} as {n}" for n, e in SCHEME.items()))


@query(f"with {NAMES_SQL} select fund_id, scheme_name, {CLOSED_SQL} as closed_end from names")
def closed_end_flag(spark, sf):
    return selection.closed_end_funds(fund_map(spark, sf))


@query(f"{TRAIL_SQL}, {NAMES_SQL} select cast(s_nationkey % 5 as bigint) as category, count(*) as n_considered, cast(sum(is_dead::int) as bigint) as n_dead, round(100.0::double * sum(is_dead::int) / count(*), 1) as attrition_pct from tr join supplier on tr.fund_id = cast(s_suppkey as varchar) where fund_id not in (select fund_id from names where {CLOSED_SQL}) group by s_nationkey % 5")
def survivorship_open_ended(spark, sf):
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("fund_id"), (F.col("s_nationkey") % 5).cast("long").alias("category"))
    rows = trailing.trailing(nav_of(spark, sf), ASOF, 3).join(s, "fund_id")
    return trailing.survivorship(selection.open_ended(rows, fund_map(spark, sf)), "category", 1)


@query(f"with {MAP_SQL} select * from fund_map where lower(category) like '%auto%' or lower(category) like '%build%'")
def category_filter(spark, sf):
    return fund_map(spark, sf).where(selection.in_categories(F.col("category"), ["AUTO", " build "]))


@query(f"with {SCHEME_SQL} select amfi_code, plan, option from scheme where plan = 'DIRECT' and option = 'GROWTH' and amfi_code in (select o_custkey from orders where cast(o_orderdate as date) between date '1996-01-01' and date '1996-03-31')")
def universe_of_plan(spark, sf):
    o = selection.between(read(spark, sf, "orders").select(F.col("o_custkey").alias("amfi_code"), F.col("o_orderdate").cast("date").alias("d")), "d", "1996-01-01", "1996-03-31")
    return selection.only(scheme(spark, sf), plan="DIRECT", option="GROWTH", category=None).join(o, "amfi_code", "left_semi").select("amfi_code", "plan", "option")


@query(f"with {MAP_SQL} select fund_id, scheme_name, category from (select * from fund_map where regexp_matches(lower(scheme_name), '\\bcap\\b') and regexp_matches(lower(scheme_name), '\\bmid\\b')) qualify row_number() over (partition by fund_id order by scheme_code desc) = 1")
def fund_search(spark, sf):
    return selection.find_funds(fund_map(spark, sf), "cap MID")


GROUP_SQL = f"""with {SCHEME_SQL}, {BOUND_SQL}, r as (select isin_growth as isin, amfi_code, case when option <> 'UNKNOWN' then option end as known, first_nav_date from bounded where isin_growth is not null),
k as (select isin, known, count(*) as k, min(amfi_code) filter (first_nav_date is null) as none, min((first_nav_date, amfi_code)) filter (first_nav_date is not null) as seen from r where known is not null group by all),
m as (select isin, known as main from k qualify row_number() over (partition by isin order by k desc, seen is null, seen, none) = 1),
g as (select r.isin, amfi_code from r left join m using (isin) where known is null or known = main)"""


def _bounded(spark, sf):
    from ..operators import store

    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("amfi_code"), F.col("o_orderdate").cast("date").alias("nav_date"))
    return store.bounds(scheme(spark, sf), o)


@query(f"{GROUP_SQL} select * from g")
def isin_group(spark, sf):
    return selection.isin_groups(_bounded(spark, sf))


@query(f"{GROUP_SQL} select isin, nav_date, round(nav, 6) + 0.0 as nav, amfi_code from g join o using (amfi_code)")
def isin_spliced(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("amfi_code"), F.col("o_orderdate").cast("date").alias("nav_date"), F.col("o_totalprice").alias("nav"))
    return selection.isin_series(_bounded(spark, sf), o)


@query(f"with {SCHEME_SQL} select amfi_code, isin_growth, coalesce(length(trim(isin_growth)) = 12 and upper(trim(isin_growth)) like 'INF%', false) as is_isin, coalesce(plan || '/' || option, 'unknown') as label from (select * replace (case when amfi_code % 2 = 0 then concat('inf', lpad(cast(amfi_code as varchar), 9, '0')) else isin_growth end as isin_growth) from scheme)")
def isin_shape_and_label(spark, sf):
    isin = F.when(F.col("amfi_code") % 2 == 0, F.concat(F.lit("inf"), F.lpad(F.col("amfi_code").cast("string"), 9, "0"))).otherwise(F.col("isin_growth"))
    s = scheme(spark, sf).withColumn("isin_growth", isin)
    return s.select("amfi_code", "isin_growth", selection.looks_like_isin(F.col("isin_growth")).alias("is_isin"), selection.plan_label(F.col("plan"), F.col("option")).alias("label"))


@query(f"""{TRAIL_SQL}, x as (select n.*, tr.anchor_d, tr.cagr, lag(n.nav) over w as prev, lag(n.d) over w as prev_d, max(n.nav) over (partition by n.fund_id order by n.d rows unbounded preceding) as top
  from nav n join tr on n.fund_id = tr.fund_id and n.d between tr.anchor_d and tr.last_d window w as (partition by n.fund_id order by n.d)),
v as (select fund_id, stddev_samp(case when prev_d > anchor_d then ln(nav / prev) end) * sqrt(252) as vol, min(nav / top - 1) as max_dd, first(cagr) as cagr from x group by fund_id)
select fund_id, round(vol, 6) + 0.0 as ann_vol, round(max_dd, 6) + 0.0 as max_dd, round((cagr - 0.065) / nullif(vol, 0), 6) + 0.0 as sharpe from v""")
def category_risk(spark, sf):
    n = nav_of(spark, sf)
    return trailing.risk(n, trailing.trailing(n, ASOF, 3))


# Smooth series with steps that last, spikes of a day, and steps that settle at a third level.
STEPS_SQL = f"""{NAV_SQL}, p as (select fund_id, d, row_number() over w as rn, count(*) over (partition by fund_id) as n, cast(fund_id as int) as f from nav window w as (partition by fund_id order by d)),
s as (select fund_id, d, 100.0::double * pow(1.0002::double, rn) * case
  when f % 5 = 0 and rn > n // 2 then 100.0 when f % 5 = 1 and rn = n // 2 then 100.0 when f % 5 = 2 and rn > n // 2 then case when rn > n // 2 + 10 then 20.0 else 100.0 end
  when f % 5 = 3 and rn > n - 5 then 10.0 when f % 5 = 4 and rn > n // 3 then case when rn > 2 * (n // 3) then 1000.0 else 10.0 end else 1.0 end as nav from p)"""
LABEL_SQL = f"""with {STEPS_SQL}, x as (select *, ln(nav / lag(nav) over w) as lr, row_number() over w as rn from s window w as (partition by fund_id order by d)),
l as (select j.fund_id, j.d, j.nav, j.lr, median(x.nav) filter (x.rn < j.rn) as pre, median(x.nav) filter (x.rn >= j.rn + 15) as post, count(*) filter (x.rn >= j.rn + 15) as k
  from (select * from x where abs(lr) > 0.35) j join x on x.fund_id = j.fund_id and x.rn between j.rn - 5 and j.rn + 40 group by all),
c as (select *, nav / pre as ri, case when coalesce(pre, 0) = 0 then 'NO_BASELINE' when k < 8 then 'INSUFFICIENT_FORWARD_DATA' when abs(post / pre - nav / pre) / greatest(nav / pre, 1e-9) < 0.25 then 'REBASE'
  when abs(post / pre - 1) < 0.25 then 'REVERT' else 'AMBIGUOUS' end as label, pow(10.0, round_even(log10(nav / pre), 0)) as ten from l)"""


def steps_of(spark, sf):
    from pyspark.sql import Window as W

    by = W.partitionBy("fund_id")
    p = nav_of(spark, sf).select("fund_id", "d", F.row_number().over(by.orderBy("d")).alias("rn"), F.count(F.lit(1)).over(by).alias("n"), (F.col("fund_id").cast("int") % 5).alias("f"))
    half, third = F.floor(F.col("n") / 2), F.floor(F.col("n") / 3)
    level = (
        F.when((F.col("f") == 0) & (F.col("rn") > half), 100.0)
        .when((F.col("f") == 1) & (F.col("rn") == half), 100.0)
        .when((F.col("f") == 2) & (F.col("rn") > half), F.when(F.col("rn") > half + 10, 20.0).otherwise(100.0))
        .when((F.col("f") == 3) & (F.col("rn") > F.col("n") - 5), 10.0)
        .when((F.col("f") == 4) & (F.col("rn") > third), F.when(F.col("rn") > 2 * third, 1000.0).otherwise(10.0))
        .otherwise(1.0)
    )
    return p.select("fund_id", "d", (F.lit(100.0) * F.pow(F.lit(1.0002), F.col("rn")) * level).alias("nav"))


@query(f"{LABEL_SQL} select fund_id, d, label, round(ri, 6) + 0.0 as ratio_immediate, case when abs(ri - ten) / ten < 0.1 then 'round' else 'not round' end as rebase_shape from c")
def round_shape(spark, sf):
    return jumps.classify_jumps(steps_of(spark, sf)).select("fund_id", "d", "label", "ratio_immediate", "rebase_shape")


@query(f"""{LABEL_SQL}, e as (select fund_id, d, exp(sum(lr) over (partition by fund_id order by d)) as factor from c where label = 'REBASE' and abs(ri - ten) / ten < 0.1 and abs(log10(ri)) > 0.5)
select s.fund_id, s.d, round(s.nav / coalesce(e.factor, 1), 6) + 0.0 as nav from s asof left join e on s.fund_id = e.fund_id and s.d >= e.d""")
def rebased_nav(spark, sf):
    n = steps_of(spark, sf)
    return jumps.correct_rebases(n, jumps.rebase_events(jumps.classify_jumps(n)))


@query(f"{LABEL_SQL} select fund_id, d, round(nav, 6) + 0.0 as nav from s where (fund_id, d) not in (select fund_id, d from c where label = 'REVERT')")
def revert_exclusion(spark, sf):
    n = steps_of(spark, sf)
    return jumps.drop_reverts(n, jumps.classify_jumps(n))[0]


@query(f"""with {NAV_SQL}, j as (select *, abs(ln(nav / lag(nav) over (partition by fund_id order by d))) as lr from nav)
select fund_id, round(max(lr), 6) + 0.0 as worst, max(d) filter (lr = m) as d from (select *, max(lr) over (partition by fund_id) as m from j) group by fund_id order by max(lr) desc, fund_id limit 5""")
def worst_jump_funds(spark, sf):
    from ..functions.series import splice_jumps

    return selection.worst_funds(splice_jumps(nav_of(spark, sf), 0.0), 5)


@query(f"""{PAIRS_SQL}, win as (select *, median(formation) over (partition by horizon_y, fy) as mf, median(holding) over (partition by horizon_y, fy) as mh from pairs),
y as (select horizon_y, fy, count(*) as n, sum((holding >= mh)::int) as repeats from win where formation >= mf group by all having count(*) >= 2)
select cast(horizon_y as bigint) as horizon_y, cast(sum(n) as bigint) as n, cast(sum(repeats) as bigint) as repeats, round(sum(repeats) / sum(n), 6) + 0.0 as rate, round((sum(repeats) / sum(n) - 0.5) / sqrt(0.25 / sum(n)), 6) + 0.0 as z from y group by horizon_y""")
def repeat_winner_pooled(spark, sf):
    return selection.pooled_winners(_pairs(spark, sf), 2)


@query(f"{PAIRS_SQL}, r as (select *, rank() over (partition by horizon_y order by formation) + (count(*) over (partition by horizon_y, formation) - 1) / 2 as ra, rank() over (partition by horizon_y order by holding) + (count(*) over (partition by horizon_y, holding) - 1) / 2 as rb from pairs) select cast(horizon_y as bigint) as horizon_y, count(*) as n, round(corr(ra, rb), 6) + 0.0 as rho from r group by horizon_y")
def spearman_pooled(spark, sf):
    return selection.pooled_spearman(_pairs(spark, sf))
