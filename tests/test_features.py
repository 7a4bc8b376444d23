"""Name searches, ledger, profiles, bindings, one-pagers and the category chain against plain versions and hand-written results."""

import datetime as dt
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from navengine.operators import corrections, diagnostics, identity, names, panel, profile, reports, selection, store, trailing
from navengine.sources import catalog

DAY = dt.date(2020, 1, 1)


def nav(spark, rows):
    return spark.createDataFrame([(f, DAY + dt.timedelta(d), float(v)) for f, d, v in rows], "fund_id string, d date, nav double")


NAMES = ["Axis Large Cap Fund", "Axis Largecap", "SBI LARGE & MIDCAP FUND", "a", "", "100% Debt_Fund", "L&T India (G)", "Über Wert Fonds", "cap", "x" * 2000]


def table_of(spark, column, values):
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def test_parts_of_names(spark):
    queries = ["large cap", " Cap ", "a", "&", "%", "_f", "über", "no such", "", "  ", "fund", None, "x" * 300]
    got = {(r["query"], r["name"]) for r in names.holding(table_of(spark, "name", [*NAMES, None, NAMES[0]]), table_of(spark, "query", queries)).collect()}
    assert got == {(q, n) for q in queries if q and q.strip() for n in NAMES if q.strip().lower() in n.lower()}
    assert names.holding(table_of(spark, "name", NAMES), table_of(spark, "query", [])).collect() == []


def test_patterns(spark):
    patterns = ["%large%", "axis%", "%", "_", "100\\% debt\\_fund", "%\\_%", "%cap fund", "", "l_t%(g)", "%largecap%%", "ÜBER%"]
    got = {(r["query"], r["name"]) for r in names.like(table_of(spark, "name", NAMES), table_of(spark, "query", patterns)).collect()}

    def matches(pattern, name):
        out = ""
        i = 0
        while i < len(pattern):
            if pattern[i] == "\\":
                i += 1
                out += re.escape(pattern[i])
            else:
                out += {"%": ".*", "_": "."}.get(pattern[i], re.escape(pattern[i]))
            i += 1
        return re.fullmatch(out, name, re.I | re.S) is not None

    assert got == {(p, n) for p in patterns for n in NAMES if matches(p, n)}
    assert names.escaped("100%_x\\") == "100\\%\\_x\\\\"


def test_whole_words(spark):
    queries = ["cap", "large CAP", "fund axis", "l&t", "midcap sbi", "capfund", ""]
    got = {(r["query"], r["name"]) for r in names.with_words(table_of(spark, "name", NAMES), table_of(spark, "query", queries)).collect()}
    assert got == {(q, n) for q in queries for n in NAMES if all(re.search(rf"\b{re.escape(w)}\b", n.lower()) for w in q.lower().split())}


def test_resolving_keeps_every_line(spark):
    funds = spark.createDataFrame([("INF000000001", "Alpha Cap Fund", "x"), ("INF000000001", "Alpha Cap Fund", "x"), ("INF000000002", "Beta Cap", "y"), ("INF000000002", "Beta Capital", "y")], "fund_id string, scheme_name string, category string")
    got = {r["query"]: (r["fund_id"], r["n_matches"], r["reason"]) for r in names.resolve(table_of(spark, "query", [" INF000000001", "INF000000009", "alpha", "cap", "none", "none", None, "inf000000001"]), funds).collect()}
    assert got == {" INF000000001": ("INF000000001", 1, None), "INF000000009": (None, 0, "no match"), "alpha": ("INF000000001", 1, None), "cap": (None, 3, "3 matches"), "none": (None, 0, "no match"), None: (None, 0, "no match"), "inf000000001": (None, 0, "no match")}


def test_a_hundred_thousand_queries_make_no_nested_loop(spark):
    asked = spark.range(100_000).select(F.concat(F.lit("fund "), "id").alias("query"))
    known = spark.range(2_000).select(F.concat(F.lit("The Fund "), F.col("id") * 50, F.lit(" growth")).alias("name"))
    found = names.holding(known, asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = sum(1 for i in range(2_000) for k in range(1, len(str(i * 50)) + 1) if str(i * 50)[:k] == str(int(str(i * 50)[:k])))
    assert found.count() == want


def jumps_of(spark):
    rows = [("a", 10, "REVERT", "not round", 3.0), ("a", 11, "REBASE", "round", 1.05), ("b", 5, "REBASE", "round", 0.97), ("c", 5, "REBASE", "round", 1.02), ("d", 5, "REBASE", "round", 100.0), ("e", 5, "AMBIGUOUS", "round", 1.0), ("f", 1, "REBASE", "round", None), ("c", 9, "REBASE", "not round", 1.3)]
    return spark.createDataFrame([(f, DAY + dt.timedelta(d), k, s, r) for f, d, k, s, r in rows], "fund_id string, d date, label string, rebase_shape string, ratio_immediate double")


def test_ledger(spark):
    allowed = spark.createDataFrame([("c", DAY + dt.timedelta(4), "bad print"), ("a", DAY + dt.timedelta(3), "not needed"), ("z", DAY, "no jump")], "fund_id string, bad_date date, note string")
    entries = corrections.ledger(jumps_of(spark), allowed)
    got = {(r["fund_id"], (r["d"] - DAY).days, (r["bad_d"] - DAY).days if r["bad_d"] else None, r["origin"], r["state"], r["note"]) for r in entries.collect()}
    assert got == {("a", 10, 10, "revert", "resolved", None), ("a", 11, None, "rebase", "resolved", None), ("b", 5, None, "rebase", "to review", None), ("c", 5, 4, "rebase", "allowed", "bad print")}
    prices = nav(spark, [(f, d, 1 + d) for f in "abcz" for d in range(12)])
    left, gone = corrections.apply(prices, entries), corrections.taken(prices, entries)
    days = lambda df: {(r["fund_id"], (r["d"] - DAY).days) for r in df.collect()}
    assert days(prices) - days(left) == days(gone) == {("a", 10), ("c", 4)}
    assert days(corrections.undo(left, gone)) == days(prices)
    assert days(corrections.undo(left, gone, entries.where("fund_id = 'c'"))) == days(prices) - {("a", 10)}
    assert corrections.undo(prices, gone).count() == prices.count()
    assert [r["fund_id"] for r in corrections.review(entries).collect()] == ["b"]
    assert corrections.ledger(jumps_of(spark).where("false"), allowed).collect() == []


def test_profile_finds_every_frequent_value(spark):
    draw = random.Random(3)
    rows = [(draw.choice(["x", "y", "-", " ", None]) if draw.random() < 0.2 else f"v{draw.randrange(5000)}", i, draw.choice([True, False, None])) for i in range(20_000)]
    df = spark.createDataFrame(rows, "word string, number int, flag boolean").repartition(7)
    got = {(r["column"], r["value"]): r["n"] for r in profile.value_mix(df, share=0.02).collect()}
    words, flags = Counter(r[0] for r in rows), Counter({True: "true", False: "false"}.get(r[2]) for r in rows)
    want = {("word", w): n for w, n in words.items() if n >= 400} | {("flag", f): n for f, n in flags.items() if n >= 400}
    assert got == want and ("word", None) in want
    facts = {r["column"]: r for r in profile.columns(df).collect()}
    assert facts["word"]["n_null"] == words[None] and facts["word"]["n_dash"] == words["-"] and facts["word"]["n_blank"] == words[" "]
    assert facts["word"]["low"] == min(w for w in words if w and w.strip(" -")) and facts["number"]["n_known"] == 20_000
    assert profile.columns(df.where("false")).collect() == [] and profile.value_mix(df.where("false")).collect() == []


def test_columns_are_bound_by_role(spark):
    prices = nav(spark, [("1", 0, 1), ("1", 9, 2), ("2", 0, 3)])
    named = spark.createDataFrame([(1, "One Direct", None), (2, "Two", "Debt")], "scheme_code int, Name string, cat string")
    got, scheme = catalog.bound_store({"p": prices.toDF("CODE", "nav_dt", "net_asset_value"), "m": named})
    assert got.columns == ["scheme_code", "d", "nav"] and scheme.columns == ["amfi_code", "scheme_name", "isin_growth", "isin_div", "category", "status", "amc"]
    mapped = {r["scheme_code"]: (r["plan"], r["option_type"], r["fund_id"]) for r in identity.fund_map(scheme).collect()}
    assert mapped == {"2": ("REGULAR", "GROWTH", "CODE:2")}
    assert identity.fund_map(scheme, "DIRECT").collect() == []  # it has no category
    with_plan = scheme.withColumns({"plan": F.lit("x"), "option": F.lit("growth"), "category": F.lit("a")})
    assert identity.fund_map(with_plan).count() == 2 and identity.fund_map(with_plan, categories=["B"]).collect() == []
    alone = catalog.bound_store({"p": prices.select(F.col("fund_id").alias("code"), F.col("d").alias("date"), "nav", F.lit("n").alias("name"))})
    assert alone[1].count() == 2
    with pytest.raises(ValueError):
        catalog.bound_store({"m": named})


def test_one_pager_has_the_figures_of_risk(spark):
    draw = random.Random(9)
    rows = [(f, d, 100 * (1 + 0.3 * draw.random()) + d / 50) for f in "abcdefg" for d in range(0, 1600 if f not in "fg" else 900, 3)]
    prices, asof = nav(spark, rows), str(DAY + dt.timedelta(1600))
    funds = spark.createDataFrame([(f, "x" if f in "abcf" else "y") for f in "abcdefgh"], "fund_id string, category string")
    got = {(r["fund_id"], r["horizon_y"]): r for r in reports.one_pager(prices, funds, asof).collect()}
    assert len(got) == 32 and got["f", 1]["state"] == "insufficient history" and got["f", 3]["state"] == "died 2022" and got["h", 1]["state"] == got["a", 10]["state"] == "insufficient history"
    for years in (1, 3):
        window = trailing.trailing(prices, asof, years)
        risk = {r["fund_id"]: r for r in trailing.risk(prices, window.where("not is_dead")).collect()}
        values = {r["fund_id"]: r["window_return"] if years == 1 else r["cagr"] for r in window.where("not is_dead").collect()}
        for f in "abcde":
            r, peers = got[f, years], [p for p in ("abc" if f in "abc" else "de")]
            assert r["ann_vol"] == risk[f]["ann_vol"] and r["max_dd"] == risk[f]["max_dd"] <= 0 and r["sharpe"] == risk[f]["sharpe"] and r["value"] == values[f]
            assert r["rank"] == 1 + sum(values[p] > values[f] for p in peers) and r["n_peers"] == len(peers) and abs(r["cat_avg"] - sum(values[p] for p in peers) / len(peers)) < 1e-12
    assert got["a", 3]["notes"] == "1 of 4 peers had died" and got["d", 1]["notes"] == ""
    lines = {(r["fund_id"], r["horizon_y"]): r["line"] for r in reports.lines_of(reports.one_pager(prices, funds, asof)).collect()}
    assert lines["f", 3] == "died 2022" and re.fullmatch(r"[+-]\d+\.\d\d% \| [+-]\d+\.\d\d% \| \+\d+\.\d\d% \| \d/3 \| \d+", lines["a", 1])
    few = reports.one_pager(prices, funds, asof, (1,), ["a"], least_obs=500).collect()
    assert len(few) == 1 and few[0]["notes"].startswith("only ")


def test_labels_and_formats(spark):
    row = spark.createDataFrame([("DIRECT", "GROWTH", 0.1236, None), (None, "GROWTH", None, -0.126)], "p string, o string, x double, r double")
    got = row.select(selection.plan_label(F.col("p"), F.col("o")), reports.as_percent(F.col("x")), reports.as_ratio(F.col("r"))).collect()
    assert [tuple(r) for r in got] == [("DIRECT/GROWTH", "+12.36%", "n/a"), ("unknown", "n/a", "-0.13")]


def test_category_chain_and_inheritance(spark):
    kind = "amfi_code int, scheme_name string, plan string, option string, isin_growth string, category string"
    s = spark.createDataFrame([(1, "Old One", "DIRECT", "GROWTH", "I1", None), (2, "New One", "DIRECT", "GROWTH", "I1", "Debt"), (3, "Dash", "DIRECT", "GROWTH", "-", None), (4, "Dashed", "DIRECT", "GROWTH", "-", "Gold"), (5, "Listed", "REGULAR", "GROWTH", None, None), (6, "By hand", "DIRECT", "IDCW", None, None), (7, "Never", "DIRECT", "GROWTH", None, None)], kind)
    assert {r["amfi_code"]: r["category"] for r in store.inherit_category(s).collect()} == {1: "Debt", 2: "Debt", 3: None, 4: "Gold", 5: None, 6: None, 7: None}
    listing = spark.createDataFrame([(5, "Equity")], "amfi_code int, category string")
    curated = spark.createDataFrame([(6, ["%nobody%", "list%"]), (7, ["zz"]), (2, ["%"])], "amfi_code int, candidates array<string>")
    got = {r["amfi_code"]: (r["category"], r["origin"]) for r in store.category_chain(s, listing, curated).collect()}
    assert got == {1: ("Debt", "sibling"), 5: ("Equity", "list"), 6: ("Equity", "curated")}
    assert {r["amfi_code"] for r in store.category_chain(s, listing, curated, only_direct_growth=True).collect()} == {1}


def test_common_window_needs_living_funds(spark):
    prices = nav(spark, [("a", d, 10 + d) for d in range(50)] + [("b", d, 20 + d) for d in range(10, 30)])
    both = diagnostics.common_range(prices, ["a", "b"]).first()
    assert (both["start_date"] - DAY).days == 10 and (both["end_date"] - DAY).days == 29
    assert diagnostics.common_range(prices, ["a", "b"], str(DAY + dt.timedelta(60))).collect() == []
    got = {(r["fund_id"], (r["d"] - DAY).days): r["rebased"] for r in diagnostics.rebased_together(prices, ["a", "b"]).collect()}
    assert len(got) == 40 and got["a", 10] == got["b", 10] == 100.0 and got["a", 20] == 150.0


def test_rolling_horizons_are_those_of_each(spark):
    draw = random.Random(2)
    prices = nav(spark, [(f, d, draw.uniform(1, 9)) for f in "ab" for d in sorted(draw.sample(range(3000), 400))])
    got = trailing.rolling_all(prices, (1, 3), 7)
    for years in (1, 3):
        one = sorted(map(tuple, trailing.rolling_returns(prices, years, 7).collect()))
        assert one and sorted(map(tuple, got.where(F.col("horizon_y") == years).drop("horizon_y").collect())) == one


def test_orders(spark):
    scheme = spark.createDataFrame([(3, "b", None, "-", DAY), (1, "b", None, "I", DAY), (2, "a", None, "I", DAY), (9, "z", "Debt", "I", DAY)], "amfi_code int, scheme_name string, category string, isin_growth string, last_nav_date date")
    assert [(r["scheme_name"], r["amfi_code"], r["has_sibling"]) for r in diagnostics.uncategorised(scheme, str(DAY)).collect()] == [("a", 2, True), ("b", 1, True), ("b", 3, False)]
    jumps = spark.createDataFrame([("b", DAY, -2.0), ("a", DAY, 2.0), ("a", DAY + dt.timedelta(1), 3.0), ("c", DAY, 0.1)], "fund_id string, d date, lr double")
    assert [(r["fund_id"], r["lr"]) for r in diagnostics.worst_days(jumps, 3).collect()] == [("a", 3.0), ("a", 2.0), ("b", -2.0)]
    assert [r["amfi_code"] for r in reports.category_worklist(scheme.withColumns({"plan": F.lit("DIRECT"), "option": F.lit("GROWTH")}), True, 2).collect()] == [1, 2]


def test_panel_reads_prices_twice(spark, tmp_path):
    nav(spark, [("a", d, 10 + d % 7) for d in range(1200)]).write.parquet(f"{tmp_path}/nav")
    prices = spark.read.parquet(f"{tmp_path}/nav")
    rows = panel.returns_panel(prices, panel.fiscal_windows(spark, 2020, 2023))
    assert {(r["horizon_y"], r["fy_start"]) for r in rows.collect()} == {(1, 2020), (1, 2021), (1, 2022), (3, 2020)}
    final = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FileScan parquet") == 3 and final.count("/nav]") == 1  # statistics twice, prices once more for the anchors
    assert panel.attrition(rows).count() == 3


def test_schemes_go_by_name(spark):
    old = spark.createDataFrame([("2020-01-01", "x", 1, "One"), ("2020-01-01", None, 2, "Two")], "updated_at string, category string, amfi_code int, scheme_name string")
    new = spark.createDataFrame([("Two B", 2, "IN1"), ("Three", 3, None)], "scheme_name string, amfi_code int, isin_div string")
    got = store.upsert_schemes(old, new, now=F.lit("2021-01-01"))
    assert got.columns == ["amfi_code", "scheme_name", "updated_at", "category", "isin_div"]
    assert sorted(map(tuple, got.collect())) == [(1, "One", "2020-01-01", "x", None), (2, "Two B", "2021-01-01", None, "IN1"), (3, "Three", "2021-01-01", None, None)]
