import datetime as dt

import pytest
from pyspark.sql import functions as F

from navengine.functions.series import horizon_days
from navengine.operators import asof, audit, identity, jumps, store, trailing
from navengine.operators import reports as tables
from navengine.sources import catalog, reports

DAY = dt.date(2020, 1, 1)


def nav(spark, rows):
    return spark.createDataFrame([(f, DAY + dt.timedelta(d), float(v)) for f, d, v in rows], "fund_id string, d date, nav double")


def test_horizon_days():
    assert [horizon_days(y) for y in (1, 3, 5, 10)] == [365, 1096, 1826, 3652]


def test_nearest_prefers_the_later_of_two(spark):
    n = nav(spark, [("a", 0, 1), ("a", 10, 2)])
    p = spark.createDataFrame([("a", DAY + dt.timedelta(5))], "fund_id string, t date")
    assert asof.nearest_within(p, n, "t", 45).first()["anchor_nav"] == 2.0


def test_bounded_anchor_stops_at_fifteen_days(spark):
    n = nav(spark, [("a", 0, 1)])
    p = spark.createDataFrame([("a", DAY + dt.timedelta(15)), ("a", DAY + dt.timedelta(16))], "fund_id string, t date")
    got = {r["t"].day: r["anchor_nav"] for r in asof.asof_bounded(p, n, "t", 15).collect()}
    assert got == {16: 1.0, 17: None}


def test_jump_labels_and_correction(spark):
    step = [("s", i, 10 if i < 30 else 1000) for i in range(80)]
    spike = [("r", i, 10 if i != 30 else 40) for i in range(80)]
    late = [("l", i, 10 if i < 30 else 30) for i in range(40)]
    n = nav(spark, step + spike + late)
    j = jumps.classify_jumps(n)
    got = {(r["fund_id"], (r["d"] - DAY).days): (r["label"], r["rebase_shape"]) for r in j.collect()}
    assert got["s", 30] == ("REBASE", "round") and got["r", 30][0] == "REVERT" and got["l", 30][0] == "INSUFFICIENT_FORWARD_DATA"
    fixed = jumps.correct_rebases(n, jumps.rebase_events(j))
    assert fixed.count() == n.count()
    assert abs(fixed.where("fund_id = 's'").agg({"nav": "max"}).first()[0] - 10) < 1e-9


def test_merge_keeps_what_is_known(spark):
    kind = "amfi_code int, scheme_name string, plan string, option string, category string"
    old = spark.createDataFrame([(1, "a", "DIRECT", "GROWTH", "x")], kind)
    new = spark.createDataFrame([(1, "b", "UNKNOWN", "IDCW", None), (2, "c", "UNKNOWN", None, None)], kind)
    got = {r["amfi_code"]: tuple(r)[1:] for r in store.upsert_schemes(old, new).collect()}
    assert got == {1: ("b", "DIRECT", "IDCW", "x"), 2: ("c", "UNKNOWN", None, None)}


def test_last_position_of_a_batch_wins(spark):
    old = spark.createDataFrame([(1, DAY, 1.0)], "amfi_code int, nav_date date, nav double")
    new = spark.createDataFrame([(1, DAY, 2.0, 0), (1, DAY, 3.0, 1)], "amfi_code int, nav_date date, nav double, pos long")
    assert store.upsert_nav(old, new).first()["nav"] == 3.0


def test_reports(spark):
    lines = ["Head", "1;A Direct Growth;;;INF1;-;10.5;01-Jan-2020", "2;B;Direct;IDCW;;;N.A.;01-Jan-2020", "3;C;Direct;Payout;-;;7;02-01-2020", "x;y"]
    rows = reports.history_report(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["amfi_code"], r["plan"], r["option"], r["isin_growth"], r["nav"]) for r in rows] == [(1, "DIRECT", "GROWTH", "INF1", 10.5), (3, "DIRECT", "IDCW", None, 7.0)]
    listing = ["Open(Equity)", "House", "1;a", "Open(Debt)", "2;b"]
    got = reports.current_list(spark.createDataFrame([("f", i, x) for i, x in enumerate(listing)], "file string, pos int, value string")).collect()
    assert {r["amfi_code"]: r["category"] for r in got} == {1: "Equity", 2: "Debt"}


def test_category_spellings(spark):
    c = spark.createDataFrame([("Large Cap Fund",), ("Large Cap",), ("Other Schemes",), ("Other Scheme",)], "category string")
    got = {r["raw_category"]: r["canonical_category"] for r in identity.category_map(c).collect()}
    assert got == {"Large Cap Fund": "Large Cap", "Large Cap": "Large Cap", "Other Schemes": "Other Scheme", "Other Scheme": "Other Scheme"}


def test_payload_without_code_raises(spark):
    with pytest.raises(Exception, match="scheme_code"):
        reports.json_payloads(spark.createDataFrame([('{"meta":{},"data":[{"date":"01-01-2020","nav":"1"}]}',)], "value string")).collect()


def test_portfolio_needs_twenty_common_days(spark):
    rows = [(f, i, 10 + i % 3 + k) for k, f in enumerate("ab") for i in range(20)]
    weights = {"a": 0.5, "b": 0.5}
    few = trailing.common_returns(nav(spark, rows), ["a", "b"])
    assert trailing.portfolio_summary(few, weights).collect() == []
    assert abs(sum(r["contribution"] for r in trailing.risk_contribution(few, weights).collect()) - 1) < 1e-9


def test_snapshot_labels(spark):
    live, dead, young = [("l", i, 10) for i in range(400)], [("d", i, 10) for i in range(100)], [("y", i, 10) for i in range(350, 400)]
    funds = spark.createDataFrame([(f, "c") for f in ("l", "d", "y", "n")], "fund_id string, category string")
    got = trailing.snapshot(nav(spark, live + dead + young), funds, str(DAY + dt.timedelta(399)), (1,)).collect()
    assert {r["fund_id"]: r["label"] for r in got} == {"l": None, "d": "Died", "y": "Too new", "n": "Died"}
    assert next(r for r in got if r["fund_id"] == "l")["n_peers"] == 1


def test_p_values_of_known_quantiles():
    from navengine.functions.pvalues import chi_square_tail, student_tail

    for x, dof in ((3.841459, 1), (5.991465, 2), (16.918978, 9), (18.307038, 10)):
        assert abs(chi_square_tail(x, dof) - 0.05) < 1e-6
    for t, dof in ((12.706205, 1), (4.302653, 2), (3.182446, 3), (2.228139, 10), (2.200985, 11), (1.959964, 10**6)):
        assert abs(student_tail(t, dof) - 0.05) < 1e-6
    assert chi_square_tail(0.0, 0) == 1.0 and student_tail(0.0, 7) == 1.0


def test_weights_sum_to_one():
    import pytest

    from navengine.operators.reports import normalised_weights

    assert normalised_weights(["a", "b"]) == {"a": 0.5, "b": 0.5}
    assert normalised_weights(["a", "b"], [75, 25]) == {"a": 0.75, "b": 0.25}
    for bad in ([1.0], [-1.0, 2.0], [0.0, 0.0]):
        with pytest.raises(ValueError):
            normalised_weights(["a", "b"], bad)


@pytest.mark.parametrize("name,closed", [("A FMP Series 3", True), ("B (370Days)", True), ("C ( 370 days )", True), ("D (90 day)", True), ("E Closeend", True), ("F semiclosed end", True), ("G close-ended", True), ("H Quarterly Interval Plan", True), ("Intervals", False), ("I (5 days)", False), ("J open ended", False), (None, False)])
def test_closed_end_names(spark, name, closed):
    from navengine.functions.classify import is_closed_end

    assert spark.createDataFrame([(name,)], "n string").select(is_closed_end(F.col("n"))).first()[0] is closed


def test_jump_labels_without_a_level(spark):
    rows = [("a", d, v) for d, v in enumerate([100.0] * 10 + [1000.0] * 4)] + [("b", 0, 0.0), ("b", 1, 5.0), ("b", 2, 50.0), ("c", 0, 1.0)]
    got = {(r["fund_id"], r["label"]): r for r in jumps.classify_jumps(nav(spark, [r for r in rows if r[2]])).collect()}
    r = got["a", "INSUFFICIENT_FORWARD_DATA"]
    assert r["ratio_immediate"] == 10 and r["ratio_settled"] is None and r["n_settled_obs"] == 0 and r["rebase_shape"] == "round"


def test_repeated_keys_in_a_batch_of_schemes(spark):
    kind = "amfi_code int, scheme_name string, plan string, category string"
    current = spark.createDataFrame([(1, "old", "DIRECT", None), (2, "kept", "UNKNOWN", "Debt")], kind)
    batch = spark.createDataFrame([(1, "new", "REGULAR", "Equity", 2), (1, "first", "UNKNOWN", None, 1), (1, "last", "UNKNOWN", None, 3), (3, "added", "UNKNOWN", None, 1)], kind + ", pos int")
    got = sorted(map(tuple, store.upsert_schemes(current, batch).select("amfi_code", "scheme_name", "plan", "category").collect()))
    assert got == [(1, "last", "REGULAR", "Equity"), (2, "kept", "UNKNOWN", "Debt"), (3, "added", "UNKNOWN", None)]


def test_ingest_keeps_history_and_replays(spark, tmp_path):
    from navengine.streaming.ingest import ingest, read_store

    landing, base = tmp_path / "in", str(tmp_path / "store")
    landing.mkdir()
    line = "{};Fund;;;;;{};{}-Jan-2020\n"
    (landing / "a.txt").write_text("House\n" + line.format(1, 10, "01") + line.format(1, 11, "02") + line.format(1, 12, "02"))
    ingest(spark, str(landing), base, str(tmp_path / "c1"))
    got = lambda: sorted((r["amfi_code"], r["nav_date"].day, r["nav"]) for r in read_store(spark, base).collect())
    assert got() == [(1, 1, 10.0), (1, 2, 12.0)]
    (landing / "b.txt").write_text(line.format(2, 20, "01") + line.format(1, 13, "01"))
    ingest(spark, str(landing), base, str(tmp_path / "c1"))
    assert got() == [(1, 1, 13.0), (1, 2, 12.0), (2, 1, 20.0)]
    ingest(spark, str(landing), base, str(tmp_path / "c2"))  # a new checkpoint reads all files again
    assert got() == [(1, 1, 13.0), (1, 2, 12.0), (2, 1, 20.0)]


def test_plain_files(spark, tmp_path):
    from navengine.operators.selection import with_columns
    from navengine.sources import tables

    rows = spark.createDataFrame([(1, "a, b", None), (2, "c", 0.5)], "k int, name string, x double")
    tables.write_csv(rows, f"{tmp_path}/csv")
    back = tables.read_csv(spark, f"{tmp_path}/csv", "k int, name string, x double")
    assert sorted(map(tuple, back.collect())) == [(1, "a, b", None), (2, "c", 0.5)]
    (tmp_path / "list.txt").write_text("# funds\nINF090I01239\n\n  hdfc flexi cap \n")
    assert [r["query"] for r in tables.line_list(spark, f"{tmp_path}/list.txt").collect()] == ["INF090I01239", "hdfc flexi cap"]
    for _ in range(2):
        tables.append_log(rows, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 4
    assert with_columns(rows, "k int, y date").dtypes[-1] == ("y", "date")


def test_joins_within_a_tolerance_by_brute_force(spark):
    import random

    rng = random.Random(4)
    prices = sorted({(rng.choice("ab"), rng.randrange(-400, 400)) for _ in range(250)})
    probes = [(rng.choice("abc"), rng.randrange(-450, 450)) for _ in range(120)]
    n = nav(spark, [(f, d, i) for i, (f, d) in enumerate(prices)])
    p = spark.createDataFrame([(f, DAY + dt.timedelta(d)) for f, d in set(probes)], "fund_id string, t date")
    days = lambda x: x and (x - DAY).days
    near = {(r["fund_id"], days(r["t"])): days(r["anchor_d"]) for r in asof.nearest_within(p, n, "t", 7).collect()}
    back = {(r["fund_id"], days(r["t"])): days(r["anchor_d"]) for r in asof.asof_bounded(p, n, "t", 7).collect()}
    for f, t in set(probes):
        own = [d for g, d in prices if g == f]
        assert near.get((f, t)) == max((d for d in own if abs(d - t) <= 7), key=lambda d: (-abs(d - t), d), default=None)
        assert back[f, t] == max((d for d in own if t - 7 <= d <= t), default=None)


def test_two_by_two_is_corrected(spark):
    t = spark.createDataFrame([(1, 1, 1, 10), (1, 1, 2, 20), (1, 2, 1, 30), (1, 2, 2, 40)], "horizon_y int, fq int, hq int, n int")
    got = tables.transition_test(t).first()
    assert got["dof"] == 1 and abs(got["chi2"] - 100 * 150**2 / (30 * 70 * 40 * 60)) < 1e-9


def test_roles_and_second_store(spark, tmp_path):
    prices = nav(spark, [("a", 0, 1), ("a", 1, 2)]).withColumnsRenamed({"fund_id": "Scheme_Code", "d": "NAV_DATE"})
    names = spark.createDataFrame([("a", "x")], "scheme_code string, scheme_name string")
    assert catalog.role_columns(prices.columns)["code"] == "Scheme_Code" and catalog.role_columns(prices.columns)["plan"] is None
    assert catalog.role_tables({"p": prices, "few": prices.limit(1), "s": names}) == ("p", "s")
    assert catalog.role_tables({"p": prices}) == ("p", "p")
    with pytest.raises(ValueError):
        catalog.role_tables({"s": names})
    names.write.parquet(f"{tmp_path}/s.parquet")
    catalog.attach(spark, str(tmp_path), ["s"])
    assert prices.join(spark.table("src_s"), "scheme_code").count() == 2


def test_rows_around_meet_once(spark):
    n = nav(spark, [("a", i, 1) for i in range(60)])
    j = nav(spark, [("a", 20, 1), ("a", 25, 1)])
    got = audit.rows_around(n, j).collect()
    assert len(got) == len(set(got)) == 42


def test_dead_funds_have_a_year_and_no_return(spark):
    n = nav(spark, [("x", 0, 1), ("x", 330, 2), ("y", 0, 1), ("y", 360, 2)])
    got = {r["fund_id"]: r for r in audit.fund_windows(n, "2020-12-31", (1,)).collect()}
    assert got["x"]["death_year"] == 2020 and got["x"]["cagr"] is None and got["y"]["death_year"] is None and got["y"]["window_return"] == 1.0
