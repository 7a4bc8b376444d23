"""Runs with guards, the walk through windows, scans and ranks: crashes, replays, and plain versions."""

import datetime as dt
import math
import random
from bisect import bisect_left

import pytest
from pyspark.sql import functions as F

from navengine.operators import asof, jumps, ranks, runs, scan, selection, trailing
from navengine.sources import reports
from navengine.sources.windows import WindowReader, following
from navengine.streaming import walk as walks
from navengine.streaming.ingest import walk

DAY = dt.date(2020, 1, 1)


def stages(spark, calls, lose=0, broken=False):
    def make(name, f):
        def go(tables):
            calls.append(name)
            return f(tables)

        return go

    def second(t):
        if broken:
            raise RuntimeError("no such column")
        return t["prices"].where(F.col("id") >= lose)

    return [
        runs.Stage("prices", make("prices", lambda t: spark.range(10))),
        runs.Stage("corrected", make("corrected", second), [runs.same_counts("prices", "id")]),
        runs.Stage("panel", make("panel", lambda t: t["corrected"].selectExpr("id * 2 as id"))),
    ]


def states(df):
    return [(r["stage"], r["state"], r["n_rows"]) for r in df.orderBy("position").collect()]


def test_a_run_is_published_once(spark, tmp_path):
    root, calls = str(tmp_path), []
    want = [("prices", "ok", 10), ("corrected", "ok", 10), ("panel", "ok", 10)]
    assert runs.published(spark, root) == {} and states(runs.run(spark, root, "monday", stages(spark, calls))) == want
    assert sorted(r["id"] for r in runs.published(spark, root)["panel"].collect()) == list(range(0, 20, 2))
    assert states(runs.run(spark, root, "monday", stages(spark, calls))) == want and calls == ["prices", "corrected", "panel"]
    assert runs.commits(spark, root).count() == 1


def test_a_guard_that_speaks_stops_the_run(spark, tmp_path):
    root, calls = str(tmp_path), []
    runs.run(spark, root, "monday", stages(spark, calls))
    got = runs.run(spark, root, "tuesday", stages(spark, calls, lose=3))
    assert states(got) == [("prices", "ok", 10), ("corrected", "needs review", 7), ("panel", "not run", None)]
    assert got.where("stage = 'corrected'").first()["note"] == "rows 10 -> 7, id 10 -> 7"
    assert runs.published(spark, root)["corrected"].count() == 10 and runs.commits(spark, root).count() == 1
    # Mended, it goes on after the stage that was ok.
    calls.clear()
    assert [s for _, s, _ in states(runs.run(spark, root, "tuesday", stages(spark, calls)))] == ["ok"] * 3
    assert calls == ["corrected", "panel"] and runs.commits(spark, root).count() == 2


def test_a_failed_stage_leaves_what_is_published(spark, tmp_path):
    root = str(tmp_path)
    got = runs.run(spark, root, "monday", stages(spark, [], broken=True))
    assert states(got) == [("prices", "ok", 10), ("corrected", "failed", None), ("panel", "not run", None)]
    assert "no such column" in got.where("state = 'failed'").first()["note"] and runs.published(spark, root) == {}


def test_a_crash_between_writing_and_the_swap(spark, tmp_path, monkeypatch):
    root, calls = str(tmp_path), []
    runs.run(spark, root, "monday", stages(spark, calls))
    kept = runs.publish

    def crash(*a):
        raise KeyboardInterrupt

    monkeypatch.setattr(runs, "publish", crash)
    later = stages(spark, calls)
    later[0].make = lambda t: spark.range(5)
    with pytest.raises(KeyboardInterrupt):
        runs.run(spark, root, "tuesday", later)
    assert runs.published(spark, root)["prices"].count() == 10  # written, but readers see Monday's
    monkeypatch.setattr(runs, "publish", kept)
    calls.clear()
    assert states(runs.run(spark, root, "tuesday", later)) == [("prices", "ok", 5), ("corrected", "ok", 5), ("panel", "ok", 5)]
    assert calls == [] and runs.published(spark, root)["prices"].count() == 5
    runs.roll_back(spark, root, 0)
    assert runs.published(spark, root)["prices"].count() == 10
    with pytest.raises(ValueError):
        runs.roll_back(spark, root, 9)
    assert runs.forget(spark, root, keep=1) == 3 and runs.published(spark, root)["panel"].count() == 10
    assert runs.forget(spark, root, keep=1) == 0


def test_windows():
    d = lambda m, day: dt.date(2021, m, day)
    assert walks.date_windows(d(1, 1), d(1, 5), 2) == [(d(1, 1), d(1, 2)), (d(1, 3), d(1, 4)), (d(1, 5), d(1, 5))]
    assert walks.date_windows(d(1, 2), d(1, 1)) == []
    w = [(d(1, 1), d(1, 3), "a"), (d(1, 2), d(1, 5), "b"), (d(1, 7), d(1, 9), "c")]
    assert [x[2] for x in following(w, d(1, 1))] == ["a", "b"] and [x[2] for x in following(w, d(1, 6))] == [] and [x[2] for x in following(w, d(1, 7))] == ["c"]


def land(folder, first, days, price, codes=(1, 2), late=()):
    """A window's file: a price a day and code, and late rows of other days."""
    last = first + dt.timedelta(days - 1)
    rows = [(c, first + dt.timedelta(i), price) for i in range(days) for c in codes] + list(late)
    text = "Some House\n" + "".join(f"{c};Fund {c};Direct Plan;Growth;;;{p};{d:%d-%b-%Y}\n" for c, d, p in rows)
    (folder / f"{first}_{last}.txt").write_text(text)
    return last + dt.timedelta(1)


def prices(spark, store):
    return {(r["amfi_code"], r["nav_date"]): r["nav"] for r in walks.read_prices(spark, store).collect()}


def test_walk_resumes_and_replays(spark, tmp_path, monkeypatch):
    landing, store, checkpoint = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "c")
    landing.mkdir()
    day = dt.date(2020, 1, 1)
    for price in (10, 11, 12):
        day = land(landing, day, 90, price)
    land(landing, day + dt.timedelta(90), 90, 99)  # a gap before it: it waits
    real, seen = walks.merge, []

    def dies(spark, store, rows, batch, first, last):
        seen.append(batch)
        if len(seen) == 2:
            real(spark, store, rows, batch, first, last)  # merged and logged, but the stream does not learn of it
            raise RuntimeError("killed")
        return real(spark, store, rows, batch, first, last)

    monkeypatch.setattr("navengine.streaming.ingest.merge", dies)
    with pytest.raises(Exception, match="killed"):
        walk(spark, str(landing), store, checkpoint, "2020-01-01", windows=1)
    assert len(prices(spark, store)) == 360
    walk(spark, str(landing), store, checkpoint, "2020-01-01", windows=1)
    assert seen[1] == seen[2] and len(seen) == 4  # the batch under way was read again
    assert prices(spark, store) == {(c, dt.date(2020, 1, 1) + dt.timedelta(i)): 10.0 + i // 90 for i in range(270) for c in (1, 2)}
    assert walks.batches(spark, store).count() == 3 and walks.high_water(spark, store) == day - dt.timedelta(1)
    assert walks.plan(spark, store, dt.date(2020, 1, 1), day + dt.timedelta(99)) == [(day, day + dt.timedelta(89)), (day + dt.timedelta(90), day + dt.timedelta(99))]
    assert len(walks.plan(spark, store, dt.date(2020, 1, 1), day, resume=False)) == 4
    # The missing window lands with a late row: the gap closes, and only its months are rewritten.
    stamp = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "store" / "nav").rglob("*.parquet")}
    before = stamp()
    land(landing, day, 90, 13, late=[(1, dt.date(2020, 1, 15), 77)])
    walk(spark, str(landing), store, checkpoint, "2020-01-01", windows=4)
    after = prices(spark, store)
    assert after[1, dt.date(2020, 1, 15)] == 77.0 and after[2, dt.date(2020, 1, 15)] == 10.0 and len(after) == 900
    same = {p.split("month=")[1][:7] for p, t in before.items() if stamp().get(p) == t}
    assert same == {f"2020-{m:02}" for m in range(2, 9)}  # January and from September on


def test_a_batch_is_merged_once(spark, tmp_path):
    store = str(tmp_path)
    rows = spark.createDataFrame([(1, DAY, 1.0, 0), (1, DAY, 2.0, 1), (None, DAY, 3.0, 2), (2, None, 3.0, 3)], "amfi_code int, nav_date date, nav double, pos long")
    assert walks.high_water(spark, store) is None and prices(spark, store) == {}
    assert walks.merge(spark, store, rows, "a", DAY, DAY) == 1 and walks.merge(spark, store, rows.withColumn("nav", F.lit(9.0)), "a", DAY, DAY) == 0
    assert walks.merge(spark, store, rows.where("false"), "b", DAY, DAY + dt.timedelta(3)) == 0
    assert prices(spark, store) == {(1, DAY): 2.0} and walks.high_water(spark, store) == DAY + dt.timedelta(3)


def test_offsets_are_dates(tmp_path):
    day = dt.date(2020, 1, 1)
    for _ in range(3):
        day = land(tmp_path, day, 30, 1)
    (tmp_path / "notes.txt").write_text("x")
    r = WindowReader({"path": str(tmp_path), "start": "2020-01-01", "windows": "2"})
    assert r.initialOffset() == {"next": "2020-01-01"} and r.latestOffset() == {"next": "2020-03-01"} and r.latestOffset() == {"next": "2020-03-31"}
    parts = r.partitions({"next": "2020-01-31"}, {"next": "2020-03-31"})
    assert [p.first for p in parts] == ["2020-01-31", "2020-03-01"]
    lines = [x for b in r.read(parts[0]) for x in b.to_pylist()]
    assert [x["pos"] for x in lines] == list(range(61)) and lines[0]["value"] == "Some House" and lines[1]["last_day"] == dt.date(2020, 2, 29)


def series(spark, seed=1):
    """One fund with nine in ten rows, a few others, nulls among the values."""
    draw = random.Random(seed)
    rows = [("big", DAY + dt.timedelta(i), draw.uniform(1, 100)) for i in range(0, 4000, 2)] + [(f, DAY + dt.timedelta(i), draw.uniform(1, 100)) for f in "abc" for i in draw.sample(range(4000), 60)]
    rows.append((None, DAY, 5.0))
    return rows, spark.createDataFrame(rows, "fund_id string, d date, nav double")


def test_scans_by_segments(spark):
    rows, nav = series(spark)
    top, was, total = {}, {}, {}
    want = {}
    for f, d, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        top[f] = max(top.get(f, v), v)
        total[f] = total.get(f, 0) + v
        want[f, d] = (top[f], was.get(f), total[f])
        was[f] = v
    for days in (7, 100, 100_000):
        got = scan.drawdowns(nav, days=days)
        got = scan.running(got, F.col("nav"), "was", "last", ["fund_id"], ["d"], scan.of_days(days=days), inclusive=False)
        got = scan.running(got, F.col("nav"), "total", "sum", ["fund_id"], ["d"], scan.of_days(days=days)).collect()
        assert len(got) == len(rows)
        for r in got:
            a, b, c = want[r["fund_id"], r["d"]]
            assert r["top"] == a and r["was"] == b and abs(r["total"] - c) < 1e-6 and abs(r["fall"] - (r["nav"] / a - 1)) < 1e-12
    lr = {(r["fund_id"], r["d"]): r["lr"] for r in scan.log_returns(nav, days=50).collect()}
    assert all((lr[k] is None) == (p is None) and (p is None or abs(lr[k] - math.log(v / p)) < 1e-12) for (k, (_, p, _)), v in ((x, dict(((f, d), v) for f, d, v in rows)[x[0]]) for x in want.items()))
    index = {(r["fund_id"], r["d"]): r["index"] for r in scan.growth_index(scan.log_returns(nav, days=50), days=30).where("fund_id = 'big'").collect()}
    first = rows[0][2]
    assert all(abs(index[f, d] - v / first) < 1e-6 for f, d, v in rows if f == "big")
    plan = scan.drawdowns(nav)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(fund_id" in plan and not scan.drawdowns(nav.where("false")).collect()


def test_sweep_over_segments(spark):
    rows, nav = series(spark, 2)
    draw = random.Random(5)
    events = [(f, DAY + dt.timedelta(i), float(i)) for f in ("big", "a") for i in sorted(draw.sample(range(4000), 12))]
    e = spark.createDataFrame(events, "fund_id string, d date, factor double")
    got = {(r["fund_id"], r["d"]): r["factor"] for r in asof.asof_sweep(nav, e, "factor", days=90).collect()}
    for f, d, _ in rows:
        assert got[f, d] == max((x for g, day, x in events if g == f and day <= d), default=None)
    fixed = jumps.correct_rebases(nav.where("fund_id is not null"), e.withColumn("factor", F.lit(2.0)))
    assert fixed.count() == len(rows) - 1


def test_parses_files_larger_than_a_split(spark, tmp_path):
    draw, want, houses, text = random.Random(8), {}, [], ["Scheme Code;Name;a;b;c;d;e;f"]
    category = house = None
    for i in range(30_000):
        if draw.random() < 0.001 or i == 0:
            category = f"Type {draw.randrange(50)}"
            text.append(f"Open Ended Schemes({category})")
            house = text[-1]
        if draw.random() < 0.002:
            house = f"House {draw.randrange(99)}"
            text.append(house)
        code = draw.randrange(20_000)
        text.append(f"{code};x;y;Name {code};Direct;Growth;10.5;01-Jan-2020")
        want[code] = category
        houses.append((code, house))
    (tmp_path / "big.txt").write_text("\n".join(text))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        rows = reports.lines(spark, str(tmp_path))
        assert rows.select("split").distinct().count() > 20
        assert {r["amfi_code"]: r["category"] for r in reports.current_list(rows).collect()} == want
        got = [(r["amfi_code"], r["house"]) for r in sorted(reports.house_of_rows(rows).collect(), key=lambda r: (r["split"], r["pos"]))]
        assert got == houses
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_ranks_and_quantiles_with_ties(spark):
    draw = random.Random(4)
    rows = [(g, float(draw.choice([1, 2, 2, 3, 7, draw.random()])), float(draw.randrange(6))) for g in [1] * 900 + [2] * 50 + [3] * 1 for _ in [0]] + [(1, None, 1.0), (None, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "g int, a double, b double").repartition(6)
    by = {g: sorted(a for h, a, _ in rows if h == g and a is not None) for g in (1, 2, 3)}
    for parts in (1, 7):
        got = ranks.mean_ranks(df, "a", ["g"], "r", parts).collect()
        assert len(got) == 951
        for r in got:
            s = by[r["g"]]
            lo = bisect_left(s, r["a"])
            assert r["r"] == lo + (s.count(r["a"]) + 1) / 2
        for r in ranks.quantiles(df, "a", ["g"], {"q0": 0, "q1": 0.25, "q5": 0.5, "q9": 0.9, "q10": 1}, parts).where("g is not null").collect():
            s = by[r["g"]]
            for name, share in (("q0", 0), ("q1", 0.25), ("q5", 0.5), ("q9", 0.9), ("q10", 1)):
                at = (len(s) - 1) * share
                low, high = s[math.floor(at)], s[math.ceil(at)]
                assert abs(r[name] - (low + (high - low) * (at - math.floor(at)))) < 1e-12
    assert ranks.mean_ranks(df.where("false"), "a", ["g"], "r").collect() == [] and ranks.quantiles(df.where("false"), "a", ["g"], {"m": 0.5}).collect() == []


def test_no_window_over_a_year(spark):
    pairs = spark.createDataFrame([("f", 1, 0, 2000, float(i % 9), float(i % 7)) for i in range(200)], "fund_id string, horizon_y int, phase int, fy int, formation double, holding double")
    for df in (trailing.quartiles(pairs), trailing.spearman(pairs), trailing.repeat_winners(pairs), selection.pooled_spearman(pairs)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [x for x in plan.split("\n") if "Window" in x]
        assert all("__part" in x or "__s" in x for x in windows), windows
        assert df.count() >= 1
