"""Cases on hand-made rows: parsing, cleaning, index invariants, back-test, pages, files."""

import datetime as dt
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from quote_rows import as_json, basket, feed, raw

from fareindex.functions import parsing as p
from fareindex.functions.aggregates import pearson
from fareindex.operators import audit, cells, cleaning, indexing, market, series, validation
from fareindex.sources import dims, io, pages, views

def reasons(tagged):
    return {r["r"]: r["n"] for r in tagged.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("r")).agg(F.count("*").alias("n")).collect()}


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    return [r[0] for r in df.select(column(F.col("c"))).collect()]


def test_amounts(spark):
    assert one(spark, p.parse_amount, "₹6,500", "Rs. 6500", "INR 6,500.50", "", None, "—") == [6500.0, 6500.0, 6500.5, 0.0, 0.0, 0.0]
    assert one(spark, p.parse_int, "9 seats left", "", None, "sold") == [9, None, None, None]
    assert one(spark, p.parse_flight, "6E 123", "Flight IX  4512", "UK 99") == ["6E123", "IX4512", "UK99"]
    assert one(spark, p.flight_carrier, "AI 302", "x", None) == ["AI", "XX", "XX"]


@pytest.mark.parametrize("day", [dt.date(2025, 1, 1), dt.date(2024, 12, 30), dt.date(2026, 1, 4), dt.date(2021, 1, 3), dt.date(2027, 1, 1)])
def test_iso_week(spark, day):
    got = spark.createDataFrame([(day,)], "d date").select(p.iso_week_key(F.col("d"))).first()[0]
    y, w, _ = day.isocalendar()
    assert got == f"{y}-W{w:02d}"


def test_duplicates_and_sold_out(spark):
    tagged = cleaning.tag_drop_reason(raw(spark, {}, {}, {"seats_left": 0}))
    assert reasons(tagged) == {"kept": 1, "duplicate": 1, "sold_out": 1}


def test_reason_order(spark):
    rows = [{"seats_left": 0, "is_cancelled": True, "fare_text": "x"}, {"is_cancelled": True}, {"fare_text": "n/a"}, {"seats_left": None, "fare_text": "₹6,400"}, {"sold_out": True}, {}]
    assert reasons(cleaning.tag_drop_reason(raw(spark, *rows))) == {"sold_out": 2, "cancelled": 1, "invalid": 1, "kept": 2}


def test_outlier(spark):
    rows = [{"fare_text": f"₹{6000 + 10 * i}"} for i in range(20)] + [{"fare_text": "₹48,000"}]
    tagged = cleaning.tag_drop_reason(raw(spark, *rows))
    assert reasons(tagged) == {"kept": 20, "outlier": 1}
    report = cleaning.cleaning_report(tagged).first()
    assert (report["raw_count"], report["kept_count"], report["imputed_count"], report["coverage"]) == (21, 20, 4, 100.0)
    assert report["raw_count"] == report["kept_count"] + sum(report[f"dropped_{r}"] for r in cleaning.REASONS)


def test_equal_fares_are_kept(spark):
    rows = [{"fare_text": "₹5,000", "flight_no": str(i), "carrier": c} for i, c in enumerate(dims.FARE_INDEX)]
    assert reasons(cleaning.tag_drop_reason(raw(spark, *rows))) == {"kept": 5}


def test_imputation(spark):
    clean = cleaning.clean_quotes(raw(spark, {})).collect()
    filled = [r for r in clean if r["imputed"]]
    assert len(clean) == 5 and len(filled) == 4
    assert all("anti-bot-block" in r["flags"] and r["source_id"] == "imputed" for r in filled)
    assert {r["carrier"]: r["total_fare"] for r in filled} == {c: round(6500 * i / 0.97) for c, i in dims.FARE_INDEX.items() if c != "6E"}


def test_nothing_is_imputed_without_kept_quotes(spark):
    assert cleaning.clean_quotes(raw(spark, {"seats_left": 0})).count() == 0
    assert cleaning.clean_quotes(raw(spark)).count() == 0


def test_decomposition(spark):
    rows = cleaning.decompose(raw(spark, {}, {"source_id": "yatra", "tax_text": "Inclusive"}, {"fare_text": "₹10", "tax_text": None})).collect()
    for r in rows[:2]:
        assert r["base_fare"] + r["taxes"] + r["convenience_fee"] == r["total_fare"] == 6500
    assert rows[1]["taxes"] == 1261 and rows[1]["convenience_fee"] == 40 and "ota-channel" in rows[1]["flags"]
    assert rows[2]["base_fare"] == 10 and rows[0]["flags"] == ["non-refundable", "no-check-in-bag"]


def test_pooling_needs_no_cell(spark):
    rows = [{"fare_text": f"₹{6000 + 10 * i}", "route_id": f"DEL-{i % 3}"} for i in range(20)] + [{"fare_text": "₹48,000", "route_id": "DEL-0"}]
    assert reasons(cleaning.tag_drop_reason(raw(spark, *rows), cell=()))["outlier"] == 1


def test_result_does_not_depend_on_order_or_partitions(spark):
    rng = random.Random(1)
    rows = [{"fare_text": f"₹{rng.randint(3000, 9000)}", "carrier": rng.choice(list(dims.FARE_INDEX)), "lead_time": rng.choice([1, 7]), "flight_no": str(i), "seats_left": rng.randint(0, 9)} for i in range(300)]
    a = sorted(map(str, cleaning.clean_quotes(raw(spark, *rows), order_by=("collected_at", "flight_no")).collect()))
    rng.shuffle(rows)
    b = sorted(map(str, cleaning.clean_quotes(raw(spark, *rows).repartition(5), order_by=("collected_at", "flight_no")).collect()))
    assert a == b


def test_one_exchange_from_scan_to_cell_prices(spark, tmp_path):
    raw(spark, {}).write.parquet(f"file://{tmp_path}/raw")
    plan = cells.cell_prices(cleaning.clean_quotes(spark.read.parquet(f"file://{tmp_path}/raw")))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange ", plan.split("Initial Plan")[-1])) == 1


def test_one_sort_for_all_windows_of_the_funnel(spark, tmp_path):
    raw(spark, {}).write.parquet(f"file://{tmp_path}/raw")
    plan = cleaning.clean_quotes(spark.read.parquet(f"file://{tmp_path}/raw"))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Sort \[", plan.split("Initial Plan")[-1])) == 1
    taxes = [r["taxes"] for r in cleaning.decompose(raw(spark, {"tax_text": "₹ InCLUSIVE"}, {"tax_text": "₹100"})).orderBy("taxes").collect()]
    assert taxes[0] == 100 and taxes[1] > 100


def test_cells_carry_only_what_they_use(spark, tmp_path):
    raw(spark, {}).write.parquet(f"file://{tmp_path}/raw")
    found = cleaning.impute_missing(cleaning.tag_drop_reason(spark.read.parquet(f"file://{tmp_path}/raw")), count="raw_quotes")
    plan = cells.counted_cells(found)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "base_fare" not in plan and "low-inventory" not in plan and "transform(" not in plan


def test_lines_are_not_shuffled_for_suppliers(spark):
    plan = views.quotes(spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString()
    assert "l_suppkey" in plan and "hashpartitioning(l_suppkey" not in plan


def test_quotes_are_dealt_before_they_are_parsed(spark, tmp_path):
    raw(spark, {}).write.parquet(f"file://{tmp_path}/raw")
    plan = cleaning.clean_quotes(spark.read.parquet(f"file://{tmp_path}/raw"))._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    above, below = plan.split("Exchange hashpartitioning")
    assert "regexp_extract" in above and "regexp_extract" not in below


def test_missing_carriers_take_one_pass(spark, tmp_path):
    raw(spark, {}, {"lead_time": None}).write.parquet(f"file://{tmp_path}/raw")
    kept = cleaning.tag_drop_reason(spark.read.parquet(f"file://{tmp_path}/raw")).where("drop_reason is null")
    found = audit.missing_carriers(kept, dims.carriers(spark), cleaning.CELL)
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("parquet") and len(re.findall(r"FileScan", plan)) == 1 and len(re.findall(r"\bExchange ", plan)) == 1
    seen = {r["carrier"] for r in kept.collect()}
    assert sorted((r["lead_time"] is None, r["carrier"]) for r in found.collect()) == sorted((lead, c) for lead in (False, True) for c in set(dims.FARE_INDEX) - seen)


@pytest.mark.parametrize("price, quality, want", [(1.0, 1.0, 100.0), (1.1, 1.0, 110.0), (1.0, 1.1, 100 / 1.1)])
def test_index_on_a_whole_basket(spark, price, quality, want):
    weights = dims.route_weights(dims.routes(spark))
    base = indexing.base_snapshot(cells.route_prices(basket(spark)), "2026-09-30")
    found = indexing.route_relatives(cells.route_prices(basket(spark, price, quality)), base, weights)
    point = indexing.build_index(found).first()
    assert point["value"] == pytest.approx(want) and point["nominal"] == pytest.approx(100 * price) and point["covered"] == pytest.approx(1.0)
    again = indexing.build_index(found, missing="renormalize").first()
    assert again["value"] == pytest.approx(want)


def test_early_fares_weigh_by_booking_share(spark):
    df = basket(spark).where("route_id = 'DEL-BOM'").withColumn("price", F.when(F.col("lead_time") == 1, 14000.0).otherwise(7200.0))
    for method in ("geometric", "arithmetic"):
        assert 7200 < cells.route_prices(df, method=method).first()["price"] < 8000


def test_contributions_add_up_to_the_nominal_change(spark):
    weights = dims.route_weights(dims.routes(spark))
    assert weights.agg(F.sum("weight")).first()[0] == pytest.approx(1.0)
    later = basket(spark, day="2026-10-30").withColumn("price", F.col("price") * (1 + F.length("route_id") * F.ascii(F.substring("route_id", 2, 1)) / 1000.0))
    prices = cells.route_prices(basket(spark).union(later))
    found = indexing.route_relatives(prices, indexing.base_snapshot(prices, "2026-09-30"), weights)
    points = [r["nominal"] for r in indexing.build_index(found).orderBy("obs_date").collect()]
    parts = indexing.contributions(found, "2026-09-30", "2026-10-30").agg(F.sum("points")).first()[0]
    assert parts == pytest.approx(points[1] - points[0])


def test_missing_base_and_missing_routes(spark):
    weights = dims.route_weights(dims.routes(spark))
    prices = cells.route_prices(basket(spark, 2.0).where("route_id in ('DEL-BOM', 'DEL-LKO')"))
    none = spark.createDataFrame([], "route_id string, price_0 double, quality_0 double")
    found = indexing.route_relatives(prices, none, weights)
    assert indexing.build_index(found).first()["value"] == pytest.approx(100 * 4.7 / 36.4 / 0.95)  # against quality 1
    assert indexing.build_index(found, missing="renormalize").first()["value"] == pytest.approx(100.0 / 0.95)
    assert indexing.build_index(found, missing="renormalize").first()["nominal"] == pytest.approx(100.0)


def daily(spark, n=800, f=lambda i: 100 + 0.05 * i):
    rows = [(dt.date(2025, 1, 1) + dt.timedelta(i), float(f(i))) for i in range(n)]
    return spark.createDataFrame(rows, "date date, value double")


def test_monthly_series(spark):
    rows = series.period_series(daily(spark)).orderBy("period").collect()
    assert len(rows) >= 26 and rows[0]["change"] is None and rows[1]["change"] > 0
    assert rows[11]["yoy"] is None and rows[12]["yoy"] > 0


def test_smoothing_and_gaps(spark):
    df = daily(spark, 30).where("dayofmonth(date) not in (5, 6)")
    full = series.complete_calendar(df)
    assert full.count() == 30 and full.where("value is null").count() == 2
    s = [r["smoothed"] for r in series.smooth(daily(spark, 10, lambda i: i)).orderBy("date").collect()]
    assert s[:3] == [0.0, 0.5, 1.0] and s[9] == pytest.approx(6.0)


def months(spark, values, start="2025-01"):
    y, m = map(int, start.split("-"))
    rows = [(f"{y + (m - 1 + i) // 12}-{(m - 1 + i) % 12 + 1:02d}", float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "period string, value double")


def test_backtest_verdicts(spark):
    a = months(spark, [100 + i for i in range(12)])
    same = validation.backtest(a, a).first()
    assert same["verdict"] == "PASS" and same["pearson"] == pytest.approx(1.0) and same["mape"] == pytest.approx(0.0) and same["directional"] == 100.0
    assert validation.backtest(a, months(spark, [1, 2], "2025-12")).first()["verdict"] == "insufficient overlap"
    assert validation.backtest(a, months(spark, [(-1) ** i * 5 + 100 for i in range(12)])).first()["verdict"] == "REVIEW"
    flat = validation.backtest(a, months(spark, [100] * 12)).first()
    assert flat["pearson"] == 0.0 and flat["spearman"] == 0.0
    assert validation.backtest(a, a, last=4).first()["months"] == 4


def test_pearson_of_few_or_constant_values(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 4.0), (2, 1.0, 1.0), (2, 1.0, 2.0), (2, 1.0, 3.0), (3, 1.0, 3.0), (3, 2.0, 2.0), (3, 3.0, 1.0)], "k int, x double, y double")
    got = {r["k"]: r["r"] for r in df.groupBy("k").agg(pearson(F.col("x"), F.col("y")).alias("r")).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: pytest.approx(-1.0)}


def test_ols_matches_least_squares(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3))
    y = 2 + x @ [1.5, -2.0, 0.0] + rng.normal(0, 0.1, 60)
    df = spark.createDataFrame([(i % 2, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "n int, mean_a double, s_0_0 double, c double, y double")
    for by in ((), ("n",)):
        got = {(tuple(r[b] for b in by), r["term"]): r for r in validation.ols(df, "y", ["mean_a", "s_0_0", "c"], by).collect()}
        for group in [()] if not by else [(0,), (1,)]:
            at = slice(None) if not by else slice(group[0], None, 2)
            a = np.column_stack([np.ones(len(x[at])), x[at]])
            beta, rest, *_ = np.linalg.lstsq(a, y[at], rcond=None)
            spread = np.sqrt(np.diag(np.linalg.inv(a.T @ a)) * rest[0] / (len(a) - 4))
            for i, term in enumerate(["intercept", "mean_a", "s_0_0", "c"]):
                assert got[group, term]["beta"] == pytest.approx(beta[i], abs=1e-6) and got[group, term]["t"] == pytest.approx(beta[i] / spread[i], rel=1e-4)
    few = validation.ols(df.limit(3), "y", ["mean_a", "s_0_0", "c"]).collect()
    assert {(r["beta"], r["t"]) for r in few} == {(0.0, 0.0)}
    fit = validation.ols(df, "y", ["mean_a", "s_0_0", "c"])
    assert {r["term"] for r in validation.significant_drivers(fit).collect()} >= {"mean_a", "s_0_0"} and validation.dominant_driver(fit).first()["driver"] == "s_0_0"


def test_ols_of_collinear_and_large_columns(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=50)
    df = spark.createDataFrame([(float(v * 1e7), float(2e7 * v), float(3 * v + 1)) for v in x], "a double, b double, y double")
    got = {r["term"]: r["beta"] for r in validation.ols(df, "y", ["a", "b"]).collect()}
    assert got["a"] * 1e7 + got["b"] * 2e7 == pytest.approx(3.0) and got["intercept"] == pytest.approx(1.0)


def test_driver_changes(spark):
    index = months(spark, [100 * 1.01**i for i in range(30)])
    rows = [(r["period"], float(2 ** (i % 3)), float(i % 12)) for i, r in enumerate(index.orderBy("period").collect())]
    table = validation.driver_table(index, spark.createDataFrame(rows, "period string, fuel double, season double"), ["fuel", "season"], last=18, plain=["season"])
    found = table.orderBy("period").collect()
    assert len(found) == 18 and all(r["y"] == pytest.approx(np.log(1.01)) for r in found)
    assert {round(r["season"]) for r in found} == {1, -11} and {round(r["fuel"] / np.log(2)) for r in found} == {1, -2}
    fit = validation.driver_regression(index, spark.createDataFrame(rows, "period string, fuel double, season double"), ["fuel", "season"], last=18, plain=["season"])
    assert {r["n_rows"] for r in fit.collect()} == {18}
    days = spark.createDataFrame([(dt.date(2025, 1, d), float(d)) for d in (3, 14, 16)] + [(dt.date(2025, 2, 20), 20.0)], "date date, fuel double")
    assert {tuple(r) for r in validation.reading_of_day(days, ["fuel"]).collect()} == {("2025-01", 14.0), ("2025-02", 20.0)}


def test_error_forms(spark):
    pairs = validation.align(months(spark, [100, 110]), months(spark, [200, 220]))
    assert validation.error_against(pairs).first()["mape"] == pytest.approx(0.0) and validation.error_against(pairs, "level").first()["mape"] == pytest.approx(50.0)


def test_amenity_quality_through_the_funnel(spark):
    clean = {r["carrier"]: r["quality"] for r in cleaning.clean_quotes(raw(spark, {}), mode="amenity", expected={"6E": 0.97, "AI": 1.14}).collect()}
    assert clean == {"6E": pytest.approx(0.74 * 0.95), "AI": pytest.approx(0.93 * 0.95)}


def test_last_runs_names_sources_without_a_run(spark):
    log = spark.createDataFrame([(dt.date(2026, 9, 30), "a", 5, "ok")], "date date, source_id string, raw_quotes long, status string")
    got = {r["source_id"]: r["date"] for r in audit.last_runs(spark.createDataFrame([("a", "x"), ("b", "y")], "source_id string, kind string"), log).collect()}
    assert got == {"a": dt.date(2026, 9, 30), "b": None}


def test_one_funnel_for_stored_cells(spark):
    kept = io.store_cells(cells.cell_prices(cleaning.clean_quotes(raw(spark, {}))))
    assert "Window" not in kept._jdf.queryExecution().executedPlan().toString() and kept.count() == 1
    approx = cells.cell_prices(cleaning.clean_quotes(raw(spark, {}, {"fare_text": "₹6,600"})), method="approx").first()
    assert 6000 < approx["price"] < 7500


def test_wide_heatmap_and_nested_series(spark):
    rows = [("A", dt.date(2025, m, 1), 1.0 * m) for m in (1, 2)] + [("B", dt.date(2025, 1, 1), 3.0)]
    df = spark.createDataFrame(rows, "route_id string, obs_date date, relative double")
    wide = {r["route_id"]: r.asDict() for r in series.route_month_heatmap(df, wide=True).collect()}
    assert wide["A"]["2025-01"] == 100.0 and wide["A"]["2025-02"] == 200.0 and wide["B"]["2025-02"] is None
    long = df.select(F.col("route_id").alias("grouping"), F.date_format("obs_date", "yyyy-MM").alias("period"), F.col("relative").alias("value"))
    assert {r["period"]: r["values"] for r in series.nested_series(long).collect()} == {"2025-01": {"A": 1.0, "B": 3.0}, "2025-02": {"A": 2.0}}


def test_best_lag(spark):
    rng = random.Random(3)
    x = [rng.random() for _ in range(40)]
    pairs = spark.createDataFrame([(f"{i:03d}", x[i], x[i - 2] if i > 1 else 0.5) for i in range(40)], "period string, x double, y double")
    assert validation.best_lag(validation.cross_correlation(pairs)).first()["best_lag"] == 2


def test_booking_curve(spark):
    weights = dims.route_weights(dims.routes(spark))
    level = {1: 9000.0, 7: 7000.0, 15: 6000.0, 30: 6000.0, 45: 6500.0}
    df = basket(spark).withColumn("price", dims.lookup(F.col("lead_time"), level))
    curve = market.lead_elasticity(df, weights)
    got = {r["lead_time"]: r for r in curve.collect()}
    assert got[7]["elasticity"] == 0.0 and got[7]["index"] == pytest.approx(100.0) and got[1]["premium_pct"] == pytest.approx(200 / 7)
    best = market.booking_summary(curve).first()
    assert best["trough_lead"] == 15 and best["saving_pct"] == pytest.approx(100 / 3) and best["late_rise_pct"] == pytest.approx(100 * 500 / 6000)


def test_wedge_needs_both_channels(spark):
    rows = [{}, {"source_id": "yatra", "fare_text": "₹7,150"}, {"route_id": "DEL-BLR"}]
    got = market.channel_wedge(cleaning.clean_quotes(raw(spark, *rows))).collect()
    assert [(r["route_id"], r["wedge"], round(r["wedge_pct"], 6)) for r in got] == [("DEL-BOM", 650.0, 10.0)]


def test_plan_coverage_and_audit(spark):
    plan = audit.collection_plan(dims.routes(spark), dims.leads(spark), dims.sources(spark), "2026-09-30", "2026-09-30")
    assert plan.count() == 24 * 5 * 11
    cover = {r["source_id"]: r for r in audit.grid_coverage(plan, raw(spark, {}, {})).collect()}
    assert cover["indigo"]["expected"] == 120 and cover["indigo"]["seen"] == 1 and cover["yatra"]["seen"] == 0
    log = spark.createDataFrame([(dt.date(2026, 9, 30), s, 120, 10, e, 0, b, 1.0) for s, e, b in (("a", 0, 61), ("b", 0, 60), ("c", 1, 0), ("d", 0, 0))], "date date, source_id string, requests long, raw_quotes long, http_errors long, retries long, block_events long, duration_ms double")
    assert {r["source_id"]: r["status"] for r in audit.sweep_audit(log).collect()} == {"a": "blocked", "b": "degraded", "c": "degraded", "d": "ok"}


def test_release_ledger(spark):
    schema = "period string, frequency string, value double, published_at date, channels array<string>"
    old = spark.createDataFrame([("2025-01", "monthly", 1.0, dt.date(2025, 2, 1), ["x"]), ("2025-02", "monthly", 2.0, dt.date(2025, 3, 1), ["x"])], schema)
    new = spark.createDataFrame([("2025-02", "monthly", 2.345, dt.date(2025, 4, 1), None), ("2025-03", "monthly", 3.0, dt.date(2025, 4, 1), None)], schema)
    got = {r["period"]: r for r in audit.release_status(audit.publish_release(old, new), "2025-05-01").collect()}
    assert len(got) == 3 and got["2025-02"]["value"] == 2.35 and got["2025-02"]["channels"] == ["web", "api"]
    assert got["2025-01"]["status"] == "frozen" and got["2025-03"]["status"] == "provisional"


AIRLINE = """<html><div data-testid='flight-list-item'><br><b data-testid='price'> ₹6,500 </b><span data-testid='fare-family'>Flex Plus</span>
<i data-testid='flight-number'>6E  2045</i><p data-testid='seat-availability'>4 seats <em>left</em></p></div>
<div data-testid='flight-list-item'><span data-testid='fare-family'>Lite</span></div>
<div data-testid="flight-list-item"><b data-testid="price">₹4,000</b><span data-testid="fare-family">Saver Lite</span></div></html>"""
AGENCY = "<div data-type='flight'><div class='x fareSummary'>Rs. 5,432.90</div><u class='flight-no'>AI 302</u></div><div data-type='flight'><div class='fareSummary'>99</div><u class='flight-no'>7</u>"


def test_page_extraction(spark):
    where = {
        "indigo": pages.Selectors("[data-testid='flight-list-item']", "[data-testid='price']", "[data-testid='fare-family']", "[data-testid='flight-number']", "[data-testid='seat-availability']", "6E"),
        "makemytrip": pages.Selectors("[data-type='flight']", ".fareSummary", ".fare-type", ".flight-no", ".seat-count", fee_text="+ 48 convenience fee"),
    }
    rows = [(1, "indigo", AIRLINE), (2, "makemytrip", AGENCY), (3, "indigo", "Please VERIFY you are human" + AIRLINE), (4, "other", AIRLINE), (5, "indigo", None), (6, "indigo", "<div data-testid='flight-list-item'><<b>")]
    df = spark.createDataFrame(rows, "page_id long, source_id string, html string")
    got = pages.extract_quotes(df, where).orderBy("page_id", "fare_text").collect()
    assert [(r["page_id"], r["carrier"], r["fare_class"], r["flight_no"], r["fare_text"], r["seats_left"], r["refundable"], r["baggage_kg"]) for r in got] == [
        (1, "6E", "Saver Lite", "", "₹4,000", None, False, 15),
        (1, "6E", "Flex Plus", "6E2045", "₹6,500", 4, True, 25),
        (2, "AI", "VALUE", "AI302", "₹5,432", None, False, 15),
        (2, "XX", "VALUE", "7", "₹99", None, False, 15),
    ]
    assert {r["page_id"]: r["blocked"] for r in pages.flag_challenges(df).collect()} == {1: False, 2: False, 3: True, 4: False, 5: False, 6: False}
    assert pages.flag_challenges(spark.createDataFrame([("_Incapsula_Resource",)], "html string")).first()["blocked"]


def test_raw_feed_and_quote_store(spark, tmp_path):
    path = feed(tmp_path, {5: [as_json(), "{broken"], 6: [as_json(fare_text="₹7,000", is_synthetic=None)]})
    rows = io.read_raw_quotes(spark, path)
    assert sorted(r["corrupt"] or "" for r in rows.collect()) == ["", "", "{broken"]
    good = rows.where("corrupt is null").drop("corrupt")
    assert good.where("is_synthetic").count() == 0 and {str(r["obs_date"]) for r in good.collect()} == {"2026-09-30"}
    store = f"file://{tmp_path}/store"
    io.write_quotes(good.drop("is_synthetic"), store)
    io.write_quotes(good.withColumn("is_synthetic", F.lit(True)), store)
    back = io.read_quotes(spark, store)
    assert back.count() == 4 and back.where("is_synthetic").count() == 2 and back.where("is_synthetic is null").count() == 0


def test_point_store_and_base_store(spark, tmp_path):
    shape = "date date, value double, nominal double, quality_index double, hedge_ratio double, avg_fare double, observations bigint, is_synthetic boolean"
    rows = lambda days, v: spark.createDataFrame([(d, v, v, 1.0, 1.0, 5.0, 3, v < 2) for d in days], shape)
    path = f"file://{tmp_path}/points"
    d = dt.date
    io.upsert_points(spark, path, rows([d(2026, 1, 1), d(2026, 1, 2), d(2026, 2, 1)], 1.0))
    io.upsert_points(spark, path, rows([d(2026, 1, 2), d(2026, 3, 1)], 2.0))
    got = {str(r["date"]): r["value"] for r in io.read_points(spark, path).collect()}
    assert got == {"2026-01-01": 1.0, "2026-01-02": 2.0, "2026-02-01": 1.0, "2026-03-01": 2.0}
    where = f"file://{tmp_path}/base"
    first = io.load_or_seed_base(spark, where, cells.route_prices(basket(spark)), "2026-09-30").collect()
    again = io.load_or_seed_base(spark, where, cells.route_prices(basket(spark, 3.0)), "2026-09-30").collect()
    assert sorted(first) == sorted(again) and first[0]["price_0"] == pytest.approx(7200.0)


def test_reference_json_and_csv(spark, tmp_path):
    items = [{"sector": s, "period": f"2025-{m:02d}", "index": 100.0 + m} for s in ("Combined", "Urban") for m in (1, 2)]
    (tmp_path / "cpi.json").write_text(json.dumps({"series": {"airfare_item": items}}, indent=1))
    got = io.read_reference_series(spark, f"file://{tmp_path}/cpi.json").collect()
    assert sorted((r["period"], r["value"]) for r in got) == [("2025-01", 101.0), ("2025-02", 102.0)]
    a = months(spark, [1, 2, 3])
    io.write_backtest_csv(validation.backtest_table(a, a), f"file://{tmp_path}/out")
    assert spark.read.csv(f"file://{tmp_path}/out", header=True).count() == 3
