"""Stored tables: counts carried with cells, the clean store by day, sketches, versions of the points, replayed batches."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F
from quote_rows import as_json, basket, feed, raw

from fareindex import queries as q
from fareindex.operators import audit, cells, cleaning, indexing, market, validation
from fareindex.operators.cleaning import CELL
from fareindex.sources import dims, io, views
from fareindex.streaming.ingest import current_medians, sketch_upkeep, stream_raw_quotes, upkeep

POINTS = "date date, value double, nominal double, quality_index double, hedge_ratio double, avg_fare double, observations bigint, is_synthetic boolean"


def points(spark, days, v):
    return spark.createDataFrame([(d, v, v, 1.0, 1.0, 5.0, 3, False) for d in days], POINTS)


def stored(spark, path):
    return {str(r["date"]): r["value"] for r in io.read_points(spark, path).collect()}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_survive_a_write_that_fails(spark, tmp_path):
    path = f"file://{tmp_path}/points"
    d = dt.date
    assert io.read_points(spark, path).collect() == []
    io.upsert_points(spark, path, points(spark, [d(2026, 1, 1), d(2026, 2, 1)], 1.0))
    before = stored(spark, path)
    bad = points(spark, [d(2026, 1, 1), d(2026, 2, 1), d(2026, 3, 1)], 2.0).repartition(3)
    bad = bad.withColumn("value", F.when(F.month("date") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        io.upsert_points(spark, path, bad)
    assert stored(spark, path) == before
    half = tmp_path / "points/version=000000009/month=2026-01"  # a writer that died before its job committed
    half.mkdir(parents=True)
    (half / "part-0.parquet").write_bytes(b"broken")
    assert stored(spark, path) == before
    io.upsert_points(spark, path, points(spark, [d(2026, 1, 2), d(2026, 3, 1)], 3.0))
    now = before | {"2026-01-02": 3.0, "2026-03-01": 3.0}
    assert stored(spark, path) == now
    assert io.forget_versions(spark, path) >= 2 and stored(spark, path) == now


def test_a_batch_delivered_twice_changes_nothing(spark, tmp_path):
    weights = dims.route_weights(dims.routes(spark))
    base = indexing.base_snapshot(cells.route_prices(basket(spark)), "2026-09-30")
    raw_path, points_path = f"file://{tmp_path}/raw", f"file://{tmp_path}/points"
    path = feed(tmp_path, {5: [as_json(), as_json(carrier="AI")], 6: [as_json(fare_text="₹9,000", collected_at=dt.datetime(2026, 9, 30, 6))]})
    batches = []
    stream = stream_raw_quotes(spark, path, files_per_batch=1)
    run = upkeep(raw_path, points_path, base, weights)

    def twice(batch, epoch):
        run(batch, epoch)
        batches.append((epoch, io.read_quotes(spark, raw_path).count(), stored(spark, points_path)))
        run(batch, epoch)
        assert batches[-1] == (epoch, io.read_quotes(spark, raw_path).count(), stored(spark, points_path))

    stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert [n for _, n, _ in batches[:2]] == [2, 3] and batches[-1][1] == 3 and len(batches[-1][2]) == 1  # an empty batch may follow
    run(spark.createDataFrame([], io.read_quotes(spark, raw_path).drop("commit").schema), 7)  # an empty batch
    assert io.read_quotes(spark, raw_path).count() == 3


def test_cells_carry_raw_counts(spark):
    rows = [{}, {}, {"seats_left": 0}, {"route_id": "DEL-BLR", "sold_out": True}, {"route_id": "DEL-BLR", "is_cancelled": True}]
    tagged = cleaning.tag_drop_reason(raw(spark, *rows))
    found = {r["route_id"]: r for r in cells.counted_cells(cleaning.impute_missing(tagged, count="raw_quotes")).collect()}
    assert (found["DEL-BOM"]["raw_quotes"], found["DEL-BOM"]["quotes"]) == (3, 5)
    assert (found["DEL-BLR"]["raw_quotes"], found["DEL-BLR"]["quotes"], found["DEL-BLR"]["price"]) == (2, 0, None)
    plain = {r["route_id"]: tuple(r) for r in cells.cell_prices(cleaning.impute_missing(tagged)).collect()}
    assert plain == {"DEL-BOM": tuple(found["DEL-BOM"])[: len(CELL) + 3]}


def test_weights_of_counts_equal_those_of_facts_without_reading_them(spark, sf):
    kept, weights = q.kept_cells(spark, sf)
    want = {r["route_id"]: r["weight"] for r in views.traffic_weights(views.quotes(spark, sf)).collect()}
    assert {r["route_id"]: r["weight"] for r in weights.collect()} == want and len(want) == 25
    assert "lineitem" not in plan_of(weights) and "lineitem" not in plan_of(kept)
    found = q.relatives(spark, sf)
    assert "l_extendedprice" not in plan_of(q.points_of(found))


def test_latest_day_comes_from_partitions(spark, sf):
    kept, last = q.kept_quotes(spark, sf)
    assert str(kept.agg(F.max("period")).first()[0]) == last
    plan = plan_of(market.route_fares(kept, last, "period"))
    assert "Window" not in plan and re.search(r"PartitionFilters: \[[^\]]*period", plan)
    daily = market.route_fares(kept, last, "period").collect()
    assert daily == market.route_fares(q.clean(spark, sf), column="period").collect()


def test_latest_quotes_of_an_empty_store(spark, tmp_path):
    clean = cleaning.clean_quotes(raw(spark, {})).where("false")
    path = io.store_quotes(clean, f"file://{tmp_path}/quotes")
    assert io.stored_values(spark, path) == []
    path = io.store_quotes(cleaning.clean_quotes(raw(spark, {})), f"file://{tmp_path}/some")
    assert io.latest_quotes(spark, path).count() == 5 and io.stored_values(spark, path) == ["2026-09-30"]


@pytest.mark.parametrize("parts", [1, 7])
def test_sketches_merge_within_their_rank_error(spark, parts):
    rows = spark.range(40_000).select((F.col("id") % 2).alias("cell"), F.pmod(F.xxhash64("id"), F.lit(10_000)).cast("double").alias("total_fare"), F.lit(1.0).alias("quality"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).alias("batch"))
    rows = io.store_cells(rows)
    merged = cells.cell_sketches(rows.where("batch = 0"), ["cell"])
    for k in range(1, parts):
        merged = cells.merge_sketches(merged, cells.cell_sketches(rows.where(F.col("batch") == k), ["cell"]), ["cell"])
    for share in (0.1, 0.5, 0.9):
        got = cells.sketched_prices(merged, ["cell"], share)
        ranks = rows.join(got, "cell").groupBy("cell").agg(F.avg((F.col("total_fare") <= F.col("price")).cast("double")).alias("rank"), F.max("quotes").alias("quotes"))
        assert all(abs(r["rank"] - share) < 0.013 and r["quotes"] == 20_000 for r in ranks.collect())


def test_expected_coverage_equals_that_of_the_grid(spark):
    rows = [{}, {}, {"lead_time": 1}, {"lead_time": 99}, {"route_id": "X-Y"}, {"source_id": "yatra", "collected_at": dt.datetime(2026, 10, 1, 5)}]
    quotes = raw(spark, *rows)
    span = "2026-09-29", "2026-10-01"
    plan = audit.collection_plan(dims.routes(spark), dims.leads(spark), dims.sources(spark), *span)
    want = {tuple(r) for r in audit.grid_coverage(plan, quotes).collect()}
    found = audit.expected_coverage(quotes, dims.routes(spark), dims.leads(spark), dims.sources(spark), *span)
    assert {tuple(r) for r in found.collect()} == want and len(want) == 33


def test_a_route_without_a_base_is_its_own(spark):
    prices = cells.route_prices(basket(spark, quality=2.0))
    base = indexing.base_snapshot(cells.route_prices(basket(spark)), "2026-09-30").where("route_id <> 'DEL-BOM'")
    got = {r["route_id"]: r for r in indexing.route_relatives(prices, base, dims.route_weights(dims.routes(spark))).collect()}
    assert got["DEL-BOM"]["relative"] == 1.0 and got["DEL-BOM"]["hedonic"] == pytest.approx(1 / 1.9)
    assert got["DEL-BLR"]["relative"] == 1.0 and got["DEL-BLR"]["hedonic"] == pytest.approx(0.5)


def test_regression_reads_its_rows_once_and_stays_exact(spark):
    rows = spark.range(2_000).select((1e9 + F.col("id")).alias("x"), (1e9 + 3 * F.col("id")).alias("y"), (F.col("id") % 3).alias("g"))
    fit = validation.ols(rows, "y", ["x"], ["g"])
    assert plan_of(fit).count("Range (") == 1
    assert all(abs(r["beta"] - 3) < 1e-9 for r in fit.collect() if r["term"] == "x")


def test_shown_readings_leave_out_the_first_and_keep_the_last(spark):
    rows = spark.createDataFrame([(f"2025-{m:02d}", float(m)) for m in range(1, 13)], "period string, fuel double")
    assert [(r["period"], r["value"]) for r in validation.shown_readings(rows, ["fuel"], last=18).orderBy("period").collect()] == [(f"2025-{m:02d}", float(m)) for m in range(2, 13)]
    assert validation.shown_readings(rows, ["fuel"], last=3).count() == 3


def test_medians_follow_the_stream_batch_by_batch(spark, tmp_path):
    fares = [f"₹{5_000 + 37 * k % 1_009}" for k in range(40)]
    path = feed(tmp_path, {h: [as_json(fare_text=f, collected_at=dt.datetime(2026, 9, 30, h)) for f in fares[h - 4 :: 4]] + [as_json(seats_left=0, fare_text="₹1", collected_at=dt.datetime(2026, 9, 30, h))] for h in (4, 5, 6, 7)})
    where = f"file://{tmp_path}/sketches"
    run = sketch_upkeep(where)

    def twice(batch, epoch):
        run(batch, epoch)
        run(batch, epoch)

    stream_raw_quotes(spark, path, files_per_batch=1).writeStream.foreachBatch(twice).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = current_medians(spark, where).collect()
    assert [(r["route_id"], r["lead_time"], r["quotes"]) for r in got] == [("DEL-BOM", 7, 40)]
    ordered = sorted(5_000 + 37 * k % 1_009 for k in range(40))
    assert ordered[18] <= got[0]["price"] <= ordered[21]


def test_route_fares_store_days_of_routes_and_no_quotes(spark, sf):
    found = q.QUERIES["route_fares"][0](spark, sf)
    plan = plan_of(found)
    assert "/cells-" in plan and "/quotes-" not in plan
    want = market.route_fares(q.clean(spark, sf), column="period")
    assert sorted((r["route_id"], round(r["avg_fare"], 3), r["quotes"], r["origin"]) for r in found.collect()) == sorted((r["route_id"], round(r["avg_fare"], 3), r["quotes"], r["origin"]) for r in want.collect())
