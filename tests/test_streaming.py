"""The stream against the batch path."""

import datetime as dt

from pyspark.sql import functions as F
from quote_rows import as_json, basket, feed

from fareindex.operators import cells, indexing
from fareindex.operators.cleaning import clean_quotes, first_quotes
from fareindex.sources import dims, io
from fareindex.streaming.ingest import error_windows, stream_raw_quotes, upkeep


def test_stream_drops_repeats_and_keeps_points_current(spark, tmp_path):
    weights = dims.route_weights(dims.routes(spark))
    base = indexing.base_snapshot(cells.route_prices(basket(spark)), "2026-09-30")
    raw, points = f"file://{tmp_path}/raw", f"file://{tmp_path}/points"
    path = feed(tmp_path, {5: [as_json(), as_json(), as_json(fare_text="₹7,000")]})

    def run():
        q = stream_raw_quotes(spark, path, files_per_batch=1).writeStream.foreachBatch(upkeep(raw, points, base, weights))
        q = q.option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    assert io.read_quotes(spark, raw).count() == 2
    first = io.read_points(spark, points).collect()
    feed(tmp_path, {6: [as_json(), as_json(fare_text="₹9,000", collected_at=dt.datetime(2026, 9, 30, 6))]})
    run()
    assert io.read_quotes(spark, raw).count() == 3
    last = io.read_points(spark, points).collect()
    assert len(first) == len(last) == 1 and last[0]["value"] > first[0]["value"]
    prices = cells.route_prices(cells.cell_prices(clean_quotes(io.read_quotes(spark, raw))))
    assert abs(indexing.build_index(indexing.route_relatives(prices, base, weights)).first()["value"] - last[0]["value"]) < 1e-9


def test_a_sold_out_quote_does_not_hide_one_on_sale(spark, tmp_path):
    at = lambda hour, **changes: as_json(collected_at=dt.datetime(2026, 9, 30, hour), **changes)
    hours = {5: [at(5, seats_left=0), at(5, carrier="AI", is_cancelled=True)], 6: [at(6), at(6, carrier="AI"), at(6, carrier="AI")], 7: [at(7), at(7, seats_left=0)]}
    path = feed(tmp_path, hours)
    raw = f"file://{tmp_path}/raw"
    q = stream_raw_quotes(spark, path, files_per_batch=1).writeStream.foreachBatch(lambda batch, _: io.write_quotes(batch, raw))
    for _ in range(2):  # a second run finds nothing new
        q.option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    kept = io.read_quotes(spark, raw)
    assert kept.count() == 4
    whole = io.read_raw_quotes(spark, path).drop("corrupt")
    assert {str(r) for r in clean_quotes(kept).where("not imputed").collect()} == {str(r) for r in clean_quotes(whole).where("not imputed").collect()}
    assert clean_quotes(kept).where("not imputed").count() == 2
    assert first_quotes(whole).count() == 4


def test_error_windows_on_a_stream(spark, sf, tmp_path):
    log = lambda df: df.select("ts", "event_type", (F.col("user_id") % 3).cast("string").alias("source_id"))
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(f"file://{tmp_path}/events")
    want = {tuple(r) for r in error_windows(log(events)).collect()}
    stream = log(spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/events"))
    q = error_windows(stream, delay="60 days").writeStream.format("memory").queryName("windows").outputMode("update").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("windows").collect()} == want
