"""Incremental ingest: de-duplicated raw feed, upkeep of touched days, error windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareindex.operators.cells import cell_prices, cell_sketches, merge_sketches, route_prices, sketched_prices
from fareindex.operators.cleaning import CELL, DUPLICATE_KEY, clean_quotes, decompose, unavailable
from fareindex.operators.indexing import build_index, route_relatives
from fareindex.sources.io import committed_days, read_quotes, upsert_points, with_defaults, write_quotes
from fareindex.sources.schema import RAW_QUOTES


def stream_raw_quotes(spark: SparkSession, path: str, schema: str = RAW_QUOTES, files_per_batch: int = 1_000) -> DataFrame:
    """The hourly feed as a stream, without repeats of a quote within a day. State lasts one day past the watermark.

    A quote that is sold out or cancelled is no repeat of one on sale: cleaning
    drops such rows before it looks for repeats.
    """
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(f"{path}/*/*/*/*.jsonl")
    keyed = with_defaults(raw).withColumn("obs_date", F.to_date("collected_at")).withWatermark("collected_at", "1 day")
    keyed = keyed.withColumn("status", F.coalesce(unavailable(keyed), F.lit("on sale")))
    return keyed.dropDuplicatesWithinWatermark(["obs_date", *DUPLICATE_KEY, "status"]).drop("status")


def upkeep(raw_path: str, points_path: str, base: DataFrame, weights: DataFrame, stream: str = "feed") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: commit the batch, then recompute each day it touches from the whole raw table.

    The batch is stored under the names of `stream` and its epoch, so one that
    is delivered again replaces itself. A stream that starts from a new
    checkpoint counts its epochs anew and needs another name. The batch is
    evaluated once: its days are read off the partitions it wrote. Medians do
    not merge, so a touched day is cleaned anew; repeats from other batches drop
    out there.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        commit = f"{stream}-{epoch:012d}"
        write_quotes(batch, raw_path, commit=commit)
        days = [F.to_date(F.lit(d)) for d in committed_days(spark, raw_path, commit)]  # a batch of hourly files has few
        if not days:
            return
        raw = read_quotes(spark, raw_path).where(F.col("obs_date").isin(days)).drop("commit")
        prices = route_prices(cell_prices(clean_quotes(raw, CELL)))
        points = build_index(route_relatives(prices, base, weights))
        fresh = points.select(F.col("obs_date").alias("date"), "value", "nominal", "quality_index", "hedge_ratio", F.col("basket_fare").alias("avg_fare"), "observations", F.lit(False).alias("is_synthetic"))
        upsert_points(spark, points_path, fresh)

    return run


def sketch_upkeep(path: str, cell=("route_id", "lead_time"), stream: str = "feed") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the fare distribution of coarse cells current at the cost of the batch alone.

    The sketches of a batch's valid quotes are stored under its stream and
    epoch, so a batch that is delivered again replaces its own. Outliers aren't
    told within a batch; a median doesn't move by them.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        priced = decompose(batch).where(unavailable(batch).isNull() & (F.col("fare") > 0))
        named = cell_sketches(priced, cell).withColumn("commit", F.lit(f"{stream}-{epoch:012d}"))
        named.write.partitionBy("commit").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)

    return run


def current_medians(spark: SparkSession, path: str, cell=("route_id", "lead_time"), q: float = 0.5) -> DataFrame:
    """price (the q-quantile), quality and quotes of each cell over all batches that `sketch_upkeep` has stored."""
    kept = spark.read.parquet(path).drop("commit")
    return sketched_prices(merge_sketches(kept, kept.limit(0), cell), cell, q)


def error_windows(log: DataFrame, width: str = "1 day", delay: str = "1 day", time: str = "ts") -> DataFrame:
    """Errors and blocks of each source in event-time windows; works on streams and tables."""
    return (
        log.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, delay)
        .groupBy(F.window(time, width), "source_id")
        .agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("http_errors"), F.count_if(F.col("event_type") == "signup").alias("block_events"))
    )
