"""Reports that a user calls, each a composition of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareindex.operators import audit, cleaning, indexing, market, series
from fareindex.sources import dims


def headline_report(points: DataFrame, relatives: DataFrame, period: str = "obs_date", top: int = 8) -> DataFrame:
    """The headline's figures and the heaviest routes' fare, change to the base and weight, as (section, key, value)."""
    smoothed = series.changes(series.smooth(points))
    last = smoothed.agg(*[F.max_by(c, "date").alias(c) for c in ("value", "smoothed", "dod", "wow", "mom", "yoy", "nominal", "quality_index")])
    names = last.columns
    figures = last.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("key", "value")).select(F.lit("headline").alias("section"), "key", "value")
    step = series.headline(smoothed).select(F.lit("month").alias("section"), F.lit("percent").alias("key"), F.col("percent").alias("value"))
    now = market.on_date(relatives, column=period).orderBy(F.desc("weight"), "route_id").limit(top)
    each = now.select("route_id", F.explode(F.create_map(F.lit("fare"), "price", F.lit("change_pct"), (F.col("relative") - 1) * 100, F.lit("weight_pct"), F.col("weight") * 100)).alias("what", "value"))
    rows = each.select(F.concat(F.lit("route_"), "what").alias("section"), F.col("route_id").alias("key"), "value")
    return figures.unionByName(step).unionByName(rows)


def series_report(points: DataFrame, freq: str = "day") -> DataFrame:
    """Daily points with changes, or weekly or monthly means of the smoothed headline."""
    smoothed = series.smooth(points)
    return series.changes(smoothed) if freq == "day" else series.period_series(smoothed, freq, "smoothed")


def sub_index_report(cells: DataFrame, weights: DataFrame, base: str, period: str = "obs_date", last: int = 400, **window) -> DataFrame:
    """Lead and region series, rebased to their first of the last `last` points."""
    parts = []
    for by in ("lead_time", "region"):
        one = indexing.sub_index(cells, weights, base, by, period, **window).withColumn("key", F.col(by).cast("string"))
        parts.append(series.rebase(one.select("key", period, "value"), "value", period, ["key"], last).withColumn("grouping", F.lit(by)))
    return parts[0].unionByName(parts[1])


def basket_report(relatives: DataFrame, cells: DataFrame, weights: DataFrame, period: str = "obs_date") -> DataFrame:
    """Weights and latest index of each route, and the latest level of each lead window."""
    routes = market.on_date(relatives, column=period).select(F.lit("route").alias("section"), F.col("route_id").alias("key"), (F.col("weight") * 100).alias("weight_pct"), (F.col("relative") * 100).alias("value"))
    levels = market.on_date(indexing.all_groups(cells, weights, period).where("grouping = 'lead'"), column=period)
    windows = levels.select(F.lit("lead").alias("section"), "key", (dims.lookup(F.col("key"), {str(k): v for k, v in dims.LEADS.items()}) * 100).alias("weight_pct"), F.col("level").alias("value"))
    return routes.unionByName(windows)


def pipeline_report(sources: DataFrame, audited: DataFrame) -> DataFrame:
    """Every source's last run and its share of all quotes."""
    return audit.last_runs(sources.select("source_id", "kind"), audited).join(audit.source_shares(audited).select("source_id", "share_pct"), "source_id", "left")


def explorer_report(tagged: DataFrame, route_id: str, date: str, cell, period: str = "obs_date", n: int = 24) -> DataFrame:
    """One route and date, raw to clean: counts by reason, then fares by lead and carrier, as (section, key, value, quotes)."""
    here = tagged.where((F.col("route_id") == route_id) & (F.col(period) == F.to_date(F.lit(date))))
    funnel = here.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("key")).agg(F.count("*").alias("quotes"))
    funnel = funnel.select(F.lit("funnel").alias("section"), "key", F.lit(None).cast("double").alias("value"), "quotes")
    fares = market.explore_cell(cleaning.impute_missing(here, cell), route_id, date, column=period)
    return funnel.unionByName(fares.select(F.col("grouping").alias("section"), "key", F.col("avg_fare").alias("value"), "quotes"))
