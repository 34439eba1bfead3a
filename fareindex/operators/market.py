"""Daily market views: fares by route and lead, booking curve, channel wedge, cell explorer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fareindex.functions.aggregates import weighted_mean
from fareindex.functions.parsing import data_origin, percent_change
from fareindex.sources import dims


def on_date(df: DataFrame, date: str | None = None, offset: int = 0, column: str = "obs_date") -> DataFrame:
    """Rows of `date`, or of the latest date less `offset` days. The latest is one row, looked up first."""
    if date:
        return df.where(F.col(column) == F.to_date(F.lit(date)))
    latest = df.agg(F.date_sub(F.max(column), offset).alias("latest"))
    return df.join(F.broadcast(latest), F.col(column) == F.col("latest"), "left_semi")


def route_days(clean: DataFrame, column: str = "obs_date") -> DataFrame:
    """Each date's routes with their mean fare, in one pass: a small table to store, of which `on_date` takes the latest date without a second run of the funnel."""
    return clean.groupBy(column, "route_id").agg(F.avg("total_fare").alias("avg_fare"), F.count("*").alias("quotes"), data_origin(F.col("is_synthetic")).alias("origin"))


def route_fares(clean: DataFrame, date: str | None = None, column: str = "obs_date") -> DataFrame:
    return route_days(on_date(clean, date, column=column), column).drop(column).orderBy(F.desc("avg_fare"), "route_id")


def lead_fares(clean: DataFrame, date: str | None = None, column: str = "obs_date") -> DataFrame:
    rows = on_date(clean, date, column=column)
    return rows.groupBy("lead_time").agg(F.avg("total_fare").alias("avg_fare"), data_origin(F.col("is_synthetic")).alias("origin")).orderBy("lead_time")


def lead_elasticity(cells: DataFrame, weights: DataFrame, end: str | None = None, days: int = 21, ref_lead: int = 7, period: str = "obs_date") -> DataFrame:
    """Weighted mean price of each lead over the last `days` days, its premium over `ref_lead` and elasticity ln(v / v_ref) / ln(lead / ref).

    `end` defaults to the last date.
    """
    last = cells.agg(F.max(period).alias("last_day")) if end is None else cells.sparkSession.range(1).select(F.to_date(F.lit(end)).alias("last_day"))
    near = cells.join(F.broadcast(last), (F.col(period) <= F.col("last_day")) & (F.col(period) > F.date_sub("last_day", days)), "left_semi")
    level = near.join(weights, "route_id").groupBy("lead_time").agg(weighted_mean(F.col("price"), F.col("weight")).alias("level"))
    ref = level.where(F.col("lead_time") == ref_lead).select(F.col("level").alias("ref_level"))
    curve = level.crossJoin(F.broadcast(ref))
    ratio = F.try_divide(F.col("level"), F.col("ref_level"))
    slope = F.when(F.col("lead_time") == ref_lead, 0.0).otherwise(F.ln(ratio) / F.ln(F.col("lead_time") / F.lit(float(ref_lead))))
    return curve.select("lead_time", "level", (ratio * 100).alias("index"), percent_change(F.col("ref_level"), F.col("level")).alias("premium_pct"), slope.alias("elasticity")).orderBy("lead_time")


def booking_summary(curve: DataFrame, first: int = 1, last: int = 45) -> DataFrame:
    """Cheapest lead (the earliest on ties), its saving against `first`, and the rise from it to `last`, in percent."""
    at = lambda lead: F.max(F.when(F.col("lead_time") == lead, F.col("level")))
    best = curve.agg(F.min_by("lead_time", F.struct("level", "lead_time")).alias("trough_lead"), F.min("level").alias("trough"), at(first).alias("a"), at(last).alias("b"))
    return best.select("trough_lead", "trough", (-percent_change(F.col("a"), F.col("trough"))).alias("saving_pct"), percent_change(F.col("trough"), F.col("b")).alias("late_rise_pct"))


def channel_wedge(clean: DataFrame, date: str | None = None, stat: str = "avg", column: str = "obs_date", every_date: bool = False) -> DataFrame:
    """Each route's direct and agency fare and the wedge between them, where both channels are seen. Imputed rows are of no channel."""
    rows = clean if every_date else on_date(clean, date, column=column)
    kind = dims.lookup(F.col("source_id"), dims.SOURCE_KIND)
    f = F.avg if stat == "avg" else F.median
    of = lambda k: f(F.when(kind == k, F.col("total_fare")))
    both = rows.groupBy("route_id").agg(of("airline").alias("direct_fare"), of("ota").alias("ota_fare")).where("direct_fare is not null and ota_fare is not null")
    wedge = F.col("ota_fare") - F.col("direct_fare")
    return both.select("*", wedge.alias("wedge"), percent_change(F.col("direct_fare"), F.col("ota_fare")).alias("wedge_pct")).orderBy(F.desc("wedge_pct"), "route_id")


def mean_wedge(wedges: DataFrame) -> DataFrame:
    return wedges.agg(F.avg("wedge_pct").alias("mean_wedge_pct"), F.count("*").alias("routes"))


def explore_cell(clean: DataFrame, route_id: str, date: str | None = None, ref: str = "lead7", column: str = "obs_date") -> DataFrame:
    """Mean fares of one route and date: total, by lead and by carrier, in one pass, with the premium over T+7 or the overall mean."""
    rows = on_date(clean.where(F.col("route_id") == route_id), date, column=column)
    sets = [[F.col("lead_time")], [F.col("carrier")], []]
    each = rows.groupingSets(sets, "lead_time", "carrier").agg(F.avg("total_fare").alias("avg_fare"), F.count("*").alias("quotes"), F.grouping_id().alias("g"))
    name = dims.lookup(F.col("g"), {1: "lead", 2: "carrier", 3: "total"})
    key = F.coalesce(F.col("lead_time").cast("string"), "carrier", F.lit("all"))
    each = each.select(name.alias("grouping"), key.alias("key"), "avg_fare", "quotes")
    pick = (F.col("grouping") == "lead") & (F.col("key") == "7") if ref == "lead7" else F.col("grouping") == "total"
    reference = each.agg(F.max(F.when(pick, F.col("avg_fare"))).alias("ref_fare"))
    return each.crossJoin(F.broadcast(reference)).select("grouping", "key", "avg_fare", "quotes", percent_change(F.col("ref_fare"), F.col("avg_fare")).alias("premium_pct"))


def sample_rows(df: DataFrame, n: int, by, order_by) -> DataFrame:
    """The first n rows of each group in a fixed order."""
    nth = F.row_number().over(W.partitionBy(*by).orderBy(*order_by))
    return df.withColumn("nth", nth).where(F.col("nth") <= n)


def top(df: DataFrame, n: int, by: str, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(n)
