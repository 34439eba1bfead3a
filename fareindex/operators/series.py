"""Series of index points: calendars, smoothing, changes, periods, heat map.

Windows are partitioned by the series key; a series has one row per period, so a
partition is as long as its calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fareindex.functions.parsing import iso_week_key, month_key, percent_change


def index_series(points: DataFrame, start: str | None = None, end: str | None = None, date: str = "date") -> DataFrame:
    """Points between start and end, inclusive, in order."""
    out = points
    if start:
        out = out.where(F.col(date) >= F.to_date(F.lit(start)))
    if end:
        out = out.where(F.col(date) <= F.to_date(F.lit(end)))
    return out.orderBy(date)


def complete_calendar(points: DataFrame, date: str = "date", keys=(), step: str = "1 day") -> DataFrame:
    """A row for every step between each series' first and last date; new rows hold nulls."""
    span = points.groupBy(*keys).agg(F.min(date).alias("a"), F.max(date).alias("b"))
    days = span.select(*keys, F.explode(F.sequence("a", "b", F.expr(f"interval {step}"))).alias(date))
    return days.join(points, [*keys, date], "left")


def ordered(date: str = "date", keys=()):
    return W.partitionBy(*keys).orderBy(date)


def smooth(points: DataFrame, value: str = "value", n: int = 7, date: str = "date", keys=(), name: str = "smoothed") -> DataFrame:
    """Trailing mean over n rows, fewer at the start."""
    return points.withColumn(name, F.avg(value).over(ordered(date, keys).rowsBetween(1 - n, 0)))


def changes(points: DataFrame, value: str = "smoothed", date: str = "date", keys=(), year: int = 365, week: int = 7) -> DataFrame:
    """Adds dod, wow, mom and yoy in percent.

    wow looks `week` rows back, to the first row at most; mom is the last step's
    change on the first row of a month, else 0; yoy is 0 in the first year.
    """
    w, x = ordered(date, keys), F.col(value)
    before = F.lag(x).over(w)
    new_month = F.coalesce(month_key(F.col(date)) != month_key(F.lag(date).over(w)), F.lit(False))
    zero = F.lit(0.0)
    return points.withColumns(
        {
            "dod": F.coalesce(percent_change(before, x), zero),
            "wow": percent_change(F.coalesce(F.lag(x, week).over(w), F.first(x).over(w)), x),
            "mom": F.when(new_month, percent_change(before, x)).otherwise(zero),
            "yoy": F.coalesce(percent_change(F.lag(x, year).over(w), x), zero),
        }
    )


def period_series(points: DataFrame, freq: str = "month", value: str = "value", date: str = "date", keys=(), yoy_lag: int | None = None, pick: str = "mean") -> DataFrame:
    """Means of each month or ISO week, or with pick "last" its last value, with changes to the period before and a year before (null where there is none)."""
    key = month_key(F.col(date)) if freq == "month" else iso_week_key(F.col(date))
    one = F.avg(value) if pick == "mean" else F.max_by(value, date)
    out = points.groupBy(*keys, key.alias("period")).agg(one.alias("value"), F.count("*").alias("n"))
    w = ordered("period", keys)
    back = yoy_lag or (12 if freq == "month" else 52)
    return out.withColumns(
        {
            "change": percent_change(F.lag("value").over(w), F.col("value")),
            "yoy": percent_change(F.lag("value", back).over(w), F.col("value")),
        }
    )


def headline(points: DataFrame, value: str = "smoothed", date: str = "date") -> DataFrame:
    """The last value against the mean of the month before its own, in points and percent."""
    last = points.agg(F.max(date).alias("last_date"), F.max_by(value, date).alias("last_value"))
    months = points.groupBy(month_key(F.col(date)).alias("period")).agg(F.avg(value).alias("month_mean"))
    joined = last.withColumn("period", month_key(F.add_months("last_date", -1))).join(months, "period", "left")
    gap = F.col("last_value") - F.col("month_mean")
    return joined.select("last_date", "last_value", "month_mean", gap.alias("points"), percent_change(F.col("month_mean"), F.col("last_value")).alias("percent"))


def tail(points: DataFrame, n: int, date: str = "date") -> DataFrame:
    """The last n rows, in order."""
    return points.orderBy(F.desc(date)).limit(n).orderBy(date)


def rebase(series: DataFrame, value: str = "value", date: str = "date", keys=(), last: int = 400) -> DataFrame:
    """The last `last` rows of each series, divided by the first of them, times 100. Series of one row are left out."""
    w = W.partitionBy(*keys)
    recent = series.withColumns({"nth": F.row_number().over(w.orderBy(F.desc(date))), "rows": F.count("*").over(w)}).where((F.col("nth") <= last) & (F.col("rows") > 1))
    return recent.drop("nth", "rows").withColumn("rebased", F.try_divide(F.col(value), F.first(value).over(ordered(date, keys))) * 100)


def latest_changes(rebased: DataFrame, keys, date: str = "date", year: int = 365) -> DataFrame:
    """For each series its last rebased value, its change over one row and over `year` rows (or from the first), by the latter."""
    w = ordered(date, keys)
    x = F.col("rebased")
    step = rebased.withColumns({"one": percent_change(F.lag(x).over(w), x), "year": percent_change(F.coalesce(F.lag(x, year).over(w), F.first(x).over(w)), x)})
    out = step.groupBy(*keys).agg(F.max_by("rebased", date).alias("last_value"), F.max_by("one", date).alias("change_1"), F.max_by("year", date).alias("change_year"))
    return out.orderBy(F.desc("change_year"), *keys)


def expanding_mean(series: DataFrame, value: str, date: str, keys=(), name: str = "expanding") -> DataFrame:
    return series.withColumn(name, F.avg(value).over(ordered(date, keys).rowsBetween(W.unboundedPreceding, 0)))


def differences(series: DataFrame, value: str = "value", date: str = "date", keys=()) -> DataFrame:
    return series.withColumn("diff", F.col(value) - F.lag(value).over(ordered(date, keys)))


def log_changes(series: DataFrame, value: str = "value", date: str = "period", keys=()) -> DataFrame:
    """ln(x / x before); null at the start and where either is not positive."""
    before = F.lag(value).over(ordered(date, keys))
    ok = (F.col(value) > 0) & (before > 0)
    return series.withColumn("log_change", F.when(ok, F.ln(F.col(value) / before)))


def average_rank(x: str, keys=()) -> Column:
    """Ranks from 1; ties share their mean rank."""
    return F.rank().over(W.partitionBy(*keys).orderBy(x)) + (F.count("*").over(W.partitionBy(*keys, x)) - 1) / 2


def route_month_heatmap(relatives: DataFrame, date: str = "obs_date", wide: bool = False) -> DataFrame:
    """Monthly mean of each route's relative, times 100, and its change to the month before (first: 0)."""
    cells = relatives.groupBy("route_id", month_key(F.col(date)).alias("month")).agg((F.avg("relative") * 100).alias("index"))
    before = F.lag("index").over(ordered("month", ["route_id"]))
    out = cells.withColumn("mom", F.coalesce(percent_change(before, F.col("index")), F.lit(0.0)))
    return out.groupBy("route_id").pivot("month").agg(F.first("index")) if wide else out


def quality_series(points: DataFrame, n: int = 180, date: str = "date") -> DataFrame:
    return tail(points.select(date, "nominal", "value", "quality_index", "hedge_ratio"), n, date)


def release_rows(points: DataFrame, date: str = "date") -> DataFrame:
    """Points in release form: rounded, with date and month labels."""
    return points.select(
        F.date_format(date, "yyyy-MM-dd").alias("period"),
        F.round("value", 2).alias("index"),
        F.round("nominal", 2).alias("nominal"),
        F.round("quality_index", 4).alias("quality"),
        F.round("hedge_ratio", 4).alias("hedge_ratio"),
        "observations",
    )


def nested_series(rows: DataFrame, keys=("period",), name: str = "grouping", value: str = "value") -> DataFrame:
    """Long to nested: a map of group to value for each key."""
    return rows.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, value)))).alias("values"))
