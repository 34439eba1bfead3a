"""Base snapshots, the fixed-basket index with its quality divisor, and its parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareindex.sources import dims


def around(period: str, base: str, half_window: int, unit: str) -> Column:
    """Whether `period` lies within half_window days or months of the date `base`."""
    day = F.to_date(F.lit(base))
    if unit == "month":
        return F.col(period).between(F.add_months(day, -half_window), F.add_months(day, half_window))
    return F.col(period).between(F.date_sub(day, half_window), F.date_add(day, half_window))


def base_snapshot(prices: DataFrame, base: str, period: str = "obs_date", half_window: int = 3, unit: str = "day", by=("route_id",), method: str = "prices") -> DataFrame:
    """price_0 and quality_0 of each group over the periods around `base`.

    prices: means of period prices. quotes: means of clean quotes (`total_fare`).
    """
    near = prices.where(around(period, base, half_window, unit))
    value = "price" if method == "prices" else "total_fare"
    return near.groupBy(*by).agg(F.avg(value).alias("price_0"), F.avg("quality").alias("quality_0"))


def count_weights(counted: DataFrame, count: str = "raw_quotes", within: Column | None = None) -> DataFrame:
    """(route_id, weight): each route's share of the counts that a stored table carries, in the rows `within`."""
    each = (counted if within is None else counted.where(within)).groupBy("route_id").agg(F.sum(count).alias("n")).where("n > 0")
    return each.crossJoin(F.broadcast(each.agg(F.sum("n").alias("total")))).select("route_id", (F.col("n") / F.col("total")).alias("weight"))


def route_relatives(prices: DataFrame, base: DataFrame, weights: DataFrame) -> DataFrame:
    """Route prices with weight, relative and hedonic divisor; a route without a weight is not in the basket.

    A route that the base lacks is its own base: relative 1, against quality 1,
    so its divisor is 1 / quality. A base without a quality, and a null or zero
    quality, give a divisor of 1.
    """
    known = base.withColumn("has_base", F.lit(True))
    joined = prices.join(weights, "route_id").join(known, "route_id", "left")
    relative = F.coalesce(F.try_divide(F.col("price"), F.col("price_0")), F.lit(1.0))
    before = F.when(F.col("has_base").isNull(), F.lit(1.0)).otherwise(F.col("quality_0"))
    hedonic = F.coalesce(F.try_divide(before, F.col("quality")), F.lit(1.0))
    return joined.withColumns({"relative": relative, "hedonic": hedonic}).drop("has_base")


def build_index(relatives: DataFrame, period: str = "obs_date", missing: str = "skip", by=()) -> DataFrame:
    """Index points of each period (and group of `by`).

    skip: absent routes add nothing. renormalize: weights of the present routes
    are scaled to one. `covered` is their weight.
    """
    w, r, h = F.col("weight"), F.col("relative"), F.col("hedonic")
    sums = relatives.groupBy(period, *by).agg(
        F.sum(w * r).alias("n"),
        F.sum(w * r * h).alias("r"),
        F.sum(w * F.col("quality")).alias("q"),
        F.sum(w).alias("covered"),
        F.sum(w * F.col("price")).alias("basket"),
        F.sum("quotes").alias("observations"),
    )
    scale = F.lit(1.0) if missing == "skip" else F.nullif("covered", F.lit(0.0))
    out = sums.select(
        period,
        *by,
        (F.col("r") / scale * 100).alias("value"),
        (F.col("n") / scale * 100).alias("nominal"),
        (F.col("q") / scale).alias("quality_index"),
        F.coalesce(F.try_divide(F.col("r"), F.col("n")), F.lit(1.0)).alias("hedge_ratio"),
        (F.col("basket") / scale).alias("basket_fare"),
        "covered",
        "observations",
    )
    return out


def sub_index(cells: DataFrame, weights: DataFrame, base: str, by: str, period: str = "obs_date", half_window: int = 3, unit: str = "day") -> DataFrame:
    """Weighted mean price of each group against its own mean around the base, times 100. `by`: lead_time, region or kind."""
    w = F.col("weight")
    level = cells.join(weights, "route_id").groupBy(period, by).agg((F.sum(w * F.col("price")) / F.sum(w)).alias("level"))
    base_level = level.where(around(period, base, half_window, unit)).groupBy(by).agg(F.avg("level").alias("level_0"))
    return level.join(base_level, by).select(period, by, "level", (F.try_divide(F.col("level"), F.col("level_0")) * 100).alias("value"))


def all_groups(cells: DataFrame, weights: DataFrame, period: str = "obs_date") -> DataFrame:
    """Weighted mean prices of the total and by lead, region and route, in one pass: (period, grouping, key, level)."""
    joined = cells.join(weights, "route_id")
    w = F.col("weight")
    sets = [[F.col(period)], [F.col(period), F.col("lead_time")], [F.col(period), F.col("region")], [F.col(period), F.col("route_id")]]
    out = joined.groupingSets(sets, F.col(period), F.col("lead_time"), F.col("region"), F.col("route_id")).agg((F.sum(w * F.col("price")) / F.sum(w)).alias("level"), F.grouping_id().alias("g"))
    name = dims.lookup(F.col("g"), {7: "total", 3: "lead", 5: "region", 6: "route"})
    key = F.coalesce(F.col("lead_time").cast("string"), "region", "route_id", F.lit("all"))
    return out.select(period, name.alias("grouping"), key.alias("key"), "level")


def contributions(relatives: DataFrame, start: str, end: str, period: str = "obs_date") -> DataFrame:
    """Each route's weight, price change and index points between its first and last period in [start, end], largest first."""
    window = relatives.where(F.col(period).between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    ends = window.groupBy("route_id").agg(F.max("weight").alias("weight"), F.min_by("relative", period).alias("first"), F.max_by("relative", period).alias("last"))
    change = F.coalesce(F.try_divide(F.col("last"), F.col("first")) - 1, F.lit(0.0)) * 100
    points = F.col("weight") * (F.col("last") - F.col("first")) * 100
    return ends.select("route_id", (F.col("weight") * 100).alias("weight_pct"), change.alias("change_pct"), points.alias("points")).orderBy(F.desc("points"), "route_id")


def rank_contributions(contributed: DataFrame) -> DataFrame:
    """By the size of change times weight."""
    return contributed.orderBy(F.abs(F.col("change_pct") * F.col("weight_pct")).desc(), "route_id")
