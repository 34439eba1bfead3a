"""Raw quotes, sweep logs and monthly series as views of order and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareindex.functions.parsing import month_key
from fareindex.sources import dims

ORDER = ["collected_at", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
CELL = ["period", "route_id", "lead_time"]
LEADS = list(dims.LEADS)
CARRIERS = list(dims.FARE_INDEX)
SOURCE_IDS = list(dims.SOURCE_FEE)
CLASSES = {"SMALL": "SAVER", "STANDARD": "VALUE", "MEDIUM": "FLEX", "LARGE": "PREMIUM", "PROMO": "BIZ"}
LOW_COST = [code for code, group, *_ in dims.CARRIERS if group == "LCC"]
SWEEP_KINDS = {"error": "http_errors", "click": "retries", "signup": "block_events"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list, index) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw quote for each order line: routes run from the customer's region to the supplier's."""
    read = lambda name: table(spark, sf_dir, name)
    regions = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    home = read("customer").join(regions, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r_name").alias("region"))
    # the nations are joined last: Spark's size of a join is a product, so suppliers joined to them never look small, and all lines would be shuffled for them
    away = read("supplier").select("s_suppkey", "s_nationkey")
    to_regions = regions.select(F.col("n_nationkey").alias("s_nationkey"), F.col("r_name").alias("to_region"))
    days = [F.to_date("o_orderdate").alias("obs_date"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("period")]  # here, not for each line
    orders = read("orders").join(home, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate", *days, "o_orderstatus", "region")
    kinds = read("part").select("p_partkey", dims.lookup(F.split("p_type", " ")[0], CLASSES, "UNKNOWN").alias("fare_class"))
    lines = read("lineitem").join(away, F.col("l_suppkey") == F.col("s_suppkey")).join(kinds, F.col("l_partkey") == F.col("p_partkey"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(F.broadcast(to_regions), "s_nationkey")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    whole, cents, tax = F.floor(price + 0.5), F.floor(price * 100 + 0.5), F.floor(price * F.col("l_tax") + 0.5)
    carrier = _pick(CARRIERS, F.col("l_suppkey") % 5)
    form = F.col("l_linenumber") % 3
    fare_text = (
        F.when(form == 0, F.concat(F.lit("₹"), F.format_number(whole, 0)))
        .when(form == 1, F.concat(F.lit("Rs. "), whole.cast("string")))
        .otherwise(F.concat(F.lit("INR "), F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")))
    )
    return rows.select(
        "obs_date",
        "period",
        F.concat("region", F.lit("-"), "to_region").alias("route_id"),
        "region",
        _pick(LEADS, F.col("l_partkey") % 5).alias("lead_time"),
        carrier.alias("carrier"),
        _pick(SOURCE_IDS, F.col("l_suppkey") % 11).alias("source_id"),
        "fare_class",
        fare_text.alias("fare_text"),
        F.when(F.col("l_linestatus") == "O", "inclusive of taxes").otherwise(F.concat(F.lit("₹"), tax.cast("string"))).alias("tax_text"),
        (F.col("l_quantity").cast("int") % 20).alias("seats_left"),
        ((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7)).alias("is_cancelled"),
        (F.col("l_returnflag") == "N").alias("refundable"),
        F.when(carrier.isin(LOW_COST), 15).otherwise(25).alias("baggage_kg"),
        F.col("o_orderdate").alias("collected_at"),
        (F.col("o_orderstatus") == "F").alias("is_synthetic"),
        *ORDER[1:],
    )


def traffic_weights(raw: DataFrame, year: int = 1995) -> DataFrame:
    """(route_id, weight): each route's share of that year's quotes."""
    each = raw.where(F.year("obs_date") == year).groupBy("route_id").agg(F.count("*").alias("n"))
    return each.crossJoin(F.broadcast(each.agg(F.sum("n").alias("total")))).select("route_id", (F.col("n") / F.col("total")).alias("weight"))


def reference_series(spark: SparkSession, sf_dir: str, by_region: bool = False) -> DataFrame:
    """Monthly mean order totals: an outside series to compare with."""
    return table(spark, sf_dir, "orders").groupBy(month_key(F.col("o_orderdate")).alias("period")).agg(F.avg("o_totalprice").alias("value"))


def covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return months.groupBy(month_key(F.col("o_orderdate")).alias("period")).agg(F.avg("l_quantity").alias("quantity"), F.avg("o_totalprice").alias("total"), F.count("*").cast("double").alias("lines"))


def daily_covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, quantity, total, lines): each order day's means and number of lines, from lines added up by order first."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    each = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"), "o_totalprice").join(lines, "o_orderkey")
    sums = each.groupBy("date").agg(F.sum("q").alias("q"), F.sum("n").alias("n"), F.sum(F.col("o_totalprice") * F.col("n")).alias("t"))
    return sums.select("date", (F.col("q") / F.col("n")).alias("quantity"), (F.col("t") / F.col("n")).alias("total"), F.col("n").cast("double").alias("lines"))


def sweep_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a sweep's counters."""
    events = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    one = lambda c: c.cast("long")
    return events.select(
        F.to_date("ts").alias("date"),
        "ts",
        "event_type",
        _pick(SOURCE_IDS, F.col("user_id") % 11).alias("source_id"),
        one(~kind.isin(*SWEEP_KINDS)).alias("requests"),
        one(kind == "purchase").alias("raw_quotes"),
        *[one(kind == k).alias(v) for k, v in SWEEP_KINDS.items()],
        F.col("value").alias("duration_ms"),
    )
