"""Dimensions of the price basket: tens of rows each, all replaceable by a caller's own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The published basket, its carriers, lead windows, fare classes and sources.
ROUTES = [  # route, traffic weight, region
    ("DEL-BOM", 4.2, "West"),
    ("DEL-BLR", 3.6, "South"),
    ("DEL-HYD", 2.9, "South"),
    ("BOM-BLR", 2.4, "South"),
    ("DEL-CCU", 2.1, "East"),
    ("BLR-HYD", 1.9, "South"),
    ("MAA-DEL", 1.8, "South"),
    ("BLR-COK", 1.7, "South"),
    ("DEL-COK", 1.6, "South"),
    ("DEL-JAI", 1.5, "North"),
    ("HYD-BOM", 1.4, "West"),
    ("DEL-PNQ", 1.3, "West"),
    ("DEL-TRV", 1.1, "South"),
    ("CCU-BLR", 1.1, "East"),
    ("DEL-IXC", 1.0, "North"),
    ("BLR-MAA", 1.0, "South"),
    ("BOM-CCU", 1.0, "East"),
    ("HYD-CCU", 0.9, "East"),
    ("BOM-GOI", 0.9, "West"),
    ("PNQ-BLR", 0.7, "West"),
    ("CCU-PNQ", 0.6, "East"),
    ("DEL-VNS", 0.6, "North"),
    ("IDR-DEL", 0.6, "Central"),
    ("DEL-LKO", 0.5, "North"),
]
CARRIERS = [  # code, group, seat share, fare index, amenity
    ("6E", "LCC", 0.42, 0.97, 0.74),
    ("AI", "Full Service", 0.22, 1.14, 0.93),
    ("QP", "LCC", 0.12, 0.9, 0.78),
    ("SG", "LCC", 0.11, 0.93, 0.71),
    ("IX", "LCC", 0.13, 0.88, 0.66),
]
LEADS = {1: 0.08, 7: 0.42, 15: 0.22, 30: 0.18, 45: 0.10}
FARE_CLASSES = [  # code, quality
    ("SAVER", 0.7),
    ("VALUE", 0.95),
    ("FLEX", 1.22),
    ("PREMIUM", 1.55),
    ("BIZ", 2.4),
]
SOURCES = [  # id, kind, carrier, convenience fee
    ("indigo", "airline", "6E", 0.0),
    ("airindia", "airline", "AI", 0.0),
    ("akasaair", "airline", "QP", 0.0),
    ("spicejet", "airline", "SG", 0.0),
    ("aiaexpress", "airline", "IX", 0.0),
    ("makemytrip", "ota", None, 48.0),
    ("yatra", "ota", None, 40.0),
    ("easemytrip", "ota", None, 35.0),
    ("cleartrip", "ota", None, 55.0),
    ("ixigo", "ota", None, 42.0),
    ("goibibo", "ota", None, 44.0),
]
DEFAULT_QUALITY = 0.95
INCLUSIVE_TAX = 0.194
IMPUTED_BASE, IMPUTED_TAX = 0.82, 0.18
REFERENCE_FARE_INDEX = 0.97

FARE_INDEX = {code: index for code, _, _, index, _ in CARRIERS}
SEAT_SHARE = {code: share for code, _, share, _, _ in CARRIERS}
AMENITY = {code: amenity for code, _, _, _, amenity in CARRIERS}
CLASS_QUALITY = dict(FARE_CLASSES)
SOURCE_FEE = {row[0]: row[3] for row in SOURCES}
SOURCE_KIND = {row[0]: row[1] for row in SOURCES}


def lookup(key: Column, table: dict, default=None) -> Column:
    """A small dictionary as an expression: no join, no shuffle."""
    if not table:
        return F.lit(default)
    cases = reduce(lambda c, kv: c.when(key == F.lit(kv[0]), F.lit(kv[1])), list(table.items())[1:], F.when(key == F.lit(next(iter(table))), F.lit(next(iter(table.values())))))
    return cases if default is None else cases.otherwise(F.lit(default))


def routes(spark: SparkSession) -> DataFrame:
    rows = [(r, *r.split("-"), w, region) for r, w, region in ROUTES]
    return spark.createDataFrame(rows, "route_id string, origin string, destination string, traffic_weight double, region string")


def route_weights(routes: DataFrame) -> DataFrame:
    """(route_id, weight): traffic weights that sum to one."""
    total = routes.agg(F.sum("traffic_weight").alias("total"))
    return routes.crossJoin(F.broadcast(total)).select("route_id", (F.col("traffic_weight") / F.col("total")).alias("weight"))


def carriers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CARRIERS, "carrier string, carrier_group string, seat_share double, fare_index double, amenity double")


def leads(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEADS.items()), "lead_time int, lead_weight double")


def fare_classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FARE_CLASSES, "fare_class string, quality double")


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, "source_id string, kind string, carrier string, convenience_fee double")
