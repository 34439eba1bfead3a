"""Rows and feeds that several tests share."""

import datetime as dt
import json

from pyspark.sql import functions as F

from fareindex.sources import dims
from fareindex.sources.schema import RAW_QUOTES

DAY = dt.datetime(2026, 9, 30, 5, 10)
DEFAULT = {
    "source_id": "indigo", "carrier": "6E", "route_id": "DEL-BOM", "origin": "DEL", "destination": "BOM", "departure": dt.date(2026, 10, 7), "lead_time": 7, "fare_class": "VALUE",
    "flight_no": "6E123", "fare_text": "₹6,500", "tax_text": "₹1,240", "fee_text": "—", "seats_left": 9, "refundable": False, "baggage_kg": 15, "collected_at": DAY,
    "sold_out": False, "is_cancelled": False, "is_synthetic": False,
}


def raw(spark, *changes):
    rows = [tuple((DEFAULT | c)[f.split()[0]] for f in RAW_QUOTES.split(", ")) for c in changes]
    return spark.createDataFrame(rows, RAW_QUOTES).withColumn("obs_date", F.to_date("collected_at"))


def basket(spark, price=1.0, quality=1.0, day="2026-09-30"):
    rows = [(dt.date.fromisoformat(day), route[0], lead, 7200.0 * price, 0.95 * quality, 1) for route in dims.ROUTES for lead in dims.LEADS]
    return spark.createDataFrame(rows, "obs_date date, route_id string, lead_time int, price double, quality double, quotes long")


def as_json(**changes):
    row = {k: v for k, v in (DEFAULT | changes).items() if v is not None}
    return json.dumps(row | {"departure": "2026-10-07", "collected_at": row["collected_at"].isoformat() + "Z"})


def feed(tmp_path, hours):
    for hour, lines in hours.items():
        folder = tmp_path / "feed/2026/09/30"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{hour:02d}.jsonl").write_text("\n".join(lines) + "\n")
    return f"file://{tmp_path}/feed"
