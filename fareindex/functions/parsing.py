"""Text to numbers, keys and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT = r"([0-9][0-9,]*(?:[.][0-9]+)?)"


def parse_amount(text: Column) -> Column:
    """The first number of a price text, commas dropped; 0 without one or for null."""
    return F.coalesce(F.replace(F.regexp_extract(text, AMOUNT, 1), F.lit(","), F.lit("")).try_cast("double"), F.lit(0.0))


def parse_int(text: Column) -> Column:
    """All digits of the text as an integer; null without a digit, which means unknown."""
    return F.regexp_replace(text, "[^0-9]", "").try_cast("int")


def parse_flight(text: Column) -> Column:
    """The flight number in a text without its blanks, else that text."""
    packed = F.regexp_replace(text, r"\s", "")
    return F.coalesce(F.nullif(F.regexp_extract(packed, r"(?:6E|IX)[0-9]{2,4}", 0), F.lit("")), packed)


def flight_carrier(text: Column) -> Column:
    """The first two characters of a flight number; XX if it has fewer."""
    packed = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")
    return F.when(F.length(packed) >= 2, F.substring(packed, 1, 2)).otherwise("XX")


def is_flexible(fare_class: Column) -> Column:
    return F.lower(F.coalesce(fare_class, F.lit(""))).contains("flex")


def baggage_of(fare_class: Column) -> Column:
    return F.when(F.lower(F.coalesce(fare_class, F.lit(""))).contains("lite"), F.lit(15)).otherwise(F.lit(25))


def origin(route: Column) -> Column:
    return F.split(route, "-")[0]


def destination(route: Column) -> Column:
    return F.try_element_at(F.split(route, "-"), F.lit(2))


def departure_date(day: Column, lead: Column) -> Column:
    return F.date_add(day, lead)


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def month_label(day: Column) -> Column:
    return F.date_format(day, "MMM yy")


def iso_week_key(day: Column) -> Column:
    """ISO week-year and week, as 2025-W01."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def epoch_day(day: Column) -> Column:
    return F.unix_date(day)


def day_of_epoch(n: Column) -> Column:
    return F.date_from_unix_date(n)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def percent_change(before: Column, after: Column) -> Column:
    """(after - before) / before in percent; 0 where before is 0."""
    return F.when(before == 0, F.lit(0.0)).otherwise((after - before) / F.nullif(before, F.lit(0.0)) * 100)


def data_origin(is_synthetic: Column) -> Column:
    """Aggregate: mixed, simulated or live. Null counts as live."""
    fake = F.coalesce(is_synthetic, F.lit(False))
    return F.when(F.bool_or(fake) & F.bool_or(~fake), "mixed").when(F.bool_or(fake), "simulated").otherwise("live")
