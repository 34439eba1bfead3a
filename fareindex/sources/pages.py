"""Quotes out of fetched HTML pages."""

from __future__ import annotations

from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fareindex.functions.parsing import baggage_of, flight_carrier, is_flexible, parse_amount, parse_flight, parse_int

# Texts of pages that challenge a reader.
CHALLENGES = ("captcha", "unusual traffic", "verify you are human", "access denied", "cf-challenge", "_incapsula_resource")
FIELDS = ("fare", "fare_class", "flight", "seats")
PAGES_AT_ONCE = 64  # pages that a task holds as Python texts
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def is_challenge(html: Column, markers=CHALLENGES) -> Column:
    return F.coalesce(F.lower(html).rlike("|".join(m.lower() for m in markers)), F.lit(False))


def flag_challenges(pages: DataFrame, markers=CHALLENGES) -> DataFrame:
    return pages.withColumn("blocked", is_challenge(F.col("html"), markers))


@dataclass(frozen=True)
class Selectors:
    """Where a source keeps its fields: each is `tag`, `.class` or `[attr=value]`."""

    container: str
    fare: str
    fare_class: str = ""
    flight: str = ""
    seats: str = ""
    carrier: str | None = None  # of an airline's own pages; agencies name it in the flight number
    fee_text: str = "—"


def matches(selector: str, tag: str, attrs: dict) -> bool:
    if selector.startswith("."):
        return selector[1:] in (attrs.get("class") or "").split()
    if selector.startswith("["):
        name, _, value = selector[1:-1].partition("=")
        return name in attrs and (not value or attrs[name] == value.strip("'\""))
    return bool(selector) and tag == selector


class _Blocks(HTMLParser):
    """Collects the first text of each field inside each outermost container."""

    def __init__(self, where: Selectors):
        super().__init__()
        self.where, self.blocks = where, []
        self.depth, self.inside = 0, None  # open tags; depth of the container
        self.reading: list[tuple[str, int]] = []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in VOID:
            return
        self.depth += 1
        if self.inside is None and matches(self.where.container, tag, attrs):
            self.inside = self.depth
            self.blocks.append({})
        if self.inside is not None:
            for field in FIELDS:
                if field not in self.blocks[-1] and matches(getattr(self.where, field), tag, attrs):
                    self.blocks[-1][field] = ""
                    self.reading.append((field, self.depth))

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        self.reading = [(f, d) for f, d in self.reading if d < self.depth]
        if self.inside is not None and self.depth <= self.inside:
            self.inside, self.reading = None, []
        self.depth = max(0, self.depth - 1)

    def handle_data(self, data):
        for field, _ in self.reading:
            self.blocks[-1][field] += data


def blocks_of(html: str | None, where: Selectors) -> list[dict]:
    """The fields of each result block that has a fare."""
    parser = _Blocks(where)
    parser.feed(html or "")
    parser.close()
    found = [{f: b.get(f, "").strip() for f in FIELDS} for b in parser.blocks]
    return [b for b in found if b["fare"]]


def extract_quotes(pages: DataFrame, selectors: dict[str, Selectors], keep=("page_id",), source: str = "source_id") -> DataFrame:
    """A raw quote for each result block of the pages that are no challenge. Pages of sources without selectors give none."""
    fine = pages.where(~is_challenge(F.col("html"))).select(*keep, source, "html")
    schema = T.StructType([*fine.drop("html").schema, *[T.StructField(f, T.StringType()) for f in (*FIELDS, "own", "fee_text")]])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, PAGES_AT_ONCE):
                rows = []
                for r in batch.slice(lo, PAGES_AT_ONCE).to_pylist():
                    if where := selectors.get(r[source]):
                        own = {k: v for k, v in r.items() if k != "html"} | {"own": where.carrier, "fee_text": where.fee_text}
                        rows += [own | b for b in blocks_of(r["html"], where)]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    found = fine.mapInArrow(run, schema)
    direct = F.col("own").isNotNull()
    return found.select(
        *keep,
        source,
        F.coalesce("own", flight_carrier(F.col("flight"))).alias("carrier"),
        F.coalesce(F.nullif("fare_class", F.lit("")), F.lit("VALUE")).alias("fare_class"),
        F.when(direct, parse_flight(F.col("flight"))).otherwise(F.regexp_replace("flight", r"\s", "")).alias("flight_no"),
        F.when(direct, F.col("fare")).otherwise(F.concat(F.lit("₹"), F.format_number(F.floor(parse_amount(F.col("fare"))), 0))).alias("fare_text"),
        F.lit("inclusive of taxes").alias("tax_text"),
        "fee_text",
        parse_int(F.col("seats")).alias("seats_left"),
        is_flexible(F.col("fare_class")).alias("refundable"),
        F.when(direct, baggage_of(F.col("fare_class"))).otherwise(F.lit(15)).alias("baggage_kg"),
    )
