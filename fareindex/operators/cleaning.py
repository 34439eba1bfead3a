"""Raw quotes to clean quotes: one reason for every dropped row, robust outliers, imputed carriers.

Everything from de-duplication to imputation works within a cell. The quotes are
dealt by cell once; all windows here, and the cell aggregate after them, reuse
that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fareindex.functions.parsing import clamp, parse_amount
from fareindex.sources import dims

CELL = ("obs_date", "route_id", "lead_time")
DUPLICATE_KEY = ("source_id", "carrier", "route_id", "lead_time", "fare_class", "fare_text")
REASONS = ("sold_out", "cancelled", "duplicate", "invalid", "outlier")


def quote_flags() -> Column:
    return F.array_compact(
        F.array(
            F.when(F.col("seats_left") <= 4, "low-inventory"),
            F.when(~F.coalesce(F.col("refundable"), F.lit(False)), "non-refundable"),
            F.when(F.col("baggage_kg") <= 15, "no-check-in-bag"),
            F.when(dims.lookup(F.col("source_id"), dims.SOURCE_KIND) == "ota", "ota-channel"),
        )
    )


def has_flag(name: str) -> Column:
    return F.array_contains("flags", name)


def quality_score(mode: str = "class") -> Column:
    """By fare class, or with mode "amenity" by the carrier's amenity times the class."""
    by_class = dims.lookup(F.col("fare_class"), dims.CLASS_QUALITY, dims.DEFAULT_QUALITY)
    return by_class if mode == "class" else dims.lookup(F.col("carrier"), dims.AMENITY, 1.0) * by_class


def decompose(raw: DataFrame, mode: str = "class") -> DataFrame:
    """Adds base_fare, taxes, udf, convenience_fee, total_fare, quality and flags. The fare text is the all-in total."""
    total = parse_amount(F.col("fare_text"))
    inclusive = F.coalesce(F.col("tax_text"), F.lit("")).rlike("(?i)inclusive")  # lower() is slow on texts with a ₹
    fee = dims.lookup(F.col("source_id"), dims.SOURCE_FEE, 0.0)
    priced = raw.withColumns({"fare": total, "convenience_fee": fee})
    priced = priced.withColumn("tax", F.when(inclusive, F.round(F.col("fare") * dims.INCLUSIVE_TAX)).otherwise(parse_amount(F.col("tax_text"))))
    priced = priced.withColumn("base", F.greatest(F.lit(1.0), F.col("fare") - F.col("tax") - F.col("convenience_fee")))
    return priced.withColumns(
        {
            "base_fare": F.round("base"),
            "taxes": F.round("tax"),
            "udf": F.lit(0.0),
            "total_fare": F.round(F.col("base") + F.col("tax") + F.col("convenience_fee")),
            "quality": quality_score(mode),
            "flags": quote_flags(),
        }
    ).drop("base", "tax")


def _flag(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)


def unavailable(df: DataFrame) -> Column:
    """"sold_out" (also: no seats left; unknown seats count as some), "cancelled", or null."""
    sold_out = _flag(df, "sold_out") | F.coalesce(F.col("seats_left") == 0, F.lit(False))
    return F.when(sold_out, "sold_out").when(_flag(df, "is_cancelled"), "cancelled")


def tag_drop_reason(raw: DataFrame, cell=CELL, order_by=("collected_at",), k: float = 3.0, low: float = 0.45, high: float = 2.6, mode: str = "class") -> DataFrame:
    """Decomposed quotes with `drop_reason` (null: kept), `cell_median` and `cell_sigma`.

    The first reason that holds counts: sold out (seats 0; unknown seats stay),
    cancelled, duplicate (first by `order_by` wins among those still there),
    invalid fare, outlier beyond median +- k sigma or outside [low, high] medians,
    where sigma is the scaled MAD, one percent of the median at least. An empty
    `cell` pools all rows in one task: for a sweep, not for a history.
    """
    # dealt before it is decomposed: the shuffle carries the texts, not also what is read from them
    df = decompose(raw.repartition(*cell) if cell else raw, mode)
    here = W.partitionBy(*cell)
    key = [c for c in dict.fromkeys([*cell, *DUPLICATE_KEY])]
    df = df.withColumn("gone", unavailable(df))
    # the hash decides nearly every comparison of the sort, before the texts do
    twin = F.xxhash64(*[F.col(c) for c in DUPLICATE_KEY])
    copies = W.partitionBy(*cell, twin, *key[len(cell) :], F.col("gone").isNull()).orderBy(*order_by)
    early = F.coalesce("gone", F.when(F.row_number().over(copies) > 1, "duplicate"), F.when(~(F.col("fare") > 0), "invalid"))
    df = df.withColumn("gone", early)
    df = df.withColumn("valid_fare", F.when(F.col("gone").isNull(), F.col("total_fare")))
    df = df.withColumn("cell_median", F.median("valid_fare").over(here))
    df = df.withColumn("deviation", F.abs(F.col("valid_fare") - F.col("cell_median")))
    df = df.withColumn("cell_sigma", F.greatest(1.4826 * F.median("deviation").over(here), 0.01 * F.col("cell_median")))
    x, med, sigma = F.col("total_fare"), F.col("cell_median"), F.col("cell_sigma")
    outlier = (x < med - k * sigma) | (x > med + k * sigma) | (x < low * med) | (x > high * med)
    return df.withColumn("drop_reason", F.coalesce("gone", F.when(outlier, "outlier"))).drop("gone", "valid_fare", "deviation", "fare")


def reject_outliers(df: DataFrame, cell, value: str, k: float = 3.0, low: float = 0.45, high: float = 2.6) -> DataFrame:
    """Rows of `df` within the bounds of their cell, inclusive. An empty `cell` puts all rows in one task."""
    here, x = W.partitionBy(*cell), F.col(value)
    out = df.withColumn("cell_median", F.median(x).over(here))
    out = out.withColumn("deviation", F.abs(x - F.col("cell_median")))
    sigma = F.greatest(1.4826 * F.median("deviation").over(here), 0.01 * F.col("cell_median"))
    out = out.withColumn("cell_sigma", sigma)
    med = F.col("cell_median")
    keep = x.between(med - k * F.col("cell_sigma"), med + k * F.col("cell_sigma")) & x.between(low * med, high * med)
    return out.where(keep).drop("deviation")


CLEAN = ("source_id", "carrier", "fare_class", "base_fare", "taxes", "udf", "convenience_fee", "total_fare", "quality", "flags", "imputed", "is_synthetic")
COUNTED = "\0"  # in place of a carrier: the row that holds the number of its cell's raw quotes


def impute_missing(tagged: DataFrame, cell=CELL, expected: dict | None = None, mode: str = "class", count: str | None = None) -> DataFrame:
    """Clean quotes: the kept rows, and one imputed row for each expected carrier that a cell with kept rows lacks.

    The imputed rows come out of one kept row of their cell, so facts are neither
    joined nor read twice, nor sorted again: the rows stay in the order that the
    tagging needed. With `count`, that row also gives one that holds
    nothing but the number of the cell's raw quotes, in a column of that name;
    cells without kept rows have it too.
    """
    fare_index = expected or dims.FARE_INDEX
    here = W.partitionBy(*cell)
    kept = F.col("drop_reason").isNull()
    df = tagged.withColumn("at", F.monotonically_increasing_id())
    host = F.coalesce(F.min(F.when(kept, F.col("at"))).over(here), F.min("at").over(here))
    df = df.withColumns({"present": F.collect_set(F.when(kept, F.col("carrier"))).over(here), "host": host})
    if count:
        df = df.withColumn("cell_rows", F.count("*").over(here))
    first = F.col("at") == F.col("host")
    missing = F.array_except(F.array(*map(F.lit, fare_index)), "present")
    itself, none = F.array(F.lit(None).cast("string")), F.array().cast("array<string>")
    hosted = F.concat(F.when(kept, F.concat(itself, missing)).otherwise(none), F.array(F.lit(COUNTED)) if count else none)
    # only the carrier is exploded, so a column that nobody reads is neither made nor carried through the windows
    df = df.where(kept | first if count else kept).withColumn("filled", F.explode(F.when(first, hosted).otherwise(itself)))
    filled = F.col("filled")
    observed, counted = filled.isNull(), F.coalesce(filled == COUNTED, F.lit(False))
    fare = F.round(F.col("cell_median") * (dims.lookup(filled, fare_index) / dims.REFERENCE_FARE_INDEX))
    grade = F.lit(dims.DEFAULT_QUALITY) if mode == "class" else dims.lookup(filled, dims.AMENITY, 1.0) * dims.DEFAULT_QUALITY
    guess = {
        "source_id": F.lit("imputed"), "carrier": filled, "fare_class": F.lit("VALUE"), "base_fare": F.round(fare * dims.IMPUTED_BASE),
        "taxes": F.round(fare * dims.IMPUTED_TAX), "udf": F.lit(0.0), "convenience_fee": F.lit(0.0), "total_fare": fare,
        "quality": grade.cast("double"), "flags": F.array(F.lit("imputed"), F.lit("anti-bot-block")),
    }
    columns = [F.when(observed, F.col(c)).when(~counted, guess[c]).alias(c) for c in CLEAN[:-2]]
    columns += [(~observed & ~counted).alias("imputed"), (observed & _flag(tagged, "is_synthetic")).alias("is_synthetic")]
    if count:
        columns.append(F.when(counted, F.col("cell_rows")).alias(count))
    return df.select(*cell, *columns)


def clean_quotes(raw: DataFrame, cell=CELL, order_by=("collected_at",), expected: dict | None = None, mode: str = "class") -> DataFrame:
    """The whole funnel; `mode` sets the quality of kept and imputed quotes alike."""
    return impute_missing(tag_drop_reason(raw, cell, order_by, mode=mode), cell, expected, mode)


def first_quotes(raw: DataFrame, order_by=("collected_at",)) -> DataFrame:
    """Raw quotes without repeats of one within its day and status: what the stream lets through."""
    key = [F.col(c) for c in ("obs_date", *DUPLICATE_KEY)]
    copies = W.partitionBy(*key, F.coalesce(unavailable(raw), F.lit("on sale"))).orderBy(*order_by)
    return raw.withColumn("nth", F.row_number().over(copies)).where("nth = 1").drop("nth")


def cleaning_report(tagged: DataFrame, by=CELL, cell=CELL, expected: dict | None = None) -> DataFrame:
    """Counts of each reason, imputed carriers and coverage percent, for each group of `by`, a part of `cell`."""
    n_expected = len(expected or dims.FARE_INDEX)
    kept = F.col("drop_reason").isNull()
    each = tagged.groupBy(*cell).agg(
        F.count("*").alias("raw_count"),
        F.count_if(kept).alias("kept_count"),
        *[F.count_if(F.col("drop_reason") == r).alias(f"dropped_{r}") for r in REASONS],
        F.collect_set(F.when(kept & F.col("carrier").isin(list(expected or dims.FARE_INDEX)), F.col("carrier"))).alias("present"),
        F.max("cell_median").alias("median_total"),
        F.max("cell_sigma").alias("sigma_total"),
    )
    each = each.withColumn("imputed_count", F.when(F.col("kept_count") > 0, n_expected - F.size("present")).otherwise(0).cast("long"))
    counts = ["raw_count", "kept_count", *(f"dropped_{r}" for r in REASONS), "imputed_count"]
    if tuple(by) == tuple(cell):
        out = each.select(*by, *counts, F.round("median_total").alias("median_total"), F.round("sigma_total").alias("sigma_total"))
    else:
        out = each.groupBy(*by).agg(*[F.sum(c).alias(c) for c in counts])
    coverage = clamp(100 * (F.col("kept_count") + F.col("imputed_count")) / F.col("raw_count"), 0.0, 100.0)
    return out.withColumn("coverage", F.round(coverage, 2))


def kept_by_channel(tagged: DataFrame, by=()) -> DataFrame:
    """Raw and kept counts of each source."""
    return tagged.groupBy(*by, "source_id").agg(F.count("*").alias("raw_count"), F.count_if(F.col("drop_reason").isNull()).alias("kept_count"))


def economy_only(quotes: DataFrame, excluded=("BIZ",)) -> DataFrame:
    return quotes.where(~F.coalesce(F.col("fare_class").isin(*excluded), F.lit(False)))
