"""Collection plan, coverage, sweep audit, release ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SEARCHES = 120  # routes times lead windows of one source's sweep


def collection_plan(basket: DataFrame, leads: DataFrame, sources: DataFrame, start: str, end: str) -> DataFrame:
    """Every search due between two days: route x lead x source x day, with departure date and query string."""
    days = basket.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("obs_date"))
    grid = days.crossJoin(F.broadcast(basket)).crossJoin(F.broadcast(leads)).crossJoin(F.broadcast(sources.select("source_id")))
    depart = F.date_add("obs_date", F.col("lead_time"))
    query = F.concat_ws("&", *[F.concat(F.lit(f"{k}="), v) for k, v in (("from", F.split("route_id", "-")[0]), ("to", F.try_element_at(F.split("route_id", "-"), F.lit(2))), ("date", depart.cast("string")), ("adults", F.lit("1")))])
    return grid.select("obs_date", "source_id", "route_id", "lead_time", depart.alias("departure"), query.alias("query"))


def grid_coverage(plan: DataFrame, quotes: DataFrame, by=("obs_date", "source_id")) -> DataFrame:
    """Expected and seen cells of each group. Quotes are reduced to cells before the join."""
    cell = ["obs_date", "source_id", "route_id", "lead_time"]
    seen = quotes.groupBy(*cell).agg(F.count("*").alias("quotes"))
    out = plan.select(*cell).join(seen, cell, "left").groupBy(*by).agg(F.count("*").alias("expected"), F.count("quotes").alias("seen"))
    return out.withColumn("coverage", F.col("seen") / F.col("expected") * 100)


def expected_coverage(quotes: DataFrame, basket: DataFrame, leads: DataFrame, sources: DataFrame, start: str, end: str) -> DataFrame:
    """`grid_coverage` of a whole plan by day and source, without its grid: each source owes routes x lead windows a day.

    Days x sources are the only rows made; quotes outside the plan don't count.
    """
    size = basket.agg(F.count("*").alias("routes")).crossJoin(leads.agg(F.count("*").alias("windows"))).select((F.col("routes") * F.col("windows")).alias("expected"))
    planned = quotes.join(F.broadcast(leads.select("lead_time")), "lead_time", "left_semi").join(basket.select("route_id"), "route_id", "left_semi")
    seen = planned.groupBy("obs_date", "source_id", "route_id", "lead_time").agg(F.lit(1).alias("one")).groupBy("obs_date", "source_id").agg(F.count("*").alias("seen"))
    days = basket.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("obs_date"))
    owed = days.crossJoin(F.broadcast(sources.select("source_id"))).crossJoin(F.broadcast(size))
    out = owed.join(seen, ["obs_date", "source_id"], "left").withColumn("seen", F.coalesce("seen", F.lit(0).cast("long")))
    return out.select("obs_date", "source_id", "expected", "seen", (F.col("seen") / F.col("expected") * 100).alias("coverage"))


def missing_carriers(clean: DataFrame, carriers: DataFrame, cell) -> DataFrame:
    """Expected carriers that a cell of the observed quotes `clean` lacks: one pass, in which each cell gathers its carriers."""
    each = clean.groupBy(*cell).agg(F.collect_set("carrier").alias("present"))
    return each.crossJoin(F.broadcast(carriers.select("carrier"))).where("not array_contains(present, carrier)").select(*cell, "carrier")


def sweep_status(blocks: Column, errors: Column, expected: Column | int = SEARCHES) -> Column:
    return F.when(blocks > expected * 0.5, "blocked").when((blocks > 0) | (errors > 0), "degraded").otherwise("ok")


def sweep_audit(log: DataFrame, expected: int = SEARCHES, by=("date", "source_id")) -> DataFrame:
    counters = ["requests", "raw_quotes", "http_errors", "retries", "block_events"]
    out = log.groupBy(*by).agg(*[F.sum(c).alias(c) for c in counters], F.sum("duration_ms").alias("duration_ms"))
    return out.withColumn("status", sweep_status(F.col("block_events"), F.col("http_errors"), expected))


def run_totals(audit: DataFrame, by=("date",)) -> DataFrame:
    counters = ["requests", "raw_quotes", "http_errors", "retries", "block_events"]
    return audit.groupBy(*by).agg(*[F.sum(c).alias(c) for c in counters], F.count_if(F.col("status") == "blocked").alias("blocked"), F.count_if(F.col("status") == "degraded").alias("degraded"))


def source_shares(audit: DataFrame) -> DataFrame:
    """Each source's part of all quotes, in percent."""
    each = audit.groupBy("source_id").agg(F.sum("raw_quotes").alias("raw_quotes"))
    return each.withColumn("share_pct", F.coalesce(F.try_divide(F.col("raw_quotes") * 100.0, F.sum("raw_quotes").over(W.partitionBy())), F.lit(0.0)))


def source_yield(coverage: DataFrame, floor: float = 80.0) -> DataFrame:
    """Sources whose coverage is under `floor` percent are downgraded."""
    return coverage.withColumn("downgraded", F.col("coverage") < floor)


def last_runs(sources: DataFrame, audit: DataFrame) -> DataFrame:
    """Every source with its latest audit row, if any."""
    latest = audit.groupBy("source_id").agg(F.max("date").alias("date"), F.max_by("status", "date").alias("status"), F.max_by("raw_quotes", "date").alias("raw_quotes"))
    return sources.join(latest, "source_id", "left")


def release_status(releases: DataFrame, as_of: str, days: int = 60, published: str = "published_at") -> DataFrame:
    """Provisional for `days` days, then frozen."""
    age = F.datediff(F.to_date(F.lit(as_of)), F.to_date(published))
    return releases.withColumn("status", F.when(age <= days, "provisional").otherwise("frozen"))


def latest_releases(ledger: DataFrame, n: int = 40) -> DataFrame:
    return ledger.orderBy(F.desc("period"), "frequency").limit(n)


def upsert(existing: DataFrame, new: DataFrame, key=("date",)) -> DataFrame:
    """`new` in place of the rows of `existing` with its keys."""
    return existing.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def publish_release(ledger: DataFrame, rows: DataFrame, channels=("web", "api")) -> DataFrame:
    """Rows patched in or added by (period, frequency); values to two places, missing channels filled."""
    default = F.array(*map(F.lit, channels))
    given = F.coalesce("channels", default) if "channels" in rows.columns else default
    return upsert(ledger, rows.withColumn("value", F.round("value", 2)).withColumn("channels", given), ("period", "frequency"))
