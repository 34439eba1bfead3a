"""The registered queries over the given tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareindex.functions import aggregates as agg
from fareindex.functions import parsing as p
from fareindex.operators import audit, cells, cleaning, indexing, market, series, validation
from fareindex.plans import reports
from fareindex.sources import dims, pages, views
from fareindex.sources.io import store_cells, store_quotes, stored_values
from fareindex.streaming.ingest import error_windows

BASE = "1995-06-01"
START, END = "1995-06-01", "1997-06-01"
DRIVERS = ["quantity", "total", "lines"]


# Spark side


def raw(s: SparkSession, d: str) -> DataFrame:
    return views.quotes(s, d)


def tagged(s, d):
    return cleaning.tag_drop_reason(raw(s, d), views.CELL, views.ORDER)


def clean(s, d):
    return cleaning.impute_missing(tagged(s, d), views.CELL)


def cell_table(s, d):
    return cells.cell_prices(clean(s, d), views.CELL)


def kept_cells(s, d, *by: str) -> tuple[DataFrame, DataFrame]:
    """(cells with a price, route weights), both from one stored table: for queries that use cells more than once.

    Cells carry the numbers of their raw quotes, so weights don't read the facts
    again. `by`: further keys, whose cells hold observed quotes only.
    """
    found = cleaning.impute_missing(tagged(s, d), views.CELL, count="raw_quotes")
    if "kind" in by:
        found = found.where("not imputed").withColumn("kind", dims.lookup(F.col("source_id"), dims.SOURCE_KIND))
    stored = store_cells(cells.counted_cells(found, [*views.CELL, *by]))
    return stored.where("price is not null"), indexing.count_weights(stored, within=F.year("period") == 1995)


def kept_quotes(s, d) -> tuple[DataFrame, str | None]:
    """(clean quotes stored by period, the last period there is), for views of the latest period."""
    path = store_quotes(clean(s, d).drop("flags"), day="period")
    return s.read.parquet(path), (stored_values(s, path, "period") or [None])[-1]


def with_region(found: DataFrame) -> DataFrame:
    """Cells with the region that their route starts in."""
    return found.withColumn("region", F.split("route_id", "-")[0])


def prices(s, d):
    return cells.route_prices(cell_table(s, d), "period")


def weights(s, d):
    return views.traffic_weights(raw(s, d))


def base(prices: DataFrame) -> DataFrame:
    return indexing.base_snapshot(prices, BASE, "period", 3, "month")


def relatives(s, d, kept: tuple[DataFrame, DataFrame] | None = None):
    """From the stored cells, which base, points and weights all read."""
    found, w = kept_cells(s, d) if kept is None else kept
    by_route = cells.route_prices(found, "period")
    return indexing.route_relatives(by_route, base(by_route), w)


def points_of(found: DataFrame, missing="renormalize"):
    return indexing.build_index(found, "period", missing).withColumnRenamed("period", "date")


def points(s, d, missing="renormalize"):
    return points_of(relatives(s, d), missing)


def monthly(s, d):
    return points(s, d).select(p.month_key(F.col("date")).alias("period"), "value")


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles to so many places, so that summing in another order gives the same value. Qualities are means of a few
    two-digit scores, which often end on a tie; they keep nine places."""
    keep = lambda c: 9 if c in ("quality", "quality_0") else places
    return df.select(*[F.round(c, keep(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# SQL side: common table expressions, chained by name


def case(key: str, table: dict, default: str = "NULL") -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)
    return f"CASE {key} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {default} END"


PARSE = "COALESCE(TRY_CAST(replace(regexp_extract({0}, '([0-9][0-9,]*(?:[.][0-9]+)?)', 1), ',', '') AS DOUBLE), 0)"
CELL = "period, route_id, lead_time"
PRICE = "l_extendedprice * (1 - l_discount)"
LOW_COST = ", ".join(f"'{c}'" for c in views.LOW_COST)


def pick(values: list, key: str) -> str:
    return case(key, dict(enumerate(values)))


CTES = {
    "quotes": f"""
        SELECT CAST(o_orderdate AS DATE) AS obs_date, CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
            cr.r_name || '-' || sr.r_name AS route_id, cr.r_name AS region, {pick(views.LEADS, "l_partkey % 5")} AS lead_time,
            {pick(views.CARRIERS, "l_suppkey % 5")} AS carrier, {pick(views.SOURCE_IDS, "l_suppkey % 11")} AS source_id,
            {case("split_part(p_type, ' ', 1)", views.CLASSES, "'UNKNOWN'")} AS fare_class,
            CASE l_linenumber % 3 WHEN 0 THEN '₹' || format('{{:,}}', CAST(floor({PRICE} + 0.5) AS BIGINT))
                WHEN 1 THEN 'Rs. ' || CAST(CAST(floor({PRICE} + 0.5) AS BIGINT) AS VARCHAR)
                ELSE 'INR ' || CAST(CAST(floor({PRICE} * 100 + 0.5) AS BIGINT) // 100 AS VARCHAR) || '.' || lpad(CAST(CAST(floor({PRICE} * 100 + 0.5) AS BIGINT) % 100 AS VARCHAR), 2, '0') END AS fare_text,
            CASE WHEN l_linestatus = 'O' THEN 'inclusive of taxes' ELSE '₹' || CAST(CAST(floor({PRICE} * l_tax + 0.5) AS BIGINT) AS VARCHAR) END AS tax_text,
            CAST(trunc(l_quantity) AS INTEGER) % 20 AS seats_left, l_returnflag = 'R' AND l_linenumber = 7 AS is_cancelled, l_returnflag = 'N' AS refundable,
            CASE WHEN {pick(views.CARRIERS, "l_suppkey % 5")} IN ({LOW_COST}) THEN 15 ELSE 25 END AS baggage_kg,
            o_orderdate AS collected_at, o_orderstatus = 'F' AS is_synthetic,
            l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey""",
    "parsed": f"""
        SELECT *, {PARSE.format("fare_text")} AS fare, {case("source_id", dims.SOURCE_FEE, "0")} AS convenience_fee,
            CASE WHEN contains(lower(tax_text), 'inclusive') THEN round({PARSE.format("fare_text")} * 0.194) ELSE {PARSE.format("tax_text")} END AS tax,
            {case("fare_class", dims.CLASS_QUALITY, "0.95")} AS quality FROM quotes""",
    "priced": """
        SELECT *, round(greatest(1.0, fare - tax - convenience_fee)) AS base_fare, round(tax) AS taxes,
            round(greatest(1.0, fare - tax - convenience_fee) + tax + convenience_fee) AS total_fare FROM parsed""",
    "early": """
        SELECT *, CASE WHEN seats_left = 0 THEN 'sold_out' WHEN is_cancelled THEN 'cancelled' END AS gone FROM priced""",
    "early2": f"""
        SELECT * REPLACE (COALESCE(gone, CASE WHEN row_number() OVER (PARTITION BY {CELL}, source_id, carrier, fare_class, fare_text, gone IS NULL
            ORDER BY {", ".join(views.ORDER)}) > 1 THEN 'duplicate' END, CASE WHEN NOT fare > 0 THEN 'invalid' END) AS gone) FROM early""",
    "centred": f"""
        SELECT *, median(CASE WHEN gone IS NULL THEN total_fare END) OVER (PARTITION BY {CELL}) AS cell_median FROM early2""",
    "spread": f"""
        SELECT *, greatest(1.4826 * median(CASE WHEN gone IS NULL THEN abs(total_fare - cell_median) END) OVER (PARTITION BY {CELL}), 0.01 * cell_median) AS cell_sigma FROM centred""",
    "tagged": """
        SELECT *, COALESCE(gone, CASE WHEN total_fare < cell_median - 3 * cell_sigma OR total_fare > cell_median + 3 * cell_sigma
            OR total_fare < 0.45 * cell_median OR total_fare > 2.6 * cell_median THEN 'outlier' END) AS drop_reason FROM spread""",
    "kept": "SELECT * FROM tagged WHERE drop_reason IS NULL",
    "gaps": f"""
        SELECT {CELL}, carrier, round(med * ({case("carrier", dims.FARE_INDEX)} / 0.97)) AS total_fare
        FROM (SELECT {CELL}, max(cell_median) AS med FROM kept GROUP BY ALL) CROSS JOIN (SELECT unnest([{", ".join(f"'{c}'" for c in dims.FARE_INDEX)}]) AS carrier)
        ANTI JOIN kept USING ({CELL}, carrier)""",
    "clean": f"""
        SELECT {CELL}, source_id, carrier, fare_class, base_fare, taxes, convenience_fee, total_fare, quality, false AS imputed, is_synthetic FROM kept
        UNION ALL SELECT {CELL}, 'imputed', carrier, 'VALUE', round(total_fare * 0.82), round(total_fare * 0.18), 0, total_fare, 0.95, true, false FROM gaps""",
    "cells": f"SELECT {CELL}, median(total_fare) AS price, avg(quality) AS quality, count(*) AS quotes, split_part(route_id, '-', 1) AS region FROM clean GROUP BY ALL",
    "prices": f"""
        SELECT period, route_id, exp(sum(w * ln(price)) / sum(w)) AS price, avg(quality) AS quality, CAST(sum(quotes) AS BIGINT) AS quotes
        FROM (SELECT *, {case("lead_time", dims.LEADS)} AS w FROM cells WHERE price > 0) GROUP BY ALL""",
    "weights": """
        SELECT route_id, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM quotes WHERE year(obs_date) = 1995) AS weight FROM quotes WHERE year(obs_date) = 1995 GROUP BY ALL""",
    "base": f"""
        SELECT route_id, avg(price) AS price_0, avg(quality) AS quality_0 FROM prices
        WHERE period BETWEEN DATE '{BASE}' - INTERVAL 3 MONTH AND DATE '{BASE}' + INTERVAL 3 MONTH GROUP BY ALL""",
    "relatives": """
        SELECT period, route_id, price, quality, quotes, weight, price_0, quality_0, COALESCE(price / price_0, 1.0) AS relative, COALESCE(CASE WHEN price_0 IS NULL THEN 1.0 ELSE quality_0 END / quality, 1.0) AS hedonic
        FROM prices JOIN weights USING (route_id) LEFT JOIN base USING (route_id)""",
    "sums": """
        SELECT period, sum(weight * relative) AS n, sum(weight * relative * hedonic) AS r, sum(weight * quality) AS q, sum(weight) AS covered,
            sum(weight * price) AS basket, CAST(sum(quotes) AS BIGINT) AS observations FROM relatives GROUP BY ALL""",
    "points": """
        SELECT period AS date, r / covered * 100 AS value, n / covered * 100 AS nominal, q / covered AS quality_index, r / n AS hedge_ratio,
            basket / covered AS basket_fare, covered, observations FROM sums""",
    "smooth": "SELECT *, avg(value) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS smoothed FROM points",
    "monthly": "SELECT strftime(date, '%Y-%m') AS period, value FROM points",
    "reference": "SELECT strftime(o_orderdate, '%Y-%m') AS period, avg(o_totalprice) AS value FROM orders GROUP BY ALL",
    "pairs": "SELECT period, m.value AS x, r.value AS y FROM monthly m JOIN reference r USING (period)",
    "rebased": """
        SELECT *, a - b AS gap, a - lag(a) OVER (ORDER BY period) AS da, b - lag(b) OVER (ORDER BY period) AS db FROM
            (SELECT *, x / first_value(x) OVER (ORDER BY period) * 100 AS a, y / first_value(y) OVER (ORDER BY period) * 100 AS b FROM pairs)""",
    "readings": """
        SELECT strftime(date, '%Y-%m') AS period, arg_min(quantity, away) AS quantity, arg_min(total, away) AS total, arg_min(lines, away) AS lines FROM
            (SELECT CAST(o_orderdate AS DATE) AS date, avg(l_quantity) AS quantity, avg(o_totalprice) AS total, CAST(count(*) AS DOUBLE) AS lines, CASE WHEN day(CAST(o_orderdate AS DATE)) <= 15 THEN 15 - day(CAST(o_orderdate AS DATE)) ELSE 100 + day(CAST(o_orderdate AS DATE)) END AS away
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY ALL""",
    "moved": """
        SELECT y, x1, x2, x3 FROM (SELECT period, ln(value / lag(value) OVER (ORDER BY period)) AS y FROM monthly)
        JOIN (SELECT period, ln(quantity / lag(quantity) OVER o) AS x1, ln(total / lag(total) OVER o) AS x2, lines - lag(lines) OVER o AS x3 FROM readings WINDOW o AS (ORDER BY period)) USING (period)
        WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL""",
    "normal": f"""
        SELECT count(*) AS n, avg(y) AS my, count(*) * var_pop(y) AS syy, {", ".join(f"avg(x{i}) AS m{i}, count(*) * covar_pop(x{i}, y) AS s{i}y" for i in (1, 2, 3))},
            {", ".join(f"count(*) * covar_pop(x{i}, x{j}) AS s{i}{j}" for i in (1, 2, 3) for j in range(i, 4))} FROM moved""",
    "inverse": """
        SELECT *, c11 / det AS i11, c12 / det AS i12, c13 / det AS i13, c22 / det AS i22, c23 / det AS i23, c33 / det AS i33 FROM (SELECT *, s11 * c11 + s12 * c12 + s13 * c13 AS det FROM
            (SELECT *, s22 * s33 - s23 * s23 AS c11, s13 * s23 - s12 * s33 AS c12, s12 * s23 - s13 * s22 AS c13, s11 * s33 - s13 * s13 AS c22, s12 * s13 - s11 * s23 AS c23, s11 * s22 - s12 * s12 AS c33 FROM normal))""",
    "slopes": """
        SELECT *, my - b1 * m1 - b2 * m2 - b3 * m3 AS b0, syy - b1 * s1y - b2 * s2y - b3 * s3y AS rest, m1 * m1 * i11 + m2 * m2 * i22 + m3 * m3 * i33 + 2 * (m1 * m2 * i12 + m1 * m3 * i13 + m2 * m3 * i23) AS lever FROM
            (SELECT *, i11 * s1y + i12 * s2y + i13 * s3y AS b1, i12 * s1y + i22 * s2y + i23 * s3y AS b2, i13 * s1y + i23 * s2y + i33 * s3y AS b3 FROM inverse)""",
    "log": f"""
        SELECT CAST(ts AS DATE) AS date, ts, event_type, {pick(views.SOURCE_IDS, "user_id % 11")} AS source_id, CAST(event_type NOT IN ('error', 'click', 'signup') AS BIGINT) AS requests,
            CAST(event_type = 'purchase' AS BIGINT) AS raw_quotes, CAST(event_type = 'error' AS BIGINT) AS http_errors, CAST(event_type = 'click' AS BIGINT) AS retries,
            CAST(event_type = 'signup' AS BIGINT) AS block_events, value AS duration_ms FROM events""",
    "audit": """
        SELECT date, source_id, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(raw_quotes) AS BIGINT) AS raw_quotes, CAST(sum(http_errors) AS BIGINT) AS http_errors,
            CAST(sum(retries) AS BIGINT) AS retries, CAST(sum(block_events) AS BIGINT) AS block_events, sum(duration_ms) AS duration_ms,
            CASE WHEN sum(block_events) > 5 THEN 'blocked' WHEN sum(block_events) > 0 OR sum(http_errors) > 0 THEN 'degraded' ELSE 'ok' END AS status FROM log GROUP BY date, source_id""",
}
NEEDS = {
    "parsed": ["quotes"], "priced": ["parsed"], "early": ["priced"], "early2": ["early"], "centred": ["early2"], "spread": ["centred"], "tagged": ["spread"], "kept": ["tagged"],
    "gaps": ["kept"], "clean": ["gaps"], "cells": ["clean"], "prices": ["cells"], "weights": ["quotes"], "base": ["prices"], "relatives": ["base", "weights"], "sums": ["relatives"],
    "points": ["sums"], "smooth": ["points"], "monthly": ["points"], "pairs": ["monthly", "reference"], "rebased": ["pairs"], "audit": ["log"],
    "moved": ["monthly", "readings"], "normal": ["moved"], "inverse": ["normal"], "slopes": ["inverse"],
}


def sql(last: str, *names: str) -> str:
    """`last` after the named expressions and all that they need."""
    order: list[str] = []

    def need(name):
        for n in NEEDS.get(name, []):
            need(n)
        if name not in order:
            order.append(name)

    for n in names:
        need(n)
    return ("WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in order) + " " if order else "") + last


def pct(a: str, b: str) -> str:
    return f"CASE WHEN {a} = 0 THEN 0.0 ELSE ({b} - {a}) / NULLIF({a}, 0) * 100 END"


PEARSON = "CASE WHEN count(*) < 3 OR sqrt(var_pop({0})) * sqrt(var_pop({1})) <= 1e-12 THEN 0.0 ELSE covar_pop({0}, {1}) / (sqrt(var_pop({0})) * sqrt(var_pop({1}))) END"
DAYS = """(SELECT unnest(generate_series((SELECT CAST(min(o_orderdate) AS DATE) FROM orders), (SELECT CAST(max(o_orderdate) AS DATE) FROM orders), INTERVAL 1 DAY)) AS day)"""
SPAN = f"period BETWEEN DATE '{START}' AND DATE '{END}'"
LATEST = "period = (SELECT max(period) FROM clean)"
ORIGIN = "CASE WHEN bool_or(is_synthetic) AND bool_or(NOT is_synthetic) THEN 'mixed' WHEN bool_or(is_synthetic) THEN 'simulated' ELSE 'live' END"


def _parse(s, d):
    q = raw(s, d)
    return q.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "fare_text",
        F.round(p.parse_amount(F.col("fare_text")), 2).alias("fare"), F.round(p.parse_amount(F.col("tax_text")), 2).alias("tax"), p.parse_int(F.col("fare_text")).cast("long").alias("digits"),
        p.origin(F.col("route_id")).alias("origin"), p.destination(F.col("route_id")).alias("destination"), p.departure_date(F.col("obs_date"), F.col("lead_time")).alias("departure"),
    )


def _calendar(s, d):
    day = F.col("obs_date")
    each = raw(s, d).groupBy("obs_date").agg(F.count("*").alias("quotes"))
    return each.select(
        "obs_date", "quotes", p.month_key(day).alias("month"), p.month_label(day).alias("label"), p.iso_week_key(day).alias("week"), p.epoch_day(day).cast("long").alias("epoch_day"),
        F.dayofweek(day).cast("long").alias("weekday"), F.dayofyear(day).cast("long").alias("yearday"), p.clamp(F.col("quotes"), 5, 20).cast("long").alias("clamped"),
    )


def _flags(s, d):
    q = cleaning.decompose(raw(s, d))
    return q.select(F.explode_outer("flags").alias("flag"), "total_fare").groupBy("flag").agg(F.count("*").alias("n"), F.round(F.avg("total_fare"), 2).alias("avg_fare"))


def _stats(s, d):
    q = cleaning.decompose(raw(s, d))
    x, w = F.col("total_fare"), F.col("baggage_kg").cast("double")
    return rounded(q.groupBy("route_id").agg(agg.weighted_mean(x, w).alias("wmean"), agg.weighted_geomean(x, w).alias("wgeomean"), agg.stdev(x).alias("sd"), agg.median0(x).alias("med"), agg.quantile(x, 0.9).alias("q90")), 2)


def _upserted(s, d):
    found = points(s, d).select("date", F.round("value", 2).alias("value"), F.lit(True).alias("is_synthetic"))
    fresh = found.where("year(date) = 1997").select("date", F.round(F.col("value") + 1, 2).alias("value"), F.lit(False).alias("is_synthetic"))
    return audit.upsert(found, fresh)


def _releases(s, d):
    month = monthly(s, d).select("period", F.lit("monthly").alias("frequency"), "value", F.to_date(F.concat("period", F.lit("-28"))).alias("published_at"))
    ledger = audit.publish_release(month.where("period < '1998-01'").withColumn("channels", F.array(F.lit("web"))), month.where("period between '1997-06' and '2001-06'"))
    out = audit.latest_releases(audit.release_status(ledger, "2001-06-30"), 40)
    return out.select("period", "frequency", "value", "status", F.concat_ws(",", "channels").alias("channels"))


def _sub_lead(s, d):
    return rounded(indexing.sub_index(*kept_cells(s, d), BASE, "lead_time", "period", 3, "month"))


def _sub_region(s, d):
    found, w = kept_cells(s, d)
    return rounded(indexing.sub_index(with_region(found), w, BASE, "region", "period", 3, "month"))


def _all_groups(s, d):
    found, w = kept_cells(s, d)
    return rounded(indexing.all_groups(with_region(found), w, "period"), 3)


def _elasticity(s, d):
    return market.lead_elasticity(*kept_cells(s, d), "1998-01-31", 365, period="period")


def _sub_indices(s, d):
    found, w = kept_cells(s, d)
    return rounded(reports.sub_index_report(with_region(found), w, BASE, "period", 24, half_window=3, unit="month").select("grouping", "key", "period", "rebased"), 3)


def _route_fares(s, d):
    stored = store_cells(market.route_days(clean(s, d), "period"))
    return rounded(market.on_date(stored, column="period").drop("period").orderBy(F.desc("avg_fare"), "route_id"), 3)


def _daily_views(s, d):
    """Route fares, booking curve and channel wedge of the latest period, from one store."""
    stored, last = kept_quotes(s, d)
    parts = [
        market.route_fares(stored, last, "period").select(F.lit("route").alias("view"), F.col("route_id").alias("key"), F.col("avg_fare").alias("value"), "origin"),
        market.lead_fares(stored, last, "period").select(F.lit("lead").alias("view"), F.col("lead_time").cast("string").alias("key"), F.col("avg_fare").alias("value"), "origin"),
        market.channel_wedge(stored, last, column="period").select(F.lit("wedge_pct").alias("view"), F.col("route_id").alias("key"), F.col("wedge_pct").alias("value"), F.lit(None).cast("string").alias("origin")),
    ]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), 3)


def _sketched(s, d):
    """Route medians from sketches that two halves of the quotes left; `close`: their rank is within 1.3 % of the middle."""
    kept = store_cells(clean(s, d).select("period", "route_id", "total_fare", "quality"))
    early = F.year("period") <= 1995
    old, new = (store_cells(cells.cell_sketches(kept.where(half), ["route_id"])) for half in (early, ~early))
    middle = cells.sketched_prices(cells.merge_sketches(old, new, ["route_id"]), ["route_id"])
    ranks = kept.join(middle.select("route_id", "price"), "route_id").groupBy("route_id").agg(F.avg((F.col("total_fare") < F.col("price")).cast("double")).alias("lo"), F.avg((F.col("total_fare") <= F.col("price")).cast("double")).alias("hi"))
    return rounded(middle.join(ranks, "route_id").select("route_id", "quality", "quotes", F.lit(0.5).between(F.col("lo") - 0.013, F.col("hi") + 0.013).alias("close")))


def _month_end(s, d):
    """Each month's last daily mean fare and its changes."""
    daily = cleaning.decompose(raw(s, d)).groupBy("obs_date").agg(F.avg("total_fare").alias("fare"))
    return rounded(series.period_series(daily, "month", "fare", "obs_date", pick="last"), 3)


def _channel_index(s, d):
    """The channel sub-index: cells of each channel apart, imputed rows left out."""
    found, w = kept_cells(s, d, "kind")
    return rounded(indexing.sub_index(found, w, BASE, "kind", "period", 3, "month"))


def _latest_groups(s, d):
    found, w = kept_cells(s, d)
    one = indexing.sub_index(with_region(found), w, BASE, "region", "period", 3, "month")
    return rounded(series.latest_changes(series.rebase(one, "value", "period", ["region"]), ["region"], "period", 12), 3)


def _span(s, d) -> list[str]:
    return [str(day)[:10] for day in views.table(s, d, "orders").agg(F.min("o_orderdate"), F.max("o_orderdate")).first()]


def _plan(s, d):
    """The basket is the routes of the quotes; the days run from their first to their last."""
    return audit.collection_plan(weights(s, d).select("route_id"), dims.leads(s), dims.sources(s), *_span(s, d))


def _plan_days(s, d):
    """How many searches each source has on each day, and the last departure and query."""
    return _plan(s, d).groupBy("obs_date", "source_id").agg(F.count("*").alias("searches"), F.max("departure").alias("last_departure"), F.max("query").alias("last_query"))


def _coverage(s, d):
    """Quotes are reduced to seen cells once; these give the basket too."""
    seen = store_cells(raw(s, d).groupBy("obs_date", "source_id", "route_id", "lead_time").agg(F.count("*").alias("quotes")))
    basket = indexing.count_weights(seen, "quotes", F.year("obs_date") == 1995).select("route_id")
    return rounded(audit.source_yield(audit.expected_coverage(seen, basket, dims.leads(s), dims.sources(s), *_span(s, d))))


def _headline(s, d):
    found = store_cells(relatives(s, d))
    return rounded(reports.headline_report(points_of(found), found, "period"), 3)


def _basket(s, d):
    kept = kept_cells(s, d)
    return rounded(reports.basket_report(relatives(s, d, kept), with_region(kept[0]), kept[1], "period"), 3)


def _first_quotes(s, d):
    """What the stream lets through, as a batch."""
    found = cleaning.first_quotes(raw(s, d), views.ORDER)
    return found.groupBy("period", F.coalesce(cleaning.unavailable(found), F.lit("on sale")).alias("status")).agg(F.count("*").alias("quotes"), F.count_distinct("l_orderkey").alias("orders"))


def _pages(s, d):
    where = {"page": pages.Selectors(container="p", fare="b", fare_class="i", flight="a")}
    found = pages.extract_quotes(views.table(s, d, "pages").withColumn("source_id", F.lit("page")), where)
    return found.select("page_id", "carrier", "fare_class", "flight_no", "fare_text", "seats_left", "refundable", "baggage_kg")


def _ols_check(s, d):
    both = validation.align(monthly(s, d), views.reference_series(s, d))
    return rounded(validation.ols(both, "y", ["x"]).drop("t"), 3)


def _panel(s, d):
    """The regression by route: a month's price on its quotes and quality."""
    fit = validation.ols(prices(s, d), "price", ["quotes", "quality"], ["route_id"])
    return rounded(fit, 2)


def _readings(s, d):
    """Mid-month readings of the daily covariates."""
    return validation.reading_of_day(views.daily_covariates(s, d), DRIVERS)


def _drivers(s, d):
    """Every monthly change of the index on those of the mid-month readings: log changes, of `lines` differences."""
    return rounded(validation.driver_regression(monthly(s, d), _readings(s, d), DRIVERS, plain=["lines"]), 3)


def _error_of_levels(s, d):
    return rounded(validation.error_against(validation.align(monthly(s, d), views.reference_series(s, d)), "level"), 3)


QUERIES = {
    "parse_fares": (_parse, sql(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, fare_text, round({PARSE.format("fare_text")}, 2) AS fare, round({PARSE.format("tax_text")}, 2) AS tax,
        TRY_CAST(regexp_replace(fare_text, '[^0-9]', '', 'g') AS BIGINT) AS digits, split_part(route_id, '-', 1) AS origin, split_part(route_id, '-', 2) AS destination,
        obs_date + CAST(lead_time AS INTEGER) AS departure FROM quotes""", "quotes")),
    "decompose_fares": (lambda s, d: cleaning.decompose(raw(s, d)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "base_fare", "taxes", "convenience_fee", "total_fare", "quality"),
        sql("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, base_fare, taxes, CAST(convenience_fee AS DOUBLE) AS convenience_fee, total_fare, CAST(quality AS DOUBLE) AS quality FROM priced", "priced")),
    "quote_flags": (_flags, sql("""SELECT flag, count(*) AS n, round(avg(total_fare), 2) AS avg_fare FROM (SELECT total_fare, unnest(CASE WHEN len(f) = 0 THEN [NULL] ELSE f END) AS flag FROM (
        SELECT total_fare, list_filter([CASE WHEN seats_left <= 4 THEN 'low-inventory' END, CASE WHEN NOT refundable THEN 'non-refundable' END, CASE WHEN baggage_kg <= 15 THEN 'no-check-in-bag' END,
        CASE WHEN convenience_fee > 0 THEN 'ota-channel' END], lambda x: x IS NOT NULL) AS f FROM priced)) GROUP BY ALL""", "priced")),
    "has_flag": (lambda s, d: cleaning.decompose(raw(s, d)).where(cleaning.has_flag("ota-channel") & cleaning.has_flag("low-inventory")).groupBy("source_id").agg(F.count("*").alias("n")),
        sql("SELECT source_id, count(*) AS n FROM priced WHERE convenience_fee > 0 AND seats_left <= 4 GROUP BY ALL", "priced")),
    "calendar_keys": (_calendar, sql("""SELECT obs_date, count(*) AS quotes, strftime(obs_date, '%Y-%m') AS month, strftime(obs_date, '%b %y') AS label, strftime(obs_date, '%G-W%V') AS week,
        CAST(obs_date - DATE '1970-01-01' AS BIGINT) AS epoch_day, CAST(dayofweek(obs_date) + 1 AS BIGINT) AS weekday, CAST(dayofyear(obs_date) AS BIGINT) AS yearday, CAST(least(greatest(count(*), 5), 20) AS BIGINT) AS clamped FROM quotes GROUP BY obs_date""", "quotes")),
    "aggregates": (_stats, sql("""SELECT route_id, round(sum(baggage_kg * total_fare) / sum(baggage_kg), 2) AS wmean, round(exp(sum(baggage_kg * ln(total_fare)) / sum(baggage_kg)), 2) AS wgeomean, round(stddev_samp(total_fare), 2) AS sd,
        round(median(total_fare), 2) AS med, round(quantile_cont(total_fare, 0.9), 2) AS q90 FROM priced GROUP BY ALL""", "priced")),
    "drop_reasons": (lambda s, d: tagged(s, d).select(*views.ORDER[1:7], F.coalesce("drop_reason", F.lit("kept")).alias("reason")),
        sql(f"SELECT {', '.join(views.ORDER[1:7])}, COALESCE(drop_reason, 'kept') AS reason FROM tagged", "tagged")),
    "reject_outliers": (lambda s, d: cleaning.reject_outliers(cleaning.decompose(raw(s, d)), ["period", "route_id"], "total_fare").groupBy("period", "route_id").agg(F.count("*").alias("n"), F.round(F.max("cell_sigma"), 3).alias("sigma")),
        sql("""SELECT period, route_id, count(*) AS n, round(max(sigma), 3) AS sigma FROM (SELECT *, greatest(1.4826 * median(abs(total_fare - med)) OVER (PARTITION BY period, route_id), 0.01 * med) AS sigma FROM
            (SELECT *, median(total_fare) OVER (PARTITION BY period, route_id) AS med FROM priced)) WHERE total_fare BETWEEN med - 3 * sigma AND med + 3 * sigma AND total_fare BETWEEN 0.45 * med AND 2.6 * med GROUP BY ALL""", "priced")),
    "first_quotes": (_first_quotes, sql(f"""SELECT period, COALESCE(gone, 'on sale') AS status, count(*) AS quotes, count(DISTINCT l_orderkey) AS orders FROM
        (SELECT * FROM early QUALIFY row_number() OVER (PARTITION BY obs_date, source_id, carrier, route_id, lead_time, fare_class, fare_text, COALESCE(gone, '-') ORDER BY {", ".join(views.ORDER)}) = 1) GROUP BY ALL""", "early")),
    "cleaning_report": (lambda s, d: cleaning.cleaning_report(tagged(s, d), views.CELL, views.CELL),
        sql(f"""SELECT {CELL}, count(*) AS raw_count, count(*) FILTER (drop_reason IS NULL) AS kept_count, {", ".join(f"count(*) FILTER (drop_reason = '{r}') AS dropped_{r}" for r in cleaning.REASONS)},
            CASE WHEN kept_count > 0 THEN 5 - count(DISTINCT carrier) FILTER (drop_reason IS NULL) ELSE 0 END AS imputed_count, round(max(cell_median)) AS median_total, round(max(cell_sigma)) AS sigma_total,
            round(least(100.0, 100 * (kept_count + imputed_count) / raw_count), 2) AS coverage FROM tagged GROUP BY {CELL}""", "tagged")),
    "cleaning_report_by_period": (lambda s, d: cleaning.cleaning_report(tagged(s, d), ["period"], views.CELL),
        sql(f"""SELECT period, CAST(sum(n) AS BIGINT) AS raw_count, CAST(sum(k) AS BIGINT) AS kept_count, {", ".join(f"CAST(sum({r}) AS BIGINT) AS dropped_{r}" for r in cleaning.REASONS)}, CAST(sum(i) AS BIGINT) AS imputed_count,
            round(least(100.0, 100 * (sum(k) + sum(i)) / sum(n)), 2) AS coverage FROM (SELECT {CELL}, count(*) AS n, count(*) FILTER (drop_reason IS NULL) AS k, {", ".join(f"count(*) FILTER (drop_reason = '{r}') AS {r}" for r in cleaning.REASONS)},
            CASE WHEN k > 0 THEN 5 - count(DISTINCT carrier) FILTER (drop_reason IS NULL) ELSE 0 END AS i FROM tagged GROUP BY {CELL}) GROUP BY period""", "tagged")),
    "kept_by_channel": (lambda s, d: cleaning.kept_by_channel(tagged(s, d)), sql("SELECT source_id, count(*) AS raw_count, count(*) FILTER (drop_reason IS NULL) AS kept_count FROM tagged GROUP BY ALL", "tagged")),
    "clean_quotes": (lambda s, d: clean(s, d).select(*views.CELL, "source_id", "carrier", "fare_class", "base_fare", "taxes", "convenience_fee", "total_fare", "quality", "imputed"),
        sql(f"SELECT {CELL}, source_id, carrier, fare_class, base_fare, taxes, CAST(convenience_fee AS DOUBLE) AS convenience_fee, total_fare, CAST(quality AS DOUBLE) AS quality, imputed FROM clean", "clean")),
    "missing_carriers": (lambda s, d: audit.missing_carriers(tagged(s, d).where("drop_reason is null"), dims.carriers(s), views.CELL), sql(f"SELECT {CELL}, carrier FROM gaps", "gaps")),
    "economy_only": (lambda s, d: cleaning.economy_only(raw(s, d)).groupBy("fare_class").agg(F.count("*").alias("n")), sql("SELECT fare_class, count(*) AS n FROM quotes WHERE fare_class <> 'BIZ' GROUP BY ALL", "quotes")),
    "cell_prices": (lambda s, d: rounded(cell_table(s, d)), sql(f"SELECT {CELL}, round(price, 4) AS price, round(quality, 9) AS quality, quotes FROM cells", "cells")),
    "cell_prices_seat_share": (lambda s, d: rounded(cells.cell_prices(clean(s, d), views.CELL, "seat_share"), 3),
        sql(f"""SELECT {CELL}, round(exp(sum(w * ln(f)) / sum(w)), 3) AS price, round(sum(w * g) / sum(w), 9) AS quality, CAST(sum(n) AS BIGINT) AS quotes FROM (SELECT {CELL}, {case("carrier", dims.SEAT_SHARE)} AS w, avg(total_fare) AS f, avg(quality) AS g,
            count(*) AS n FROM clean GROUP BY {CELL}, carrier) GROUP BY {CELL}""", "clean")),
    "route_prices": (lambda s, d: rounded(prices(s, d), 3), sql("SELECT period, route_id, round(price, 3) AS price, round(quality, 9) AS quality, quotes FROM prices", "prices")),
    "route_prices_arithmetic": (lambda s, d: rounded(cells.route_prices(cell_table(s, d), "period", method="arithmetic"), 3),
        sql(f"""SELECT period, route_id, round(sum(w * price) / sum(w), 3) AS price, round(sum(w * quality) / sum(w), 9) AS quality, CAST(sum(quotes) AS BIGINT) AS quotes FROM (SELECT *, {case("lead_time", dims.LEADS)} AS w FROM cells) GROUP BY period, route_id""", "cells")),
    "route_weights": (lambda s, d: rounded(weights(s, d), 8), sql("SELECT route_id, round(weight, 8) AS weight FROM weights", "weights")),
    "base_snapshot": (lambda s, d: rounded(base(prices(s, d)), 3), sql("SELECT route_id, round(price_0, 3) AS price_0, round(quality_0, 9) AS quality_0 FROM base", "base")),
    "base_snapshot_quotes": (lambda s, d: rounded(indexing.base_snapshot(clean(s, d), BASE, "period", 3, "month", method="quotes"), 3),
        sql(f"""SELECT route_id, round(avg(total_fare), 3) AS price_0, round(avg(quality), 9) AS quality_0 FROM clean WHERE period BETWEEN DATE '{BASE}' - INTERVAL 3 MONTH AND DATE '{BASE}' + INTERVAL 3 MONTH GROUP BY ALL""", "clean")),
    "index_points": (lambda s, d: rounded(points(s, d), 3), sql("""SELECT date, round(value, 3) AS value, round(nominal, 3) AS nominal, round(quality_index, 3) AS quality_index, round(hedge_ratio, 3) AS hedge_ratio, round(basket_fare, 3) AS basket_fare,
        round(covered, 3) AS covered, observations FROM points""", "points")),
    "index_points_skip": (lambda s, d: rounded(points(s, d, "skip"), 3), sql("""SELECT period AS date, round(r * 100, 3) AS value, round(n * 100, 3) AS nominal, round(q, 3) AS quality_index, round(r / n, 3) AS hedge_ratio, round(basket, 3) AS basket_fare,
        round(covered, 3) AS covered, observations FROM sums""", "sums")),
    "sub_index_lead": (_sub_lead, sql(f"""SELECT period, lead_time, round(level, 4) AS level, round(level / level_0 * 100, 4) AS value FROM (SELECT period, lead_time, sum(weight * price) / sum(weight) AS level FROM cells JOIN weights USING (route_id) GROUP BY ALL)
        JOIN (SELECT lead_time, avg(level) AS level_0 FROM (SELECT period, lead_time, sum(weight * price) / sum(weight) AS level FROM cells JOIN weights USING (route_id) GROUP BY ALL)
        WHERE period BETWEEN DATE '{BASE}' - INTERVAL 3 MONTH AND DATE '{BASE}' + INTERVAL 3 MONTH GROUP BY ALL) USING (lead_time)""", "cells", "weights")),
    "sub_index_region": (_sub_region,
        sql(f"""SELECT period, region, round(level, 4) AS level, round(level / level_0 * 100, 4) AS value FROM (SELECT period, region, sum(weight * price) / sum(weight) AS level FROM cells JOIN weights USING (route_id) GROUP BY ALL)
        JOIN (SELECT region, avg(level) AS level_0 FROM (SELECT period, region, sum(weight * price) / sum(weight) AS level FROM cells JOIN weights USING (route_id) GROUP BY ALL)
        WHERE period BETWEEN DATE '{BASE}' - INTERVAL 3 MONTH AND DATE '{BASE}' + INTERVAL 3 MONTH GROUP BY ALL) USING (region)""", "cells", "weights")),
    "sub_index_channel": (_channel_index, sql(f"""SELECT period, kind, round(level, 4) AS level, round(level / level_0 * 100, 4) AS value FROM (SELECT period, kind, sum(weight * price) / sum(weight) AS level FROM
        (SELECT {CELL}, {case("source_id", dims.SOURCE_KIND)} AS kind, median(total_fare) AS price FROM clean WHERE NOT imputed GROUP BY ALL) JOIN weights USING (route_id) GROUP BY ALL)
        JOIN (SELECT kind, avg(level) AS level_0 FROM (SELECT period, kind, sum(weight * price) / sum(weight) AS level FROM
        (SELECT {CELL}, {case("source_id", dims.SOURCE_KIND)} AS kind, median(total_fare) AS price FROM clean WHERE NOT imputed GROUP BY ALL) JOIN weights USING (route_id) GROUP BY ALL)
        WHERE period BETWEEN DATE '{BASE}' - INTERVAL 3 MONTH AND DATE '{BASE}' + INTERVAL 3 MONTH GROUP BY ALL) USING (kind)""", "clean", "weights")),
    "all_groups": (_all_groups,
        sql("""SELECT period, CASE WHEN lead_time IS NOT NULL THEN 'lead' WHEN region IS NOT NULL THEN 'region' WHEN route_id IS NOT NULL THEN 'route' ELSE 'total' END AS grouping,
            COALESCE(CAST(lead_time AS VARCHAR), region, route_id, 'all') AS key, round(sum(weight * price) / sum(weight), 3) AS level FROM cells JOIN weights USING (route_id)
            GROUP BY GROUPING SETS ((period), (period, lead_time), (period, region), (period, route_id))""", "cells", "weights")),
    "contributions": (lambda s, d: rounded(indexing.contributions(relatives(s, d), START, END, "period"), 3),
        sql(f"""SELECT route_id, round(max(weight) * 100, 3) AS weight_pct, round((arg_max(relative, period) / arg_min(relative, period) - 1) * 100, 3) AS change_pct, round(max(weight) * (arg_max(relative, period) - arg_min(relative, period)) * 100, 3) AS points
            FROM relatives WHERE {SPAN} GROUP BY route_id""", "relatives")),
    "top_contributions": (lambda s, d: rounded(indexing.rank_contributions(indexing.contributions(relatives(s, d), START, END, "period")).limit(10), 3),
        sql(f"""SELECT route_id, round(w * 100, 3) AS weight_pct, round((b / a - 1) * 100, 3) AS change_pct, round(w * (b - a) * 100, 3) AS points FROM (SELECT route_id, max(weight) AS w, arg_min(relative, period) AS a, arg_max(relative, period) AS b
            FROM relatives WHERE {SPAN} GROUP BY route_id) ORDER BY abs((b / a - 1) * w) DESC, route_id LIMIT 10""", "relatives")),
    "smoothed_changes": (lambda s, d: rounded(series.changes(series.smooth(points(s, d).select("date", "value")), year=12), 3),
        sql(f"""SELECT date, round(value, 3) AS value, round(smoothed, 3) AS smoothed, round(COALESCE({pct("b", "smoothed")}, 0), 3) AS dod, round({pct("COALESCE(w, f)", "smoothed")}, 3) AS wow, round(COALESCE({pct("b", "smoothed")}, 0), 3) AS mom,
            round(COALESCE({pct("y", "smoothed")}, 0), 3) AS yoy FROM (SELECT *, lag(smoothed) OVER o AS b, lag(smoothed, 7) OVER o AS w, lag(smoothed, 12) OVER o AS y, first_value(smoothed) OVER o AS f FROM smooth WINDOW o AS (ORDER BY date))""", "smooth")),
    "complete_calendar": (lambda s, d: series.complete_calendar(raw(s, d).groupBy("region", "obs_date").agg(F.count("*").alias("n")), "obs_date", ["region"]),
        sql("""SELECT region, CAST(day AS DATE) AS obs_date, n FROM (SELECT region, unnest(generate_series(min(obs_date), max(obs_date), INTERVAL 1 DAY)) AS day FROM quotes GROUP BY region)
            LEFT JOIN (SELECT region, obs_date, count(*) AS n FROM quotes GROUP BY ALL) q USING (region) WHERE q.obs_date = CAST(day AS DATE)
            UNION ALL SELECT region, CAST(day AS DATE), NULL FROM (SELECT region, unnest(generate_series(min(obs_date), max(obs_date), INTERVAL 1 DAY)) AS day FROM quotes GROUP BY region) c
            WHERE NOT EXISTS (SELECT 1 FROM quotes q WHERE q.region = c.region AND q.obs_date = CAST(c.day AS DATE))""", "quotes")),
    "weekly_series": (lambda s, d: rounded(series.period_series(cleaning.decompose(raw(s, d)), "week", "total_fare", "obs_date"), 3),
        sql(f"""SELECT period, round(value, 3) AS value, n, round({pct("a", "value")}, 3) AS change, round({pct("b", "value")}, 3) AS yoy FROM (SELECT *, lag(value) OVER (ORDER BY period) AS a, lag(value, 52) OVER (ORDER BY period) AS b FROM
            (SELECT strftime(obs_date, '%G-W%V') AS period, avg(total_fare) AS value, count(*) AS n FROM priced GROUP BY ALL))""", "priced")),
    "monthly_series": (lambda s, d: rounded(series.period_series(points(s, d)), 3),
        sql(f"""SELECT period, round(value, 3) AS value, CAST(1 AS BIGINT) AS n, round({pct("a", "value")}, 3) AS change, round({pct("b", "value")}, 3) AS yoy FROM
            (SELECT *, lag(value) OVER (ORDER BY period) AS a, lag(value, 12) OVER (ORDER BY period) AS b FROM monthly)""", "monthly")),
    "headline": (lambda s, d: rounded(series.headline(series.smooth(points(s, d))), 3),
        sql(f"""SELECT date AS last_date, round(smoothed, 3) AS last_value, round(m, 3) AS month_mean, round(smoothed - m, 3) AS points, round({pct("m", "smoothed")}, 3) AS percent FROM (SELECT date, smoothed, lag(smoothed) OVER (ORDER BY date) AS m FROM smooth) ORDER BY date DESC LIMIT 1""", "smooth")),
    "index_range": (lambda s, d: rounded(series.index_series(points(s, d).select("date", "value"), START, END), 3), sql(f"SELECT date, round(value, 3) AS value FROM points WHERE date BETWEEN DATE '{START}' AND DATE '{END}'", "points")),
    "last_points": (lambda s, d: rounded(series.tail(points(s, d).select("date", "value"), 12), 3), sql("SELECT date, round(value, 3) AS value FROM points ORDER BY date DESC LIMIT 12", "points")),
    "rebased_points": (lambda s, d: rounded(series.rebase(points(s, d).select("date", "value"), last=24), 3),
        sql("SELECT date, round(value, 3) AS value, round(value / first_value(value) OVER (ORDER BY date) * 100, 3) AS rebased FROM (SELECT date, value FROM points ORDER BY date DESC LIMIT 24)", "points")),
    "latest_groups": (_latest_groups, sql(f"""SELECT region, round(l / f * 100, 3) AS last_value, round({pct("b", "l")}, 3) AS change_1, round({pct("y", "l")}, 3) AS change_year FROM (SELECT region, arg_max(level, period) AS l, arg_min(level, period) AS f,
        arg_max(one, period) AS b, arg_max(year_before, period) AS y FROM (SELECT *, lag(level) OVER (PARTITION BY region ORDER BY period) AS one, COALESCE(lag(level, 12) OVER (PARTITION BY region ORDER BY period), first_value(level) OVER (PARTITION BY region ORDER BY period)) AS year_before
        FROM (SELECT period, region, sum(weight * price) / sum(weight) AS level FROM cells JOIN weights USING (route_id) GROUP BY ALL)) GROUP BY region)""", "cells", "weights")),
    "expanding_mean": (lambda s, d: rounded(series.expanding_mean(prices(s, d).select("route_id", "period", "price"), "price", "period", ["route_id"]), 3),
        sql("SELECT route_id, period, round(price, 3) AS price, round(avg(price) OVER (PARTITION BY route_id ORDER BY period ROWS UNBOUNDED PRECEDING), 3) AS expanding FROM prices", "prices")),
    "differences": (lambda s, d: rounded(series.log_changes(series.differences(prices(s, d).select("route_id", "period", "price"), "price", "period", ["route_id"]), "price", "period", ["route_id"]), 3),
        sql("""SELECT route_id, period, round(price, 3) AS price, round(price - lag(price) OVER (PARTITION BY route_id ORDER BY period), 3) AS diff, round(ln(price / lag(price) OVER (PARTITION BY route_id ORDER BY period)), 3) AS log_change FROM prices""", "prices")),
    "average_ranks": (lambda s, d: cleaning.decompose(raw(s, d)).groupBy("route_id", "lead_time").agg(F.max("total_fare").alias("top")).withColumn("rank", series.average_rank("top", ["route_id"])),
        sql("""SELECT route_id, lead_time, top, rank() OVER (PARTITION BY route_id ORDER BY top) + (count(*) OVER (PARTITION BY route_id, top) - 1) / 2 AS rank FROM (SELECT route_id, lead_time, max(total_fare) AS top FROM priced GROUP BY ALL)""", "priced")),
    "route_month_heatmap": (lambda s, d: rounded(series.route_month_heatmap(relatives(s, d), "period"), 3),
        sql(f"""SELECT route_id, month, round("index", 3) AS "index", round(COALESCE({pct("b", '"index"')}, 0), 3) AS mom FROM (SELECT *, lag("index") OVER (PARTITION BY route_id ORDER BY month) AS b FROM
            (SELECT route_id, strftime(period, '%Y-%m') AS month, avg(relative) * 100 AS "index" FROM relatives GROUP BY ALL))""", "relatives")),
    "quality_series": (lambda s, d: rounded(series.quality_series(points(s, d), 24), 3),
        sql("SELECT date, round(nominal, 3) AS nominal, round(value, 3) AS value, round(quality_index, 3) AS quality_index, round(hedge_ratio, 3) AS hedge_ratio FROM points ORDER BY date DESC LIMIT 24", "points")),
    "release_rows": (lambda s, d: series.release_rows(points(s, d)),
        sql("SELECT strftime(date, '%Y-%m-%d') AS period, round(value, 2) AS \"index\", round(nominal, 2) AS nominal, round(quality_index, 4) AS quality, round(hedge_ratio, 4) AS hedge_ratio, observations FROM points", "points")),
    "route_fares": (_route_fares, sql(f"SELECT route_id, round(avg(total_fare), 3) AS avg_fare, count(*) AS quotes, {ORIGIN} AS origin FROM clean WHERE {LATEST} GROUP BY ALL", "clean")),
    "lead_fares": (lambda s, d: rounded(market.lead_fares(clean(s, d), "1996-05-01", "period"), 3), sql(f"SELECT lead_time, round(avg(total_fare), 3) AS avg_fare, {ORIGIN} AS origin FROM clean WHERE period = DATE '1996-05-01' GROUP BY ALL", "clean")),
    "lead_elasticity": (lambda s, d: rounded(_elasticity(s, d)),
        sql(f"""SELECT lead_time, round(level, 4) AS level, round(level / r * 100, 4) AS "index", round({pct("r", "level")}, 4) AS premium_pct, round(CASE WHEN lead_time = 7 THEN 0 ELSE ln(level / r) / ln(lead_time / 7.0) END, 4) AS elasticity FROM
            (SELECT *, max(CASE WHEN lead_time = 7 THEN level END) OVER () AS r FROM (SELECT lead_time, sum(weight * price) / sum(weight) AS level FROM cells JOIN weights USING (route_id)
            WHERE period <= DATE '1998-01-31' AND period > DATE '1998-01-31' - 365 GROUP BY ALL))""", "cells", "weights")),
    "booking_summary": (lambda s, d: rounded(market.booking_summary(_elasticity(s, d))),
        sql(f"""SELECT arg_min(lead_time, level) AS trough_lead, round(min(level), 4) AS trough, round(-({pct("max(CASE WHEN lead_time = 1 THEN level END)", "min(level)")}), 4) AS saving_pct, round({pct("min(level)", "max(CASE WHEN lead_time = 45 THEN level END)")}, 4) AS late_rise_pct
            FROM (SELECT lead_time, sum(weight * price) / sum(weight) AS level FROM cells JOIN weights USING (route_id) WHERE period <= DATE '1998-01-31' AND period > DATE '1998-01-31' - 365 GROUP BY ALL)""", "cells", "weights")),
    "channel_wedge": (lambda s, d: rounded(market.channel_wedge(clean(s, d), column="period", every_date=True), 3),
        sql(f"""SELECT route_id, round(a, 3) AS direct_fare, round(o, 3) AS ota_fare, round(o - a, 3) AS wedge, round({pct("a", "o")}, 3) AS wedge_pct FROM (SELECT route_id, avg(total_fare) FILTER (k = 'airline') AS a, avg(total_fare) FILTER (k = 'ota') AS o
            FROM (SELECT *, {case("source_id", dims.SOURCE_KIND)} AS k FROM clean) GROUP BY ALL) WHERE a IS NOT NULL AND o IS NOT NULL""", "clean")),
    "channel_wedge_median": (lambda s, d: rounded(market.channel_wedge(clean(s, d), "1996-05-01", "median", "period"), 3),
        sql(f"""SELECT route_id, round(a, 3) AS direct_fare, round(o, 3) AS ota_fare, round(o - a, 3) AS wedge, round({pct("a", "o")}, 3) AS wedge_pct FROM (SELECT route_id, median(total_fare) FILTER (k = 'airline') AS a, median(total_fare) FILTER (k = 'ota') AS o
            FROM (SELECT *, {case("source_id", dims.SOURCE_KIND)} AS k FROM clean WHERE period = DATE '1996-05-01') GROUP BY ALL) WHERE a IS NOT NULL AND o IS NOT NULL""", "clean")),
    "mean_wedge": (lambda s, d: rounded(market.mean_wedge(market.channel_wedge(clean(s, d), column="period", every_date=True)), 3),
        sql(f"""SELECT round(avg({pct("a", "o")}), 3) AS mean_wedge_pct, count(*) AS routes FROM (SELECT route_id, avg(total_fare) FILTER (k = 'airline') AS a, avg(total_fare) FILTER (k = 'ota') AS o
            FROM (SELECT *, {case("source_id", dims.SOURCE_KIND)} AS k FROM clean) GROUP BY ALL) WHERE a IS NOT NULL AND o IS NOT NULL""", "clean")),
    "explore_cell": (lambda s, d: rounded(market.explore_cell(clean(s, d), "ASIA-EUROPE", "1996-05-01", column="period"), 3),
        sql(f"""SELECT CASE WHEN lead_time IS NOT NULL THEN 'lead' WHEN carrier IS NOT NULL THEN 'carrier' ELSE 'total' END AS grouping, COALESCE(CAST(lead_time AS VARCHAR), carrier, 'all') AS key, round(avg_fare, 3) AS avg_fare, quotes,
            round({pct("r", "avg_fare")}, 3) AS premium_pct FROM (SELECT *, max(CASE WHEN lead_time = 7 THEN avg_fare END) OVER () AS r FROM (SELECT lead_time, carrier, avg(total_fare) AS avg_fare, count(*) AS quotes FROM clean
            WHERE route_id = 'ASIA-EUROPE' AND period = DATE '1996-05-01' GROUP BY GROUPING SETS ((lead_time), (carrier), ())))""", "clean")),
    "sample_rows": (lambda s, d: market.sample_rows(raw(s, d), 2, views.CELL, views.ORDER).select(*views.CELL, "l_orderkey", "l_linenumber", "fare_text", F.col("nth").cast("long").alias("nth")),
        sql(f"SELECT {CELL}, l_orderkey, l_linenumber, fare_text, row_number() OVER (PARTITION BY {CELL} ORDER BY {', '.join(views.ORDER)}) AS nth FROM quotes QUALIFY nth <= 2", "quotes")),
    "top_routes": (lambda s, d: rounded(market.top(weights(s, d), 8, "weight", "route_id"), 8), sql("SELECT route_id, round(weight, 8) AS weight FROM weights ORDER BY weight DESC, route_id LIMIT 8", "weights")),
    "distinct_sources": (lambda s, d: raw(s, d).select("period", "source_id").distinct(), sql("SELECT DISTINCT period, source_id FROM quotes", "quotes")),
    "upsert_points": (_upserted, sql("""SELECT date, round(value, 2) AS value, true AS is_synthetic FROM points WHERE year(date) <> 1997 UNION ALL SELECT date, round(round(value, 2) + 1, 2), false FROM points WHERE year(date) = 1997""", "points")),
    "releases": (_releases, sql("""SELECT period, 'monthly' AS frequency, CASE WHEN period >= '1997-06' THEN round(value, 2) ELSE value END AS value, CASE WHEN DATE '2001-06-30' - CAST(period || '-28' AS DATE) <= 60 THEN 'provisional' ELSE 'frozen' END AS status,
        CASE WHEN period >= '1997-06' THEN 'web,api' ELSE 'web' END AS channels FROM monthly WHERE period <= '2001-06' ORDER BY period DESC LIMIT 40""", "monthly")),
    "spearman": (lambda s, d: rounded(validation.spearman(validation.align(monthly(s, d), views.reference_series(s, d)))),
        sql(f"SELECT round({PEARSON.format('rx', 'ry')}, 4) AS spearman FROM (SELECT rank() OVER (ORDER BY x) AS rx, rank() OVER (ORDER BY y) AS ry FROM pairs)", "pairs")),
    "cross_correlation": (lambda s, d: validation.cross_correlation(validation.align(monthly(s, d), views.reference_series(s, d))),
        sql(f"""SELECT CAST(lag AS INTEGER) AS lag, round({PEARSON.format('x', 'y')}, 3) AS r, count(*) AS n FROM (SELECT l.lag, a.x, b.y FROM (SELECT unnest([-3, -2, -1, 0, 1, 2, 3]) AS lag) l, (SELECT *, row_number() OVER (ORDER BY period) AS i FROM pairs) a,
            (SELECT *, row_number() OVER (ORDER BY period) AS i FROM pairs) b WHERE b.i = a.i + l.lag) GROUP BY lag""", "pairs")),
    "best_lag": (lambda s, d: validation.best_lag(validation.cross_correlation(validation.align(monthly(s, d), views.reference_series(s, d)))),
        sql(f"""SELECT CAST(lag AS INTEGER) AS best_lag, r AS best_r FROM (SELECT lag, round({PEARSON.format('x', 'y')}, 3) AS r FROM (SELECT l.lag, a.x, b.y FROM (SELECT unnest([-3, -2, -1, 0, 1, 2, 3]) AS lag) l, (SELECT *, row_number() OVER (ORDER BY period) AS i FROM pairs) a,
            (SELECT *, row_number() OVER (ORDER BY period) AS i FROM pairs) b WHERE b.i = a.i + l.lag) GROUP BY lag) ORDER BY r DESC, lag LIMIT 1""", "pairs")),
    "backtest": (lambda s, d: rounded(validation.backtest(monthly(s, d), views.reference_series(s, d)), 3),
        sql(f"""SELECT months, round(pearson, 3) AS pearson, round(mape, 3) AS mape, round(directional, 3) AS directional, round(mean_mom_gap, 3) AS mean_mom_gap, round(spearman, 3) AS spearman,
            CASE WHEN months < 6 THEN 'insufficient overlap' WHEN pearson >= 0.9 AND mape < 10 THEN 'PASS' WHEN pearson >= 0.7 THEN 'PASS (directional)' ELSE 'REVIEW' END AS verdict
            FROM (SELECT count(*) AS months, {PEARSON.format('a', 'b')} AS pearson, avg(abs((a - b) / b)) * 100 AS mape, avg(CAST(sign(da) = sign(db) AS DOUBLE)) * 100 AS directional, avg(abs(da - db)) AS mean_mom_gap FROM rebased),
            (SELECT {PEARSON.format('rx', 'ry')} AS spearman FROM (SELECT rank() OVER (ORDER BY x) AS rx, rank() OVER (ORDER BY y) AS ry FROM pairs))""", "rebased")),
    "backtest_table": (lambda s, d: rounded(validation.backtest_table(monthly(s, d), views.reference_series(s, d)), 3),
        sql("SELECT period, round(x, 3) AS x, round(y, 3) AS y, round(a, 3) AS a, round(b, 3) AS b, round(gap, 3) AS gap, round(da, 3) AS da, round(db, 3) AS db FROM rebased", "rebased")),
    "ols": (_ols_check, sql("""SELECT term, round(beta, 3) AS beta, round(r2, 3) AS r2, n_rows FROM (SELECT 'x' AS term, regr_slope(y, x) AS beta, regr_r2(y, x) AS r2, count(*) AS n_rows FROM pairs UNION ALL
        SELECT 'intercept', regr_intercept(y, x), regr_r2(y, x), count(*) FROM pairs)""", "pairs")),
    "ols_by_route": (_panel, sql("""SELECT route_id, term, round(CASE term WHEN 'quotes' THEN b1 WHEN 'quality' THEN b2 ELSE my - b1 * m1 - b2 * m2 END, 2) AS beta,
        round(CASE term WHEN 'quotes' THEN b1 / sqrt(v * s22 / d) WHEN 'quality' THEN b2 / sqrt(v * s11 / d) ELSE (my - b1 * m1 - b2 * m2) / sqrt(v * (1.0 / n_rows + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / d)) END, 2) AS t,
        round(1 - rest / syy, 2) AS r2, n_rows FROM (SELECT *, rest / (n_rows - 3) AS v FROM (SELECT *, syy - b1 * s1y - b2 * s2y AS rest FROM (SELECT *, (s1y * s22 - s2y * s12) / d AS b1, (s2y * s11 - s1y * s12) / d AS b2 FROM
        (SELECT *, s11 * s22 - s12 * s12 AS d FROM (SELECT route_id, count(*) AS n_rows, avg(quotes) AS m1, avg(quality) AS m2, avg(price) AS my, count(*) * var_pop(quotes) AS s11, count(*) * var_pop(quality) AS s22, count(*) * var_pop(price) AS syy,
        count(*) * covar_pop(quotes, quality) AS s12, count(*) * covar_pop(quotes, price) AS s1y, count(*) * covar_pop(quality, price) AS s2y FROM prices GROUP BY route_id))))), (SELECT unnest(['intercept', 'quotes', 'quality']) AS term)""", "prices")),
    "driver_regression": (_drivers, sql("""SELECT term, round(beta, 3) AS beta, round(beta / sqrt(rest / (n - 4) * factor), 3) AS t, round(1 - rest / syy, 3) AS r2, n AS n_rows, round(beta * 100, 3) AS effect, abs(beta / sqrt(rest / (n - 4) * factor)) >= 2 AS significant
        FROM (SELECT *, unnest(['intercept', 'quantity', 'total', 'lines']) AS term, unnest([b0, b1, b2, b3]) AS beta, unnest([1.0 / n + lever, i11, i22, i33]) AS factor FROM slopes)""", "slopes")),
    "driver_readings": (lambda s, d: validation.shown_readings(_readings(s, d), DRIVERS).withColumn("value", F.round(F.col("value") + 1e-7, 3)),  # means of cents often end on a tie
        sql("""SELECT unnest(['quantity', 'total', 'lines']) AS name, period, round(unnest([quantity, total, lines]) + 1e-7, 3) AS value FROM (SELECT * FROM readings WHERE period > (SELECT min(period) FROM readings) ORDER BY period DESC LIMIT 18)""", "readings")),
    "mape_level": (_error_of_levels, sql("SELECT round(avg(abs((x - y) / y)) * 100, 3) AS mape, count(*) AS periods FROM pairs", "pairs")),
    "month_end_series": (_month_end, sql(f"""SELECT period, round(value, 3) AS value, n, round({pct("a", "value")}, 3) AS change, round({pct("b", "value")}, 3) AS yoy FROM (SELECT *, lag(value) OVER (ORDER BY period) AS a, lag(value, 12) OVER (ORDER BY period) AS b FROM
        (SELECT strftime(obs_date, '%Y-%m') AS period, arg_max(fare, obs_date) AS value, count(*) AS n FROM (SELECT obs_date, avg(total_fare) AS fare FROM priced GROUP BY obs_date) GROUP BY ALL))""", "priced")),
    "sketched_medians": (_sketched, sql("SELECT route_id, round(avg(quality), 9) AS quality, count(*) AS quotes, true AS close FROM clean GROUP BY ALL", "clean")),
    "daily_views": (_daily_views, sql(f"""SELECT 'route' AS view, route_id AS key, round(avg(total_fare), 3) AS value, {ORIGIN} AS origin FROM clean WHERE {LATEST} GROUP BY ALL
        UNION ALL SELECT 'lead', CAST(lead_time AS VARCHAR), round(avg(total_fare), 3), {ORIGIN} FROM clean WHERE {LATEST} GROUP BY lead_time
        UNION ALL SELECT 'wedge_pct', route_id, round({pct("a", "o")}, 3), NULL FROM (SELECT route_id, avg(total_fare) FILTER (k = 'airline') AS a, avg(total_fare) FILTER (k = 'ota') AS o
            FROM (SELECT *, {case("source_id", dims.SOURCE_KIND)} AS k FROM clean WHERE {LATEST}) GROUP BY ALL) WHERE a IS NOT NULL AND o IS NOT NULL""", "clean")),
    "sweep_audit": (lambda s, d: rounded(audit.sweep_audit(views.sweep_log(s, d), 10), 3),
        sql("SELECT date, source_id, requests, raw_quotes, http_errors, retries, block_events, round(duration_ms, 3) AS duration_ms, status FROM audit", "audit")),
    "run_totals": (lambda s, d: audit.run_totals(audit.sweep_audit(views.sweep_log(s, d), 10)),
        sql(f"""SELECT date, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("requests", "raw_quotes", "http_errors", "retries", "block_events"))}, count(*) FILTER (status = 'blocked') AS blocked, count(*) FILTER (status = 'degraded') AS degraded FROM audit GROUP BY date""", "audit")),
    "source_shares": (lambda s, d: rounded(audit.source_shares(audit.sweep_audit(views.sweep_log(s, d), 10))),
        sql("SELECT source_id, CAST(sum(raw_quotes) AS BIGINT) AS raw_quotes, round(sum(raw_quotes) * 100.0 / sum(sum(raw_quotes)) OVER (), 4) AS share_pct FROM audit GROUP BY source_id", "audit")),
    "last_runs": (lambda s, d: audit.last_runs(dims.sources(s).select("source_id", "kind"), audit.sweep_audit(views.sweep_log(s, d), 10)),
        sql(f"""SELECT source_id, kind, max(date) AS date, arg_max(status, date) AS status, arg_max(raw_quotes, date) AS raw_quotes FROM (SELECT unnest([{", ".join(f"'{x}'" for x in dims.SOURCE_KIND)}]) AS source_id, unnest([{", ".join(f"'{x}'" for x in dims.SOURCE_KIND.values())}]) AS kind)
            LEFT JOIN audit USING (source_id) GROUP BY ALL""", "audit")),
    "error_windows": (lambda s, d: error_windows(views.sweep_log(s, d)).select(F.to_date("window.start").alias("day"), "source_id", "events", "http_errors", "block_events"),
        sql("SELECT date AS day, source_id, count(*) AS events, CAST(sum(http_errors) AS BIGINT) AS http_errors, CAST(sum(block_events) AS BIGINT) AS block_events FROM log GROUP BY ALL", "log")),
    "collection_plan": (_plan_days, sql(f"""SELECT CAST(day AS DATE) AS obs_date, source_id, count(*) AS searches, max(CAST(day AS DATE) + lead_time) AS last_departure,
        max('from=' || split_part(route_id, '-', 1) || '&to=' || split_part(route_id, '-', 2) || '&date=' || CAST(CAST(day AS DATE) + lead_time AS VARCHAR) || '&adults=1') AS last_query FROM weights, (SELECT unnest([1, 7, 15, 30, 45]) AS lead_time),
        (SELECT unnest([{", ".join(f"'{x}'" for x in dims.SOURCE_KIND)}]) AS source_id), {DAYS} GROUP BY ALL""", "weights")),
    "grid_coverage": (_coverage, sql(f"""SELECT obs_date, source_id, CAST(5 * k AS BIGINT) AS expected, seen, round(seen / (5 * k) * 100, 4) AS coverage, seen / (5 * k) * 100 < 80 AS downgraded FROM (SELECT count(*) AS k FROM weights), (SELECT CAST(day AS DATE) AS obs_date, source_id, count(DISTINCT (q.route_id, q.lead_time)) FILTER (q.route_id IS NOT NULL) AS seen
        FROM {DAYS} CROSS JOIN (SELECT unnest([{", ".join(f"'{x}'" for x in dims.SOURCE_KIND)}]) AS source_id)
        LEFT JOIN (SELECT obs_date AS od, source_id AS sid, route_id, lead_time FROM quotes SEMI JOIN weights USING (route_id)) q ON q.od = CAST(day AS DATE) AND q.sid = source_id GROUP BY ALL)""", "quotes", "weights")),
    "challenge_pages": (lambda s, d: pages.flag_challenges(views.table(s, d, "pages"), (*pages.CHALLENGES, "error")).select("page_id", "blocked"),
        "SELECT page_id, regexp_matches(lower(html), 'captcha|unusual traffic|verify you are human|access denied|cf-challenge|_incapsula_resource|error') AS blocked FROM pages"),
    "extract_quotes": (_pages, None),
    "report_headline": (_headline, sql(f"""SELECT 'headline' AS section, unnest(['value', 'smoothed', 'dod', 'wow', 'mom', 'yoy', 'nominal', 'quality_index']) AS key,
        round(unnest([value, smoothed, COALESCE({pct("b", "smoothed")}, 0), {pct("w", "smoothed")}, COALESCE({pct("b", "smoothed")}, 0), COALESCE({pct("y", "smoothed")}, 0), nominal, quality_index]), 3) AS value FROM
        (SELECT *, lag(smoothed) OVER o AS b, COALESCE(lag(smoothed, 7) OVER o, first_value(smoothed) OVER o) AS w, lag(smoothed, 365) OVER o AS y FROM smooth WINDOW o AS (ORDER BY date)) WHERE date = (SELECT max(date) FROM smooth)
        UNION ALL SELECT 'month', 'percent', round({pct("m", "smoothed")}, 3) FROM (SELECT date, smoothed, lag(smoothed) OVER (ORDER BY date) AS m FROM smooth) WHERE date = (SELECT max(date) FROM smooth)
        UNION ALL SELECT unnest(['route_fare', 'route_change_pct', 'route_weight_pct']), route_id, round(unnest([price, (relative - 1) * 100, weight * 100]), 3) FROM
            (SELECT * FROM relatives WHERE period = (SELECT max(period) FROM relatives) ORDER BY weight DESC, route_id LIMIT 8)""", "smooth")),
    "report_series": (lambda s, d: rounded(reports.series_report(points(s, d), "month"), 3),
        sql(f"""SELECT period, round(value, 3) AS value, CAST(1 AS BIGINT) AS n, round({pct("a", "value")}, 3) AS change, round({pct("b", "value")}, 3) AS yoy FROM (SELECT *, lag(value) OVER (ORDER BY period) AS a, lag(value, 12) OVER (ORDER BY period) AS b
            FROM (SELECT strftime(date, '%Y-%m') AS period, smoothed AS value FROM smooth))""", "smooth")),
    "report_sub_indices": (_sub_indices,
        sql("""SELECT grouping, key, period, round(level / first_value(level) OVER (PARTITION BY grouping, key ORDER BY period) * 100, 3) AS rebased FROM (
            SELECT 'lead_time' AS grouping, CAST(lead_time AS VARCHAR) AS key, period, sum(weight * price) / sum(weight) AS level FROM cells JOIN weights USING (route_id) GROUP BY lead_time, period QUALIFY row_number() OVER (PARTITION BY lead_time ORDER BY period DESC) <= 24
            UNION ALL SELECT 'region', region, period, sum(weight * price) / sum(weight) FROM cells JOIN weights USING (route_id) GROUP BY region, period QUALIFY row_number() OVER (PARTITION BY region ORDER BY period DESC) <= 24)""", "cells", "weights")),
    "report_basket": (_basket, sql(f"""SELECT 'route' AS section, route_id AS key, round(weight * 100, 3) AS weight_pct, round(relative * 100, 3) AS value FROM relatives WHERE period = (SELECT max(period) FROM relatives)
        UNION ALL SELECT 'lead', CAST(lead_time AS VARCHAR), round({case("lead_time", dims.LEADS)} * 100, 3), round(sum(weight * price) / sum(weight), 3) FROM cells JOIN weights USING (route_id)
        WHERE period = (SELECT max(period) FROM cells JOIN weights USING (route_id)) GROUP BY lead_time""", "relatives")),
    "report_pipeline": (lambda s, d: rounded(reports.pipeline_report(dims.sources(s), audit.sweep_audit(views.sweep_log(s, d), 10)), 3),
        sql(f"""SELECT source_id, kind, date, status, raw_quotes, round(total * 100.0 / sum(total) OVER (), 3) AS share_pct FROM (SELECT source_id, kind, max(date) AS date, arg_max(status, date) AS status, arg_max(raw_quotes, date) AS raw_quotes, sum(raw_quotes) AS total
            FROM (SELECT unnest([{", ".join(f"'{x}'" for x in dims.SOURCE_KIND)}]) AS source_id, unnest([{", ".join(f"'{x}'" for x in dims.SOURCE_KIND.values())}]) AS kind) LEFT JOIN audit USING (source_id) GROUP BY source_id, kind)""", "audit")),
    "report_explorer": (lambda s, d: rounded(reports.explorer_report(tagged(s, d), "ASIA-EUROPE", "1996-05-01", views.CELL, "period"), 3),
        sql("""SELECT 'funnel' AS section, COALESCE(drop_reason, 'kept') AS key, CAST(NULL AS DOUBLE) AS value, count(*) AS quotes FROM tagged WHERE route_id = 'ASIA-EUROPE' AND period = DATE '1996-05-01' GROUP BY ALL
            UNION ALL SELECT CASE WHEN lead_time IS NOT NULL THEN 'lead' WHEN carrier IS NOT NULL THEN 'carrier' ELSE 'total' END, COALESCE(CAST(lead_time AS VARCHAR), carrier, 'all'), round(avg(total_fare), 3), count(*)
            FROM clean WHERE route_id = 'ASIA-EUROPE' AND period = DATE '1996-05-01' GROUP BY GROUPING SETS ((lead_time), (carrier), ())""", "clean")),
}


def queries() -> dict:
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in QUERIES.items() if text}
