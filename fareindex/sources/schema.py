"""Schemas of the fact tables."""

RAW_QUOTES = (
    "source_id string, carrier string, route_id string, origin string, destination string, departure date, lead_time int, fare_class string, "
    "flight_no string, fare_text string, tax_text string, fee_text string, seats_left int, refundable boolean, baggage_kg int, "
    "collected_at timestamp, sold_out boolean, is_cancelled boolean, is_synthetic boolean"
)
INDEX_POINTS = "date date, value double, nominal double, quality_index double, hedge_ratio double, avg_fare double, observations bigint, is_synthetic boolean"
RELEASES = "period string, frequency string, value double, published_at timestamp, channels array<string>"
SWEEP_LOG = "date date, source_id string, requests bigint, raw_quotes bigint, http_errors bigint, retries bigint, block_events bigint, duration_ms double"
