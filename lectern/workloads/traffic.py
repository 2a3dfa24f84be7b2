"""Limits, scores and providers over the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import traffic as TR
from lectern.workloads.base import query, table


@query("""
SELECT epoch_us(date_trunc('day', ts)) AS start_us, 'client' AS scope, user_id, count(*) AS n, greatest(count(*) - 20, 0) AS refused
FROM events GROUP BY 1, 3
UNION ALL
SELECT epoch_us(date_trunc('day', ts)), 'all', NULL, count(*), greatest(count(*) - 100, 0) FROM events GROUP BY 1
""")
def rate_limits(spark, sf):
    """The limits of a minute applied to days, as the events are sparse."""
    events = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    found = TR.rate_limits(events, "user_id", every="1 day")
    return found.select(F.unix_micros("start").alias("start_us"), "scope", "user_id", "n", "refused")


@query("SELECT event_id, value FROM events WHERE value >= 3")
def score_filter(spark, sf):
    return TR.keep_scored(table(spark, sf, "events").select("event_id", "value"), "value")


@query("""
SELECT coalesce(event_type, 'unknown') AS provider, count(*) AS n, count(*) / (SELECT count(*) FROM events)::DOUBLE AS fraction,
  coalesce(event_type, 'unknown') <> 'view' AS fallback FROM events GROUP BY 1
""")
def provider_share(spark, sf):
    return TR.provider_share(table(spark, sf, "events"), "event_type", "view")
