"""Requests and replies: limits per window, scores, providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern import fixed


def rate_limits(
    requests: DataFrame, client: str = "client", ts: str = "ts", every: str = "1 minute",
    per_client: int = fixed.CLIENT_REQUESTS, in_all: int = fixed.ALL_REQUESTS,
) -> DataFrame:
    """``start, scope, client, n, refused`` per window: requests of each client, and of all (client null).

    Requests without a time are not counted; those without a client are one client.
    """
    slim = requests.select(F.window(ts, every).start.alias("start"), F.col(client))
    counts = slim.groupingSets([["start", client], ["start"]], "start", client).agg(
        F.when(F.grouping(client) == 1, "all").otherwise("client").alias("scope"), F.count(F.lit(1)).alias("n")
    )
    limit = F.when(F.col("scope") == "all", in_all).otherwise(per_client)
    return counts.select("start", "scope", client, "n", F.greatest(F.col("n") - limit, F.lit(0)).cast("bigint").alias("refused"))


def client_counts(
    requests: DataFrame, client: str = "client", ts: str = "ts", every: str = "1 minute", delay: str = "1 minute"
) -> DataFrame:
    """``start, client, n`` per window of a stream (or a static frame); state ends ``delay`` after a window."""
    counted = requests.withWatermark(ts, delay).groupBy(F.window(ts, every).alias("w"), client).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), client, "n")


def keep_scored(df: DataFrame, score: Column | str = "score", least: float = fixed.LEAST_SCORE) -> DataFrame:
    """The rows with at least that score; rows without one go."""
    return df.where((F.col(score) if isinstance(score, str) else score) >= least)


def provider_share(replies: DataFrame, provider: str = "provider", primary: str = "primary") -> DataFrame:
    """``provider, n, fraction, fallback`` of all replies; without a provider ``unknown``."""
    name = F.coalesce(F.col(provider), F.lit("unknown"))
    counts = replies.groupBy(name.alias("provider")).agg(F.count(F.lit(1)).alias("n"))
    # one row per provider
    return counts.select(
        "provider", "n", (F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0)))).alias("fraction"),
        (F.col("provider") != primary).alias("fallback"),
    )
