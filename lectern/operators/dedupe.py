"""Exact duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import norm_text, strip
from lectern.plans.ranking import keep_first


def text_key(col: str) -> Column:
    """Fixed-width identity of a normalised text: shuffles 64 characters instead of the text."""
    return F.sha2(norm_text(col), 256)


def first_texts(df: DataFrame, col: str = "texto", order: str = "ord", key: str = "__key") -> DataFrame:
    """First row in ``order`` per normalised text, with the identity of its text as ``key``; blank texts are dropped."""
    filled = df.where(F.coalesce(strip(col), F.lit("")) != "").withColumn(key, text_key(col))
    return keep_first(filled, [key], [order])


def dedupe_text(df: DataFrame, col: str = "texto", order: str = "ord") -> DataFrame:
    """First row in ``order`` per normalised text; blank texts are dropped."""
    return first_texts(df, col, order).drop("__key")


def dedupe_id(df: DataFrame, key: str = "question_id", order: str = "ord") -> DataFrame:
    """First row in ``order`` per key; rows without a key are dropped."""
    return keep_first(df.where(F.col(key).isNotNull()), [key], [order])


def seed_then_extend(existing: DataFrame, new: DataFrame, key: str = "question_id", order: str = "ord") -> DataFrame:
    """Rows of ``existing`` win over ``new`` ones with the same key."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(
        new.withColumn("__new", F.lit(1)), allowMissingColumns=True
    )
    return keep_first(both.where(F.col(key).isNotNull()), [key], ["__new", order]).drop("__new")


def duplicate_report(df: DataFrame, col: str = "texto") -> DataFrame:
    """total, unique and duplicates of the normalised text (two-level count, no hot key)."""
    sizes = df.groupBy(text_key(col).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    unique = F.count(F.lit(1))
    return sizes.agg(
        total.alias("total"), unique.alias("unique_rows"), (total - unique).alias("duplicates")
    )
