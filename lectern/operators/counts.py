"""Counts and shares in long form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions import labels as L
from lectern.functions import text as T
from lectern.functions.arrays import safe_fraction
from lectern.plans.ranking import keep_first


def value_counts(df: DataFrame, col: Column | str, out: str = "value") -> DataFrame:
    value = F.col(col) if isinstance(col, str) else col
    return df.groupBy(value.alias(out)).agg(F.count(F.lit(1)).alias("n"))


def exploded_counts(df: DataFrame, col: str, lower: bool = False, out: str = "value") -> DataFrame:
    """Counts of array elements."""
    items = df.select(F.explode(col).alias(out))
    return value_counts(items, F.lower(out) if lower else F.col(out), out)


def top_k(counts: DataFrame, k: int, key: str = "value", n: str = "n") -> DataFrame:
    """The ``k`` largest counts; ties by key."""
    return counts.orderBy(F.desc(n), F.asc(key)).limit(k)


def cell(section: str, key: Column, when: Column | None = None) -> Column:
    """One (section, key) tally mark of a row, left out when the condition fails."""
    mark = F.struct(F.lit(section).alias("section"), key.cast("string").alias("key"))
    return mark if when is None else F.when(when, mark)


def tally(df: DataFrame, *cells: Column, lists: Sequence[Column] = ()) -> DataFrame:
    """Many counts in one scan and one shuffle: each row emits its marks, marks are counted.

    ``lists`` are columns that hold arrays of marks already.
    """
    marks = F.array_compact(F.array(*cells))
    if lists:
        marks = F.concat(marks, *lists)
    return df.select(F.inline(marks)).groupBy("section", "key").agg(F.count(F.lit(1)).alias("n"))


def label_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Supervised labels per head."""
    long = L.heads_long(df, by).where(F.col("supervised") & F.col("label").isNotNull())
    return long.groupBy(*by, "head", "label").agg(F.count(F.lit(1)).alias("n"))


def supervision_coverage(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Supervised and unsupervised rows per head."""
    long = L.heads_long(df, by)
    return long.groupBy(*by, "head").agg(
        F.count_if("supervised").alias("supervised_rows"),
        F.count_if(~F.col("supervised")).alias("unsupervised_rows"),
    )


def source_counts(df: DataFrame, source: str = "fuente") -> DataFrame:
    return value_counts(df, L.source_or_unknown(source), source)


def signal_counts(df: DataFrame) -> DataFrame:
    """Rows with a positive signal and rows without a body."""
    blank = F.coalesce(T.strip("body"), F.lit("")) == ""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.coalesce(F.col("urgency_signal"), F.lit(0)) > 0).alias("urgency_gt0"),
        F.count_if(F.coalesce(F.col("advanced_signal"), F.lit(0)) > 0).alias("advanced_gt0"),
        F.count_if(blank).alias("body_empty"),
    )


def synthetic_fraction(df: DataFrame, by: Sequence[str] = (), source: str = "fuente") -> DataFrame:
    """Share of synthetic rows, 0 for an empty group."""
    n, synth = F.count(F.lit(1)), F.count_if(L.is_synthetic(source))
    return df.groupBy(*by).agg(
        n.alias("n_rows"), synth.alias("n_synthetic"), safe_fraction(synth, n).alias("fraction")
    )


def extraction_audit(selected: DataFrame, candidates: DataFrame, top_tags: int = 24) -> DataFrame:
    """Pool and selection sizes, domains, strategies, signals and the most frequent tags."""
    tag_marks = F.transform(
        F.coalesce(F.col("tags"), F.array().cast("array<string>")),
        lambda t: F.struct(F.lit("tag").alias("section"), F.lower(t).alias("key")),
    )
    counted = tally(
        selected,
        cell("total", F.lit("selected")),
        cell("domain", F.coalesce(F.col("domain"), F.lit("general"))),
        cell("strategy", T.strategy_prefix("source_strategy")),
        cell("signal", F.lit("urgency_gt0"), F.coalesce(F.col("urgency_signal") > 0, F.lit(False))),
        cell("signal", F.lit("advanced_gt0"), F.coalesce(F.col("advanced_signal") > 0, F.lit(False))),
        lists=[tag_marks],
    )
    tags = counted.where(F.col("section") == "tag")
    pool = candidates.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("total").alias("section"), F.lit("candidates").alias("key"), "n"
    )
    return (
        counted.where(F.col("section") != "tag")
        .unionByName(keep_first(tags, ["section"], [F.desc("n"), F.asc("key")], top_tags))
        .unionByName(pool)
    )


def corpus_summary(df: DataFrame) -> DataFrame:
    """Per domain: rows, mean body length, rows with signals."""
    return df.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.length(F.coalesce(F.col("body"), F.lit("")))).alias("mean_body"),
        F.count_if(F.col("urgency_signal") > 0).alias("urgency_gt0"),
        F.count_if(F.col("advanced_signal") > 0).alias("advanced_gt0"),
    )


def labeling_summary(df: DataFrame) -> DataFrame:
    """Counts per model, level, urgency and emotion."""
    return tally(
        df,
        cell("total", F.lit("labeled")),
        cell("model", F.coalesce(F.col("model_used"), F.lit("na"))),
        *[cell(h, F.lower(F.col(h)), T.blank_to_null(h).isNotNull()) for h in fixed.HEADS[:3] if h in df.columns],
    )


def deficits(df: DataFrame, targets: Mapping[str, tuple[str, str, int]]) -> DataFrame:
    """``max(0, target - count)`` per axis; ``targets`` maps axis to (column, label, target)."""
    counts = [
        F.greatest(F.lit(0), F.lit(goal) - F.count_if(F.col(col) == label)).cast("long").alias(axis)
        for axis, (col, label, goal) in targets.items()
    ]
    return df.agg(*counts)


def split_overlap(df: DataFrame, text: str = "texto", max_chars: int | None = None) -> DataFrame:
    """Unique texts per split and texts shared by two splits.

    Whole texts by default; ``max_chars=2000`` gives keys cut to that length.
    """
    key = F.sha2(T.norm_text(text, max_chars), 256).alias("key")
    flags = [F.max(F.col("split") == s).alias(s) for s in ("train", "val", "test")]
    seen = df.groupBy(key).agg(*flags)
    both = [("train", "val"), ("train", "test"), ("val", "test")]
    return seen.agg(
        *[F.count_if(s).alias(f"{s}_unique") for s in ("train", "val", "test")],
        *[F.count_if(F.col(a) & F.col(b)).alias(f"{a}_{b}") for a, b in both],
    )


def shared_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Number of distinct keys on each side, in both, and only on the left."""
    both = (
        left.select(key, F.lit(True).alias("l"), F.lit(False).alias("r"))
        .unionByName(right.select(key, F.lit(False).alias("l"), F.lit(True).alias("r")))
        .groupBy(key)
        .agg(F.max("l").alias("l"), F.max("r").alias("r"))
    )
    return both.agg(
        F.count_if("l").alias("n_left"),
        F.count_if("r").alias("n_right"),
        F.count_if(F.col("l") & F.col("r")).alias("n_both"),
        F.count_if(F.col("l") & ~F.col("r")).alias("n_left_only"),
    )
