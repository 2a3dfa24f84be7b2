"""Columns about label dimensions and their supervision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions.arrays import literal_map, map_value
from lectern.functions.text import blank_to_null


def normal_domain(col: Column | str) -> Column:
    """Raw domain to final domain, ``general`` when missing or unknown."""
    return map_value(F.coalesce(blank_to_null(col), F.lit("general")), fixed.DOMAIN_FINAL, "general")


def supervision(*heads: str) -> Column:
    """Mask in which exactly ``heads`` are supervised (all four when none are given)."""
    wanted = heads or fixed.HEADS
    return F.struct(*[F.lit(h in wanted).alias(h) for h in fixed.HEADS])


def is_supervised(df: DataFrame, head: str) -> Column:
    """Missing mask or missing key means supervised."""
    if "supervision" not in df.columns or head not in df.schema["supervision"].dataType.names:
        return F.lit(True)
    return F.coalesce(F.col(f"supervision.{head}"), F.lit(True))


def label_or_null(df: DataFrame, head: str, domain_alias: str = "domain") -> Column:
    """Trimmed label, null when blank; the domain falls back to its raw column."""
    label = blank_to_null(head)
    if head == "dominio" and domain_alias in df.columns:
        label = F.coalesce(label, blank_to_null(domain_alias))
    return label


def has_label(df: DataFrame, head: str, label: str) -> Column:
    """The row supervises ``head`` and carries ``label`` (domain normalised)."""
    value = label_or_null(df, head)
    if head == "dominio":
        value = F.when(value.isNotNull(), normal_domain(value))
    return F.coalesce(is_supervised(df, head) & (value == label), F.lit(False))


def is_synthetic(source: Column | str) -> Column:
    column = F.col(source) if isinstance(source, str) else source
    return F.coalesce(column.startswith(fixed.SYNTHETIC_PREFIX), F.lit(False))


def source_or_unknown(source: Column | str) -> Column:
    column = F.col(source) if isinstance(source, str) else source
    return F.coalesce(F.nullif(column, F.lit("")), F.lit("unknown"))


def heads_long(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per (row, head): the kept columns, ``head``, ``label``, ``supervised``."""
    cells = []
    for head in fixed.HEADS:
        label = label_or_null(df, head)
        if head == "dominio":
            label = F.when(label.isNotNull(), normal_domain(label))
        cells.append(
            F.struct(
                F.lit(head).alias("head"),
                label.alias("label"),
                is_supervised(df, head).alias("supervised"),
            )
        )
    return df.select(*keep, F.inline(F.array(*cells)))


def label_table(spark) -> DataFrame:
    """The closed label sets as a frame: head, label, idx."""
    rows = [(h, label, i) for h in fixed.HEADS for i, label in enumerate(fixed.LABELS[h])]
    return spark.createDataFrame(rows, "head string, label string, idx int")


def label_index(head: Column | str, label: Column | str) -> Column:
    """Class index of a label within its head; null when it is not in the label set."""
    head_col = F.col(head) if isinstance(head, str) else head
    label_col = F.col(label) if isinstance(label, str) else label
    keyed = {f"{h}|{x}": i for h in fixed.HEADS for i, x in enumerate(fixed.LABELS[h])}
    return F.try_element_at(literal_map(keyed), F.concat(head_col, F.lit("|"), label_col))


def n_classes(head: Column | str) -> Column:
    head_col = F.col(head) if isinstance(head, str) else head
    sizes = {h: len(v) for h, v in fixed.LABELS.items()}
    return F.element_at(literal_map(sizes), head_col)
