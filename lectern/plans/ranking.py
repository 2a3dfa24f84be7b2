"""Exact row numbers that do not put a group, or the table, into one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.plans.scratch import settle

_MID, _PID, _BASE, _FIRST = "__mid", "__pid", "__base", "__first"
_OFFSET_MASK = (1 << 33) - 1


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on ``keys`` in which null matches null; the right copies are dropped."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def number_rows(
    df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), out: str = "rn"
) -> DataFrame:
    """Add ``out`` = 1, 2, .. in ``order``, restarting for each value of ``by``.

    ``order`` must end in a unique column. The rows are range partitioned on ``by`` and
    ``order``, so a hot group spreads over as many tasks as its size asks for; each range is
    sorted and written once, and only one offset per range is combined globally.
    """
    keys = [F.col(k) for k in by]
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    stored = settle(ranged.withColumn(_MID, F.monotonically_increasing_id()), "ranked")
    # monotonically_increasing_id = range number in the upper bits, position in the lower 33
    pid = F.shiftright(F.col(_MID), 33)
    sizes = stored.groupBy(pid.alias(_PID)).agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy(_PID).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(_PID, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(_BASE))
    # one row per range: bounded by the number of shuffle partitions
    numbered = stored.withColumn(_PID, pid).join(F.broadcast(offsets), _PID)
    position = F.col(_BASE) + F.col(_MID).bitwiseAND(F.lit(_OFFSET_MASK))
    numbered = numbered.withColumn(out, (position + 1).cast("long")).drop(_PID, _BASE)
    if by:
        starts = settle(numbered.groupBy(*by).agg(F.min(out).alias(_FIRST)), "starts")
        numbered = null_safe_join(numbered, starts, by)
        numbered = numbered.withColumn(out, F.col(out) - F.col(_FIRST) + 1).drop(_FIRST)
    return numbered.drop(_MID)


def number_by_key(
    df: DataFrame, key: str, columns: Sequence[str], order: Sequence[Column], by: Sequence[str] = (),
    out: str = "rn", most: int | None = None,
) -> DataFrame:
    """:func:`number_rows` for wide rows: only the unique ``key`` and the ordering ``columns``
    are ranged and written, and the numbers are joined back. With ``most`` only those rows stay,
    and the join is a broadcast as long as their file is small."""
    slim = df.select(*dict.fromkeys([key, *by, *columns]))
    numbered = number_rows(slim, order, by, out)
    if most is not None:
        numbered = settle(numbered.where(F.col(out) <= most), "first")
    return df.join(numbered.select(key, out), key)


def hash_key(id_col: Column | str, seed: int) -> Column:
    """Seeded order key of a row: hex md5 of ``seed|id``."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}|"), column.cast("string")))


def number_by_hash(
    df: DataFrame, id_col: str, seed: int, by: Sequence[str] = (), out: str = "hn", digits: int = 4
) -> DataFrame:
    """Add ``out`` = 0, 1, .. in seeded hash order (the stand-in for a seeded shuffle).

    The first hex ``digits`` of the hash split every group into equally sized buckets. Bucket
    sizes are summed up separately, so each window holds one bucket and never a whole group.
    """
    marked = df.withColumn("__h", hash_key(id_col, seed)).withColumn(
        "__b", F.substring("__h", 1, digits)
    )
    keys = ["__b"]
    if by:
        # one never-null key, so that the join and the window share one exchange
        marked = marked.withColumn("__k", F.to_json(F.struct(*by)))
        keys = ["__k", "__b"]
    sizes = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*keys[:-1]).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(_BASE))
    inside = W.partitionBy(*keys).orderBy("__h", id_col)
    numbered = marked.join(offsets, keys).withColumn(
        out, F.col(_BASE) + F.row_number().over(inside) - 1
    )
    return numbered.drop("__h", _BASE, *keys)


def keep_first(df: DataFrame, key: Sequence[Column | str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first ``n`` rows per key in ``order``.

    A rank filter with a literal bound: Spark places a group limit in front of the shuffle, so
    at most ``n`` rows per key leave each map task, however many copies the key has.
    """
    ranked = df.withColumn("__rn", F.row_number().over(W.partitionBy(*key).orderBy(*order)))
    return ranked.where(F.col("__rn") <= n).drop("__rn")
