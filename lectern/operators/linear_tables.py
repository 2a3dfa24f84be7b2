"""Linear heads as a table: fitted by counting, applied as a sparse product.

A model is one row per token bucket with the weight of every class of every head, and two more rows for the
class shares and for tokens that no class has seen. Its size is bounded by buckets times classes, so it can be
broadcast, written and joined like any table, in SQL too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions import labels as L
from lectern.functions.text import tokens
from lectern.operators.scoring import view_rows

#: Every class of every head, in the order of the weights.
CLASSES = tuple((h, i) for h in fixed.HEADS for i in range(len(fixed.LABELS[h])))
#: Buckets of the two rows that belong to no token: class shares, unseen tokens.
SHARE, UNSEEN = -1, -2
#: Hex digits of a token's digest that make its bucket.
DIGITS = 4


def bucket(token: Column) -> Column:
    return F.conv(F.substring(F.md5(token), 1, DIGITS), 16, 10).cast("int")


def fit_table(df: DataFrame, alpha: float = 0.5, id_col: str = "ord", text: str = "texto") -> DataFrame:
    """``bucket, w`` (array by :data:`CLASSES`) from labelled rows: smoothed log shares of the buckets in each class.

    A row counts for the classes of the heads it supervises, an empty label for the head's default. One pass
    counts tokens by (bucket, class); rows are not multiplied by classes, and nothing comes to the driver.
    """
    hits = []
    for head, i in CLASSES:
        label = F.coalesce(L.label_index(F.lit(head), L.label_or_null(df, head)), F.lit(fixed.LABELS[head].index(fixed.HEAD_DEFAULT[head])))
        hits.append((L.is_supervised(df, head) & (label == i)).cast("int").alias(f"__c{len(hits)}"))
    names = [f"__c{k}" for k in range(len(CLASSES))]
    marked = df.select(F.col(id_col).alias("__id"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("__toks"), *hits)
    shares = marked.agg(*[F.sum(c).alias(c) for c in names])
    long = marked.select(*names, F.explode("__toks").alias("__t"))
    counts = long.groupBy(bucket(F.col("__t")).alias("bucket")).agg(*[F.sum(c).alias(c) for c in names])
    totals = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}n") for c in names])
    size = alpha * 16**DIGITS
    one = F.lit(1).alias("__one")
    joined = counts.select("*", one).join(F.broadcast(totals.select("*", one)), "__one")  # totals are one row
    floor = lambda c: F.log(F.lit(alpha) / (F.col(f"{c}n") + size))
    cells = joined.select("bucket", F.array(*[F.log((F.col(c) + alpha) / (F.col(f"{c}n") + size)) - floor(c) for c in names]).alias("w"))
    unseen = totals.select(F.lit(UNSEEN).alias("bucket"), F.array(*[floor(c) for c in names]).alias("w"))
    per_head = {h: sum(F.coalesce(F.col(names[k]), F.lit(0)) for k, (g, _) in enumerate(CLASSES) if g == h) for h in fixed.HEADS}
    prior = [F.log((F.coalesce(F.col(c), F.lit(0)) + alpha) / (per_head[h] + alpha * len(fixed.LABELS[h]))) for c, (h, _) in zip(names, CLASSES, strict=True)]
    share = shares.select(F.lit(SHARE).alias("bucket"), F.array(*prior).alias("w"))
    return cells.unionByName(unseen).unionByName(share)


def score_table(df: DataFrame, model: DataFrame, keys: list[str], toks: Column) -> DataFrame:
    """``keys, logits_<head>`` of token lists: every token meets its weights where it is, only sums per key are shuffled.

    ``model`` has at most ``16 ** DIGITS + 2`` rows of one number per class, which bounds the broadcast.
    """
    long = df.select(*keys, F.explode_outer(toks).alias("__t")).select(*keys, bucket(F.col("__t")).alias("bucket"))
    every = [F.coalesce(F.get("w", F.lit(k)), F.lit(0.0)) for k in range(len(CLASSES))]
    joined = long.join(F.broadcast(model.where(F.col("bucket") >= 0)), "bucket", "left")
    # rows without tokens have bucket null
    summed = joined.groupBy(*keys).agg(F.count("bucket").alias("__n"), *[F.sum(x).alias(f"__s{k}") for k, x in enumerate(every)])
    edges = model.where(F.col("bucket") < 0).agg(
        F.max(F.when(F.col("bucket") == SHARE, F.col("w"))).alias("__share"), F.max(F.when(F.col("bucket") == UNSEEN, F.col("w"))).alias("__unseen"))
    one = F.lit(1).alias("__one")
    full = summed.select("*", one).join(F.broadcast(edges.select("*", one)), "__one")  # edges are one row
    value = [F.get("__share", F.lit(k)) + F.col("__n") * F.get("__unseen", F.lit(k)) + F.col(f"__s{k}") for k in range(len(CLASSES))]
    return full.select(
        *keys, *[F.array(*[value[k] for k, (g, _) in enumerate(CLASSES) if g == h]).alias(f"logits_{h}") for h in fixed.HEADS])


def score_texts(df: DataFrame, model: DataFrame, id_col: str = "ord", text: str = "texto") -> DataFrame:
    """``id_col, logits_<head>`` of whole texts; an empty or null text gets the class shares."""
    return score_table(df, model, [id_col], tokens(F.coalesce(F.col(text), F.lit(""))))


def score_text_views(
    df: DataFrame, model: DataFrame, length: int = fixed.MAX_LEN, mode: str = "score", id_col: str = "ord", text: str = "texto"
) -> DataFrame:
    """Mean logits over the windows of a text: ``id_col, logits_<head>``."""
    views = view_rows(df.withColumn(text, F.coalesce(F.col(text), F.lit(""))), length, mode, id_col, text)
    scored = score_table(views, model, [id_col, "view"], F.col("toks"))
    means = [
        F.array(*[F.avg(F.get(f"logits_{h}", F.lit(i))) for i in range(len(fixed.LABELS[h]))]).alias(f"logits_{h}") for h in fixed.HEADS
    ]
    return scored.groupBy(id_col).agg(*means)
