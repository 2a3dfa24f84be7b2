"""Class weights, confusion, F1, baselines, intervals and training curves."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern import fixed
from lectern.functions import labels as L
from lectern.functions import text as T
from lectern.functions.arrays import literal_array, log_softmax_at
from lectern.plans.ranking import null_safe_join
from lectern.plans.scratch import once

WIDE = tuple(f"{m}_{h}" for h in fixed.HEADS for m in ("f1_macro", "f1_micro", "acc"))


def index_labels(df: DataFrame, keep: Sequence[str] = ("ord",)) -> DataFrame:
    """Long class indices ``head, y_true``: explicit non-supervision gives -100, labels outside
    the sets give the head's default."""
    cells = []
    for head in fixed.HEADS:
        value = T.strip(F.coalesce(L.label_or_null(df, head), F.lit("")))
        index = F.coalesce(
            L.label_index(F.lit(head), value),
            F.lit(fixed.LABELS[head].index(fixed.HEAD_DEFAULT[head])),
        )
        supervised = L.is_supervised(df, head)
        cells.append(
            F.struct(
                F.lit(head).alias("head"),
                F.when(supervised, index).otherwise(fixed.IGNORE_INDEX).alias("y_true"),
            )
        )
    return df.select(*keep, F.inline(F.array(*cells)))


def join_predictions(truth: DataFrame, predicted: DataFrame, id_col: str = "row_id") -> DataFrame:
    return truth.join(predicted, [id_col, "head"])


def cells(df: DataFrame, by: Sequence[str] = (), ignored: bool = False) -> DataFrame:
    """Rows per (by, head, y_true, y_pred): everything below is computed from this small frame."""
    kept = df if ignored else df.where(F.col("y_true") != fixed.IGNORE_INDEX)
    return kept.groupBy(*by, "head", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def _dense(counted: DataFrame, by: Sequence[str], key: Column, spec: list[tuple], names: Sequence[str], fill) -> DataFrame:
    """All keys of ``spec`` for every group; the map per group is bounded by the label sets."""
    entry = F.struct(key.alias("k"), F.struct(*names).alias("v"))
    maps = counted.groupBy(*by).agg(F.map_from_entries(F.collect_list(entry)).alias("__m"))
    wanted = []
    for text_key, fields in spec:
        value = F.try_element_at(F.col("__m"), F.lit(text_key))
        wanted.append(
            F.struct(
                *[F.lit(v).alias(k) for k, v in fields.items()],
                *[F.coalesce(value[n], F.lit(fill)).alias(n) for n in names],
            )
        )
    return maps.select(*by, F.inline(F.array(*wanted)))


def confusion(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Dense confusion matrices: every (head, true label, predicted label) with its count."""
    key = F.concat_ws("|", "head", "y_true", "y_pred")
    spec = [
        (f"{h}|{t}|{p}", {"head": h, "true_label": a, "pred_label": b})
        for h in fixed.HEADS
        for t, a in enumerate(fixed.LABELS[h])
        for p, b in enumerate(fixed.LABELS[h])
    ]
    return _dense(cells(df, by), by, key, spec, ["n"], 0)


def class_sums(counted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per class: tp, support (true rows), predicted rows."""
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("y_true").alias("cls"), hit.alias("tp"), F.col("n").alias("sup"), F.lit(0).cast("long").alias("pred")),
        F.struct(F.col("y_pred").alias("cls"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("sup"), F.col("n").alias("pred")),
    )
    return (
        counted.select(*by, "head", F.inline(sides))
        .groupBy(*by, "head", "cls")
        .agg(F.sum("tp").alias("tp"), F.sum("sup").alias("support"), F.sum("pred").alias("predicted"))
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def f1(tp: Column, support: Column, predicted: Column) -> Column:
    return _ratio(2.0 * tp, support + predicted)


def per_class(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Dense precision, recall, F1 and support of every class; 0 where undefined."""
    sums = class_sums(cells(df, by), by)
    spec = [
        (f"{h}|{i}", {"head": h, "label": x}) for h in fixed.HEADS for i, x in enumerate(fixed.LABELS[h])
    ]
    dense = _dense(sums, by, F.concat_ws("|", "head", "cls"), spec, ["tp", "support", "predicted"], 0)
    tp, sup, pred = F.col("tp"), F.col("support"), F.col("predicted")
    return dense.select(
        *by, "head", "label", _ratio(tp, pred).alias("precision"), _ratio(tp, sup).alias("recall"),
        f1(tp, sup, pred).alias("f1"), "support",
    )


def metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per group: macro and micro F1 and accuracy per head, their macro mean, row count.

    Macro F1 averages the classes present in truth or prediction. A head without supervised
    rows scores 0 and still counts in the mean.
    """
    return metrics_from_cells(cells(df, by, ignored=True), by)


def metrics_from_cells(counted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    rows = counted.groupBy(*by, "head").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.max("n").alias("n_rows"))
    active = counted.where(F.col("y_true") != fixed.IGNORE_INDEX)
    sums = class_sums(active, by)
    score = f1(F.col("tp"), F.col("support"), F.col("predicted"))
    heads = sums.groupBy(*by, "head").agg(
        F.avg(score).alias("macro"), _ratio(F.sum("tp"), F.sum("support")).alias("acc")
    )
    picked = []
    for head in fixed.HEADS:
        here = F.col("head") == head
        macro = F.coalesce(F.max(F.when(here, F.col("macro"))), F.lit(0.0))
        acc = F.coalesce(F.max(F.when(here, F.col("acc"))), F.lit(0.0))
        # one label per row: micro F1 is the accuracy
        picked += [macro.alias(f"f1_macro_{head}"), acc.alias(f"f1_micro_{head}"), acc.alias(f"acc_{head}")]
    wide = heads.groupBy(*by).agg(*picked)
    if by:
        joined = null_safe_join(rows, wide, by, "left")
    else:
        joined = rows.withColumn("one", F.lit(1)).join(wide.withColumn("one", F.lit(1)), "one", "left").drop("one")
    filled = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in WIDE]
    out = joined.select(*by, "n_rows", *filled)
    mean = sum((F.col(f"f1_macro_{h}") for h in fixed.HEADS), F.lit(0.0)) / len(fixed.HEADS)
    return out.withColumn("f1_macro_mean", mean)


def metrics_by_source(
    df: DataFrame, source: str = "fuente", min_rows: int = 0, kinds: bool = True
) -> DataFrame:
    """Metrics per source and, with ``kinds``, for all real and all synthetic rows together.

    Each prediction is counted for its source and its kind in one aggregate. With ``min_rows`` smaller
    sources keep their row and its count, without scores, and are marked in ``note``.
    """
    name = L.source_or_unknown(source)
    base = df.groupBy(name.alias("__src"), "head", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n0"))
    groups = F.array(F.col("__src"), kind_of("__src")) if kinds else F.array("__src")
    counted = (
        base.select(F.explode(groups).alias("source"), "head", "y_true", "y_pred", "n0")
        .groupBy("source", "head", "y_true", "y_pred")
        .agg(F.sum("n0").alias("n"))
    )
    out = metrics_from_cells(counted, ["source"])
    if not min_rows:
        return out
    few = F.col("n_rows") < min_rows
    named = ("source", "head", "n_rows")
    scores = [F.col(c) if c in named else F.when(~few, F.col(c)).alias(c) for c in out.columns]
    return out.select(*scores, F.when(few, "skipped").alias("note"))


def kind_of(source: Column | str) -> Column:
    return F.when(L.is_synthetic(source), "__synthetic__").otherwise("__real__")


def source_summary(by_source: DataFrame) -> DataFrame:
    """Real and synthetic mean F1: the direct value, else the row-weighted mean over sources."""
    single = ~F.col("source").startswith("__")

    def summary(kind: str, synthetic: bool) -> Column:
        direct = F.max(F.when(F.col("source") == kind, F.col("f1_macro_mean")))
        part = single & (L.is_synthetic("source") if synthetic else ~L.is_synthetic("source"))
        weighted = F.sum(F.when(part, F.col("f1_macro_mean") * F.col("n_rows")))
        total = F.sum(F.when(part, F.col("n_rows")))
        return F.coalesce(direct, F.try_divide(weighted, total))

    return by_source.agg(
        summary("__real__", False).alias("real_f1_macro_mean"),
        summary("__synthetic__", True).alias("synthetic_f1_macro_mean"),
    )


def majority_baseline(df: DataFrame) -> DataFrame:
    """Macro F1 per head of always predicting its most frequent class (lowest index on ties)."""
    counts = df.where(F.col("y_true") != fixed.IGNORE_INDEX).groupBy("head", "y_true").agg(
        F.count(F.lit(1)).alias("n")
    )
    per_head = counts.groupBy("head").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("classes"), F.max("n").alias("top"),
        F.max(F.struct("n", (-F.col("y_true")).alias("i"))).alias("best"),
    )
    score = 2.0 * F.col("top") / (F.col("total") + F.col("top")) / F.col("classes")
    return per_head.select("head", (-F.col("best.i")).alias("majority"), score.alias("f1_macro"))


def class_weights(df: DataFrame) -> DataFrame:
    """Balanced weights ``n / (k * n_c)`` per head and label; absent labels weigh 1."""
    counts = df.where(F.col("y_true") != fixed.IGNORE_INDEX).groupBy("head", "y_true").agg(
        F.count(F.lit(1)).alias("n")
    )
    per_head = W.partitionBy("head")
    weight = F.sum("n").over(per_head) / (F.count(F.lit(1)).over(per_head) * F.col("n"))
    known = counts.select("head", F.col("y_true").alias("idx"), "n", weight.alias("w"))
    table = L.label_table(df.sparkSession)
    joined = table.join(known, ["head", "idx"], "left")
    return joined.select(
        "head", "label", "idx", F.coalesce("n", F.lit(0).cast("long")).alias("n"),
        F.coalesce("w", F.lit(1.0)).alias("weight"),
    )


def parity(
    left: DataFrame, right: DataFrame, rtol: float = fixed.PARITY_RTOL, atol: float = fixed.PARITY_ATOL,
    rtol_by_head: Mapping[str, float] | None = None, id_col: str = "row_id",
) -> DataFrame:
    """Per head: rows, largest absolute difference, rows outside the tolerance."""
    loose = {"emocion": max(rtol, fixed.PARITY_RTOL_EMOTION), **(rtol_by_head or {})}
    limit = F.lit(rtol)
    for head, value in loose.items():
        limit = F.when(F.col("head") == head, F.lit(value)).otherwise(limit)
    pairs = left.select(id_col, "head", F.col("logits").alias("a")).join(
        right.select(id_col, "head", F.col("logits").alias("b")), [id_col, "head"]
    )
    diffs = F.zip_with("a", "b", lambda x, y: F.abs(x - y))
    slack = F.zip_with("a", "b", lambda x, y: F.abs(x - y) <= atol + F.col("__r") * F.abs(y))
    ok = F.forall(slack, lambda v: F.coalesce(v, F.lit(False)))
    scored = pairs.withColumn("__r", limit).select("head", F.array_max(diffs).alias("d"), ok.alias("ok"))
    return scored.groupBy("head").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("d").alias("max_diff"), F.count_if(~F.col("ok")).alias("n_outside")
    )


def mean_nll(df: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Mean cross entropy per head of supervised rows (``logits``, ``y_true``); optional class
    weights ``head, idx, weight`` give the weighted mean."""
    scored = df.where(F.col("y_true") != fixed.IGNORE_INDEX).withColumn(
        "nll", -log_softmax_at("logits", "y_true")
    )
    if weights is None:
        scored = scored.withColumn("weight", F.lit(1.0))
    else:
        table = weights.select("head", F.col("idx").alias("y_true"), "weight")
        scored = scored.join(F.broadcast(table), ["head", "y_true"])  # one row per class
    return scored.groupBy("head").agg(
        F.count(F.lit(1)).alias("n_rows"), (F.sum(F.col("nll") * F.col("weight")) / F.sum("weight")).alias("mean_nll")
    )


def mean_head_acc(metrics_frame: DataFrame) -> DataFrame:
    acc = sum((F.col(f"acc_{h}") for h in fixed.HEADS), F.lit(0.0)) / len(fixed.HEADS)
    return metrics_frame.withColumn("mean_acc", acc)


#: Parts of a count below this power of two are drawn from the exact Poisson distribution, larger ones from the normal one.
EXACT_POWERS = 6


def poisson_thresholds(power: int) -> list[float]:
    """Cumulated probabilities of 0, 1, .. at a mean of ``2 ** power``, as far as a byte can tell them from 1."""
    mean, out, term = float(2**power), [], math.exp(-float(2**power))
    total, k = term, 0
    while total <= 1 - 1 / 512:
        out.append(total)
        k += 1
        term *= mean / k
        total += term
    return out


def normal_quantiles() -> list[float]:
    """Standard normal quantiles of the middles of 256 equal shares."""
    return [NormalDist().inv_cdf((i + 0.5) / 256) for i in range(256)]


def poisson_weight(n: Column, digest: Column) -> Column:
    """How often ``n`` rows are drawn together: the sum of one Poisson draw per binary digit of ``n``, whose
    uniform number is the digit's byte of a 256-bit hex digest (so ``n`` is below 2 ** 32)."""
    def passed(u: Column):
        return lambda c: c <= u

    parts = []
    for power in range(32):
        byte = F.conv(F.substring(digest, 2 * power + 1, 2), 16, 10).cast("int")
        if power < EXACT_POWERS:
            drawn = F.size(F.filter(literal_array(poisson_thresholds(power)), passed((byte + 0.5) / 256.0))).cast("bigint")
        else:
            z = F.get(literal_array(normal_quantiles()), byte)
            drawn = F.floor(float(2**power) + math.sqrt(2.0**power) * z + 0.5)
        parts.append(F.when(F.shiftright(n, power).bitwiseAND(F.lit(1)) == 1, drawn).otherwise(F.lit(0).cast("bigint")))
    return sum(parts[1:], parts[0])


def bootstrap_f1(df: DataFrame, n_boot: int = 500, seed: int = 42, id_col: str = "row_id") -> DataFrame:
    """Poisson bootstrap of the mean macro F1: ``n_boot, mean, std, ci95_low, ci95_high``.

    Every row counts a Poisson(1) number of times in a replicate, so the rows of one joint (truth, prediction)
    cell of the four heads count Poisson(rows) times. Rows are reduced to joint cells first (a closed set);
    the number of a cell and replicate comes from a hash of both, so it is the same at any partitioning, and the
    sums of a replicate merge like any other aggregate. Nothing is multiplied but the cells.
    """
    columns = []
    for head in fixed.HEADS:
        here = F.col("head") == head
        columns.append(F.coalesce(F.max(F.when(here, F.col("y_true"))), F.lit(fixed.IGNORE_INDEX)).cast("int").alias(f"t_{head}"))
        columns.append(F.coalesce(F.max(F.when(here, F.col("y_pred"))), F.lit(0)).cast("int").alias(f"p_{head}"))
    names = [f"{s}_{h}" for h in fixed.HEADS for s in ("t", "p")]
    joint = df.groupBy(id_col).agg(*columns).groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    drawn = joint.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    digest = F.sha2(F.concat_ws("|", *names, F.lit(seed), "replicate"), 256)
    drawn = once(drawn, {"__digest": digest})
    drawn = once(drawn, {"n": poisson_weight(F.col("__n"), F.col("__digest"))}).where("n > 0")
    sides = [F.struct(F.lit(h).alias("head"), F.col(f"t_{h}").alias("y_true"), F.col(f"p_{h}").alias("y_pred")) for h in fixed.HEADS]
    counted = drawn.select("replicate", "n", F.inline(F.array(*sides)))
    counted = counted.groupBy("replicate", "head", "y_true", "y_pred").agg(F.sum("n").alias("n"))
    scores = metrics_from_cells(counted, ["replicate"]).select(F.col("f1_macro_mean").alias("value"))
    return scores.agg(
        F.count(F.lit(1)).alias("n_boot"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.percentile("value", 0.025).alias("ci95_low"), F.percentile("value", 0.975).alias("ci95_high"),
    )


def checkpoint_metric(mixed: Column | str, real: Column | str, name: str = "mixed_f1_macro_mean") -> Column:
    """The score that decides the best epoch; without a real score the mixed one."""
    m = F.col(mixed) if isinstance(mixed, str) else mixed
    r = F.col(real) if isinstance(real, str) else real
    if name == "real_f1_macro_mean":
        return F.coalesce(r, m)
    if name == "composite_f1_macro_mean":
        return F.coalesce(0.70 * r + 0.30 * m, m)
    return m


def early_stop(history: DataFrame, metric: str, patience: int, by: Sequence[str] = (), epoch: str = "epoch") -> DataFrame:
    """Best epoch, its score and the last epoch run, per ``by``.

    An epoch improves when it beats every earlier one (and -1); training ends at the first
    epoch that is ``patience`` epochs past the last improvement. Groups are runs, so a window
    holds the epochs of one run.
    """
    run = W.partitionBy(*by).orderBy(epoch)
    before = run.rowsBetween(W.unboundedPreceding, -1)
    upto = run.rowsBetween(W.unboundedPreceding, 0)
    best_before = F.greatest(F.coalesce(F.max(metric).over(before), F.lit(-1.0)), F.lit(-1.0))
    marked = history.withColumn("__n", F.row_number().over(run)).withColumn(
        "__up", F.coalesce(F.col(metric) > best_before, F.lit(False))
    )
    last_up = F.coalesce(F.max(F.when(F.col("__up"), F.col("__n"))).over(upto), F.lit(0))
    marked = marked.withColumn("__stale", F.col("__n") - last_up)
    stop = F.min(F.when(F.col("__stale") >= patience, F.col("__n"))).over(W.partitionBy(*by))
    ran = marked.withColumn("__stop", stop).where(
        F.col("__stop").isNull() | (F.col("__n") <= F.col("__stop"))
    )
    best = F.max(F.when(F.col("__up"), F.struct(F.col("__n"), F.col(epoch).alias("e"), F.col(metric).alias("v"))))
    out = ran.groupBy(*by).agg(
        best.alias("b"), F.max(epoch).alias("last_epoch"), F.max("__stop").isNotNull().alias("stopped")
    )
    return out.select(*by, F.col("b.e").alias("best_epoch"), F.col("b.v").alias("best_score"), "last_epoch", "stopped")


def curves(history: DataFrame) -> DataFrame:
    """Learning curves: losses, mean accuracy, mean F1 and real F1 per epoch."""

    def mean_acc(col: str) -> Column:
        return sum((F.try_element_at(F.col(col), F.lit(f"acc_{h}")) for h in fixed.HEADS), F.lit(0.0)) / len(fixed.HEADS)

    return history.select(
        "epoch", "train_loss", "val_loss",
        mean_acc("metrics_train").alias("train_acc"),
        mean_acc("metrics_val").alias("val_acc"),
        F.try_element_at(F.col("metrics_val"), F.lit("f1_macro_mean")).alias("val_f1"),
        "real_f1",
    )


def report_rows(df: DataFrame, section: str, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Long report rows ``section, key, value`` of the numeric ``values`` of a frame."""
    marks = [
        F.struct(
            F.concat_ws("/", *[F.col(k).cast("string") for k in keys], F.lit(v)).alias("key"),
            F.col(v).cast("double").alias("value"),
        )
        for v in values
    ]
    return df.select(F.lit(section).alias("section"), F.inline(F.array(*marks)))


def diagnose(predictions: DataFrame, min_rows: int = 5) -> DataFrame:
    """Long report of a prediction table: totals, classes, confusion and sources."""
    parts = [
        report_rows(metrics(predictions), "metrics", [], ["n_rows", *WIDE, "f1_macro_mean"]),
        report_rows(per_class(predictions), "per_class", ["head", "label"], ["precision", "recall", "f1", "support"]),
        report_rows(confusion(predictions), "confusion", ["head", "true_label", "pred_label"], ["n"]),
        report_rows(
            metrics_by_source(predictions, min_rows=min_rows, kinds=False), "per_source", ["source"],
            ["n_rows", "f1_macro_mean"],
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
