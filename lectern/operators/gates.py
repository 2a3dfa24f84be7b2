"""Quality gates and reports over a labelled corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions import labels as L
from lectern.functions import text as T
from lectern.functions.arrays import safe_fraction, safe_pct
from lectern.operators.dedupe import duplicate_report
from lectern.plans.scratch import settle

SPLITS = ("train", "val", "test")
REPORT_COLUMNS = ("section", "name", "value", "bound", "passed")


def gate_thresholds(total: int) -> dict[str, int]:
    """Minimum rows per label in the whole corpus and in one split."""
    return {
        "full": min(400, max(1, int(total * 0.05))),
        "split": min(80, max(1, int(total * 0.0055))),
    }


def label_signatures(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per combination of ``by`` and the four active labels (null = not supervised).

    One map-side aggregate whose size is bounded by the label sets, from which every label
    count, share and gate of the corpus follows.
    """
    active = []
    for head in fixed.HEADS:
        label = L.label_or_null(df, head)
        if head == "dominio":
            label = F.when(label.isNotNull(), L.normal_domain(label))
        active.append(F.when(L.is_supervised(df, head), label).alias(head))
    return df.select(*by, *active).groupBy(*by, *fixed.HEADS).agg(F.count(F.lit(1)).alias("n"))


def signature_label_counts(signatures: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    cells = [F.struct(F.lit(h).alias("head"), F.col(h).alias("label")) for h in fixed.HEADS]
    long = signatures.select(*by, "n", F.inline(F.array(*cells)))
    return long.where(F.col("label").isNotNull()).groupBy(*by, "head", "label").agg(F.sum("n").alias("n"))


def _scoped_labels(spark: SparkSession, scopes: Sequence[str]) -> DataFrame:
    rows = [(s, h, x) for s in scopes for h in fixed.HEADS for x in fixed.LABELS[h]]
    return spark.createDataFrame(rows, "scope string, head string, label string")


def support_gates(counts: DataFrame, minimum: int | Column, scopes: Sequence[str] = ("all",)) -> DataFrame:
    """Every label of every head against ``minimum``; absent labels count as 0.

    ``counts`` has ``scope, head, label, n``.
    """
    bound = minimum if isinstance(minimum, Column) else F.lit(minimum).cast("long")
    wanted = _scoped_labels(counts.sparkSession, scopes)
    joined = wanted.join(counts, ["scope", "head", "label"], "left")
    n = F.coalesce(F.col("n"), F.lit(0).cast("long"))
    return joined.select(
        "scope", "head", "label", n.alias("n"), bound.alias("minimum"), (n >= bound).alias("passed")
    )


def mix_gates(
    fractions: DataFrame,
    max_train: float = fixed.MAX_TRAIN_SYNTHETIC,
    max_eval: float = fixed.MAX_EVAL_SYNTHETIC,
) -> DataFrame:
    """Synthetic share per split (``split, fraction``) against its cap."""
    cap = F.when(F.col("split") == "train", F.lit(max_train)).otherwise(F.lit(max_eval))
    return fractions.select(
        "split", "fraction", cap.alias("cap"), (F.col("fraction") <= cap).alias("passed")
    )


def _report(df: DataFrame, section: str, name: Column, value=None, bound=None, passed=None) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"),
        name.alias("name"),
        (value if value is not None else F.lit(None)).cast("double").alias("value"),
        (bound if bound is not None else F.lit(None)).cast("double").alias("bound"),
        (passed if passed is not None else F.lit(None)).cast("boolean").alias("passed"),
    )


def _all_passed(df: DataFrame, section: str, name: str) -> DataFrame:
    return df.agg(F.coalesce(F.every("passed"), F.lit(True)).alias("passed")).select(
        *_report_cols(section, name)
    )


def _report_cols(section: str, name: str) -> list[Column]:
    none = F.lit(None).cast("double")
    return [
        F.lit(section).alias("section"), F.lit(name).alias("name"),
        none.alias("value"), none.alias("bound"), F.col("passed"),
    ]


def quality_report(df: DataFrame, text: str = "texto", source: str = "fuente") -> DataFrame:
    """Totals, sources, label counts, duplicates, synthetic shares, thresholds and gates."""
    spark = df.sparkSession
    slim = df.withColumn("fuente_", L.source_or_unknown(source))
    signatures = settle(label_signatures(slim, ["fuente_", "split"]), "signatures")
    duplicates = settle(duplicate_report(df, text), "duplicates")
    total = signatures.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bounds = gate_thresholds(total)

    sources = signatures.groupBy("fuente_").agg(F.sum("n").alias("n"))
    per_split = signature_label_counts(signatures, ["split"]).withColumnRenamed("split", "scope")
    full = per_split.groupBy(F.lit("all").alias("scope"), "head", "label").agg(F.sum("n").alias("n"))
    synth = F.when(L.is_synthetic("fuente_"), F.col("n")).otherwise(0)
    shares = signatures.groupBy("split").agg(
        safe_fraction(F.sum(synth), F.sum("n")).alias("fraction")
    )
    share_all = signatures.agg(safe_fraction(F.sum(synth), F.sum("n")).alias("fraction"))

    label = F.concat_ws("/", "head", "label")
    full_gate = support_gates(full, bounds["full"])
    split_gate = support_gates(per_split, bounds["split"], SPLITS)
    mix_gate = mix_gates(shares)
    dup_gate = duplicates.select((F.col("duplicates") == 0).alias("passed"))
    summary = [
        _all_passed(full_gate, "gates", "full"),
        _all_passed(split_gate, "gates", "splits"),
        _all_passed(mix_gate, "gates", "source_mix"),
        _all_passed(dup_gate, "gates", "duplicates"),
    ]
    gates = summary[0]
    for part in summary[1:]:
        gates = gates.unionByName(part)
    one = spark.range(1)
    parts = [
        _report(one, "total_rows", F.lit("all"), F.lit(total)),
        _report(sources, "sources", F.col("fuente_"), F.col("n")),
        _report(full, "counts", label, F.col("n")),
        _report(
            duplicates.select(F.expr("stack(3, 'total', total, 'unique', unique_rows, 'duplicates', duplicates) as (k, v)")),
            "duplicates", F.col("k"), F.col("v"),
        ),
        _report(share_all, "source_mix", F.lit("all"), F.col("fraction")),
        _report(shares, "source_mix", F.col("split"), F.col("fraction")),
        _report(one, "thresholds", F.lit("full"), F.lit(bounds["full"])),
        _report(one, "thresholds", F.lit("split"), F.lit(bounds["split"])),
        _report(full_gate, "gate_full", label, F.col("n"), F.col("minimum"), F.col("passed")),
        _report(
            split_gate, "gate_split", F.concat_ws("/", "scope", "head", "label"),
            F.col("n"), F.col("minimum"), F.col("passed"),
        ),
        _report(mix_gate, "gate_mix", F.col("split"), F.col("fraction"), F.col("cap"), F.col("passed")),
        gates,
        _all_passed(gates, "gates", "all_pass"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def labeling_report(
    raw: DataFrame,
    labeled: DataFrame,
    min_high_pct: float = 8.0,
    min_advanced_pct: float = 4.0,
    min_domain: int = 5,
    keys: Sequence[str] = fixed.QUESTION_KEYS,
) -> DataFrame:
    """One row: sizes, empties, rates and the eight gates of a labelling run."""

    def blank(col: str) -> Column:
        return F.coalesce(T.strip(col), F.lit("")) == ""

    complete = F.lit(True)
    for key in keys:
        complete = complete & (F.col(key).isNotNull() if key in labeled.columns else F.lit(False))
    # per-key pre-aggregate: a key with many copies is reduced before the shuffle
    per_id = labeled.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(blank("body")).alias("empty"),
        F.count_if(complete).alias("complete"),
        F.count_if(F.col("urgencia") == "alta").alias("high"),
        F.count_if(F.col("nivel_tecnico") == "avanzado").alias("advanced"),
    )
    right = per_id.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("labeled_rows"),
        F.count(F.lit(1)).alias("unique_ids"),
        F.coalesce(F.sum("empty"), F.lit(0)).alias("labeled_body_empty"),
        F.coalesce(F.sum("complete"), F.lit(0)).alias("schema_ok_rows"),
        F.coalesce(F.sum("high"), F.lit(0)).alias("high"),
        F.coalesce(F.sum("advanced"), F.lit(0)).alias("advanced"),
    )
    per_domain = raw.groupBy(F.coalesce(F.col("domain"), F.lit("general")).alias("domain")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(blank("body")).alias("empty")
    )
    left = per_domain.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("raw_rows"),
        F.coalesce(F.sum("empty"), F.lit(0)).alias("raw_body_empty"),
        F.coalesce(F.min("rows"), F.lit(min_domain)).alias("smallest_domain"),
    )
    # two one-row summaries side by side
    both = left.withColumn("one", F.lit(1)).join(right.withColumn("one", F.lit(1)), "one").drop("one")
    raw_pct = lambda part: F.when(F.col("labeled_rows") > 0, F.col(part) / F.col("labeled_rows") * 100).otherwise(0.0)
    gates = {
        "gate_rows_match_raw": F.col("labeled_rows") == F.col("raw_rows"),
        "gate_unique_question_ids": F.col("unique_ids") == F.col("labeled_rows"),
        "gate_raw_body_non_empty": F.col("raw_body_empty") == 0,
        "gate_labeled_body_non_empty": F.col("labeled_body_empty") == 0,
        "gate_schema_coverage_100pct": F.col("schema_ok_rows") == F.col("labeled_rows"),
        "gate_urgencia_alta_min_pct": raw_pct("high") >= min_high_pct,
        "gate_nivel_avanzado_min_pct": raw_pct("advanced") >= min_advanced_pct,
        "gate_domain_floor": F.col("smallest_domain") >= min_domain,
    }
    ready = F.lit(True)
    for name in gates:
        ready = ready & F.col(name)
    return (
        both.withColumns(gates)
        .withColumn("nivel_avanzado_pct", safe_pct("advanced", "labeled_rows"))
        .withColumn("urgencia_alta_pct", safe_pct("high", "labeled_rows"))
        .withColumn("ready", ready)
        .drop("high", "advanced", "smallest_domain")
    )


def done_report(
    metrics: DataFrame, baselines: DataFrame, train_metrics: DataFrame,
    thresholds: dict[str, float] | None = None, gap: float = fixed.OVERFIT_GAP,
) -> DataFrame:
    """Thresholds, beats-the-majority checks and train-validation gap warnings, in long form.

    ``metrics`` and ``train_metrics`` are one-row frames of :func:`lectern.operators.metrics.metrics`;
    ``baselines`` has ``head, f1_macro``.
    """
    limits = thresholds or fixed.DONE_THRESHOLDS
    names = ["f1_macro_mean", *fixed.HEADS]
    column = {"f1_macro_mean": "f1_macro_mean", **{h: f"f1_macro_{h}" for h in fixed.HEADS}}
    marks = [
        F.struct(
            F.lit("threshold").alias("section"), F.lit(n).alias("name"),
            F.col(column[n]).alias("value"), F.lit(float(limits[n])).alias("bound"),
            (F.col(column[n]) >= limits[n]).alias("passed"),
        )
        for n in names
    ]
    checks = metrics.select(F.inline(F.array(*marks)))
    by_head = metrics.select(
        F.inline(F.array(*[F.struct(F.lit(h).alias("head"), F.col(f"f1_macro_{h}").alias("value")) for h in fixed.HEADS]))
    )
    majority = by_head.join(baselines, "head").select(
        F.lit("majority").alias("section"), F.col("head").alias("name"), "value",
        F.col("f1_macro").alias("bound"), (F.col("value") > F.col("f1_macro")).alias("passed"),
    )
    pair = metrics.select(F.lit(1).alias("one"), *[F.col(f"f1_macro_{h}") for h in fixed.HEADS[:2]]).join(
        train_metrics.select(F.lit(1).alias("one"), *[F.col(f"f1_macro_{h}").alias(f"t_{h}") for h in fixed.HEADS[:2]]),
        "one",
    )
    gaps = [
        F.struct(
            F.lit("overfit").alias("section"), F.lit(h).alias("name"),
            (F.col(f"t_{h}") - F.col(f"f1_macro_{h}")).alias("value"), F.lit(gap).alias("bound"),
            (F.col(f"t_{h}") - F.col(f"f1_macro_{h}") <= gap).alias("passed"),
        )
        for h in fixed.HEADS[:2]
    ]
    return checks.unionByName(majority).unionByName(pair.select(F.inline(F.array(*gaps))))
