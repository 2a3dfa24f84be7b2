import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern import fixed
from lectern.operators import gates as G
from lectern.operators import metrics as M
from lectern.operators import scoring as SC

SCHEMA = "row_id long, fuente string, head string, y_true int, y_pred int"


def macro(pairs):
    classes = {t for t, _ in pairs} | {p for _, p in pairs}
    scores = []
    for c in classes:
        tp = sum(t == p == c for t, p in pairs)
        denominator = sum(t == c for t, _ in pairs) + sum(p == c for _, p in pairs)
        scores.append(2 * tp / denominator)
    return sum(scores) / len(scores) if scores else 0.0


def random_predictions(n, seed, ignore=0.2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["so_es", "synthetic_a", "goemotions_es", "rara" if i < 3 else "so_es"])
        for head in fixed.HEADS:
            k = len(fixed.LABELS[head])
            truth = -100 if rng.random() < ignore or (source == "goemotions_es" and head != "emocion") else rng.randrange(k)
            guess = truth if truth >= 0 and rng.random() < 0.6 else rng.randrange(k)
            rows.append((i, source, head, truth, guess))
    return rows


def expected_metrics(rows):
    out = {}
    for head in fixed.HEADS:
        pairs = [(t, p) for _, _, h, t, p in rows if h == head and t != -100]
        out[f"f1_macro_{head}"] = macro(pairs)
        out[f"acc_{head}"] = sum(t == p for t, p in pairs) / len(pairs) if pairs else 0.0
    out["f1_macro_mean"] = sum(out[f"f1_macro_{h}"] for h in fixed.HEADS) / 4
    return out


def check(row, rows):
    for key, value in expected_metrics(rows).items():
        assert row[key] == pytest.approx(value, abs=1e-12), key


def test_published_confusion_matrix(spark):
    matrix = [[490, 77, 0], [100, 478, 5], [10, 11, 342]]
    rows = [(t, p, n) for t, line in enumerate(matrix) for p, n in enumerate(line)]
    wide = spark.createDataFrame(rows, "y_true int, y_pred int, n int").select(
        F.lit(1).cast("long").alias("row_id"), F.lit("x").alias("fuente"), F.lit("nivel_tecnico").alias("head"), "y_true", "y_pred",
        F.explode(F.array_repeat(F.lit(1), F.col("n"))),
    )
    classes = {r["label"]: round(r["f1"], 4) for r in M.per_class(wide).where("head = 'nivel_tecnico'").collect()}
    assert classes == {"principiante": 0.8398, "intermedio": 0.8320, "avanzado": 0.9634}
    assert round(M.metrics(wide).first()["f1_macro_nivel_tecnico"], 4) == 0.8784
    cells = {(r["true_label"], r["pred_label"]): r["n"] for r in M.confusion(wide).where("head = 'nivel_tecnico'").collect()}
    assert cells[("avanzado", "principiante")] == 10 and cells[("principiante", "avanzado")] == 0


def test_metrics_against_plain_python(spark):
    rows = random_predictions(200, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    row = M.metrics(df).first()
    check(row, rows)
    assert row["n_rows"] == 200
    by = {r["source"]: r for r in M.metrics_by_source(df).collect()}
    assert set(by) == {"so_es", "synthetic_a", "goemotions_es", "rara", "__real__", "__synthetic__"} or "rara" not in {r[1] for r in rows}
    for source in {r[1] for r in rows}:
        check(by[source], [r for r in rows if r[1] == source])
    check(by["__real__"], [r for r in rows if not r[1].startswith("synthetic_")])
    assert by["goemotions_es"]["f1_macro_urgencia"] == 0.0
    noted = {r["source"]: r for r in M.metrics_by_source(df, min_rows=5, kinds=False).collect()}
    assert set(noted) == {r[1] for r in rows}
    for source, r in noted.items():
        assert r["n_rows"] == by[source]["n_rows"]
        assert (r["note"], r["f1_macro_mean"] is None) == (("skipped", True) if r["n_rows"] < 5 else (None, False))


def test_source_summary_falls_back_to_weighted_mean(spark):
    frame = spark.createDataFrame([("so_es", 10, 0.5), ("otra", 30, 0.9), ("synthetic_a", 5, 0.2)], "source string, n_rows long, f1_macro_mean double")
    row = M.source_summary(frame).first()
    assert row["real_f1_macro_mean"] == pytest.approx(0.8) and row["synthetic_f1_macro_mean"] == pytest.approx(0.2)


def test_baseline_and_weights(spark):
    rows = random_predictions(150, 9, 0.1)
    df = spark.createDataFrame(rows, SCHEMA)
    base = {r["head"]: r for r in M.majority_baseline(df).collect()}
    weights = M.class_weights(df).collect()
    for head in fixed.HEADS:
        truth = [t for _, _, h, t, _ in rows if h == head and t != -100]
        top = min(set(truth), key=lambda c: (-truth.count(c), c))
        assert base[head]["majority"] == top
        assert base[head]["f1_macro"] == pytest.approx(macro([(t, top) for t in truth]))
        mine = [w for w in weights if w["head"] == head]
        assert len(mine) == len(fixed.LABELS[head])
        assert sum(w["n"] * w["weight"] for w in mine) == pytest.approx(len(truth))


def test_bootstrap_matches_row_resampling(spark):
    rows = random_predictions(120, 12)
    got = M.bootstrap_f1(spark.createDataFrame(rows, SCHEMA), 400, 1).first()
    again = M.bootstrap_f1(spark.createDataFrame(rows, SCHEMA).repartition(5), 400, 1).first()
    assert tuple(got) == pytest.approx(tuple(again))
    rng = np.random.default_rng(0)
    by_row = [[r for r in rows if r[0] == i] for i in range(120)]
    means = []
    for _ in range(300):
        drawn = [x for i in rng.integers(0, 120, 120) for x in by_row[i]]
        means.append(expected_metrics(drawn)["f1_macro_mean"])
    assert got["n_boot"] == 400
    assert got["mean"] == pytest.approx(np.mean(means), abs=0.01)
    assert got["std"] == pytest.approx(np.std(means), rel=0.25)
    assert got["ci95_low"] < got["mean"] < got["ci95_high"]


def test_early_stop_equals_the_loop(spark):
    rng = random.Random(2)
    runs = {f"r{k}": [round(rng.random(), 2) for _ in range(12)] for k in range(8)}
    rows = [(run, e, v) for run, values in runs.items() for e, v in enumerate(values, 1)]
    got = {r["run"]: r for r in M.early_stop(spark.createDataFrame(rows, "run string, epoch int, m double"), "m", 3, ["run"]).collect()}
    for run, values in runs.items():
        best, best_epoch, stale, last, stopped = -1.0, 0, 0, 0, False
        for epoch, value in enumerate(values, 1):
            last = epoch
            if value > best:
                best, best_epoch, stale = value, epoch, 0
            else:
                stale += 1
                if stale >= 3:
                    stopped = True
                    break
        assert (got[run]["best_epoch"], got[run]["last_epoch"], got[run]["stopped"]) == (best_epoch, last, stopped)


def fit_loop(rows):
    out = {}
    for head in fixed.HEADS:
        mine = [(np.array(x), t) for h, t, x in rows if h == head and t != -100]

        def score(bias):
            return macro([(t, int(np.argmax(x + bias))) for x, t in mine])

        bias = np.zeros(len(fixed.LABELS[head]))
        best = score(bias)
        for _ in range(3):
            gained = False
            for c in range(len(bias)):
                top, value = best, bias[c]
                for v in fixed.BIAS_GRID:
                    trial = bias.copy()
                    trial[c] = v
                    got = score(trial)
                    if got > top + 1e-9:
                        top, value = got, v
                if top > best + 1e-9:
                    bias[c], best, gained = value, top, True
            if not gained:
                break
        out[head] = bias.tolist()
    return out


def test_fit_bias_equals_the_loop(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(60):
        for head in fixed.HEADS:
            k = len(fixed.LABELS[head])
            truth = rng.randrange(k) if rng.random() < 0.9 else -100
            # coarse values, so that ties occur
            logits = [rng.randrange(-4, 5) / 4 + (0.5 if i == truth else 0.0) + (0.75 if i == 0 else 0.0) for i in range(k)]
            rows.append((head, truth, logits))
    df = spark.createDataFrame(rows, "head string, y_true int, logits array<double>")
    found = SC.fit_bias(df)
    assert found == fit_loop(rows)
    assert any(any(v) for v in found.values())


def test_decode_checks_lengths(spark):
    names = [f"logits_{h}" for h in fixed.HEADS]
    good = spark.createDataFrame(
        [(1, [10.0, 0.0, 0.0], [0.0, 5.0, 0.0], [0.0] * 8 + [8.0], [9.0] + [0.0] * 7)],
        "row_id int, " + ", ".join(f"{n} array<double>" for n in names),
    )
    row = SC.decode_logits(good).first()
    assert [row[h] for h in fixed.HEADS] == ["principiante", "media", "neutral", "backend"]
    assert 0 < row["confianza"] <= 1 and row["conf_nivel_tecnico"] > 0.5
    bad = good.withColumn("logits_urgencia", F.array(F.lit(1.0)))
    with pytest.raises(Exception, match="expected 3"):
        SC.decode_logits(bad).collect()


def test_gates(spark):
    assert G.gate_thresholds(12_000) == {"full": 400, "split": 66}
    counts = spark.createDataFrame([("all", "urgencia", "alta", 5)], "scope string, head string, label string, n long")
    got = {(r["head"], r["label"]): (r["n"], r["passed"]) for r in G.support_gates(counts, 5).collect()}
    assert len(got) == 23 and got[("urgencia", "alta")] == (5, True) and got[("urgencia", "baja")] == (0, False)


def test_parity_and_views(spark):
    base = [(1, h, [1.0] * len(fixed.LABELS[h])) for h in fixed.HEADS]
    moved = [(1, h, [1.0003] * len(fixed.LABELS[h])) for h in fixed.HEADS]
    schema = "row_id int, head string, logits array<double>"
    out = {r["head"]: r["n_outside"] for r in M.parity(spark.createDataFrame(moved, schema), spark.createDataFrame(base, schema)).collect()}
    assert out == {"nivel_tecnico": 1, "urgencia": 1, "emocion": 0, "dominio": 1}
    views = spark.createDataFrame([(1, "urgencia", 1, [3.0, 4.0]), (1, "urgencia", 0, [1.0, 2.0]), (2, "urgencia", 0, [5.0, 5.0])], "row_id int, head string, view int, logits array<double>")
    assert {r["row_id"]: r["logits"] for r in SC.average_views(views).collect()} == {1: [2.0, 3.0], 2: [5.0, 5.0]}
