"""Models applied to tables: decoding, views, bias calibration, fitting, batch scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions import labels as L
from lectern.functions.arrays import add_bias, argmax, geo_mean, literal_array, pad_ids, softmax, token_views
from lectern.functions.text import tokens
from lectern.operators.metrics import metrics
from lectern.operators.vocab import encode_tokens
from lectern.plans.scratch import once, settle


def _checked(df: DataFrame, head: str) -> Column:
    logits, size = F.col(f"logits_{head}"), len(fixed.LABELS[head])
    message = F.concat(F.lit(f"logits_{head}: length "), F.size(logits).cast("string"), F.lit(f", expected {size}"))
    # raise_error is typed void, so the branch keeps the type of the logits
    return F.when(F.size(logits) == size, logits).otherwise(
        F.raise_error(message).cast(df.schema[f"logits_{head}"].dataType)
    )


def decode_logits(df: DataFrame, keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """``logits_<head>`` arrays to label and confidence per head and their geometric mean."""
    probs = df.select(*keep, *[softmax(_checked(df, h)).alias(f"__p_{h}") for h in fixed.HEADS])
    out = []
    for head in fixed.HEADS:
        names = literal_array(fixed.LABELS[head])
        out.append(F.get(names, argmax(f"__p_{head}")).alias(head))
        out.append(F.array_max(f"__p_{head}").alias(f"conf_{head}"))
    decoded = probs.select(*keep, *out)
    return decoded.withColumn("confianza", geo_mean(F.array(*[F.col(f"conf_{h}") for h in fixed.HEADS])))


def logits_long(df: DataFrame, keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """``logits_<head>`` columns to rows ``head, logits``."""
    cells = [F.struct(F.lit(h).alias("head"), F.col(f"logits_{h}").alias("logits")) for h in fixed.HEADS]
    return df.select(*keep, F.inline(F.array(*cells)))


def average_views(df: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Mean logits per (id, head) over all its views, summed in view order."""
    views = F.array_sort(F.collect_list(F.struct("view", "logits")))
    grouped = df.groupBy(id_col, "head").agg(views.alias("v"))
    total = F.aggregate(
        F.slice("v", 2, F.size("v")), F.transform(F.get("v", F.lit(0))["logits"], lambda x: x.cast("double")),
        lambda acc, e: F.zip_with(acc, e["logits"], lambda a, b: a + b),
    )
    return grouped.select(id_col, "head", F.transform(total, lambda x: x / F.size("v")).alias("logits"))


def bias_column(biases: Mapping[str, Sequence[float]]) -> Column:
    """Bias array of a row's head, as a constant lookup."""
    (first, values), *rest = biases.items()
    pick = F.when(F.col("head") == first, F.array(*[F.lit(float(b)) for b in values]))
    for head, values in rest:
        pick = pick.when(F.col("head") == head, F.array(*[F.lit(float(b)) for b in values]))
    return pick


def apply_bias(df: DataFrame, biases: Mapping[str, Sequence[float]]) -> DataFrame:
    return df.withColumn("logits", add_bias("logits", bias_column(biases)))


def with_prediction(df: DataFrame) -> DataFrame:
    return df.withColumn("y_pred", argmax("logits"))


def _trial_cells(df: DataFrame, biases: Mapping[str, Sequence[float]], grid: Sequence[float], classes: Mapping[str, Sequence[int]]) -> DataFrame:
    """Rows per (head, class, y_true, best other class, first grid value at which the class wins).

    A row predicts a class from some grid value on and its best other class below it, so one count per row
    and class covers all trial values. The best other class is the winner, or the second for the winner itself.
    """
    current = F.zip_with("logits", bias_column(biases), lambda a, b: a.cast("double") + b)
    base = df.where(F.col("y_true") != fixed.IGNORE_INDEX).select("head", "y_true", "logits", current.alias("now"))
    base = base.withColumn("first", argmax("now"))
    place = F.sequence(F.lit(0), F.size("now") - 1)
    rest = F.zip_with("now", place, lambda v, i: F.when(i == F.col("first"), F.lit(float("-inf"))).otherwise(v))
    base = once(base, {"second": argmax(rest)})
    wanted = F.create_map(*[x for h, own in classes.items() for x in (F.lit(h), F.array(*[F.lit(int(c)) for c in own]))])
    values = literal_array([float(v) for v in grid])

    def trial(c: Column) -> Column:
        other = F.when(c == F.col("first"), F.col("second")).otherwise(F.col("first"))
        own, top = F.get("logits", c).cast("double"), F.get("now", other)
        lost = F.filter(values, lambda v: ~F.when(c < other, own + v >= top).otherwise(own + v > top))
        return F.struct(c.alias("cls"), other.alias("other"), F.size(lost).alias("first_win"))

    trials = base.select("head", "y_true", F.inline(F.transform(F.element_at(wanted, F.col("head")), trial)))
    return trials.groupBy("head", "cls", "y_true", "other", "first_win").agg(F.count(F.lit(1)).alias("n"))


def _macro_f1(counts: Mapping[tuple[int, int], int]) -> float:
    tp, sup, pred = {}, {}, {}
    for (t, p), n in counts.items():
        sup[t] = sup.get(t, 0) + n
        pred[p] = pred.get(p, 0) + n
        if t == p:
            tp[t] = tp.get(t, 0) + n
    present = set(sup) | set(pred)
    if not present:
        return 0.0
    return sum(2 * tp.get(c, 0) / (sup.get(c, 0) + pred.get(c, 0)) for c in sorted(present)) / len(present)


def _climb(
    trials: Mapping[tuple[str, int], list], head: str, classes: Sequence[int], own: list[float],
    best: dict[str, float], grid: Sequence[float], unchanged: int,
) -> int | None:
    """Try the classes in turn; the first whose bias gains enough is changed and returned."""
    for cls in classes:
        rows = trials.get((head, cls), [])

        def score(place: int) -> float:
            counts: dict[tuple[int, int], int] = {}
            for r in rows:  # noqa: B023
                cell = (r["y_true"], cls if place >= r["first_win"] else r["other"])  # noqa: B023
                counts[cell] = counts.get(cell, 0) + r["n"]
            return _macro_f1(counts)

        best.setdefault(head, score(unchanged))
        top, value = best[head], own[cls]
        for place, trial in enumerate(grid):
            got = score(place)
            if got > top + fixed.BIAS_MIN_GAIN:
                top, value = got, float(trial)
        if top > best[head] + fixed.BIAS_MIN_GAIN:
            own[cls], best[head] = value, top
            return cls
    return None


def fit_bias(
    df: DataFrame, grid: Sequence[float] = fixed.BIAS_GRID, passes: int = 3
) -> dict[str, list[float]]:
    """Additive class biases by coordinate ascent on macro F1 (validation rows only).

    Input ``head, y_true, logits``. One aggregate counts the trials of all classes of all heads; it holds until a
    bias changes, and then only for the later classes of that head. So a pass costs one scan and one
    more for each change of the head that changes most. The driver sees only counts, whose number is
    bounded by the label sets and the grid.
    """
    stored = settle(df.select("head", "y_true", "logits"), "logits")
    size = {h: len(fixed.LABELS[h]) for h in fixed.HEADS}
    biases = {h: [0.0] * size[h] for h in fixed.HEADS}
    best: dict[str, float] = {}
    unchanged = list(grid).index(0.0)
    open_heads = list(fixed.HEADS)
    for _ in range(passes):
        gained: set[str] = set()
        at = dict.fromkeys(open_heads, 0)
        while at:
            todo = {h: range(first, size[h]) for h, first in at.items()}
            trials: dict[tuple[str, int], list] = {}
            for r in _trial_cells(stored.where(F.col("head").isin(list(at))), biases, grid, todo).collect():
                trials.setdefault((r["head"], r["cls"]), []).append(r)
            for head in list(at):
                changed = _climb(trials, head, todo[head], biases[head], best, grid, unchanged)
                if changed is not None:
                    gained.add(head)
                if changed is None or changed + 1 == size[head]:
                    del at[head]
                else:
                    at[head] = changed + 1
        open_heads = [h for h in open_heads if h in gained]
        if not open_heads:
            break
    return biases


def bias_trials(
    df: DataFrame, cls: int, biases: Mapping[str, Sequence[float]] | None = None,
    grid: Sequence[float] = fixed.BIAS_GRID,
) -> DataFrame:
    """Macro F1 per head and grid value when only the bias of class ``cls`` changes."""
    start = biases or {h: [0.0] * len(fixed.LABELS[h]) for h in fixed.HEADS}
    heads = [h for h in fixed.HEADS if cls < len(fixed.LABELS[h])]
    counted = _trial_cells(df.where(F.col("head").isin(heads)), start, grid, {h: [cls] for h in heads})
    places = F.array(
        *[F.struct(F.lit(i).alias("place"), F.lit(float(v)).alias("bias")) for i, v in enumerate(grid)]
    )
    trial = counted.select("head", "y_true", "other", "first_win", "n", F.inline(places))
    guess = F.when(F.col("place") >= F.col("first_win"), F.lit(cls)).otherwise(F.col("other"))
    cells = trial.groupBy("head", "bias", "y_true", guess.alias("y_pred")).agg(F.sum("n").alias("n"))
    from lectern.operators.metrics import class_sums, f1

    sums = class_sums(cells, ["bias"])
    score = f1(F.col("tp"), F.col("support"), F.col("predicted"))
    return sums.groupBy("head", "bias").agg(F.avg(score).alias("f1_macro"))


def calibration_report(df: DataFrame, biases: Mapping[str, Sequence[float]]) -> DataFrame:
    """Macro F1 before and after the biases, per split (``split, head, y_true, logits``)."""
    before = with_prediction(df).select("split", F.lit("baseline").alias("stage"), "head", "y_true", "y_pred")
    after = with_prediction(apply_bias(df, biases)).select(
        "split", F.lit("calibrated").alias("stage"), "head", "y_true", "y_pred"
    )
    out = metrics(before.unionByName(after), ["split", "stage"])
    return out.select("split", "stage", *[f"f1_macro_{h}" for h in fixed.HEADS], "f1_macro_mean")


def validate_examples(
    df: DataFrame, expected: str = "expected_domain",
    min_confidence: float = fixed.EXAMPLE_MIN_CONFIDENCE, min_head: float = fixed.EXAMPLE_MIN_HEAD,
) -> DataFrame:
    """Decoded rows with the three example checks and whether all hold."""
    lowest = F.least(*[F.col(f"conf_{h}") for h in fixed.HEADS])
    checked = df.withColumn("min_head", lowest).withColumns(
        {
            "domain_ok": F.col("dominio") == F.col(expected),
            "confidence_ok": F.col("confianza") >= min_confidence,
            "head_ok": F.col("min_head") >= min_head,
        }
    )
    return checked.withColumn("passed", F.col("domain_ok") & F.col("confidence_ok") & F.col("head_ok"))


# --- multi-head linear model ------------------------------------------------------------
def text_features(df: DataFrame, text: str = "texto", buckets: int = 1 << 16, words: str | None = None) -> DataFrame:
    """Hashed term frequencies of the tokens as a sparse vector column ``tf``; ``words`` names a column
    that holds the tokens already."""
    from pyspark.ml.feature import HashingTF

    worded = df.withColumn("__toks", F.col(words) if words else tokens(text))
    return HashingTF(numFeatures=buckets, inputCol="__toks", outputCol="tf").transform(worded).drop("__toks")


class HeadModels:
    """Fitted term weighting and one multinomial model per head."""

    def __init__(self, idf, heads: dict, text: str, buckets: int) -> None:
        self.idf, self.heads, self.text, self.buckets = idf, heads, text, buckets

    def save(self, path: str) -> None:
        self.idf.write().overwrite().save(f"{path}/idf")
        for head, model in self.heads.items():
            model.write().overwrite().save(f"{path}/{head}")

    @classmethod
    def load(cls, path: str, text: str = "texto", buckets: int = 1 << 16) -> HeadModels:
        from pyspark.ml.classification import LogisticRegressionModel
        from pyspark.ml.feature import IDFModel

        heads = {h: LogisticRegressionModel.load(f"{path}/{h}") for h in fixed.HEADS}
        return cls(IDFModel.load(f"{path}/idf"), heads, text, buckets)


def fit_heads(
    df: DataFrame, class_weight: bool = True, text: str = "texto", buckets: int = 1 << 16,
    max_iter: int = 20, reg: float = 0.01,
) -> HeadModels:
    """One class-weighted multinomial model per head; rows that do not supervise a head are left
    out of its model. Distributed training: the driver holds coefficients, never rows. Texts are read and
    hashed once; the term weighting and all models start from the written counts."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF

    from lectern.operators.metrics import class_weights, index_labels

    featured = settle(text_features(df, text, buckets).drop(text), "term_counts")
    idf = IDF(inputCol="tf", outputCol="features").fit(featured)
    long = index_labels(featured, [])
    weights = {(r["head"], r["idx"]): r["weight"] for r in class_weights(long).collect()}
    ready = idf.transform(featured)
    heads = {}
    for head in fixed.HEADS:
        label = F.coalesce(L.label_index(F.lit(head), L.label_or_null(featured, head)), F.lit(fixed.LABELS[head].index(fixed.HEAD_DEFAULT[head])))
        table = F.array(*[F.lit(float(weights.get((head, i), 1.0))) for i in range(len(fixed.LABELS[head]))])
        weight = F.get(table, label) if class_weight else F.lit(1.0)
        rows = ready.where(L.is_supervised(featured, head)).select(
            "features", label.cast("double").alias("label"), weight.alias("w")
        )
        model = LogisticRegression(family="multinomial", maxIter=max_iter, regParam=reg, weightCol="w")
        heads[head] = model.fit(rows)
    return HeadModels(idf, heads, text, buckets)


def score(df: DataFrame, models: HeadModels, keep: Sequence[str] = ("ord",), words: str | None = None) -> DataFrame:
    """``logits_<head>`` for every row (JVM-side linear algebra, no shuffle)."""
    from pyspark.ml.functions import vector_to_array

    ready = models.idf.transform(text_features(df, models.text, models.buckets, words))
    out = ready.select(*keep, "features")
    for head, model in models.heads.items():
        # only the raw scores are asked for; unseen trailing classes get the lowest score
        scored = model.copy().setRawPredictionCol("__raw").setProbabilityCol("").setPredictionCol("").transform(out)
        size = len(fixed.LABELS[head])
        raw = vector_to_array("__raw")
        missing = F.array_repeat(F.lit(-1e9), F.greatest(F.lit(0), F.lit(size) - F.size(raw)))
        out = scored.withColumn(f"logits_{head}", F.concat(raw, missing)).drop("__raw")
    return out.drop("features")


def view_rows(df: DataFrame, length: int = fixed.MAX_LEN, mode: str = "score", id_col: str = "ord", text: str = "texto") -> DataFrame:
    """``id, view, toks``: the windows over every text, which is cut into tokens once."""
    worded = once(df.select(id_col, text), {"__toks": tokens(text)})
    return worded.select(id_col, F.posexplode(token_views("__toks", length, mode)).alias("view", "toks"))


def score_views(
    df: DataFrame, models: HeadModels, length: int = fixed.MAX_LEN, mode: str = "score",
    id_col: str = "ord", text: str = "texto",
) -> DataFrame:
    """Mean logits over the views of a text: ``id, head, logits``."""
    views = view_rows(df, length, mode, id_col, text)
    scored = logits_long(score(views, models, [id_col, "view"], "toks"), [id_col, "view"])
    return average_views(scored, id_col)


def encoded_views(
    df: DataFrame, vocab: DataFrame, length: int = fixed.MAX_LEN, mode: str = "score",
    id_col: str = "ord", text: str = "texto",
) -> DataFrame:
    """``id, view, ids``: the padded ids of every window, the input of a sequence model."""
    views = view_rows(df, length, mode, id_col, text).withColumn("__v", F.concat_ws("#", id_col, "view"))
    coded = encode_tokens(views, vocab, "__v", "toks")
    return views.select(id_col, "view", "__v").join(coded, "__v").select(
        id_col, "view", pad_ids("ids", length).alias("ids")
    )
