"""Row filters, projections into the final row shape, and validators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions import labels as L
from lectern.functions import text as T
from lectern.plans.ranking import keep_first
from lectern.plans.scratch import once


def optional(df: DataFrame, name: str, dtype: str = "string") -> Column:
    """The column, or null when the frame does not have it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def filter_lang(df: DataFrame, code: str = "sp", col: str = "language") -> DataFrame:
    return df.where(F.col(col) == code)


def min_len(df: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """Keep rows whose trimmed columns reach their minimum length."""
    for name, least in limits.items():
        df = df.where(F.length(T.strip(name)) >= least)
    return df


def _in_set(value: Column, head: str) -> Column:
    return F.coalesce(value.isin(*fixed.LABELS[head]), F.lit(False))


def _domain(df: DataFrame) -> Column:
    raw = F.coalesce(F.nullif(optional(df, "dominio"), F.lit("")), optional(df, "domain"))
    return L.normal_domain(raw)


def _carried(df: DataFrame) -> list[str]:
    return [c for c in ("ord",) if c in df.columns]


def to_final_questions(df: DataFrame) -> DataFrame:
    """Labelled questions to final rows; labels outside the sets are repaired, not dropped."""
    text = F.coalesce(
        T.question_text("title", "body"), T.blank_to_null(optional(df, "texto"))
    )
    level, urgency, emotion = (T.strip(optional(df, h)) for h in fixed.HEADS[:3])
    source_id = F.coalesce(
        optional(df, "question_id", "long").cast("string"), optional(df, "source_id"), F.lit("")
    )
    rows = once(df, {"texto": text}).where(F.col("texto").isNotNull())
    return rows.select(
        *_carried(df),
        "texto",
        F.when(_in_set(level, "nivel_tecnico"), level).otherwise("intermedio").alias("nivel_tecnico"),
        F.when(_in_set(urgency, "urgencia"), urgency).otherwise("media").alias("urgencia"),
        F.when(_in_set(emotion, "emocion"), emotion)
        .otherwise(T.infer_emotion("texto"))
        .alias("emocion"),
        _domain(df).alias("dominio"),
        F.lit(fixed.QUESTION_SOURCE).alias("fuente"),
        F.concat(F.lit("so:"), source_id).alias("source_id"),
        L.supervision().alias("supervision"),
    )


def to_final_emotions(df: DataFrame, min_chars: int = 8) -> DataFrame:
    """Emotion texts to final rows that supervise the emotion only."""
    text = F.coalesce(F.nullif(optional(df, "text"), F.lit("")), optional(df, "texto"))
    emotion = T.strip(
        F.coalesce(
            F.nullif(optional(df, "emocion_mapped"), F.lit("")),
            F.nullif(optional(df, "emocion"), F.lit("")),
        )
    )
    none = F.lit(None).cast("string")
    rows = once(df, {"texto": T.strip(F.coalesce(text, F.lit("")))})
    return rows.where(F.length("texto") >= min_chars).select(
        *_carried(df),
        "texto",
        none.alias("nivel_tecnico"),
        none.alias("urgencia"),
        F.when(_in_set(emotion, "emocion"), emotion).otherwise("neutral").alias("emocion"),
        none.alias("dominio"),
        F.lit(fixed.EMOTION_SOURCE).alias("fuente"),
        F.concat(
            F.lit("goe:"),
            F.coalesce(optional(df, "id").cast("string"), optional(df, "source_id"), F.lit("")),
        ).alias("source_id"),
        optional(df, "emotion_names", "array<string>").alias("emotion_names"),
        L.supervision("emocion").alias("supervision"),
    )


def to_final_extra(df: DataFrame, min_chars: int = 20) -> DataFrame:
    """Extra synthetic rows; one label outside the sets drops the row."""
    text = F.coalesce(F.nullif(optional(df, "texto"), F.lit("")), optional(df, "text"))
    rows = once(df, {"texto": T.strip_leaked_labels(text)}).where(F.length("texto") >= min_chars)
    for head in fixed.HEADS[:3]:
        rows = rows.where(_in_set(T.strip(head), head))
    return rows.select(
        *_carried(df),
        "texto",
        *[T.strip(h).alias(h) for h in fixed.HEADS[:3]],
        _domain(df).alias("dominio"),
        F.coalesce(F.nullif(optional(df, "fuente"), F.lit("")), F.lit(fixed.EXTRA_SOURCE)).alias("fuente"),
        F.coalesce(
            F.nullif(optional(df, "source_id"), F.lit("")),
            F.concat(F.lit("extra:"), F.sha2("texto", 256)),
        ).alias("source_id"),
        L.supervision().alias("supervision"),
    )


def union_rows(*frames: DataFrame) -> DataFrame:
    """Union by name; columns one side lacks are null there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def validate_rows(df: DataFrame, id_col: str = "ord") -> DataFrame:
    """Violations (id, problem): blank text, or a supervised head without a label."""
    found = [F.when(F.coalesce(T.strip("texto"), F.lit("")) == "", F.lit("texto"))]
    for head in fixed.HEADS:
        missing = L.is_supervised(df, head) & L.label_or_null(df, head).isNull()
        found.append(F.when(missing, F.lit(head)))
    return df.select(id_col, F.explode(F.array_compact(F.array(*found))).alias("problem"))


def require_valid(df: DataFrame, id_col: str = "ord") -> DataFrame:
    """Fail with the first violations when there are any."""
    bad = validate_rows(df, id_col).limit(5).collect()
    if bad:
        raise ValueError("invalid rows: " + ", ".join(f"{r[0]}: {r[1]}" for r in bad))
    return df


def bad_labels(df: DataFrame, by: str = "split", shown: int | None = None) -> DataFrame:
    """Distinct labels outside the label sets per group and head; all, or the first ``shown`` of each."""
    cells = [F.struct(F.lit(h).alias("head"), T.blank_to_null(h).alias("label")) for h in fixed.HEADS]
    long = df.select(by, F.inline(F.array(*cells))).where(F.col("label").isNotNull())
    unknown = long.where(L.label_index("head", "label").isNull()).distinct()
    return unknown if shown is None else keep_first(unknown, [by, "head"], ["label"], shown)


def normal_label(col: Column | str) -> Column:
    """Reply label: trimmed and lower case."""
    return F.lower(T.strip(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))))


def labels_valid(heads: Sequence[str], prefix: str = "") -> Column:
    """All of the (normalised) label columns are in their label sets."""
    ok = F.lit(True)
    for head in heads:
        ok = ok & _in_set(normal_label(f"{prefix}{head}"), head)
    return ok


def validate_labels(df: DataFrame, require_emotion: bool = False) -> DataFrame:
    """Normalise reply labels and flag rows whose labels are all in the label sets."""
    heads = fixed.HEADS[:3] if require_emotion else fixed.HEADS[:2]
    flagged = df.withColumn("valid", labels_valid(heads))
    return flagged.withColumns({h: normal_label(h) for h in heads})


def validate_emotion(df: DataFrame) -> DataFrame:
    return df.withColumn("valid", labels_valid(["emocion"])).withColumn("emocion", normal_label("emocion"))


def validate_requests(df: DataFrame) -> DataFrame:
    """Add ``errors``: the names of the request fields that break their limits."""

    def outside(col: str, low: float, high: float) -> Column:
        return ~F.coalesce(F.col(col).between(low, high), F.lit(False))

    def broken(name: str, condition: Column) -> Column:
        return F.when(condition, F.lit(name))

    def bad_text(col: Column) -> Column:
        return ~F.coalesce(F.length(col).between(1, 4000), F.lit(False))

    checks = [broken("pregunta", bad_text(F.col("pregunta")))]
    for head in fixed.HEADS:
        checks.append(broken(f"metadata.{head}", ~_in_set(F.col(f"metadata.{head}"), head)))
    checks.append(broken("metadata.confianza", outside("metadata.confianza", 0.0, 1.0)))
    turns = F.coalesce(F.col("historial"), F.array().cast(df.schema["historial"].dataType))
    checks.append(broken("historial", F.size(turns) > 10))
    role_bad = F.exists(turns, lambda m: ~F.coalesce(m["rol"].isin("user", "assistant"), F.lit(False)))
    checks.append(broken("historial.rol", role_bad))
    checks.append(broken("historial.contenido", F.exists(turns, lambda m: bad_text(m["contenido"]))))
    given = F.col("head_confidences").isNotNull()
    for head in fixed.HEADS:
        bad = given & outside(f"head_confidences.{head}", 0.0, 1.0)
        checks.append(broken(f"head_confidences.{head}", bad))
    for name, low, high in (("temperature", 0.0, 2.0), ("top_p", 0.0, 1.0), ("max_tokens", 64, 4096)):
        value = f"options.{name}"
        checks.append(broken(value, F.col(value).isNotNull() & outside(value, low, high)))
    return df.withColumn("errors", F.array_compact(F.array(*checks)))


def schema_coverage(df: DataFrame, keys: Sequence[str] = fixed.QUESTION_KEYS) -> DataFrame:
    """Rows in which every key is present."""
    present = F.lit(True)
    for key in keys:
        present = present & (F.col(key).isNotNull() if key in df.columns else F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(present).alias("n_complete"))
