"""Labelling runs: requests, replies, backfill, calibration, consensus.

Model calls are not made here. Requests go out as a table and replies come back as a table
``question_id, attempt, reply, error`` (several attempts per question).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import fixed
from lectern import fixed_prompts as P
from lectern.fixed_prompts import PARSE_MESSAGE, SCHEMA_MESSAGE
from lectern.functions import text as T
from lectern.operators.rows import labels_valid, normal_label, optional
from lectern.operators.selection import accept_within_deficit, assign_round_robin, rank_calibration, rank_consensus
from lectern.plans.ranking import keep_first
from lectern.plans.scratch import once, settle

REPLY_SCHEMA = "nivel_tecnico string, urgencia string, emocion string"


# --- joins with the question source -----------------------------------------------------
def enrich(labeled: DataFrame, source: DataFrame, how: str = "left", own_body: bool = True) -> DataFrame:
    """Title, body and tags of the source question win; the row's own values are the fallback.

    ``own_body=False`` takes the body from the source only. Adds ``q_title, q_body, q_tags``;
    ``source`` has one row per question.
    """
    right = source.select(
        "question_id", F.col("title").alias("__t"), F.col("body").alias("__b"), F.col("tags").alias("__g"),
        *[F.col(c).alias(f"src_{c}") for c in ("score", "creation_date") if c in source.columns],
    )
    joined = labeled.join(right, "question_id", how)
    body = F.coalesce(F.nullif("__b", F.lit("")), optional(labeled, "body") if own_body else F.lit(None), F.lit(""))
    return joined.withColumns(
        {
            "q_title": F.coalesce(F.nullif("__t", F.lit("")), optional(labeled, "title"), F.lit("")),
            "q_body": body,
            "q_tags": F.coalesce("__g", optional(labeled, "tags", "array<string>"), F.array().cast("array<string>")),
        }
    ).drop("__t", "__b", "__g")


def pending(questions: DataFrame, done: DataFrame, key: str = "question_id") -> DataFrame:
    """Questions that have no labelled row yet."""
    return questions.join(done.select(key), key, "left_anti")


def resume(labeled: DataFrame, source: DataFrame) -> DataFrame:
    """Earlier rows brought to the current shape: default model name, body from the source."""
    right = source.select("question_id", F.nullif("body", F.lit("")).alias("__b"))
    joined = labeled.join(right, "question_id", "left")
    own = F.nullif(optional(labeled, "body"), F.lit(""))
    filled = F.coalesce(own, T.unescape("__b"), optional(labeled, "body"))
    model = F.coalesce(optional(labeled, "model_used"), F.lit("legacy_existing"))
    return joined.withColumns({"body": filled, "model_used": model}).drop("__b")


# --- signals ----------------------------------------------------------------------------
def with_signals(
    enriched: DataFrame,
    urgency: tuple[Sequence[str], Sequence[str]] = (fixed.URGENCY_STRONG, fixed.URGENCY_WEAK),
    advanced: tuple[Sequence[str], Sequence[str]] = (fixed.ADVANCED_STRONG, fixed.ADVANCED_WEAK),
    low: Sequence[str] = fixed.LOW_URGENCY_TERMS,
    hint_tags: Sequence[str] = fixed.ADVANCED_HINT_TAGS,
) -> DataFrame:
    """Signals of the question text that its labels do not reflect yet.

    Adds ``advanced, high_urgency, low_urgency``.
    """
    text = F.concat_ws(" ", "q_title", "q_body", F.array_join("q_tags", " "))
    folded = once(enriched, {"__f": T.fold(text)})  # filters on the signals would fold a second time

    def lacks(col: str, label: str) -> Column:
        return F.coalesce(F.col(col) != label, F.lit(True))

    return folded.withColumns(
        {
            "advanced": lacks("nivel_tecnico", "avanzado") & T.advanced_flag("__f", "q_tags", *advanced, hint_tags),
            "high_urgency": lacks("urgencia", "alta") & T.urgency_flag("__f", *urgency),
            "low_urgency": lacks("urgencia", "baja") & T.low_urgency_flag("__f", low, *urgency),
        }
    ).drop("__f")


def candidate_summary(df: DataFrame) -> DataFrame:
    """Calibration candidates: urgent, advanced, both."""
    return df.agg(
        F.count_if("high_urgency").alias("urgent"),
        F.count_if("advanced").alias("advanced"),
        F.count_if(F.col("high_urgency") & F.col("advanced")).alias("both"),
    )


# --- requests ---------------------------------------------------------------------------
_TEMPLATES = {
    "label": P.LABEL_PROMPT,
    "label_emotion": P.LABEL_EMOTION_PROMPT,
    "backfill": P.BACKFILL_PROMPT,
    "calibration": P.CALIBRATION_PROMPT,
    "consensus": P.CONSENSUS_PROMPT,
}


def signal_names() -> Column:
    names = [F.when(F.col(s), F.lit(s)) for s in ("advanced", "high_urgency", "low_urgency")]
    joined = F.array_join(F.array_compact(F.array(*names)), ", ")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(P.NO_SIGNALS))


def render_label_prompt(
    df: DataFrame, kind: str = "label", taxonomy: str = "",
    title: str = "title", body: str = "body", tags: str = "tags",
) -> Column:
    """The prompt of one request kind: title, body snippet, joined tags, signals.

    Calibration shows up to 1600 characters of snippet; consensus the first 1200 of the body,
    which is how those two prompts are defined.
    """
    if kind not in _TEMPLATES:
        raise ValueError(f"unknown prompt kind {kind!r}")
    full = F.coalesce(F.col(body), F.lit(""))
    if kind == "consensus":
        shown = T.unescape(F.substring(full, 1, 1200))
    else:
        shown = T.snippet(T.unescape(full), cap=1600 if kind == "calibration" else 1400)
    plain_tags = kind in ("calibration", "consensus")
    joined = F.array_join(F.col(tags), ", ")
    values = {
        "title": T.unescape(F.coalesce(F.col(title), F.lit(""))),
        "body": shown,
        "tags": joined if plain_tags else T.unescape(joined),
        "taxonomy": taxonomy,
        "emotions": ", ".join(fixed.LABELS["emocion"]),
    }
    if kind == "calibration":
        values["signals"] = signal_names()
    return T.render(_TEMPLATES[kind], values)


def label_requests(
    questions: DataFrame, done: DataFrame | None, models: Sequence[str], kind: str = "label",
    taxonomy: str = "", start: int = 0,
) -> DataFrame:
    """Prompt, model and token limit of every question that is still to be labelled.

    ``start`` is the number of rows labelled before, so the model rotation goes on from there.
    """
    todo = questions if done is None else pending(questions, done)
    assigned = assign_round_robin(todo, models, start)
    return assigned.withColumn("prompt", render_label_prompt(assigned, kind, taxonomy)).withColumn(
        "max_tokens", F.lit(fixed.REPLY_MAX_TOKENS[kind])
    )


# --- replies ----------------------------------------------------------------------------
def attempt_status(replies: DataFrame, heads: Sequence[str], max_attempts: int = 3) -> DataFrame:
    """Every attempt as ``ok``, ``json_parse``, ``schema_validation`` or ``error``, and whether
    it ends the row. Only rate, 429 and timeout errors are tried again."""
    tried = replies.where(F.col("attempt") <= max_attempts)
    parsed = once(tried, {"__p": T.extract_json("reply", REPLY_SCHEMA)})
    flat = parsed.withColumns({h: normal_label(F.col(f"__p.{h}")) for h in fixed.HEADS[:3]})
    status = (
        F.when(F.col("error").isNotNull(), "error")
        .when(F.col("__p").isNull(), "json_parse")
        .when(~labels_valid(heads), "schema_validation")
        .otherwise("ok")
    )
    retryable = F.col("error").contains("429") | F.lower("error").contains("rate") | F.lower("error").contains("timeout")
    marked = flat.withColumn("status", status)
    again = (F.col("status") == "error") & retryable & (F.col("attempt") < max_attempts)
    return marked.withColumn("ends", ~F.coalesce(again, F.lit(False))).drop("__p")


def reply_status(replies: DataFrame, heads: Sequence[str] = fixed.HEADS[:2], max_attempts: int = 3, key: str = "question_id") -> DataFrame:
    """The attempt that settles each question (the first one that ends it)."""
    attempts = attempt_status(replies, heads, max_attempts)
    return keep_first(attempts, [key], [F.desc("ends"), "attempt"]).where("ends").drop("ends")


def reply_audit(
    outcomes: DataFrame, phase: str, max_attempts: int = 3, key: str = "question_id",
    error_chars: int | None = None, reply_chars: int | None = None,
) -> DataFrame:
    """Failure log of settled questions: the stage that failed, and ``final_failure`` when it
    was the last allowed attempt. Errors and replies are whole unless cut by ``error_chars``, ``reply_chars``."""
    message = (
        F.when(F.col("status") == "json_parse", PARSE_MESSAGE)
        .when(F.col("status") == "schema_validation", SCHEMA_MESSAGE)
        .otherwise(F.col("error") if error_chars is None else F.substring("error", 1, error_chars))
    )
    stages = F.array_compact(
        F.array(
            F.when(F.col("status").isin("json_parse", "schema_validation"), F.col("status")),
            F.when((F.col("status") != "ok") & (F.col("attempt") == max_attempts), F.lit("final_failure")),
        )
    )
    failed = outcomes.where(F.col("status") != "ok").withColumn("stage", F.explode(stages))
    final = F.col("stage") == "final_failure"
    reply = F.coalesce("reply", F.lit(""))
    excerpt = F.when(F.col("stage") != "schema_validation", reply if reply_chars is None else F.substring(reply, 1, reply_chars))
    return failed.select(
        F.lit(phase).alias("phase"), key, "attempt", "stage", excerpt.alias("raw_excerpt"),
        F.when(final, message).alias("message"),
    )


def apply_replies(
    requests: DataFrame, replies: DataFrame, require_emotion: bool = False, max_attempts: int = 3
) -> tuple[DataFrame, DataFrame]:
    """(labelled rows, audit rows) of a request table and its replies."""
    heads = fixed.HEADS[:3] if require_emotion else fixed.HEADS[:2]
    known = replies.join(requests.select("question_id"), "question_id", "left_semi")
    outcomes = settle(reply_status(known, heads, max_attempts), "outcomes")
    won = outcomes.where(F.col("status") == "ok").select("question_id", *heads)
    labeled = requests.join(won, "question_id").select(
        *_carried(requests), "question_id",
        T.unescape("title").alias("title"), T.unescape("body").alias("body"), "tags",
        F.coalesce(optional(requests, "domain"), F.lit("general")).alias("domain"),
        *heads, F.col("model").alias("model_used"),
    )
    return labeled, reply_audit(outcomes, "label_primary", max_attempts)


def _carried(df: DataFrame) -> list[str]:
    return [c for c in ("ord",) if c in df.columns]


def backfill_requests(labeled: DataFrame, source: DataFrame, models: Sequence[str], taxonomy: str = "", most: int | None = None) -> DataFrame:
    """Requests for rows without a valid emotion: source text, else the row's own text when it
    is long enough (title 4, body 20)."""
    invalid = labeled.where(~labels_valid(["emocion"]))
    right = source.select(
        "question_id", F.col("title").alias("__t"), F.col("body").alias("__b"), F.col("tags").alias("__g"),
        F.lit(True).alias("__known"),
    )
    joined = invalid.join(right, "question_id", "left")
    known = F.coalesce("__known", F.lit(False))
    own_title, own_body = T.strip(F.coalesce("title", F.lit(""))), T.strip(F.coalesce("body", F.lit("")))
    usable = joined.where(known | ((F.length(own_title) >= 4) & (F.length(own_body) >= 20)))
    texts = usable.select(
        "ord", "question_id",
        F.when(known, F.col("__t")).otherwise(own_title).alias("title"),
        F.when(known, F.col("__b")).otherwise(own_body).alias("body"),
        F.coalesce(F.when(known, F.col("__g")).otherwise(F.col("tags")), F.array().cast("array<string>")).alias("tags"),
    )
    assigned = assign_round_robin(texts, models)
    if most is not None:
        assigned = texts.orderBy("ord").limit(most).transform(lambda d: assign_round_robin(d, models))
    return assigned.withColumn("prompt", render_label_prompt(assigned, "backfill", taxonomy)).withColumn(
        "max_tokens", F.lit(fixed.REPLY_MAX_TOKENS["backfill"])
    )


def backfill_emotion(labeled: DataFrame, requests: DataFrame, replies: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Rows with the emotion of their first valid reply and the model noted behind the old one."""
    won = reply_status(replies, ["emocion"], max_attempts).where(F.col("status") == "ok")
    table = requests.select("question_id", "ord", "model").join(
        won.select("question_id", F.col("emocion").alias("__e")), "question_id"
    ).select("ord", "__e", F.concat("model", F.lit(":emotion_bf")).alias("__m"))
    joined = labeled.join(table, "ord", "left")
    noted = F.concat_ws(":", F.nullif("model_used", F.lit("")), "__m")
    changed = F.col("__e").isNotNull()
    return joined.withColumns(
        {
            "emocion": F.coalesce("__e", "emocion"),
            "model_used": F.when(changed, noted).otherwise(F.col("model_used")),
        }
    ).drop("__e", "__m")


# --- calibration and consensus ----------------------------------------------------------
CALIBRATION_TARGETS = {"avanzado": "nivel_tecnico", "alta": "urgencia", "baja": "urgencia"}


def label_deficits(labeled: DataFrame, targets: Mapping[str, int]) -> dict[str, int]:
    """``max(0, target - rows)`` of the given target labels (three numbers, one scan)."""
    counts = labeled.agg(
        *[F.count_if(F.col(CALIBRATION_TARGETS[x]) == x).alias(x) for x in targets]
    ).first()
    return {x: max(0, goal - counts[x]) for x, goal in targets.items()}


def calibration_requests(labeled: DataFrame, source: DataFrame, targets: Mapping[str, int], model: str, most: int | None = None, **terms) -> DataFrame:
    """Ranked candidates for re-labelling with their prompts."""
    need = label_deficits(labeled, targets)
    signalled = with_signals(enrich(labeled, source), **terms)
    ranked = rank_calibration(
        signalled, need.get("avanzado", 0) > 0, need.get("alta", 0) > 0, need.get("baja", 0) > 0, most
    )
    prompt = render_label_prompt(ranked, "calibration", title="q_title", body="q_body", tags="q_tags")
    return ranked.withColumn("prompt", prompt).withColumn("model", F.lit(model))


def calibrate_labels(labeled: DataFrame, ranked: DataFrame, replies: DataFrame, targets: Mapping[str, int], max_attempts: int = 3) -> DataFrame:
    """Rows after the calibration replies: changes towards a target label are accepted in rank
    order until the deficit of that label is used up."""
    need = label_deficits(labeled, targets)
    won = reply_status(replies, fixed.HEADS[:2], max_attempts).where(F.col("status") == "ok").select(
        "question_id", F.col("nivel_tecnico").alias("__n"), F.col("urgencia").alias("__u")
    )
    proposed = ranked.select("ord", "question_id", "rn", "model", "nivel_tecnico", "urgencia").join(won, "question_id")
    axes = {
        x: F.coalesce(
            (F.col("__n" if col == "nivel_tecnico" else "__u") == x) & (F.coalesce(F.col(col), F.lit("")) != x),
            F.lit(False),
        )
        for x, col in CALIBRATION_TARGETS.items()
        if x in targets
    }
    accepted = accept_within_deficit(proposed, axes, need, [F.asc("rn")])
    per_row = accepted.groupBy("ord").agg(F.collect_set("axis").alias("__axes"))
    model = ranked.select("ord", F.col("model").alias("__model"))
    changes = per_row.join(model, "ord")
    joined = labeled.join(changes, "ord", "left")
    axes_of = F.coalesce("__axes", F.array().cast("array<string>"))
    has = lambda x: F.array_contains(axes_of, x)
    return joined.withColumns(
        {
            "nivel_tecnico": F.when(has("avanzado"), "avanzado").otherwise(F.col("nivel_tecnico")),
            "urgencia": F.when(has("alta"), "alta").when(has("baja"), "baja").otherwise(F.col("urgencia")),
            "model_used": F.when(F.size(axes_of) > 0, F.concat("__model", F.lit(":calibrated"))).otherwise(F.col("model_used")),
        }
    ).drop("__axes", "__model")


def consensus(
    votes: DataFrame, mode: str = "strict_consensus", expert: str | None = None,
    min_advanced: int = 2, min_high: int = 2,
) -> DataFrame:
    """Votes ``question_id, model, nivel_tecnico, urgencia`` to promotion flags.

    Questions with fewer than two votes are left out. ``expert_plus_signal`` promotes to
    advanced on the expert's vote (the text signal is required by the caller's candidates).
    """
    if mode not in ("strict_consensus", "expert_plus_signal"):
        raise ValueError(f"unknown decision mode {mode!r}")
    advanced = F.col("nivel_tecnico") == "avanzado"
    counted = votes.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n_votes"),
        F.count_if(advanced).alias("advanced_votes"),
        F.count_if(F.col("urgencia") == "alta").alias("high_votes"),
        F.count_if(advanced & (F.col("model") == (expert or ""))).alias("expert_votes"),
    ).where(F.col("n_votes") >= 2)
    strict = F.col("advanced_votes") >= min_advanced
    promote = strict if mode == "strict_consensus" else F.col("expert_votes") >= 1
    return counted.withColumn("promote_advanced", promote).withColumn(
        "promote_high", F.col("high_votes") >= min_high
    )


def consensus_candidates(labeled: DataFrame, source: DataFrame, most: int | None = None, **terms) -> DataFrame:
    """Rows known to the source that miss a target label their text hints at, ranked."""
    inner = enrich(labeled, source, how="inner")
    signalled = with_signals(inner, **terms).withColumn("score", F.col("src_score")).withColumn(
        "creation_date", F.col("src_creation_date")
    )
    return rank_consensus(signalled, most)


def refine_consensus(
    labeled: DataFrame, candidates: DataFrame, votes: DataFrame, targets: Mapping[str, int],
    models: Sequence[str], mode: str = "strict_consensus", expert: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(refined rows, audit events with before and after)."""
    need = label_deficits(labeled, targets)
    decided = consensus(votes, mode, expert)
    ranked = candidates.select("ord", "question_id", "rn", "nivel_tecnico", "urgencia", "advanced").join(decided, "question_id")
    missing_advanced = F.coalesce(F.col("nivel_tecnico") != "avanzado", F.lit(True))
    signal = F.col("advanced") if mode == "expert_plus_signal" else F.lit(True)
    axes = {
        "avanzado": missing_advanced & F.col("promote_advanced") & signal,
        "alta": F.coalesce(F.col("urgencia") != "alta", F.lit(True)) & F.col("promote_high"),
    }
    accepted = accept_within_deficit(ranked, axes, need, [F.asc("rn")])
    per_row = settle(accepted.groupBy("ord").agg(F.collect_set("axis").alias("__axes")), "accepted")
    axes_of = F.coalesce("__axes", F.array().cast("array<string>"))
    level = F.when(F.array_contains(axes_of, "avanzado"), "avanzado").otherwise(F.col("nivel_tecnico"))
    urgency = F.when(F.array_contains(axes_of, "alta"), "alta").otherwise(F.col("urgencia"))
    joined = labeled.join(per_row, "ord", "left")
    changed = joined.where(F.col("__axes").isNotNull())
    events = changed.select(
        "question_id",
        F.struct("nivel_tecnico", "urgencia").alias("before"),
        F.struct(level.alias("nivel_tecnico"), urgency.alias("urgencia")).alias("after"),
        F.lit(mode).alias("advanced_decision_mode"),
    )
    note = F.lit("consensus:" + "|".join(models))
    refined = joined.withColumns(
        {
            "nivel_tecnico": level,
            "urgencia": urgency,
            "model_used": F.when(F.size(axes_of) > 0, note).otherwise(F.col("model_used")),
        }
    ).drop("__axes")
    return refined, events
