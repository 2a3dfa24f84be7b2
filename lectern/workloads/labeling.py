"""Labelling runs over questions derived from documents and replies derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import fixed
from lectern.operators import labeling as LB
from lectern.plans.scratch import settle
from lectern.workloads.base import (
    LABELED, QUESTIONS, REPLIES, TERMS, UNFINISHED, labeled, pick, query, questions, replies, sql_pick, table, unfinished, with_,
)
from lectern.workloads.selecting import CAL_RANK, SIGNALS, signals


@query(with_(QUESTIONS, LABELED) + """
SELECT l.question_id, coalesce(nullif(q.title, ''), l.title) AS q_title, md5(q.body) AS body_key, array_to_string(q.tags, ',') AS q_tags
FROM labeled l LEFT JOIN questions q USING (question_id)
""")
def enrich(spark, sf):
    joined = LB.enrich(labeled(spark, sf), questions(spark, sf))
    return joined.select("question_id", "q_title", F.md5("q_body").alias("body_key"), F.array_join("q_tags", ",").alias("q_tags"))


@query(with_(QUESTIONS, UNFINISHED) + "SELECT question_id FROM questions WHERE question_id NOT IN (SELECT question_id FROM labeled)")
def pending(spark, sf):
    return LB.pending(questions(spark, sf), unfinished(spark, sf)).select("question_id")


@query(with_(QUESTIONS, UNFINISHED) + """
SELECT l.question_id, md5(q.body) AS body_key, CASE WHEN l.question_id % 4 = 0 THEN 'legacy_existing' ELSE model_used END AS model_used
FROM labeled l JOIN questions q USING (question_id)
""")
def resume(spark, sf):
    rows = unfinished(spark, sf).withColumn(
        "model_used", F.when(F.col("question_id") % 4 != 0, F.col("model_used"))
    )
    return LB.resume(rows, questions(spark, sf)).select("question_id", F.md5("body").alias("body_key"), "model_used")


@query(with_(QUESTIONS, LABELED, SIGNALS) + """
SELECT count(*) FILTER (WHERE high_urgency) AS urgent, count(*) FILTER (WHERE advanced) AS advanced, count(*) FILTER (WHERE high_urgency AND advanced) AS "both" FROM signals
""")
def candidate_summary(spark, sf):
    return LB.candidate_summary(signals(spark, sf))


@query(with_(QUESTIONS, UNFINISHED) + """
SELECT question_id, ['m1', 'm2'][(row_number() OVER (ORDER BY ord) - 1 + 5) % 2 + 1] AS model, CAST(120 AS INT) AS max_tokens
FROM questions WHERE question_id NOT IN (SELECT question_id FROM labeled)
""")
def label_requests(spark, sf):
    out = LB.label_requests(questions(spark, sf), unfinished(spark, sf), ["m1", "m2"], start=5)
    return out.where(F.length("prompt") > 0).select("question_id", "model", "max_tokens")


@query(with_(REPLIES) + """
SELECT question_id, attempt, status, CASE WHEN status = 'ok' THEN want_level WHEN status = 'schema_validation' THEN 'experto' ELSE '' END AS nivel_tecnico,
  CASE WHEN status = 'ok' THEN want_urgency WHEN status = 'schema_validation' THEN 'alta' ELSE '' END AS urgencia
FROM settled
""")
def reply_status(spark, sf):
    return LB.reply_status(replies(spark, sf)).select("question_id", "attempt", "status", "nivel_tecnico", "urgencia")


@query(with_(REPLIES) + f"""
SELECT 'label' AS phase, question_id, attempt, stage, CASE WHEN stage <> 'schema_validation' THEN coalesce(reply, '') END AS raw_excerpt,
  CASE WHEN stage = 'final_failure' THEN CASE status WHEN 'json_parse' THEN '{LB.PARSE_MESSAGE}' WHEN 'schema_validation' THEN '{LB.SCHEMA_MESSAGE}' ELSE error END END AS message
FROM (
  SELECT *, status AS stage FROM settled WHERE status IN ('json_parse', 'schema_validation')
  UNION ALL SELECT *, 'final_failure' FROM settled WHERE status <> 'ok' AND attempt = 3)
""")
def reply_audit(spark, sf):
    return LB.reply_audit(LB.reply_status(replies(spark, sf)), "label")


@query(with_(QUESTIONS, UNFINISHED, REPLIES) + """
SELECT t.question_id, t.domain, s.want_level AS nivel_tecnico, s.want_urgency AS urgencia,
  ['m1', 'm2'][(t.rn - 1) % 2 + 1] AS model_used, md5(t.body) AS body_key
FROM (SELECT *, row_number() OVER (ORDER BY ord) AS rn FROM questions WHERE question_id NOT IN (SELECT question_id FROM labeled)) t
JOIN settled s ON s.question_id = t.question_id AND s.status = 'ok'
""")
def apply_replies(spark, sf):
    requests = settle(LB.label_requests(questions(spark, sf), unfinished(spark, sf), ["m1", "m2"]), "requests")
    done, _ = LB.apply_replies(requests, replies(spark, sf))
    return done.select("question_id", "domain", "nivel_tecnico", "urgencia", "model_used", F.md5("body").alias("body_key"))


def _emotion_replies(spark, sf):
    """A reply to every question, with an emotion for two of three event values."""
    events = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    emotion = F.when(k % 3 == 0, "alegria").otherwise(pick(fixed.LABELS["emocion"], k))
    text = F.concat(F.lit('{"emocion": "'), emotion, F.lit('"}'))
    return events.select(
        F.col("event_id").alias("question_id"), F.lit(1).alias("attempt"), text.alias("reply"), F.lit(None).cast("string").alias("error")
    )


@query(with_(QUESTIONS, LABELED) + f""", todo AS (
  SELECT l.ord, l.question_id, row_number() OVER (ORDER BY l.ord) AS rn FROM labeled l WHERE l.emocion = ''),
won AS (SELECT event_id AS question_id, {sql_pick(fixed.LABELS['emocion'], 'k')} AS e FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) WHERE k % 3 <> 0)
SELECT l.question_id, coalesce(w.e, l.emocion) AS emocion,
  CASE WHEN w.e IS NULL THEN l.model_used ELSE l.model_used || ':' || ['m1', 'm2'][(t.rn - 1) % 2 + 1] || ':emotion_bf' END AS model_used
FROM labeled l LEFT JOIN todo t ON t.ord = l.ord LEFT JOIN won w ON w.question_id = t.question_id
""")
def backfill_emotion(spark, sf):
    rows = labeled(spark, sf)
    requests = settle(LB.backfill_requests(rows, questions(spark, sf), ["m1", "m2"]).drop("prompt"), "requests")
    return LB.backfill_emotion(rows, requests, _emotion_replies(spark, sf)).select("question_id", "emocion", "model_used")


def _plain_replies(spark, sf):
    """A valid reply to every question, from the event with its number."""
    events = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    text = F.concat(
        F.lit('{"nivel_tecnico": "'), pick(("avanzado", "intermedio"), k), F.lit('", "urgencia": "'),
        pick(("alta", "baja", "media"), k), F.lit('"}'),
    )
    return events.select(
        F.col("event_id").alias("question_id"), F.lit(1).alias("attempt"), text.alias("reply"), F.lit(None).cast("string").alias("error")
    )


_PLAIN = f"""plain AS (SELECT event_id AS question_id, {sql_pick(('avanzado', 'intermedio'), 'k')} AS n, {sql_pick(('alta', 'baja', 'media'), 'k')} AS u
  FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))"""
_TARGETS = {"avanzado": 60, "alta": 40, "baja": 450}


def _need(label: str, col: str) -> str:
    return f"(SELECT greatest(0, {_TARGETS[label]} - count(*)) FROM labeled WHERE {col} = '{label}')"


@query(with_(QUESTIONS, LABELED, SIGNALS, CAL_RANK.replace("50 * CAST(high_urgency", f"50 * CAST({_need('alta', 'urgencia')} > 0 AND high_urgency")
             .replace("100 * CAST(advanced", f"100 * CAST({_need('avanzado', 'nivel_tecnico')} > 0 AND advanced")
             .replace("30 * CAST(low_urgency", f"30 * CAST({_need('baja', 'urgencia')} > 0 AND low_urgency"), _PLAIN) + f""",
proposed AS (SELECT c.ord, c.rn, c.nivel_tecnico, c.urgencia, p.n, p.u FROM cal_ranked c JOIN plain p USING (question_id)),
acc AS (
  SELECT ord, axis FROM (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY rn) AS a FROM (
    SELECT ord, rn, 'avanzado' AS axis FROM proposed WHERE n = 'avanzado' AND nivel_tecnico <> 'avanzado'
    UNION ALL SELECT ord, rn, u FROM proposed WHERE u IN ('alta', 'baja') AND urgencia <> u))
  WHERE a <= CASE axis WHEN 'avanzado' THEN {_need('avanzado', 'nivel_tecnico')} WHEN 'alta' THEN {_need('alta', 'urgencia')} ELSE {_need('baja', 'urgencia')} END),
per AS (SELECT ord, bool_or(axis = 'avanzado') AS adv, bool_or(axis = 'alta') AS hi, bool_or(axis = 'baja') AS lo FROM acc GROUP BY 1)
SELECT l.question_id, CASE WHEN adv THEN 'avanzado' ELSE nivel_tecnico END AS nivel_tecnico, CASE WHEN hi THEN 'alta' WHEN lo THEN 'baja' ELSE urgencia END AS urgencia,
  CASE WHEN per.ord IS NOT NULL THEN 'mx:calibrated' ELSE model_used END AS model_used
FROM labeled l LEFT JOIN per USING (ord)
""")
def calibrate_labels(spark, sf):
    rows = labeled(spark, sf)
    ranked = settle(LB.calibration_requests(rows, questions(spark, sf), _TARGETS, "mx", **TERMS).drop("prompt"), "calibration")
    out = LB.calibrate_labels(rows, ranked, _plain_replies(spark, sf), _TARGETS)
    return out.select("question_id", "nivel_tecnico", "urgencia", "model_used")


def _votes(spark, sf):
    """Three votes per question: the events 3q, 3q + 1 and 3q + 2; clicks are lost votes."""
    events = table(spark, sf, "events").where(F.col("event_type") != "click")
    k = F.get_json_object("props", "$.k").cast("long")
    i = F.col("event_id")
    return events.select(
        F.floor(i / 3).alias("question_id"), F.concat(F.lit("m"), (i % 3).cast("string")).alias("model"),
        pick(("avanzado", "intermedio"), k).alias("nivel_tecnico"), pick(("alta", "media"), F.floor(k / 2)).alias("urgencia"),
    )


_VOTES = f"""votes AS (
  SELECT event_id // 3 AS question_id, 'm' || CAST(event_id % 3 AS VARCHAR) AS model, {sql_pick(('avanzado', 'intermedio'), 'k')} AS n, {sql_pick(('alta', 'media'), 'k // 2')} AS u
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) WHERE event_type <> 'click'),
decided AS (
  SELECT question_id, count(*) AS n_votes, count(*) FILTER (WHERE n = 'avanzado') AS advanced_votes, count(*) FILTER (WHERE u = 'alta') AS high_votes,
    count(*) FILTER (WHERE n = 'avanzado' AND model = 'm1') AS expert_votes FROM votes GROUP BY 1 HAVING count(*) >= 2)"""


@query(with_(_VOTES) + """
SELECT *, expert_votes >= 1 AS promote_advanced, high_votes >= 2 AS promote_high FROM decided
""")
def consensus_votes(spark, sf):
    return LB.consensus(_votes(spark, sf), "expert_plus_signal", "m1")


@query(with_(QUESTIONS, LABELED, SIGNALS, _VOTES) + f""",
cand AS (SELECT ord, question_id, nivel_tecnico, urgencia, row_number() OVER (ORDER BY advanced DESC, high_urgency DESC, least(10, score) DESC, creation_date DESC, ord) AS rn
  FROM signals WHERE advanced OR high_urgency),
acc AS (
  SELECT ord, axis FROM (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY rn) AS a FROM (
    SELECT ord, rn, 'avanzado' AS axis FROM cand JOIN decided USING (question_id) WHERE nivel_tecnico <> 'avanzado' AND advanced_votes >= 2
    UNION ALL SELECT ord, rn, 'alta' FROM cand JOIN decided USING (question_id) WHERE urgencia <> 'alta' AND high_votes >= 2))
  WHERE a <= CASE axis WHEN 'avanzado' THEN (SELECT greatest(0, 12 - count(*)) FROM labeled WHERE nivel_tecnico = 'avanzado')
    ELSE (SELECT greatest(0, 24 - count(*)) FROM labeled WHERE urgencia = 'alta') END),
per AS (SELECT ord, bool_or(axis = 'avanzado') AS adv, bool_or(axis = 'alta') AS hi FROM acc GROUP BY 1)
SELECT l.question_id, CASE WHEN adv THEN 'avanzado' ELSE nivel_tecnico END AS nivel_tecnico, CASE WHEN hi THEN 'alta' ELSE urgencia END AS urgencia,
  CASE WHEN per.ord IS NOT NULL THEN 'consensus:m0|m1|m2' ELSE model_used END AS model_used
FROM labeled l LEFT JOIN per USING (ord)
""")
def refine_consensus(spark, sf):
    rows = labeled(spark, sf)
    candidates = settle(LB.consensus_candidates(rows, questions(spark, sf), **TERMS), "candidates")
    refined, _ = LB.refine_consensus(rows, candidates, _votes(spark, sf), {"avanzado": 12, "alta": 24}, ["m0", "m1", "m2"])
    return refined.select("question_id", "nivel_tecnico", "urgencia", "model_used")
