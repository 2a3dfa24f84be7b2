"""Ranking, quotas, splits, generation and the corpus build."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions import labels as L
from lectern.operators import gates as G
from lectern.operators import generate as GEN

from lectern.operators import selection as S
from lectern.operators import splitting as SP
from lectern.operators.dedupe import dedupe_text
from lectern.plans.corpus import build_corpus
from lectern.plans.scratch import settle
from lectern.workloads.base import (
    FINAL, LABELED, LOW_TERMS, QUESTIONS, SPLIT, STRONG_A, STRONG_U, WEAK_A, WEAK_U, final_rows, labeled, pick, q, query,
    questions, sql_any, sql_hits, sql_list, sql_norm, sql_pick, sql_strip, table, with_,
)
from lectern.workloads.corpus import split_rows

_ORDER = "urgency_signal DESC, advanced_signal DESC, greatest(-2, least(10, score)) DESC, creation_date DESC, ord"


@query(with_(QUESTIONS) + f"""
SELECT question_id, domain, row_number() OVER (PARTITION BY domain ORDER BY {_ORDER}) AS rn FROM questions
""")
def rank_candidates(spark, sf):
    return S.rank_candidates(questions(spark, sf)).select("question_id", "domain", "rn")


_DIVERSE = f"""ranked AS (
  SELECT *, score > 10 AS high, row_number() OVER (PARTITION BY domain, score > 10 ORDER BY {_ORDER}) - 1 AS r FROM questions),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY domain ORDER BY CASE WHEN high THEN r * 3 + 2 ELSE r // 2 * 3 + r % 2 END) - 1 AS place FROM ranked)"""


@query(with_(QUESTIONS, _DIVERSE) + "SELECT question_id, domain, place FROM placed")
def interleave(spark, sf):
    return S.rank_diverse(questions(spark, sf)).select("question_id", "domain", "place")


_QUOTA_ROWS = ", ".join(f"({q(k)}, {v})" for k, v in fixed.DOMAIN_QUOTA["aggressive"].items())


def _alloc(total: int) -> str:
    budget = max(0, total - max(12, total // 30))
    return f"""quota(domain, quota) AS (VALUES {_QUOTA_ROWS}),
wants AS (
  SELECT s.domain, n_rows, least(coalesce(quota, 0), n_rows) AS want
  FROM (SELECT domain, count(*) AS n_rows FROM questions GROUP BY 1) s LEFT JOIN quota USING (domain)),
alloc AS (
  SELECT domain, n_rows, CAST(want AS BIGINT) AS want,
    CAST(CASE WHEN t <= {budget} OR t = 0 THEN want ELSE floor(want * ({budget}::DOUBLE / t)) END AS BIGINT) AS alloc
  FROM (SELECT *, CAST(sum(want) OVER () AS BIGINT) AS t FROM wants))"""


@query(with_(QUESTIONS, _alloc(150)) + "SELECT * FROM alloc")
def allocation(spark, sf):
    return S.allocate(questions(spark, sf), S.quotas("aggressive"), 150)


@query(with_(QUESTIONS, _alloc(200), _DIVERSE) + """, floors AS (
  SELECT p.question_id, 'floor' AS picked_by FROM placed p JOIN alloc a USING (domain) WHERE p.place < a.alloc)
SELECT * FROM floors
UNION ALL SELECT question_id, 'fill' FROM (
  SELECT question_id, row_number() OVER (ORDER BY urgency_signal DESC, advanced_signal DESC, creation_date DESC, ord) AS rn
  FROM questions WHERE question_id NOT IN (SELECT question_id FROM floors)
) WHERE rn <= 200 - (SELECT sum(alloc) FROM alloc)
""")
def balanced_selection(spark, sf):
    return S.select_balanced(questions(spark, sf), 200, S.quotas("aggressive")).select("question_id", "picked_by")



_U = f"({sql_any('f', STRONG_U)} OR {sql_hits('f', WEAK_U)} >= 2)"
SIGNALS = f"""signals AS (
  SELECT *, nivel_tecnico <> 'avanzado' AND ({sql_any('f', STRONG_A)} OR {sql_hits('f', WEAK_A)} >= 2
      OR list_has_any(tags, {sql_list(fixed.ADVANCED_HINT_TAGS)})) AS advanced,
    urgencia <> 'alta' AND {_U} AS high_urgency, urgencia <> 'baja' AND {sql_any('f', LOW_TERMS)} AND NOT {_U} AS low_urgency
  FROM (SELECT l.* EXCLUDE (body), s.body, s.score, s.creation_date, strip_accents(lower(l.title || ' ' || s.body || ' ' || array_to_string(l.tags, ' '))) AS f
    FROM labeled l JOIN questions s USING (question_id))
)"""
CAL_RANK = """cal AS (
  SELECT *, 100 * CAST(advanced AS INT) + 50 * CAST(high_urgency AS INT) + 30 * CAST(low_urgency AS INT) AS cal_score FROM signals),
cal_ranked AS (SELECT *, row_number() OVER (ORDER BY cal_score DESC, ord) AS rn FROM cal WHERE cal_score > 0)"""


def signals(spark, sf):
    from lectern.operators.labeling import enrich, with_signals
    from lectern.workloads.base import TERMS

    return with_signals(enrich(labeled(spark, sf), questions(spark, sf)), **TERMS)


@query(with_(QUESTIONS, LABELED, SIGNALS, CAL_RANK) + """
SELECT question_id, cal_score, rn FROM cal_ranked
""")
def rank_calibration(spark, sf):
    return S.rank_calibration(signals(spark, sf)).select("question_id", "cal_score", "rn")


@query(with_(QUESTIONS, LABELED, SIGNALS) + """
SELECT question_id, advanced, high_urgency, low_urgency FROM signals WHERE advanced OR high_urgency OR low_urgency
""")
def calibration_candidates(spark, sf):
    return S.calibration_candidates(signals(spark, sf)).select("question_id", "advanced", "high_urgency", "low_urgency")


@query(with_(QUESTIONS, LABELED, SIGNALS) + """
SELECT question_id, row_number() OVER (ORDER BY advanced DESC, high_urgency DESC, least(10, score) DESC, creation_date DESC, ord) AS rn
FROM signals WHERE advanced OR high_urgency
""")
def rank_consensus(spark, sf):
    from lectern.operators.labeling import consensus_candidates
    from lectern.workloads.base import TERMS

    return consensus_candidates(labeled(spark, sf), questions(spark, sf), **TERMS).select("question_id", "rn")


@query(with_(FINAL) + """
SELECT ord, axis FROM (
  SELECT ord, axis, row_number() OVER (PARTITION BY axis ORDER BY ord DESC) AS a FROM (
    SELECT ord, 'avanzado' AS axis FROM final_rows WHERE nivel_tecnico = 'avanzado'
    UNION ALL SELECT ord, 'alta' FROM final_rows WHERE urgencia = 'alta'
    UNION ALL SELECT ord, 'baja' FROM final_rows WHERE urgencia = 'baja')
) WHERE a <= CASE axis WHEN 'avanzado' THEN 40 WHEN 'alta' THEN 15 ELSE 60 END
""")
def accept_within_deficit(spark, sf):
    axes = {
        "avanzado": F.col("nivel_tecnico") == "avanzado", "alta": F.col("urgencia") == "alta", "baja": F.col("urgencia") == "baja",
    }
    rows = final_rows(spark, sf).select("ord", "nivel_tecnico", "urgencia")
    return S.accept_within_deficit(rows, axes, {"avanzado": 40, "alta": 15, "baja": 60}, [F.desc("ord")])


@query("""
SELECT doc_id AS ord, ['m1', 'm2', 'm3'][(row_number() OVER (ORDER BY doc_id) - 1 + 7) % 3 + 1] AS model FROM documents WHERE lang <> 'de'
""")
def round_robin(spark, sf):
    docs = table(spark, sf, "documents").where(F.col("lang") != "de").select(F.col("doc_id").alias("ord"))
    return S.assign_round_robin(docs, ["m1", "m2", "m3"], 7)


@query(with_(FINAL) + """
SELECT ord, fuente FROM (
  SELECT ord, fuente, row_number() OVER (ORDER BY fuente LIKE 'synthetic%', ord) AS rn, count(*) OVER () AS total FROM final_rows
) WHERE rn <= total * 7 // 10
""")
def trim_to_target(spark, sf):
    rows = final_rows(spark, sf).select("ord", "fuente")
    return S.trim_to_target(rows, rows.count() * 7 // 10)


@query("""
SELECT doc_id FROM (
  SELECT doc_id, row_number() OVER (ORDER BY md5('7|' || CAST(doc_id AS VARCHAR)), doc_id) AS rn, count(*) OVER () AS total FROM documents
) WHERE rn <= total // 5
""")
def sample_rows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return S.sample_n(docs, docs.count() // 5, 7, "doc_id")


# --- splits -----------------------------------------------------------------------------
_DEDUPED = f"""deduped AS (
  SELECT doc_id AS ord, source FROM (
    SELECT *, row_number() OVER (PARTITION BY {sql_norm('text')} ORDER BY doc_id) AS rn FROM documents WHERE {sql_strip('text')} <> '') WHERE rn = 1),
slotted AS (
  SELECT *, (row_number() OVER (ORDER BY md5('42|' || CAST(ord AS VARCHAR)), ord) - 1) % 20 AS slot FROM deduped)"""


@query(with_(_DEDUPED) + """
SELECT source, CASE WHEN slot < 14 THEN 'train' WHEN slot < 17 THEN 'val' ELSE 'test' END AS split, count(*) AS n_rows
FROM slotted GROUP BY 1, 2
""")
def corpus_splits(spark, sf):
    """Documents without duplicates, split, counted per source."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), "text", "source")
    unique = settle(dedupe_text(docs, "text").drop("text"), "unique")
    return SP.split_slots(unique).groupBy("source", "split").agg(F.count(F.lit(1)).alias("n_rows"))


@query(with_(FINAL, SPLIT) + "SELECT ord, split FROM split_rows")
def slot_split(spark, sf):
    return SP.split_slots(final_rows(spark, sf).select("ord")).select("ord", "split")


_CAP = 0.4
_SYN = "fuente LIKE 'synthetic%'"


@query(with_(FINAL, SPLIT) + f""", ranked AS (
  SELECT ord, split, {_SYN} AS syn, row_number() OVER (PARTITION BY split, {_SYN} ORDER BY ord) AS r FROM split_rows),
x AS (
  SELECT greatest(0, ceil(count(*) FILTER (WHERE split = 'val' AND syn) - {_CAP}::DOUBLE * count(*) FILTER (WHERE split = 'val'))) AS v,
    greatest(0, ceil(count(*) FILTER (WHERE split = 'test' AND syn) - {_CAP}::DOUBLE * count(*) FILTER (WHERE split = 'test'))) AS t FROM ranked)
SELECT ord, CASE WHEN split = 'val' AND syn AND r <= v THEN 'train' WHEN split = 'test' AND syn AND r <= t THEN 'train'
  WHEN split = 'train' AND NOT syn AND r <= v THEN 'val' WHEN split = 'train' AND NOT syn AND r <= v + t THEN 'test' ELSE split END AS split
FROM ranked, x
""")
def cap_synthetic(spark, sf):
    return SP.cap_synthetic(split_rows(spark, sf).select("ord", "fuente", "split"), _CAP).select("ord", "split")


_BEFORE = """sized AS (SELECT split, count(*) AS n_rows FROM split_rows GROUP BY 1),
held AS (SELECT split, head, label FROM (
  SELECT split, ord, 'nivel_tecnico' AS head, nivel_tecnico AS label, s_nivel_tecnico AS s FROM split_rows UNION ALL SELECT split, ord, 'urgencia', urgencia, s_urgencia FROM split_rows
  UNION ALL SELECT split, ord, 'emocion', emocion, s_emocion FROM split_rows UNION ALL SELECT split, ord, 'dominio', dominio, s_dominio FROM split_rows) WHERE s AND label IS NOT NULL),
everywhere AS (SELECT head, label, count(*) AS n FROM held GROUP BY 1, 2)"""


def _checked(before, after, minimum):
    """Per split: its size, distinct ids, whether the synthetic cap holds; and how many labels there are, and have
    ``minimum`` rows in the split or none left in train."""
    sizes = after.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("ord").alias("n_ids"),
        (F.avg(L.is_synthetic("fuente").cast("int")) <= 0.55).alias("under_cap"))
    count = lambda d, by: G.signature_label_counts(G.label_signatures(d, by), by)
    every = count(before.withColumn("scope", F.lit("all")), ["scope"]).select("head", "label", F.col("n").alias("total"))
    wanted = every.withColumn("split", F.explode(F.array(F.lit("val"), F.lit("test"))))
    left = count(after.where("split = 'train'"), ["split"]).select("head", "label", F.col("n").alias("left"))
    part = wanted.join(count(after, ["split"]), ["split", "head", "label"], "left").join(left, ["head", "label"], "left")
    enough = (F.coalesce("n", F.lit(0)) >= minimum) | F.col("left").isNull()
    labels = part.groupBy("split").agg(F.count(F.lit(1)).alias("n_labels"), F.count_if(enough).alias("n_supported"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return sizes.join(labels, "split", "left").select("split", "n_rows", "n_ids", F.when(F.col("split") == "train", True).otherwise(F.col("under_cap")).alias("under_cap"), zero("n_labels"), zero("n_supported"))


_INVARIANT = """
SELECT s.split, n_rows, n_rows AS n_ids, true AS under_cap, CASE WHEN s.split = 'train' THEN 0 ELSE (SELECT count(*) FROM everywhere) END AS n_labels,
  CASE WHEN s.split = 'train' THEN 0 ELSE (SELECT count(*) FROM everywhere) END AS n_supported FROM sized s
"""


@query(with_(FINAL, SPLIT, _BEFORE) + _INVARIANT)
def repair_support(spark, sf):
    """What must hold after the repair: sizes, ids, cap and support."""
    rows = settle(split_rows(spark, sf).drop("texto"), "rows")
    return _checked(rows, SP.repair_support(SP.cap_synthetic(rows, 0.55), minimum=12, cap=0.55), 12)


@query(with_(FINAL, SPLIT, _BEFORE) + _INVARIANT)
def final_split(spark, sf):
    """What must hold after slot split, synthetic cap and support repair in one."""
    rows = final_rows(spark, sf).drop("texto")
    return _checked(rows, SP.split_final(rows), G.gate_thresholds(rows.count())["split"])


@query(with_(FINAL) + f""", keyed AS (SELECT ord, {sql_pick(('alta', 'media', 'baja'), 'ord % 5')} AS urgencia, emocion FROM final_rows),
combos AS (SELECT ord, emocion, '_|' || urgencia || '|' || emocion || '|_' AS combo FROM keyed),
usable AS (SELECT min(k) >= 2 AND sum(k) >= 10 AS yes FROM (SELECT count(*) AS k FROM combos GROUP BY combo)),
strata AS (SELECT ord, CASE WHEN yes THEN combo ELSE emocion END AS stratum FROM combos, usable),
sizes AS (SELECT stratum, count(*) AS k FROM strata GROUP BY 1),
tot AS (SELECT *, CAST(ceil(round((1 - 0.7::DOUBLE - 0.15) / (1 - 0.7::DOUBLE) * e, 9)) AS BIGINT) AS t FROM (SELECT CAST(sum(k) AS BIGINT) AS n, CAST(ceil(round((1 - 0.7::DOUBLE) * sum(k), 9)) AS BIGINT) AS e FROM sizes)),
a AS (SELECT stratum, k, n, e, t, floor(k * e::DOUBLE / n::DOUBLE) AS b, k * e::DOUBLE / n::DOUBLE - floor(k * e::DOUBLE / n::DOUBLE) AS rest FROM sizes, tot),
b AS (SELECT stratum, k, e, t, CAST(b + CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum) <= e - sum(b) OVER () THEN 1 ELSE 0 END AS BIGINT) AS n_eval FROM a),
c AS (SELECT stratum, n_eval, e, t, floor(n_eval * t::DOUBLE / e::DOUBLE) AS b, n_eval * t::DOUBLE / e::DOUBLE - floor(n_eval * t::DOUBLE / e::DOUBLE) AS rest FROM b),
d AS (SELECT stratum, n_eval, b + CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum) <= t - sum(b) OVER () THEN 1 ELSE 0 END AS n_test FROM c)
SELECT ord, CASE WHEN p < n_test THEN 'test' WHEN p < n_eval THEN 'val' ELSE 'train' END AS split FROM (
  SELECT ord, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('42|' || CAST(ord AS VARCHAR)), ord) - 1 AS p FROM strata) JOIN d USING (stratum)
""")
def stratified_split(spark, sf):
    rows = final_rows(spark, sf).select(
        "ord", pick(("alta", "media", "baja"), F.col("ord") % 5).alias("urgencia"), "emocion",
        F.lit(None).cast("string").alias("nivel_tecnico"), F.lit(None).cast("string").alias("dominio"),
    )
    return SP.split_stratified(rows).select("ord", "split")


@query(with_(FINAL, SPLIT) + """, rows AS (
  SELECT ord, split, CASE WHEN ord % 4 = 0 THEN 'synthetic_x' WHEN ord % 4 = 1 THEN 'otra' ELSE 'so_es' END AS src FROM split_rows),
need AS (SELECT count(*) FILTER (WHERE split = 'val' AND src = 'synthetic_x') AS v, count(*) FILTER (WHERE split = 'test' AND src = 'synthetic_x') AS t FROM rows),
ranked AS (
  SELECT *, split = 'train' AND src = 'so_es' AS realrow,
    row_number() OVER (PARTITION BY split = 'train' AND src = 'so_es' ORDER BY md5('9|' || CAST(ord AS VARCHAR)), ord) - 1 AS p FROM rows)
SELECT ord, CASE WHEN split <> 'train' AND src = 'synthetic_x' THEN 'train' WHEN realrow AND p < v THEN 'val'
  WHEN realrow AND p < v + t THEN 'test' ELSE split END AS split FROM ranked, need
""")
def synthetic_to_train(spark, sf):
    kind = F.when(F.col("ord") % 4 == 0, "synthetic_x").when(F.col("ord") % 4 == 1, "otra").otherwise("so_es")
    rows = split_rows(spark, sf).select("ord", "split", kind.alias("fuente"))
    return SP.synthetic_to_train(rows, "synthetic_x", seed=9).select("ord", "split")


@query("""
SELECT k, left_id, right_id FROM
  (SELECT doc_id AS left_id, row_number() OVER (ORDER BY doc_id) AS k FROM documents WHERE lang = 'es')
  JOIN (SELECT doc_id AS right_id, row_number() OVER (ORDER BY doc_id) AS k FROM documents WHERE lang = 'fr') USING (k)
""")
def paired_swap(spark, sf):
    docs = table(spark, sf, "documents").withColumn("ord", F.col("doc_id"))
    return SP.paired_swap(docs.where(F.col("lang") == "es"), docs.where(F.col("lang") == "fr"))


# --- generation and the build -------------------------------------------------------------
_O = GEN.generator_offsets(42)


def _case(options, key: str, position: str) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN {q(k)} THEN {sql_pick(v, position)}" for k, v in options.items()) + " END"


def _sql_template(template: str) -> str:
    text = q(template)
    for name in ("dominio", "topic", "level", "emotion", "urgency", "tail"):
        text = text.replace("{" + name + "}", f"' || {name} || '")
    return text


@query(f"""
SELECT source_id, md5(texto) AS text_key, nivel_tecnico, urgencia, emocion, dominio, family FROM (
  SELECT *, CASE family {' '.join(f'WHEN {q(k)} THEN {_sql_template(v)}' for k, v in fixed.FAMILY_TEMPLATES.items())} END AS texto FROM (
    SELECT *, {_case(fixed.DOMAIN_TOPICS, 'dominio', 'i + 3')} AS topic, {_case(fixed.LEVEL_STYLE, 'nivel_tecnico', 'i // 3 + 5')} AS level,
      {_case(fixed.URGENCY_STYLE, 'urgencia', 'i // 5 + 7')} AS urgency, {_case(fixed.EMOTION_STYLE, 'emocion', 'i // 7 + 11')} AS emotion,
      'El contexto es ' || {sql_pick(fixed.APP_CONTEXTS, 'i + 13')} || ', ' || {sql_pick(fixed.CONSTRAINTS, 'i // 2 + 17')} || '.' AS tail FROM (
      SELECT doc_id AS i, 'syn:final:42:' || CAST(doc_id AS VARCHAR) AS source_id,
        {sql_pick(fixed.LABELS['nivel_tecnico'], f'doc_id + {_O[0]}')} AS nivel_tecnico, {sql_pick(fixed.LABELS['urgencia'], f'doc_id // 3 + {_O[1]}')} AS urgencia,
        {sql_pick(fixed.LABELS['emocion'], f'doc_id // 8 + {_O[2]}')} AS emocion, {sql_pick(fixed.LABELS['dominio'], f'doc_id + {_O[3]}')} AS dominio,
        {sql_pick(tuple(fixed.FAMILY_TEMPLATES), f'doc_id + {_O[4]}')} AS family FROM documents)))
""")
def generate_balanced(spark, sf):
    """One generated row next to every document."""
    rows = GEN.balanced_rows(table(spark, sf, "documents").select("doc_id"), 42, "doc_id")
    return rows.select(
        "source_id", F.md5("texto").alias("text_key"), *fixed.HEADS, F.col("synthetic_provenance.family").alias("family")
    )


@query(with_(FINAL) + """
SELECT n_real, CAST(greatest(400, least(900000, floor(n_real / greatest(0.01, 1.0 - (0.7::DOUBLE * 0.70 + (0.15 + (1.0 - 0.7::DOUBLE - 0.15)) * 0.55) + 0.005)))) AS BIGINT) AS target
FROM (SELECT count(*) AS n_real FROM final_rows WHERE fuente NOT LIKE 'synthetic%')
""")
def auto_target(spark, sf):
    real = final_rows(spark, sf).where(~L.is_synthetic("fuente")).agg(F.count(F.lit(1)).alias("n_real"))
    return real.select("n_real", GEN.auto_target("n_real", 400, 900_000).alias("target"))


_EXTRA = f"""extra AS (SELECT ord, {sql_strip('texto')} AS texto FROM final_rows WHERE nivel_tecnico IS NOT NULL AND length({sql_strip('texto')}) >= 20)"""


@query(with_(QUESTIONS, LABELED, FINAL, _EXTRA) + f""", asked AS (
  SELECT ord, CASE WHEN b = '' THEN t WHEN t = '' THEN b ELSE t || chr(10) || b END AS texto
  FROM (SELECT ord, {sql_strip('title')} AS t, {sql_strip('body')} AS b FROM labeled)),
felt AS (
  SELECT id AS ord, texto FROM (
    SELECT *, row_number() OVER (ORDER BY md5('42|' || CAST(id AS VARCHAR)), id) AS rn, count(*) OVER () AS total FROM (
      SELECT conv_id * 100 + turn AS id, {sql_strip('text')} AS texto FROM conversations) WHERE length(texto) >= 8
  ) WHERE rn <= (SELECT count(*) // 2 FROM conversations)),
stacked AS (
  SELECT 0 AS s, ord, texto, 'so_es' AS fuente FROM asked WHERE texto <> '' UNION ALL SELECT 1, ord, texto, 'goemotions_es' FROM felt
  UNION ALL SELECT 2, f.ord, e.texto, f.fuente FROM extra e JOIN final_rows f USING (ord)),
uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {sql_norm('texto')} ORDER BY s, ord) AS rn FROM stacked) WHERE rn = 1),
counted AS (SELECT count(*) AS n FROM uniq)
SELECT fuente, count(*) AS n_rows FROM uniq GROUP BY 1
UNION ALL SELECT 'synthetic_programming_final', (SELECT count(*) FROM documents) * 2 - n FROM counted
""")
def corpus_build(spark, sf):
    """Questions, emotion texts, extra rows and generated rows up to twice the documents."""
    said = table(spark, sf, "conversations")
    emotions = said.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text").withColumn("ord", F.col("id"))
    target = table(spark, sf, "documents").count() * 2
    built = build_corpus(
        labeled(spark, sf), emotions, final_rows(spark, sf), target=target, seed=42, max_emotions=said.count() // 2
    )
    return built.groupBy("fuente").agg(F.count(F.lit(1)).alias("n_rows"))
