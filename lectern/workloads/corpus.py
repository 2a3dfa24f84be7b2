"""Projections, validators, counts and gates over documents and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions import labels as L
from lectern.operators import counts as C
from lectern.operators import dedupe as D
from lectern.operators import gates as G
from lectern.operators import rows as R
from lectern.plans.ranking import number_by_hash
from lectern.plans.scratch import settle
from lectern.workloads.base import (
    FINAL, FINAL_LONG, LABELED, QUESTIONS, SPLIT, final_rows, labeled, pick, q, query, questions, r6, sql_any,
    sql_map, sql_norm, sql_pick, sql_strip, table, with_,
)

LABEL_ROWS = ",\n  ".join(
    f"('{h}', '{x}', {i})" for h in fixed.HEADS for i, x in enumerate(fixed.LABELS[h])
)
LABEL_TABLE = f"label_sets(head, label, idx) AS (VALUES\n  {LABEL_ROWS}\n)"


def split_rows(spark, sf):
    """Final rows with the slot split."""
    numbered = number_by_hash(final_rows(spark, sf), "ord", 42, out="pos")
    slot = F.col("pos") % 20
    split = F.when(slot < 14, "train").when(slot < 17, "val").otherwise("test")
    return numbered.withColumn("split", split)


# --- filters and projections ------------------------------------------------------------
@query(f"""
SELECT lang, source, count(*) AS n FROM documents
WHERE lang IN ('es', 'fr') AND length({sql_strip('text')}) >= 200 GROUP BY 1, 2
""")
def language_min_length(spark, sf):
    docs = table(spark, sf, "documents")
    both = R.filter_lang(docs, "es", "lang").unionByName(R.filter_lang(docs, "fr", "lang"))
    return R.min_len(both, {"text": 200}).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


_EMO_DEFAULT = "CASE " + " ".join(
    f"WHEN {sql_any('lower(texto)', terms)} THEN {q(label)}" for label, terms in fixed.EMOTION_RULES
) + " ELSE 'neutral' END"


@query(with_(QUESTIONS, LABELED) + f"""
SELECT ord, source_id, sha256(texto) AS text_key,
  CASE WHEN nivel_tecnico IN {tuple(fixed.LABELS['nivel_tecnico'])} THEN nivel_tecnico ELSE 'intermedio' END AS nivel_tecnico,
  CASE WHEN urgencia IN {tuple(fixed.LABELS['urgencia'])} THEN urgencia ELSE 'media' END AS urgencia,
  CASE WHEN emocion IN {tuple(fixed.LABELS['emocion'])} THEN emocion ELSE {_EMO_DEFAULT} END AS emocion,
  {sql_map(fixed.DOMAIN_FINAL)}[domain] AS dominio, 'so_es' AS fuente
FROM (
  SELECT *, 'so:' || CAST(question_id AS VARCHAR) AS source_id,
    CASE WHEN b = '' THEN t WHEN t = '' THEN b ELSE t || chr(10) || b END AS texto
  FROM (SELECT *, {sql_strip('title')} AS t, {sql_strip('body')} AS b FROM labeled)
) WHERE texto <> ''
""")
def final_questions(spark, sf):
    out = R.to_final_questions(labeled(spark, sf))
    return out.select(
        "ord", "source_id", F.sha2("texto", 256).alias("text_key"), *fixed.HEADS, "fuente"
    )


@query(f"""
SELECT source_id, sha256(texto) AS text_key, emocion,
  CAST(NULL AS VARCHAR) AS nivel_tecnico, false AS s_dominio, true AS s_emocion
FROM (
  SELECT 'goe:' || CAST(conv_id * 100 + turn AS VARCHAR) AS source_id, {sql_strip('text')} AS texto,
    CASE WHEN turn % 4 = 0 THEN 'neutral' ELSE {sql_pick(fixed.LABELS['emocion'], 'conv_id + turn')} END AS emocion
  FROM conversations
) WHERE length(texto) >= 8
""")
def final_emotions(spark, sf):
    said = table(spark, sf, "conversations")
    mapped = F.when(F.col("turn") % 4 == 0, "otra").otherwise(
        pick(fixed.LABELS["emocion"], F.col("conv_id") + F.col("turn"))
    )
    raw = said.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text", mapped.alias("emocion_mapped"))
    return R.to_final_emotions(raw).select(
        "source_id", F.sha2("texto", 256).alias("text_key"), "emocion", "nivel_tecnico",
        F.col("supervision.dominio").alias("s_dominio"), F.col("supervision.emocion").alias("s_emocion"),
    )


@query(with_(FINAL) + f"""
SELECT ord, source_id, fuente, nivel_tecnico, dominio FROM (
  SELECT ord, 'extra:' || sha256({sql_strip('texto')}) AS source_id, fuente, nivel_tecnico, dominio,
    {sql_strip('texto')} AS t, urgencia, emocion
  FROM final_rows
) WHERE length(t) >= 20 AND nivel_tecnico IS NOT NULL AND urgencia IS NOT NULL
""")
def final_extra(spark, sf):
    return R.to_final_extra(final_rows(spark, sf)).select("ord", "source_id", "fuente", "nivel_tecnico", "dominio")


@query(with_(FINAL) + """
SELECT ord, problem FROM (
  SELECT ord, unnest(list_filter([
    CASE WHEN trim(texto) = '' THEN 'texto' END,
    CASE WHEN ord % 4 <> 1 AND nivel_tecnico IS NULL THEN 'nivel_tecnico' END,
    CASE WHEN urgencia IS NULL THEN 'urgencia' END], lambda x: x IS NOT NULL)) AS problem
  FROM final_rows
)
""")
def validate_rows(spark, sf):
    mask = F.struct((F.col("ord") % 4 != 1).alias("nivel_tecnico"), F.lit(True).alias("emocion"))
    return R.validate_rows(final_rows(spark, sf).withColumn("supervision", mask))


@query(f"""
WITH used AS (
  SELECT DISTINCT source AS split, head, label FROM (
    SELECT source, 'nivel_tecnico' AS head, lang AS label FROM documents
    UNION ALL SELECT source, 'urgencia', 'nivel' || CAST(n_chars % 13 AS VARCHAR) FROM documents
    UNION ALL SELECT source, 'emocion', {sql_pick(fixed.LABELS['emocion'], 'doc_id')} FROM documents
    UNION ALL SELECT source, 'dominio', CASE WHEN doc_id % 2 = 0 THEN 'backend' ELSE 'juegos' END FROM documents)
)
SELECT split, head, label FROM used WHERE head <> 'emocion' AND label <> 'backend'
""")
def bad_labels(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("source").alias("split"),
        F.col("lang").alias("nivel_tecnico"),
        F.concat(F.lit("nivel"), (F.col("n_chars") % 13).cast("string")).alias("urgencia"),
        pick(fixed.LABELS["emocion"], F.col("doc_id")).alias("emocion"),
        F.when(F.col("doc_id") % 2 == 0, "backend").otherwise("juegos").alias("dominio"),
    )
    return R.bad_labels(docs)


@query(f"""
SELECT conv_id, turn, array_to_string(list_filter([
  CASE WHEN length(text) > 4000 OR length(text) < 1 THEN 'pregunta' END,
  CASE WHEN turn % 3 = 1 THEN 'metadata.urgencia' END,
  CASE WHEN conv_id % 5 = 4 THEN 'metadata.confianza' END,
  CASE WHEN turn > 5 THEN 'historial' END,
  CASE WHEN role = 'system' AND turn * 2 >= 1 THEN 'historial.rol' END,
  CASE WHEN conv_id % 6 = 5 THEN 'head_confidences.emocion' END,
  CASE WHEN conv_id % 7 = 3 THEN 'options.temperature' END,
  CASE WHEN conv_id % 4 = 2 THEN 'options.max_tokens' END], lambda x: x IS NOT NULL), ',') AS errors
FROM conversations
""")
def validate_requests(spark, sf):
    conv, turn = F.col("conv_id"), F.col("turn")
    message = F.struct(F.col("role").alias("rol"), F.lit("hola").alias("contenido"))
    heads = F.struct(
        F.lit(0.5).alias("nivel_tecnico"), F.lit(0.5).alias("urgencia"),
        F.when(conv % 6 == 5, 1.5).otherwise(0.5).alias("emocion"), F.lit(0.5).alias("dominio"),
    )
    requests = table(spark, sf, "conversations").select(
        "conv_id", "turn",
        F.col("text").alias("pregunta"),
        F.struct(
            F.lit("avanzado").alias("nivel_tecnico"),
            F.when(turn % 3 == 1, "ahora").otherwise("alta").alias("urgencia"),
            F.lit("neutral").alias("emocion"), F.lit("general").alias("dominio"),
            F.when(conv % 5 == 4, -0.5).otherwise(0.7).alias("confianza"),
        ).alias("metadata"),
        F.array_repeat(message, (turn * 2).cast("int")).alias("historial"),
        F.when(conv % 2 == 1, heads).alias("head_confidences"),
        F.struct(
            F.when(conv % 7 == 3, 2.5).alias("temperature"), F.lit(0.9).alias("top_p"),
            F.when(conv % 4 == 2, 10).otherwise(1024).alias("max_tokens"),
        ).alias("options"),
    )
    return R.validate_requests(requests).select("conv_id", "turn", F.array_join("errors", ",").alias("errors"))


@query(with_(QUESTIONS, LABELED) + """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE NOT (body = '')) AS n_complete FROM labeled
""")
def schema_coverage(spark, sf):
    rows = labeled(spark, sf).withColumn("body", F.nullif("body", F.lit("")))
    return R.schema_coverage(rows)


# --- duplicates -------------------------------------------------------------------------
@query(f"""
SELECT doc_id, source, lang FROM (
  SELECT *, row_number() OVER (PARTITION BY {sql_norm('text')} ORDER BY doc_id) AS rn FROM documents WHERE {sql_strip('text')} <> ''
) WHERE rn = 1
""")
def dedupe_exact(spark, sf):
    docs = table(spark, sf, "documents").withColumn("ord", F.col("doc_id"))
    return D.dedupe_text(docs, "text").select("doc_id", "source", "lang")


@query(f"""
SELECT count(*) AS total, count(DISTINCT {sql_norm('text')}) AS unique_rows,
  count(*) - count(DISTINCT {sql_norm('text')}) AS duplicates FROM documents
""")
def duplicate_report(spark, sf):
    return D.duplicate_report(table(spark, sf, "documents"), "text")


@query("""
SELECT question_id, origin, score FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY origin DESC, ord) AS rn FROM (
    SELECT doc_id % 500 AS question_id, doc_id AS ord, 'seed' AS origin, n_chars AS score FROM documents WHERE doc_id % 3 = 0
    UNION ALL SELECT doc_id % 700, doc_id, 'new', n_chars FROM documents)
) WHERE rn = 1
""")
def seed_then_extend(spark, sf):
    docs = table(spark, sf, "documents")
    doc = F.col("doc_id")
    existing = docs.where(doc % 3 == 0).select(
        (doc % 500).alias("question_id"), doc.alias("ord"), F.lit("seed").alias("origin"), F.col("n_chars").alias("score")
    )
    new = docs.select(
        (doc % 700).alias("question_id"), doc.alias("ord"), F.lit("new").alias("origin"), F.col("n_chars").alias("score")
    )
    return D.seed_then_extend(existing, new).select("question_id", "origin", "score")


# --- counts -----------------------------------------------------------------------------
@query(with_(FINAL, SPLIT, FINAL_LONG.replace("FROM final_rows", "FROM split_rows").replace("ord, fuente,", "split,")) + """
SELECT split, head, label, count(*) AS n FROM long_rows WHERE supervised AND label IS NOT NULL GROUP BY 1, 2, 3
""")
def label_counts(spark, sf):
    return C.label_counts(split_rows(spark, sf), ["split"])


@query(with_(FINAL, FINAL_LONG) + """
SELECT fuente, head, count(*) FILTER (WHERE supervised) AS supervised_rows,
  count(*) FILTER (WHERE NOT supervised) AS unsupervised_rows FROM long_rows GROUP BY 1, 2
""")
def supervision_coverage(spark, sf):
    return C.supervision_coverage(final_rows(spark, sf), ["fuente"])


@query(with_(FINAL) + "SELECT fuente, count(*) AS n FROM final_rows GROUP BY 1")
def source_counts(spark, sf):
    return C.source_counts(final_rows(spark, sf))


@query(with_(QUESTIONS) + """
SELECT lower(t) AS value, count(*) AS n FROM (SELECT unnest(tags) AS t FROM questions) GROUP BY 1
ORDER BY n DESC, value LIMIT 24
""")
def top_tags(spark, sf):
    return C.top_k(C.exploded_counts(questions(spark, sf), "tags", lower=True), 24)


@query(with_(QUESTIONS) + """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE urgency_signal > 0) AS urgency_gt0,
  count(*) FILTER (WHERE advanced_signal > 0) AS advanced_gt0, count(*) FILTER (WHERE trim(body) = '') AS body_empty FROM questions
""")
def signal_counts(spark, sf):
    return C.signal_counts(questions(spark, sf))


@query(with_(FINAL, SPLIT) + """
SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE fuente LIKE 'synthetic\\_%' ESCAPE '\\') AS n_synthetic,
  round(count(*) FILTER (WHERE fuente LIKE 'synthetic\\_%' ESCAPE '\\') / count(*), 6) AS fraction FROM split_rows GROUP BY 1
""")
def synthetic_fraction(spark, sf):
    return C.synthetic_fraction(split_rows(spark, sf), ["split"])


@query(with_(QUESTIONS) + """, sel AS (SELECT * FROM questions WHERE question_id % 2 = 0)
SELECT 'total' AS section, 'selected' AS key, count(*) AS n FROM sel
UNION ALL SELECT 'total', 'candidates', count(*) FROM questions
UNION ALL SELECT 'domain', domain, count(*) FROM sel GROUP BY 2
UNION ALL SELECT 'strategy', split_part(source_strategy, ':', 1), count(*) FROM sel GROUP BY 2
UNION ALL SELECT 'signal', 'urgency_gt0', count(*) FROM sel WHERE urgency_signal > 0
UNION ALL SELECT 'signal', 'advanced_gt0', count(*) FROM sel WHERE advanced_signal > 0
UNION ALL SELECT * FROM (
  SELECT 'tag', lower(t) AS tag, count(*) AS n FROM (SELECT unnest(tags) AS t FROM sel) GROUP BY 2 ORDER BY n DESC, tag LIMIT 24)
""")
def extraction_audit(spark, sf):
    pool = questions(spark, sf)
    return C.extraction_audit(pool.where(F.col("question_id") % 2 == 0), pool)


@query(with_(QUESTIONS) + """
SELECT domain, count(*) AS n_rows, round(avg(length(body)), 6) AS mean_body, count(*) FILTER (WHERE urgency_signal > 0) AS urgency_gt0,
  count(*) FILTER (WHERE advanced_signal > 0) AS advanced_gt0 FROM questions GROUP BY 1
""")
def corpus_summary(spark, sf):
    return C.corpus_summary(questions(spark, sf)).withColumn("mean_body", r6("mean_body"))


@query(with_(QUESTIONS, LABELED) + """
SELECT 'total' AS section, 'labeled' AS key, count(*) AS n FROM labeled
UNION ALL SELECT 'model', model_used, count(*) FROM labeled GROUP BY 2
UNION ALL SELECT 'nivel_tecnico', nivel_tecnico, count(*) FROM labeled GROUP BY 2
UNION ALL SELECT 'urgencia', urgencia, count(*) FROM labeled GROUP BY 2
UNION ALL SELECT 'emocion', emocion, count(*) FROM labeled WHERE emocion <> '' GROUP BY 2
""")
def labeling_summary(spark, sf):
    return C.labeling_summary(labeled(spark, sf))


@query(with_(QUESTIONS, LABELED) + """
SELECT greatest(0, 250 - count(*) FILTER (WHERE nivel_tecnico = 'avanzado')) AS avanzado,
  greatest(0, 100 - count(*) FILTER (WHERE urgencia = 'media')) AS media FROM labeled
""")
def label_deficits(spark, sf):
    return C.deficits(
        labeled(spark, sf), {"avanzado": ("nivel_tecnico", "avanzado", 250), "media": ("urgencia", "media", 100)}
    )


@query(with_(FINAL, SPLIT) + f""", seen AS (
  SELECT {sql_norm('texto')} AS k, bool_or(split = 'train') AS a, bool_or(split = 'val') AS b, bool_or(split = 'test') AS c
  FROM split_rows GROUP BY 1)
SELECT count(*) FILTER (WHERE a) AS train_unique, count(*) FILTER (WHERE b) AS val_unique, count(*) FILTER (WHERE c) AS test_unique,
  count(*) FILTER (WHERE a AND b) AS train_val, count(*) FILTER (WHERE a AND c) AS train_test, count(*) FILTER (WHERE b AND c) AS val_test
FROM seen
""")
def split_overlap(spark, sf):
    return C.split_overlap(split_rows(spark, sf))


@query("""
SELECT count(*) FILTER (WHERE l) AS n_left, count(*) FILTER (WHERE r) AS n_right, count(*) FILTER (WHERE l AND r) AS n_both,
  count(*) FILTER (WHERE l AND NOT r) AS n_left_only
FROM (SELECT doc_id, bool_or(l) AS l, bool_or(r) AS r FROM (
  SELECT doc_id, true AS l, false AS r FROM documents UNION ALL SELECT doc_id, false, true FROM labels) GROUP BY 1)
""")
def shared_keys(spark, sf):
    return C.shared_keys(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("""
SELECT doc_id, lang, CAST(NULL AS INT) AS quality FROM documents WHERE lang <> 'en'
UNION ALL SELECT doc_id, NULL, quality FROM labels WHERE toxic = 1
""")
def union_rows(spark, sf):
    docs = table(spark, sf, "documents").where(F.col("lang") != "en").select("doc_id", "lang")
    return R.union_rows(docs, table(spark, sf, "labels").where(F.col("toxic") == 1).select("doc_id", "quality"))


# --- gates and reports ------------------------------------------------------------------
_SUPPORT = """
SELECT s.scope, l.head, l.label, coalesce(c.n, 0) AS n, CAST({bound} AS BIGINT) AS minimum, coalesce(c.n, 0) >= {bound} AS passed
FROM label_sets l, (SELECT unnest(['train', 'val', 'test']) AS scope) s
LEFT JOIN counted c ON c.split = s.scope AND c.head = l.head AND c.label = l.label"""
_COUNTED = """counted AS (
  SELECT split, head, label, count(*) AS n FROM (
    SELECT split, 'nivel_tecnico' AS head, nivel_tecnico AS label, s_nivel_tecnico AS sup FROM split_rows
    UNION ALL SELECT split, 'urgencia', urgencia, s_urgencia FROM split_rows
    UNION ALL SELECT split, 'emocion', emocion, s_emocion FROM split_rows
    UNION ALL SELECT split, 'dominio', dominio, s_dominio FROM split_rows) WHERE sup AND label IS NOT NULL GROUP BY 1, 2, 3
)"""
_BOUND_SPLIT = "(SELECT least(80, greatest(1, floor(count(*) * 0.0055::DOUBLE))) FROM final_rows)"
_BOUND_FULL = "(SELECT least(400, greatest(1, floor(count(*) * 0.05::DOUBLE))) FROM final_rows)"


@query(with_(FINAL, SPLIT, _COUNTED, LABEL_TABLE) + _SUPPORT.format(bound=_BOUND_SPLIT))
def support_gates(spark, sf):
    rows = split_rows(spark, sf)
    signatures = settle(G.label_signatures(rows, ["split"]), "signatures")
    total = signatures.agg(F.sum("n")).first()[0]
    counts = G.signature_label_counts(signatures, ["split"]).withColumnRenamed("split", "scope")
    return G.support_gates(counts, G.gate_thresholds(total)["split"], G.SPLITS)


_SYN = "fuente LIKE 'synthetic\\_%' ESCAPE '\\'"


@query(with_(FINAL, SPLIT, _COUNTED, LABEL_TABLE) + f""", dup AS (
  SELECT count(*) AS total, count(DISTINCT {sql_norm('texto')}) AS uniq FROM final_rows),
full_counts AS (SELECT head, label, CAST(sum(n) AS BIGINT) AS n FROM counted GROUP BY 1, 2),
full_gate AS (
  SELECT l.head || '/' || l.label AS name, coalesce(c.n, 0) AS n, {_BOUND_FULL} AS b, coalesce(c.n, 0) >= {_BOUND_FULL} AS ok
  FROM label_sets l LEFT JOIN full_counts c ON c.head = l.head AND c.label = l.label),
split_gate AS (SELECT scope || '/' || head || '/' || label AS name, n, minimum AS b, passed AS ok FROM ({_SUPPORT.format(bound=_BOUND_SPLIT)})),
mix AS (
  SELECT split, round(count(*) FILTER (WHERE {_SYN}) / count(*), 6) AS f, CASE WHEN split = 'train' THEN 0.70::DOUBLE ELSE 0.55::DOUBLE END AS b
  FROM split_rows GROUP BY 1),
gates AS (
  SELECT 'full' AS name, (SELECT bool_and(ok) FROM full_gate) AS ok
  UNION ALL SELECT 'splits', (SELECT bool_and(ok) FROM split_gate)
  UNION ALL SELECT 'source_mix', (SELECT bool_and(f <= b) FROM mix)
  UNION ALL SELECT 'duplicates', (SELECT total = uniq FROM dup))
SELECT section, name, CAST(value AS DOUBLE) AS value, CAST(bound AS DOUBLE) AS bound, passed FROM (
  SELECT 'total_rows' AS section, 'all' AS name, total AS value, NULL::DOUBLE AS bound, NULL::BOOLEAN AS passed FROM dup
  UNION ALL SELECT 'sources', fuente, count(*), NULL, NULL FROM final_rows GROUP BY 2
  UNION ALL SELECT 'counts', head || '/' || label, n, NULL, NULL FROM full_counts
  UNION ALL SELECT 'duplicates', 'total', total, NULL, NULL FROM dup
  UNION ALL SELECT 'duplicates', 'unique', uniq, NULL, NULL FROM dup
  UNION ALL SELECT 'duplicates', 'duplicates', total - uniq, NULL, NULL FROM dup
  UNION ALL SELECT 'source_mix', 'all', round(count(*) FILTER (WHERE {_SYN}) / count(*), 6), NULL, NULL FROM final_rows
  UNION ALL SELECT 'source_mix', split, f, NULL, NULL FROM mix
  UNION ALL SELECT 'thresholds', 'full', {_BOUND_FULL}, NULL, NULL
  UNION ALL SELECT 'thresholds', 'split', {_BOUND_SPLIT}, NULL, NULL
  UNION ALL SELECT 'gate_full', name, n, b, ok FROM full_gate
  UNION ALL SELECT 'gate_split', name, n, b, ok FROM split_gate
  UNION ALL SELECT 'gate_mix', split, f, b, f <= b FROM mix
  UNION ALL SELECT 'gates', name, NULL, NULL, ok FROM gates
  UNION ALL SELECT 'gates', 'all_pass', NULL, NULL, bool_and(ok) FROM gates)
""")
def quality_report(spark, sf):
    return G.quality_report(settle(split_rows(spark, sf), "split_rows"))


@query(with_(FINAL, SPLIT) + f"""
SELECT split, f AS fraction, b AS cap, f <= b AS passed FROM (
  SELECT split, round(count(*) FILTER (WHERE {_SYN}) / count(*), 6) AS f, CASE WHEN split = 'train' THEN 0.70::DOUBLE ELSE 0.55::DOUBLE END AS b
  FROM split_rows GROUP BY 1)
""")
def mix_gates(spark, sf):
    return G.mix_gates(C.synthetic_fraction(split_rows(spark, sf), ["split"]))


@query(with_(QUESTIONS, LABELED) + """, l AS (
  SELECT count(*) AS labeled_rows, count(DISTINCT question_id) AS unique_ids, count(*) FILTER (WHERE trim(body) = '') AS labeled_body_empty,
    count(*) AS schema_ok_rows, count(*) FILTER (WHERE urgencia = 'alta') AS high, count(*) FILTER (WHERE nivel_tecnico = 'avanzado') AS adv
  FROM labeled),
r AS (SELECT CAST(sum(n) AS BIGINT) AS raw_rows, CAST(sum(e) AS BIGINT) AS raw_body_empty, min(n) AS smallest FROM (
  SELECT domain, count(*) AS n, count(*) FILTER (WHERE trim(body) = '') AS e FROM questions GROUP BY 1)),
g AS (SELECT *,
  labeled_rows = raw_rows AS gate_rows_match_raw, unique_ids = labeled_rows AS gate_unique_question_ids,
  raw_body_empty = 0 AS gate_raw_body_non_empty, labeled_body_empty = 0 AS gate_labeled_body_non_empty,
  schema_ok_rows = labeled_rows AS gate_schema_coverage_100pct, high / labeled_rows * 100 >= 8.0 AS gate_urgencia_alta_min_pct,
  adv / labeled_rows * 100 >= 4.0 AS gate_nivel_avanzado_min_pct, smallest >= 5 AS gate_domain_floor,
  round(adv / labeled_rows * 100, 2) AS nivel_avanzado_pct, round(high / labeled_rows * 100, 2) AS urgencia_alta_pct FROM l, r)
SELECT * EXCLUDE (high, adv, smallest), gate_rows_match_raw AND gate_unique_question_ids AND gate_raw_body_non_empty AND gate_labeled_body_non_empty
  AND gate_schema_coverage_100pct AND gate_urgencia_alta_min_pct AND gate_nivel_avanzado_min_pct AND gate_domain_floor AS ready FROM g
""")
def labeling_report(spark, sf):
    return G.labeling_report(questions(spark, sf), labeled(spark, sf))


@query(with_(FINAL) + """
SELECT ord, s_dominio AND dominio = 'backend' AS backend, s_urgencia AND coalesce(urgencia, '') = 'alta' AS urgent,
  fuente LIKE 'synthetic%' AS synthetic FROM final_rows
""")
def label_predicates(spark, sf):
    rows = final_rows(spark, sf)
    return rows.select(
        "ord", L.has_label(rows, "dominio", "backend").alias("backend"),
        L.has_label(rows, "urgencia", "alta").alias("urgent"), L.is_synthetic("fuente").alias("synthetic"),
    )
