"""Text functions over documents, pages and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import fixed
from lectern import fixed_prompts as P
from lectern.functions import arrays as A
from lectern.functions import text as T
from lectern.operators.labeling import render_label_prompt
from lectern.workloads.base import (
    EMOTION_TERMS, LOW_TERMS, QUESTIONS, STRONG_A, STRONG_U, TAGS, WEAK_A, WEAK_U,
    WS, pick, q, query, questions, sql_any, sql_hits, sql_list, sql_map, sql_norm, sql_pick, sql_strip,
    sql_tokens, table, with_,
)


@query(f"""
SELECT doc_id, sha256(norm) AS norm_key, CAST(length(norm) AS INT) AS norm_length
FROM (SELECT doc_id, {sql_norm('text')} AS norm FROM documents)
""")
def normalize_text(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", T.norm_text("text").alias("norm"))
    return docs.select("doc_id", F.sha2("norm", 256).alias("norm_key"), F.length("norm").alias("norm_length"))


_LEAKS = {
    0: ("", "\nEtiquetas: nivel_tecnico: avanzado, urgencia: alta"),
    1: ("nivel_tecnico: avanzado | urgencia: baja\n\n", "\ntags: emocion: neutral\nresto"),
    2: ("etiquetas: dominio = backend\n", "\netiquetas: varias"),
    3: ("", "\nfin emocion=neutral urgencia:alta\n dominio: general"),
}


@query(f"""
SELECT doc_id, sha256(clean) AS clean_key, CAST(length(clean) AS INT) AS n_chars
FROM (SELECT doc_id, {sql_strip(f"replace(replace({sql_strip('text')}, chr(13) || chr(10), chr(10)), chr(13), chr(10))")} AS clean FROM documents)
""")
def strip_leaked_labels(spark, sf):
    docs = table(spark, sf, "documents")
    kind = F.col("doc_id") % 4
    leaked = F.concat(
        F.element_at(A.literal_map({k: v[0] for k, v in _LEAKS.items()}), kind.cast("int")),
        F.col("text"),
        F.element_at(A.literal_map({k: v[1] for k, v in _LEAKS.items()}), kind.cast("int")),
    )
    cleaned = docs.select("doc_id", T.strip_leaked_labels(leaked).alias("clean"))
    return cleaned.select("doc_id", F.sha2("clean", 256).alias("clean_key"), F.length("clean").alias("n_chars"))


_UNESCAPED = (
    "regexp_replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&quot;', '\"'), "
    "'&middot;', chr(183)), '&copy;', chr(169)), '&amp;?', '&', 'g')"
)


@query(f"""
SELECT page_id, sha256(plain) AS plain_key, CAST(length(plain) AS INT) AS plain_length
FROM (SELECT page_id, trim(regexp_replace({_UNESCAPED}, '{WS}+', ' ', 'g')) AS plain FROM pages)
""")
def html_to_text(spark, sf):
    plain = table(spark, sf, "pages").select("page_id", T.html_to_text("html").alias("plain"))
    return plain.select("page_id", F.sha2("plain", 256).alias("plain_key"), F.length("plain").alias("plain_length"))


@query("""
SELECT doc_id, sha256(folded) AS folded_key, CAST(length(folded) AS INT) AS folded_length
FROM (SELECT doc_id, strip_accents(lower(text)) AS folded FROM documents)
""")
def fold_text(spark, sf):
    folded = table(spark, sf, "documents").select("doc_id", T.fold("text").alias("folded"))
    return folded.select("doc_id", F.sha2("folded", 256).alias("folded_key"), F.length("folded").alias("folded_length"))


@query(f"""
SELECT doc_id, CAST(len(toks) AS INT) AS n_tokens, md5(array_to_string(toks, ' ')) AS tokens_key
FROM (SELECT doc_id, {sql_tokens('text')} AS toks FROM documents)
""")
def tokenize(spark, sf):
    toks = table(spark, sf, "documents").select("doc_id", T.tokens("text").alias("toks"))
    return toks.select("doc_id", F.size("toks").alias("n_tokens"), F.md5(F.array_join("toks", " ")).alias("tokens_key"))


@query(with_(QUESTIONS) + f"""
SELECT question_id, urgency_signal, advanced_signal, domain,
  CAST({sql_hits('lower(text)', fixed.URGENCY_TERMS)} AS INT) AS urgency_default
FROM questions
""")
def term_signals(spark, sf):
    return questions(spark, sf).select(
        "question_id", "urgency_signal", "advanced_signal", "domain",
        T.urgency_score("text").alias("urgency_default"),
    )


_FOLDED = "strip_accents(lower(text))"
_URGENT = f"({sql_any(_FOLDED, STRONG_U)} OR {sql_hits(_FOLDED, WEAK_U)} >= 2)"


@query(with_(QUESTIONS) + f"""
SELECT question_id, {_URGENT} AS urgent,
  ({sql_any(_FOLDED, STRONG_A)} OR {sql_hits(_FOLDED, WEAK_A)} >= 2 OR list_has_any(tags, {sql_list(fixed.ADVANCED_HINT_TAGS)})) AS advanced,
  ({sql_any(_FOLDED, LOW_TERMS)} AND NOT {_URGENT}) AS low
FROM questions
""")
def signal_flags(spark, sf):
    folded = questions(spark, sf).withColumn("f", T.fold("text"))
    return folded.select(
        "question_id",
        T.urgency_flag("f", STRONG_U, WEAK_U).alias("urgent"),
        T.advanced_flag("f", "tags", STRONG_A, WEAK_A).alias("advanced"),
        T.low_urgency_flag("f", LOW_TERMS, STRONG_U, WEAK_U).alias("low"),
    )


@query("SELECT doc_id, CASE " + " ".join(
    f"WHEN {sql_any('lower(text)', terms)} THEN {q(label)}" for label, terms in EMOTION_TERMS
) + " ELSE 'neutral' END AS emocion, CASE " + " ".join(
    f"WHEN {sql_any('lower(text)', terms)} THEN {q(label)}" for label, terms in fixed.EMOTION_RULES
) + " ELSE 'neutral' END AS emocion_default FROM documents")
def infer_emotion(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", T.infer_emotion("text", EMOTION_TERMS).alias("emocion"), T.infer_emotion("text").alias("emocion_default")
    )


_HEAD = "left(t, 320)"
_CUT_HEAD = f"CASE WHEN contains({_HEAD}, ' ') THEN regexp_extract({_HEAD}, '(?s)^(.*) ', 1) ELSE {_HEAD} END"
_CUT_TAIL = "CASE WHEN contains(right(t, 240), ' ') THEN regexp_extract(right(t, 240), '(?s)^[^ ]* (.*)$', 1) ELSE right(t, 240) END"
_SNIPPET = f"CASE WHEN length(t) <= 584 THEN t ELSE left({_CUT_HEAD} || {q(fixed.SNIPPET_MARK)} || {_CUT_TAIL}, 1400) END"


@query(f"""
SELECT doc_id, {_SNIPPET} AS snippet FROM (SELECT doc_id, {sql_strip('text')} AS t FROM documents)
""")
def body_snippet(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.snippet("text").alias("snippet"))


_IDS = "[k % 28, user_id % 31]"


@query(f"""
SELECT event_id, names[1] AS first_name, names[2] AS second_name,
  coalesce(list_filter({sql_list(fixed.EMOTION_PRIORITY)}, lambda p: list_contains(mapped, p))[1], 'neutral') AS emocion
FROM (
  SELECT *, [coalesce({sql_map(fixed.EMOTION_MAP)}[n], 'neutral') FOR n IN names] AS mapped
  FROM (
    SELECT event_id, [coalesce({sql_list(fixed.EMOTION_IDS)}[i + 1], 'unknown') FOR i IN ids] AS names
    FROM (
      SELECT event_id, CASE WHEN event_type = 'click' THEN [] ELSE {_IDS} END AS ids
      FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
    )
  )
)
""")
def map_emotions(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    text = F.when(F.col("event_type") == "click", "[]").otherwise(
        F.concat(F.lit("["), (k % 28).cast("string"), F.lit(", "), (F.col("user_id") % 31).cast("string"), F.lit("]"))
    )
    events = table(spark, sf, "events").select("event_id", text.alias("labels"))
    named = events.withColumn("names", A.map_ids(T.parse_int_list("labels")))
    return named.select(
        "event_id", F.get("names", F.lit(0)).alias("first_name"), F.get("names", F.lit(1)).alias("second_name"),
        A.pick_by_priority("names").alias("emocion"),
    )


_TAGS4 = (
    f"[{sql_pick(TAGS, 'n_chars')}, upper({sql_pick(TAGS, 'n_chars // 7')}), 'tag' || CAST(doc_id % 9 AS VARCHAR), "
    f"{sql_pick(TAGS, 'doc_id * 3 + n_chars')}, {sql_pick(TAGS, 'doc_id')}]"
)


@query(f"""
WITH tagged AS (SELECT doc_id, {_TAGS4} AS tags FROM documents),
votes AS (
  SELECT doc_id, {sql_map(fixed.TAG_DOMAIN)}[lower(tags[pos])] AS d, pos
  FROM (SELECT doc_id, tags, unnest(range(1, 6)) AS pos FROM tagged)
),
ranked AS (
  SELECT doc_id, d, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(pos)) AS rn
  FROM votes WHERE d IS NOT NULL GROUP BY doc_id, d
)
SELECT t.doc_id, coalesce(r.d, 'general') AS domain, {sql_map(fixed.DOMAIN_FINAL)}[coalesce(r.d, 'general')] AS final_domain
FROM tagged t LEFT JOIN ranked r ON t.doc_id = r.doc_id AND r.rn = 1
""")
def majority_domain(spark, sf):
    doc, n = F.col("doc_id"), F.col("n_chars")
    tags = F.array(
        pick(TAGS, n), F.upper(pick(TAGS, F.floor(n / 7))), F.concat(F.lit("tag"), (doc % 9).cast("string")),
        pick(TAGS, doc * 3 + n), pick(TAGS, doc),
    )
    voted = table(spark, sf, "documents").select("doc_id", A.majority_domain(tags).alias("domain"))
    return voted.withColumn("final_domain", A.map_value("domain", fixed.DOMAIN_FINAL, "general"))


def _sql_prompt(template: str, body: str) -> str:
    filled = template.replace("{{", "{").replace("}}", "}").replace("{taxonomy}", "T")
    filled = filled.replace("{emotions}", ", ".join(fixed.LABELS["emocion"]))
    sql = q(filled)
    for name, value in (("{title}", "title"), ("{body}", body), ("{tags}", "array_to_string(tags, ', ')")):
        before, after = sql.split(name)
        sql = f"{before}' || {value} || '{after}"
    return sql




@query(with_(QUESTIONS) + f"""
SELECT question_id, md5({_sql_prompt(P.LABEL_PROMPT, 'snip')}) AS label_prompt,
  md5({_sql_prompt(P.LABEL_EMOTION_PROMPT, 'snip')}) AS emotion_prompt,
  md5({_sql_prompt(P.BACKFILL_PROMPT, 'snip')}) AS backfill_prompt
FROM (SELECT *, {_SNIPPET} AS snip FROM (SELECT *, {sql_strip('body')} AS t FROM questions))
""")
def label_prompts(spark, sf):
    rows = questions(spark, sf)
    return rows.select(
        "question_id",
        F.md5(render_label_prompt(rows, "label")).alias("label_prompt"),
        F.md5(render_label_prompt(rows, "label_emotion", "T")).alias("emotion_prompt"),
        F.md5(render_label_prompt(rows, "backfill", "T")).alias("backfill_prompt"),
    )


@query("""
SELECT source, split_part(source_strategy, ':', 1) AS strategy, count(*) AS n
FROM (SELECT source, CASE doc_id % 3 WHEN 0 THEN 'tag:' WHEN 1 THEN 'urgency:' ELSE 'advanced:' END || lang AS source_strategy FROM documents)
GROUP BY 1, 2
""")
def strategy_counts(spark, sf):
    doc = F.col("doc_id")
    named = F.concat(F.when(doc % 3 == 0, "tag:").when(doc % 3 == 1, "urgency:").otherwise("advanced:"), "lang")
    rows = table(spark, sf, "documents").select("source", T.strategy_prefix(named).alias("strategy"))
    return rows.groupBy("source", "strategy").agg(F.count(F.lit(1)).alias("n"))
