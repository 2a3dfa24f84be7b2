"""Driver tables in the shapes the operators work on, each in Spark and as an SQL text.

A query is registered with the SQL that must give the same rows. SQL texts are assembled from
``WITH`` parts, so both sides start from the given tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions import arrays as A
from lectern.functions import text as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function name, with its SQL when it has one."""

    def register(fn):
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key!r} is registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- SQL fragments ----------------------------------------------------------------------
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TOKENS = r"[\p{L}\p{Nl}\p{No}]+"


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def sql_map(mapping) -> str:
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in mapping.items()) + "}"


def sql_norm(col: str) -> str:
    return f"trim(regexp_replace(lower({col}), '{WS}+', ' ', 'g'))"


def sql_strip(col: str) -> str:
    return f"regexp_replace({col}, '^{WS}+|{WS}+$', '', 'g')"


def sql_tokens(col: str) -> str:
    return f"regexp_extract_all(lower({col}), '{TOKENS}')"


def sql_hits(col: str, terms) -> str:
    return "(" + " + ".join(f"CAST(contains({col}, {q(t)}) AS INT)" for t in terms) + ")"


def sql_any(col: str, terms) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(t)})" for t in terms) + ")"


def sql_pick(items, position: str) -> str:
    return f"{sql_list(items)}[CAST(({position}) AS BIGINT) % {len(items)} + 1]"


def pick(items, position: Column) -> Column:
    return F.get(A.literal_array(items), (position % len(items)).cast("int"))


# The given texts are invented prose, so the term lists are fragments that occur in it.
STRONG_U, WEAK_U = ("schaft", "eauxaux"), ("tion", "oun", "lich")
STRONG_A, WEAK_A = ("ndandand", "mentment"), ("ing", "eau", "cion")
LOW_TERMS = ("the", "le ", "der ")
COUNT_U, COUNT_A = ("tion", "eau", "sch", "que"), ("ing", "und", "ment", "ado")
EMOTION_TERMS = (
    ("ansiedad", ("schaft", "eauxeaux")),
    ("confusion", ("ndand", "mentment")),
    ("frustracion", ("lichlich", "cioncion")),
    ("curiosidad", ("ouou", "erer")),
    ("motivacion", ("sch", "que")),
)
TAGS = tuple(fixed.TAG_DOMAIN)
TERMS = {
    "urgency": (STRONG_U, WEAK_U), "advanced": (STRONG_A, WEAK_A), "low": LOW_TERMS,
}

# --- final rows: documents with the labels that exist ------------------------------------
FINAL = f"""final_rows AS (
  SELECT d.doc_id AS ord, d.text AS texto,
    CASE WHEN CAST(substr(d.source, 4) AS INT) < 11 THEN 'synthetic_' || d.source ELSE d.source END AS fuente,
    CASE WHEN l.quality = 0 THEN 'principiante' WHEN l.quality = 1 AND d.doc_id % 3 = 0 THEN 'avanzado'
         WHEN l.quality = 1 THEN 'intermedio' END AS nivel_tecnico,
    CASE WHEN l.toxic = 1 THEN 'alta' WHEN l.toxic = 0 AND d.n_chars % 2 = 0 THEN 'baja'
         WHEN l.toxic = 0 THEN 'media' END AS urgencia,
    {sql_pick(fixed.LABELS['emocion'], 'd.doc_id * 7 + d.n_chars')} AS emocion,
    {sql_pick(fixed.LABELS['dominio'], 'd.n_chars')} AS dominio,
    l.quality IS NOT NULL AS s_nivel_tecnico, l.toxic IS NOT NULL AS s_urgencia, true AS s_emocion,
    d.doc_id % 5 <> 0 AS s_dominio
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""

FINAL_LONG = """long_rows AS (
  SELECT ord, fuente, 'nivel_tecnico' AS head, nivel_tecnico AS label, s_nivel_tecnico AS supervised FROM final_rows
  UNION ALL SELECT ord, fuente, 'urgencia', urgencia, s_urgencia FROM final_rows
  UNION ALL SELECT ord, fuente, 'emocion', emocion, s_emocion FROM final_rows
  UNION ALL SELECT ord, fuente, 'dominio', dominio, s_dominio FROM final_rows
)"""


def final_rows(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    number = F.substring("source", 4, 10).cast("int")
    quality, toxic, doc = F.col("quality"), F.col("toxic"), F.col("doc_id")
    return joined.select(
        doc.alias("ord"),
        F.col("text").alias("texto"),
        F.when(number < 11, F.concat(F.lit("synthetic_"), "source")).otherwise(F.col("source")).alias("fuente"),
        F.when(quality == 0, "principiante")
        .when((quality == 1) & (doc % 3 == 0), "avanzado")
        .when(quality == 1, "intermedio")
        .alias("nivel_tecnico"),
        F.when(toxic == 1, "alta")
        .when((toxic == 0) & (F.col("n_chars") % 2 == 0), "baja")
        .when(toxic == 0, "media")
        .alias("urgencia"),
        pick(fixed.LABELS["emocion"], doc * 7 + F.col("n_chars")).alias("emocion"),
        pick(fixed.LABELS["dominio"], F.col("n_chars")).alias("dominio"),
        F.struct(
            quality.isNotNull().alias("nivel_tecnico"),
            toxic.isNotNull().alias("urgencia"),
            F.lit(True).alias("emocion"),
            (doc % 5 != 0).alias("dominio"),
        ).alias("supervision"),
    )


SPLIT = """split_rows AS (
  SELECT *, CASE WHEN pos % 20 < 14 THEN 'train' WHEN pos % 20 < 17 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY md5('42|' || CAST(ord AS VARCHAR)), ord) - 1 AS pos FROM final_rows)
)"""

# --- questions: documents with tags, scores and signals ----------------------------------
QUESTIONS = f"""questions AS (
  SELECT *,
    CAST({sql_hits('lower(text)', COUNT_U)} AS INT) AS urgency_signal,
    CAST({sql_hits('lower(text)', COUNT_A)} + CAST(list_has_any(tags, {sql_list(fixed.ADVANCED_TAGS)}) AS INT) AS INT) AS advanced_signal,
    CASE WHEN d1 = d2 OR d1 = d3 THEN d1 WHEN d2 = d3 THEN d2 ELSE d1 END AS domain
  FROM (
    SELECT *, {sql_map(fixed.TAG_DOMAIN)}[tags[1]] AS d1, {sql_map(fixed.TAG_DOMAIN)}[tags[2]] AS d2,
      {sql_map(fixed.TAG_DOMAIN)}[tags[3]] AS d3
    FROM (
      SELECT doc_id AS question_id, doc_id AS ord, text, split_part(text, chr(10), 1) AS title, text AS body, lang,
        [{sql_pick(TAGS, 'n_chars')}, {sql_pick(TAGS, 'n_chars // 73')}, {sql_pick(TAGS, 'doc_id')}] AS tags,
        CAST(n_chars % 25 - 3 AS INT) AS score, 1600000000 + (doc_id * 7919) % 1000000 AS creation_date,
        CASE doc_id % 3 WHEN 0 THEN 'tag:' WHEN 1 THEN 'urgency:' ELSE 'advanced:' END || lang AS source_strategy
      FROM documents
    )
  )
)"""


def questions(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    doc, n = F.col("doc_id"), F.col("n_chars")
    base = docs.select(
        doc.alias("question_id"),
        doc.alias("ord"),
        "text",
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("body"),
        "lang",
        F.array(pick(TAGS, n), pick(TAGS, F.floor(n / 73)), pick(TAGS, doc)).alias("tags"),
        (n % 25 - 3).cast("int").alias("score"),
        (F.lit(1600000000) + (doc * 7919) % 1000000).alias("creation_date"),
        F.concat(
            F.when(doc % 3 == 0, "tag:").when(doc % 3 == 1, "urgency:").otherwise("advanced:"), "lang"
        ).alias("source_strategy"),
    )
    return base.withColumns(
        {
            "urgency_signal": T.urgency_score("text", COUNT_U),
            "advanced_signal": T.advanced_score("text", "tags", COUNT_A),
            "domain": A.majority_domain("tags"),
        }
    )


# --- labelled questions: rows with levels and urgencies as a model would have given them ---
LABELED = f"""labeled AS (
  SELECT ord, question_id, title, CASE WHEN question_id % 11 = 0 THEN '' ELSE body END AS body, tags, domain,
    {sql_pick(fixed.LABELS['nivel_tecnico'], 'question_id % 2')} AS nivel_tecnico,
    {sql_pick(fixed.LABELS['urgencia'], 'question_id % 2')} AS urgencia,
    CASE WHEN question_id % 3 = 0 THEN {sql_pick(fixed.LABELS['emocion'], 'question_id')} ELSE '' END AS emocion,
    CASE WHEN question_id % 4 = 0 THEN 'model_b' ELSE 'model_a' END AS model_used
  FROM questions
)"""
#: A labelling run that is not finished: every seventh question is still pending.
UNFINISHED = LABELED.replace("FROM questions", "FROM questions WHERE question_id % 7 <> 3")


def labeled(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("question_id")
    return questions(spark, sf).select(
        "ord", "question_id", "title",
        F.when(i % 11 == 0, "").otherwise(F.col("body")).alias("body"), "tags", "domain",
        pick(fixed.LABELS["nivel_tecnico"], i % 2).alias("nivel_tecnico"),
        pick(fixed.LABELS["urgencia"], i % 2).alias("urgencia"),
        F.when(i % 3 == 0, pick(fixed.LABELS["emocion"], i)).otherwise("").alias("emocion"),
        F.when(i % 4 == 0, "model_b").otherwise("model_a").alias("model_used"),
    )


def unfinished(spark: SparkSession, sf: str) -> DataFrame:
    return labeled(spark, sf).where(F.col("question_id") % 7 != 3)


# --- replies: three attempts per question, derived from the event table --------------------
REPLIES = f"""replies AS (
  SELECT event_id // 3 AS question_id, CAST(event_id % 3 + 1 AS INT) AS attempt, event_type,
    CASE event_type
      WHEN 'purchase' THEN '```json' || chr(10) || '{{"nivel_tecnico": "' || {sql_pick(('Avanzado', 'intermedio', ' principiante '), 'k')}
        || '", "urgencia": "' || {sql_pick(('alta', 'baja', 'MEDIA'), 'k // 3')} || '"}}' || chr(10) || '```'
      WHEN 'view' THEN 'Claro: {{"nivel_tecnico": "experto", "urgencia": "alta"}} listo'
      WHEN 'click' THEN '{{"nivel_tecnico": "avanzado", "urgencia": ' END AS reply,
    CASE event_type WHEN 'error' THEN '429 too many requests' WHEN 'signup' THEN 'connection refused' END AS error,
    {sql_pick(('avanzado', 'intermedio', 'principiante'), 'k')} AS want_level,
    {sql_pick(('alta', 'baja', 'media'), 'k // 3')} AS want_urgency
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
),
settled AS (
  SELECT *, CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'view' THEN 'schema_validation' WHEN 'click' THEN 'json_parse' ELSE 'error' END AS status
  FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY attempt) AS rn
    FROM replies WHERE NOT (event_type = 'error' AND attempt < 3)
  ) WHERE rn = 1
)"""


def replies(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    good = F.concat(
        F.lit('```json\n{"nivel_tecnico": "'), pick(("Avanzado", "intermedio", " principiante "), k),
        F.lit('", "urgencia": "'), pick(("alta", "baja", "MEDIA"), F.floor(k / 3)), F.lit('"}\n```'),
    )
    reply = (
        F.when(kind == "purchase", good)
        .when(kind == "view", 'Claro: {"nivel_tecnico": "experto", "urgencia": "alta"} listo')
        .when(kind == "click", '{"nivel_tecnico": "avanzado", "urgencia": ')
    )
    return events.select(
        F.floor(F.col("event_id") / 3).alias("question_id"),
        (F.col("event_id") % 3 + 1).cast("int").alias("attempt"),
        reply.alias("reply"),
        F.when(kind == "error", "429 too many requests").when(kind == "signup", "connection refused").alias("error"),
    )


# --- predictions: slices of the embeddings as logits of four heads, two views --------------
_SLICES = {"nivel_tecnico": (1, 3), "urgencia": (4, 3), "emocion": (7, 9), "dominio": (16, 8)}
_VIEW_STEP = 23


def _sql_slice(start: int, size: int) -> str:
    return f"CAST(embedding[{start}:{start + size - 1}] AS DOUBLE[])"


_SQL_TRUE = {
    "nivel_tecnico": "CASE WHEN vec_id % 7 = 0 THEN -100 ELSE label % 3 END",
    "urgencia": "(label // 3) % 3",
    "emocion": "label % 9",
    "dominio": "label % 8",
}
LOGITS = "logits AS (\n" + "\nUNION ALL\n".join(
    f"  SELECT vec_id AS row_id, '{h}' AS head, {v} AS view, {_sql_slice(s + v * _VIEW_STEP, n)} AS logits,\n"
    f"    CAST({_SQL_TRUE[h]} AS INT) AS y_true,\n"
    "    CASE vec_id % 4 WHEN 0 THEN 'synthetic_a' WHEN 1 THEN 'so_es' WHEN 2 THEN 'goemotions_es' ELSE 'synthetic_b' END AS fuente,\n"
    "    CASE WHEN vec_id % 3 = 0 THEN 'test' ELSE 'val' END AS split\n  FROM embeddings"
    for h, (s, n) in _SLICES.items()
    for v in (0, 1)
) + "\n)"
PREDICTIONS = LOGITS + """,
predictions AS (
  SELECT row_id, head, y_true, fuente, split, logits,
    CAST(list_position(logits, list_max(logits)) - 1 AS INT) AS y_pred
  FROM logits WHERE view = 0
)"""


def wide_logits(spark: SparkSession, sf: str, view: int = 0) -> DataFrame:
    """``row_id, fuente, split, logits_<head>, y_<head>``."""
    vec, label = F.col("vec_id"), F.col("label")
    truth = {
        "nivel_tecnico": F.when(vec % 7 == 0, fixed.IGNORE_INDEX).otherwise(label % 3),
        "urgencia": F.floor(label / 3).cast("int") % 3,
        "emocion": label % 9,
        "dominio": label % 8,
    }
    source = (
        F.when(vec % 4 == 0, "synthetic_a").when(vec % 4 == 1, "so_es").when(vec % 4 == 2, "goemotions_es").otherwise("synthetic_b")
    )
    as_double = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select(
        vec.alias("row_id"), source.alias("fuente"), F.when(vec % 3 == 0, "test").otherwise("val").alias("split"),
        *[F.slice(as_double, s + view * _VIEW_STEP, n).alias(f"logits_{h}") for h, (s, n) in _SLICES.items()],
        *[truth[h].cast("int").alias(f"y_{h}") for h in fixed.HEADS],
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """``row_id, fuente, split, head, logits, y_true, y_pred``."""
    cells = [
        F.struct(F.lit(h).alias("head"), F.col(f"logits_{h}").alias("logits"), F.col(f"y_{h}").alias("y_true"))
        for h in fixed.HEADS
    ]
    long = wide_logits(spark, sf).select("row_id", "fuente", "split", F.inline(F.array(*cells)))
    return long.withColumn("y_pred", A.argmax("logits"))


# --- turns: a user message and the assistant message after it ------------------------------
TURNS = """turns AS (
  SELECT u.conv_id, u.turn, u.text AS submitted_text, a.text AS llm_response,
    CASE WHEN a.text IS NULL THEN 'error' ELSE 'done' END AS llm_status
  FROM conversations u LEFT JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'
)"""


def turns(spark: SparkSession, sf: str) -> DataFrame:
    said = table(spark, sf, "conversations")
    answers = said.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("llm_response")
    )
    asked = said.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("submitted_text"))
    return asked.join(answers, ["conv_id", "turn"], "left").withColumn(
        "llm_status", F.when(F.col("llm_response").isNull(), "error").otherwise("done")
    )


# --- classified messages: labels and confidences of every user message ---------------------
CLASSIFIED = f"""classified AS (
  SELECT conv_id, turn, text AS pregunta,
    {sql_pick(fixed.LABELS['nivel_tecnico'], 'conv_id + turn')} AS nivel_tecnico,
    {sql_pick(fixed.LABELS['urgencia'], 'conv_id // 3 + turn')} AS urgencia,
    {sql_pick(fixed.LABELS['emocion'], 'conv_id + length(text)')} AS emocion,
    {sql_pick(fixed.LABELS['dominio'], 'length(text)')} AS dominio,
    CAST(length(text) % 101 AS DOUBLE) / 100 AS confianza,
    CAST(conv_id % 11 AS DOUBLE) / 10 AS conf_nivel_tecnico, CAST(turn % 5 AS DOUBLE) / 4 AS conf_urgencia,
    CASE WHEN conv_id % 2 = 0 THEN CAST(length(text) % 7 AS DOUBLE) / 7 END AS conf_emocion, 0.75::DOUBLE AS conf_dominio
  FROM conversations WHERE role = 'user'
)"""


def classified(spark: SparkSession, sf: str) -> DataFrame:
    said = table(spark, sf, "conversations").where(F.col("role") == "user")
    conv, turn, size = F.col("conv_id"), F.col("turn"), F.length("text")
    return said.select(
        "conv_id", "turn", F.col("text").alias("pregunta"),
        pick(fixed.LABELS["nivel_tecnico"], conv + turn).alias("nivel_tecnico"),
        pick(fixed.LABELS["urgencia"], F.floor(conv / 3) + turn).alias("urgencia"),
        pick(fixed.LABELS["emocion"], conv + size).alias("emocion"),
        pick(fixed.LABELS["dominio"], size).alias("dominio"),
        ((size % 101).cast("double") / 100).alias("confianza"),
        ((conv % 11).cast("double") / 10).alias("conf_nivel_tecnico"),
        ((turn % 5).cast("double") / 4).alias("conf_urgencia"),
        F.when(conv % 2 == 0, (size % 7).cast("double") / 7).alias("conf_emocion"),
        F.lit(0.75).alias("conf_dominio"),
    )


def r6(col: Column | str) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


