"""Vocabulary, features, metrics, scoring and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions import arrays as A
from lectern.functions import text as T
from lectern.operators import gates as G
from lectern.operators import linear_tables as LT
from lectern.operators import metrics as M
from lectern.operators import scoring as SC
from lectern.operators import vocab as V
from lectern.plans.scratch import settle
from lectern.workloads.base import (
    FINAL, FINAL_LONG, LOGITS, PREDICTIONS, final_rows, predictions, query, r6, sql_list, sql_tokens, table, wide_logits, with_,
)
from lectern.workloads.corpus import LABEL_TABLE

HEADS = fixed.HEADS

# --- vocabulary -------------------------------------------------------------------------
FREQ = f"""freq AS (SELECT word, count(*) AS freq FROM (SELECT unnest({sql_tokens('text')}) AS word FROM documents) GROUP BY 1)"""
VOCAB = f"""{FREQ},
vocab AS (
  SELECT word, CAST(row_number() OVER (ORDER BY freq DESC, word) + 1 AS INT) AS idx, freq FROM freq WHERE freq >= 2 QUALIFY idx <= 40001
  UNION ALL SELECT '<pad>', 0, 0 UNION ALL SELECT '<unk>', 1, 0
)"""


def docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.col("text").alias("texto"))


def vocab(spark, sf):
    return V.build_vocab(V.token_freq(docs(spark, sf)))


@query(with_(FREQ) + "SELECT word, freq FROM freq")
def token_freq(spark, sf):
    return V.token_freq(docs(spark, sf))


@query(with_(VOCAB) + "SELECT word, idx, freq FROM vocab")
def build_vocab(spark, sf):
    return vocab(spark, sf)


@query(with_(VOCAB) + f""", toks AS (SELECT doc_id, {sql_tokens('text')}[1:160] AS t FROM documents),
coded AS (
  SELECT doc_id, pos, coalesce(v.idx, 1) AS idx FROM (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM toks) x
  LEFT JOIN vocab v ON v.word = x.word)
SELECT t.doc_id AS ord, CAST(len(t.t) AS INT) AS n_ids, md5(coalesce(ids, '')) AS ids_key
FROM toks t LEFT JOIN (SELECT doc_id, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY pos) AS ids FROM coded GROUP BY 1) c USING (doc_id)
""")
def encode(spark, sf):
    coded = V.encode(docs(spark, sf), vocab(spark, sf))
    return coded.select("ord", F.size("ids").alias("n_ids"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_key"))


@query(with_(VOCAB) + f"""
SELECT item_id AS ord, count(*) AS n_tokens, count(*) FILTER (WHERE v.idx IS NULL) AS n_unknown,
  round(count(*) FILTER (WHERE v.idx IS NULL) / count(*), 6) AS oov_rate
FROM (SELECT item_id, unnest({sql_tokens('text')}) AS word FROM benchmark) b LEFT JOIN vocab v ON v.word = b.word GROUP BY 1
""")
def oov_rate(spark, sf):
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("ord"), F.col("text").alias("texto"))
    return V.oov_rate(V.token_table(items, vocab(spark, sf)), ["ord"]).withColumn("oov_rate", r6("oov_rate"))


@query(with_(f"""t AS (SELECT doc_id, {sql_tokens('text')} AS t, len({sql_tokens('text')}) AS n FROM documents),
views AS (
  SELECT doc_id, 0 AS view, t[1:160] AS w FROM t
  UNION ALL SELECT doc_id, 1, t[n - 159:n] FROM t WHERE n > 160
  UNION ALL SELECT doc_id, 2, list_concat(t[1:80], t[n - 79:n]) FROM t WHERE n > 160
  UNION ALL SELECT doc_id, 3, t[greatest(0, n // 2 - 80) + 1:greatest(0, n // 2 - 80) + 160] FROM t WHERE n > 320)""") + """
SELECT doc_id AS ord, CAST(view AS INT) AS view, CAST(len(w) AS INT) AS n_tokens, md5(array_to_string(w, ' ')) AS view_key FROM views
""")
def token_views(spark, sf):
    views = SC.view_rows(docs(spark, sf))
    return views.select("ord", "view", F.size("toks").alias("n_tokens"), F.md5(F.array_join("toks", " ")).alias("view_key"))


def _sql_uniform(position: str, draw: int) -> str:
    text = f"'42|' || CAST(idx AS VARCHAR) || '|' || CAST({position} AS VARCHAR) || '|{draw}'"
    return f"(CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT) + 1.0::DOUBLE) / {2**32 + 1}.0::DOUBLE"


_WORDS = f"""words AS (
  SELECT word, min(doc_id) AS first_doc FROM (SELECT doc_id, unnest({sql_tokens('text')}) AS word FROM documents) GROUP BY 1),
vectors AS (SELECT word, e.embedding AS vec FROM words w JOIN embeddings e ON e.vec_id = w.first_doc)"""


def word_vectors(spark, sf):
    """A vector for every word whose first document has an embedding."""
    words = docs(spark, sf).select("ord", F.explode(T.tokens("texto")).alias("word"))
    first = words.groupBy("word").agg(F.min("ord").alias("vec_id"))
    return first.join(table(spark, sf, "embeddings"), "vec_id").select("word", F.col("embedding").alias("vec"))


@query(with_(VOCAB, _WORDS) + f"""
SELECT idx, word, found, round(CAST(s AS DOUBLE), 5) AS vec_sum, round(CAST(f AS DOUBLE), 5) AS vec_first FROM (
  SELECT idx, word, found, list_sum([x::DOUBLE FOR x IN v]) AS s, v[1] AS f FROM (
    SELECT n.idx, n.word, vec IS NOT NULL AS found,
      CASE WHEN n.idx < 2 THEN [0.0::FLOAT FOR j IN range(64)] WHEN vec IS NOT NULL THEN vec
      ELSE [CAST(0.1 * sqrt(-2.0 * ln({_sql_uniform('j', 0)})) * cos(2.0 * pi() * {_sql_uniform('j', 1)}) AS FLOAT) FOR j IN range(64)] END AS v
    FROM vocab n LEFT JOIN vectors x ON x.word = n.word AND n.idx >= 2))
""")
def vector_alignment(spark, sf):
    aligned = V.align_vectors(vocab(spark, sf), word_vectors(spark, sf), 64)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return aligned.select(
        "idx", "word", "found", F.round(total, 5).alias("vec_sum"), F.round(F.get("vec", F.lit(0)).cast("double"), 5).alias("vec_first")
    )


@query(with_(VOCAB, _WORDS) + """
SELECT count(*) AS n_words, count(x.word) AS n_found, round((count(*) - count(x.word)) / count(*), 6) AS oov_rate
FROM vocab n LEFT JOIN vectors x ON x.word = n.word WHERE n.idx >= 2
""")
def vector_coverage(spark, sf):
    aligned = V.align_vectors(vocab(spark, sf), word_vectors(spark, sf), 64)
    return V.vector_coverage(aligned).withColumn("oov_rate", r6("oov_rate"))


_INDEX = """indexed AS (
  SELECT r.ord, r.head, CASE WHEN NOT supervised THEN -100 ELSE coalesce(l.idx, d.idx) END AS y_true
  FROM long_rows r LEFT JOIN label_sets l ON l.head = r.head AND l.label = r.label
  JOIN label_sets d ON d.head = r.head AND d.label = CASE r.head WHEN 'nivel_tecnico' THEN 'principiante' WHEN 'urgencia' THEN 'media' WHEN 'emocion' THEN 'neutral' ELSE 'general' END
)"""


@query(with_(FINAL, FINAL_LONG, LABEL_TABLE, _INDEX) + "SELECT ord, head, CAST(y_true AS INT) AS y_true FROM indexed")
def index_labels(spark, sf):
    return M.index_labels(final_rows(spark, sf))


@query(with_(FINAL, FINAL_LONG, LABEL_TABLE, _INDEX, VOCAB) + f""",
wide AS (
  SELECT ord, CAST(max(y_true) FILTER (WHERE head = 'nivel_tecnico') AS INT) AS y_nivel_tecnico, CAST(max(y_true) FILTER (WHERE head = 'urgencia') AS INT) AS y_urgencia,
    CAST(max(y_true) FILTER (WHERE head = 'emocion') AS INT) AS y_emocion, CAST(max(y_true) FILTER (WHERE head = 'dominio') AS INT) AS y_dominio
  FROM indexed GROUP BY 1),
toks AS (SELECT doc_id, {sql_tokens('text')}[1:160] AS t FROM documents),
sums AS (
  SELECT doc_id, CAST(sum(coalesce(v.idx, 1) * pos) AS BIGINT) AS ids_sum FROM (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM toks) x
  LEFT JOIN vocab v ON v.word = x.word GROUP BY 1)
SELECT w.*, CAST(160 AS INT) AS n_ids, coalesce(ids_sum, 0) AS ids_sum FROM wide w LEFT JOIN sums s ON s.doc_id = w.ord
""")
def feature_table(spark, sf):
    table_ = V.feature_table(final_rows(spark, sf), vocab(spark, sf))
    weighted = F.zip_with("ids", F.sequence(F.lit(1), F.size("ids")), lambda a, i: a.cast("long") * i)
    return table_.select(
        "ord", *[f"y_{h}" for h in HEADS], F.size("ids").alias("n_ids"),
        F.aggregate(weighted, F.lit(0).cast("long"), lambda a, x: a + x).alias("ids_sum"),
    )


# --- metrics ----------------------------------------------------------------------------
_SUMS = """hits AS (
  SELECT {by}head, cls, sum(tp) AS tp, sum(sup) AS sup, sum(pred) AS pred FROM (
    SELECT {by}head, y_true AS cls, CAST(y_true = y_pred AS INT) AS tp, 1 AS sup, 0 AS pred FROM {src} WHERE y_true <> -100
    UNION ALL SELECT {by}head, y_pred, 0, 0, 1 FROM {src} WHERE y_true <> -100) GROUP BY ALL)"""
_SCORES = """scores AS (
  SELECT {by}head, avg(2.0::DOUBLE * tp / (sup + pred)) AS macro, sum(tp) / sum(sup) AS acc FROM hits GROUP BY ALL)"""
_WIDE = ", ".join(
    f"round(coalesce(max({v}) FILTER (WHERE head = '{h}'), 0), 6) AS {n}_{h}"
    for h in HEADS
    for n, v in (("f1_macro", "macro"), ("f1_micro", "acc"), ("acc", "acc"))
)
_MEAN = "round((" + " + ".join(f"coalesce(max(macro) FILTER (WHERE head = '{h}'), 0)" for h in HEADS) + ") / 4, 6) AS f1_macro_mean"


def _sums(src: str = "predictions", by: str = "") -> str:
    return _SUMS.format(src=src, by=by) + ",\n" + _SCORES.format(by=by)


def _rounded(df, keep=()):
    return df.select(*keep, "n_rows", *[r6(c).alias(c) for c in (*M.WIDE, "f1_macro_mean")])


@query(with_(PREDICTIONS, LABEL_TABLE) + """
SELECT a.head, a.label AS true_label, b.label AS pred_label, count(p.row_id) AS n
FROM label_sets a JOIN label_sets b ON a.head = b.head
LEFT JOIN predictions p ON p.head = a.head AND p.y_true = a.idx AND p.y_pred = b.idx GROUP BY 1, 2, 3
""")
def confusion(spark, sf):
    return M.confusion(predictions(spark, sf)).withColumn("n", F.col("n").cast("long"))


@query(with_(PREDICTIONS, _sums(), LABEL_TABLE) + """
SELECT l.head, l.label, round(CASE WHEN pred > 0 THEN tp / pred ELSE 0 END, 6) AS precision, round(CASE WHEN sup > 0 THEN tp / sup ELSE 0 END, 6) AS recall,
  round(CASE WHEN sup + pred > 0 THEN 2.0::DOUBLE * tp / (sup + pred) ELSE 0 END, 6) AS f1, CAST(coalesce(sup, 0) AS BIGINT) AS support
FROM label_sets l LEFT JOIN hits h ON h.head = l.head AND h.cls = l.idx
""")
def per_class(spark, sf):
    out = M.per_class(predictions(spark, sf))
    return out.select("head", "label", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"), F.col("support").cast("long").alias("support"))


@query(with_(PREDICTIONS, _sums(by="split, ")) + f"""
SELECT split, (SELECT count(DISTINCT row_id) FROM predictions p WHERE p.split = s.split) AS n_rows, {_WIDE}, {_MEAN} FROM scores s GROUP BY 1
""")
def metrics(spark, sf):
    return _rounded(M.metrics(predictions(spark, sf), ["split"]), ["split"])


_BY_SOURCE = """sourced AS (
  SELECT row_id, head, y_true, y_pred, unnest([fuente, CASE WHEN fuente LIKE 'synthetic%' THEN '__synthetic__' ELSE '__real__' END]) AS source FROM predictions)"""


@query(with_(PREDICTIONS, _BY_SOURCE, _sums("sourced", "source, ")) + f"""
SELECT source, (SELECT count(DISTINCT row_id) FROM sourced p WHERE p.source = s.source) AS n_rows, {_WIDE}, {_MEAN} FROM scores s GROUP BY 1
""")
def metrics_by_source(spark, sf):
    return _rounded(M.metrics_by_source(predictions(spark, sf)), ["source"])


@query(with_(PREDICTIONS, _BY_SOURCE, _sums("sourced", "source, ")) + f""",
m AS (SELECT source, {_MEAN.replace('round((', '((', 1).replace(' / 4, 6)', ' / 4)')} FROM scores GROUP BY 1)
SELECT round(max(f1_macro_mean) FILTER (WHERE source = '__real__'), 6) AS real_f1_macro_mean,
  round(max(f1_macro_mean) FILTER (WHERE source = '__synthetic__'), 6) AS synthetic_f1_macro_mean FROM m
""")
def source_summary(spark, sf):
    summary = M.source_summary(M.metrics_by_source(predictions(spark, sf)))
    return summary.select(r6("real_f1_macro_mean").alias("real_f1_macro_mean"), r6("synthetic_f1_macro_mean").alias("synthetic_f1_macro_mean"))


_MAJORITY = """class_counts AS (SELECT head, y_true, count(*) AS n FROM predictions WHERE y_true <> -100 GROUP BY 1, 2),
majority AS (
  SELECT head, y_true AS majority, 2.0::DOUBLE * n / (total + n) / k AS f1_macro FROM (
    SELECT *, sum(n) OVER (PARTITION BY head) AS total, count(*) OVER (PARTITION BY head) AS k,
      row_number() OVER (PARTITION BY head ORDER BY n DESC, y_true) AS rn FROM class_counts) WHERE rn = 1)"""


@query(with_(PREDICTIONS, _MAJORITY) + "SELECT head, majority, round(f1_macro, 6) AS f1_macro FROM majority")
def majority_baseline(spark, sf):
    return M.majority_baseline(predictions(spark, sf)).withColumn("f1_macro", r6("f1_macro"))


@query(with_(FINAL, FINAL_LONG, LABEL_TABLE, _INDEX) + """, c AS (
  SELECT head, y_true, count(*) AS n, sum(count(*)) OVER (PARTITION BY head) AS total, count(*) OVER (PARTITION BY head) AS k FROM indexed WHERE y_true <> -100 GROUP BY 1, 2)
SELECT l.head, l.label, CAST(l.idx AS INT) AS idx, coalesce(n, 0) AS n, round(coalesce(total / (k * n), 1.0), 6) AS weight
FROM label_sets l LEFT JOIN c ON c.head = l.head AND c.y_true = l.idx
""")
def class_weights(spark, sf):
    return M.class_weights(M.index_labels(final_rows(spark, sf))).withColumn("weight", r6("weight"))


_NAMES = [f"{s}_{h}" for h in HEADS for s in ("t", "p")]
_JOINT = ", ".join(
    f"coalesce(max(y_true) FILTER (WHERE head = '{h}'), -100) AS t_{h}, coalesce(max(y_pred) FILTER (WHERE head = '{h}'), 0) AS p_{h}" for h in HEADS
)
_THRESHOLDS = "[" + ", ".join("[" + ", ".join(f"{x!r}::DOUBLE" for x in M.poisson_thresholds(k)) + "]" for k in range(M.EXACT_POWERS)) + "]"
_QUANTILES = "[" + ", ".join(f"{x!r}::DOUBLE" for x in M.normal_quantiles()) + "]"
_BOOT = f"""joint AS (SELECT {', '.join(_NAMES)}, count(*) AS n FROM (SELECT row_id, {_JOINT} FROM predictions GROUP BY 1) GROUP BY ALL),
hashed AS (SELECT *, sha256(concat_ws('|', {', '.join(_NAMES)}, 42, r)) AS h FROM (SELECT *, unnest(range(500)) AS r FROM joint)),
drawn AS (SELECT *, list_sum(list_transform(range(32), lambda k: CASE WHEN (n >> k) & 1 = 0 THEN 0
  WHEN k < {M.EXACT_POWERS} THEN len(list_filter({_THRESHOLDS}[k + 1], lambda c: c <= (('0x' || substr(h, CAST(2 * k + 1 AS INT), 2))::INT + 0.5::DOUBLE) / 256))
  ELSE CAST(floor(pow(2.0::DOUBLE, k) + sqrt(pow(2.0::DOUBLE, k)) * {_QUANTILES}[('0x' || substr(h, CAST(2 * k + 1 AS INT), 2))::INT + 1] + 0.5) AS BIGINT) END)) AS w FROM hashed),
sides AS ({' UNION ALL '.join(f"SELECT r, '{h}' AS head, t_{h} AS t, p_{h} AS p, w FROM drawn WHERE w > 0 AND t_{h} <> -100" for h in HEADS)}),
classed AS (SELECT r, head, cls, sum(tp) AS tp, sum(s) AS s FROM (
  SELECT r, head, t AS cls, CASE WHEN t = p THEN w ELSE 0 END AS tp, w AS s FROM sides UNION ALL SELECT r, head, p, 0, w FROM sides) GROUP BY ALL),
per AS (SELECT r, sum(macro) / 4 AS v FROM (SELECT r, head, avg(2.0::DOUBLE * tp / s) AS macro FROM classed GROUP BY ALL) GROUP BY 1)"""


@query(with_(PREDICTIONS, _BOOT) + """
SELECT count(*) AS n_boot, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.025), 6) AS ci95_low, round(quantile_cont(v, 0.975), 6) AS ci95_high FROM per
""")
def bootstrap_interval(spark, sf):
    out = M.bootstrap_f1(predictions(spark, sf))
    return out.select("n_boot", *[r6(c).alias(c) for c in ("mean", "std", "ci95_low", "ci95_high")])


_NLL = "-(logits[y_true + 1] - list_max(logits) - ln(list_sum([exp(x - list_max(logits)) FOR x IN logits])))"


@query(with_(PREDICTIONS, LABEL_TABLE) + f""", c AS (
  SELECT head, y_true, count(*) AS n, sum(count(*)) OVER (PARTITION BY head) AS total, count(*) OVER (PARTITION BY head) AS k FROM predictions WHERE y_true <> -100 GROUP BY 1, 2),
s AS (SELECT p.head, total / (k * n) AS w, {_NLL.replace('logits', 'p.logits').replace('y_true', 'p.y_true')} AS nll FROM predictions p JOIN c USING (head, y_true))
SELECT head, count(*) AS n_rows, round(avg(nll), 6) AS mean_nll, round(sum(w * nll) / sum(w), 6) AS weighted_nll FROM s GROUP BY 1
""")
def mean_loss(spark, sf):
    rows = predictions(spark, sf)
    plain = M.mean_nll(rows)
    weighted = M.mean_nll(rows, M.class_weights(rows)).select("head", F.col("mean_nll").alias("weighted_nll"))
    return plain.join(weighted, "head").select("head", "n_rows", r6("mean_nll").alias("mean_nll"), r6("weighted_nll").alias("weighted_nll"))


@query(with_(LOGITS) + """
SELECT a.head, count(*) AS n_rows, round(max(list_max([abs(a.logits[i] - b.logits[i]) FOR i IN range(1, len(a.logits) + 1)])), 6) AS max_diff,
  count(*) FILTER (WHERE NOT list_bool_and([abs(a.logits[i] - b.logits[i]) <= 0.05 + 0.5 * abs(b.logits[i]) FOR i IN range(1, len(a.logits) + 1)])) AS n_outside
FROM logits a JOIN logits b ON a.row_id = b.row_id AND a.head = b.head AND a.view = 0 AND b.view = 1 GROUP BY 1
""")
def score_parity(spark, sf):
    left, right = (SC.logits_long(wide_logits(spark, sf, v)) for v in (0, 1))
    out = M.parity(left, right, rtol=0.5, atol=0.05)
    return out.withColumn("max_diff", r6("max_diff"))


@query(with_(PREDICTIONS, _sums(by="split, "), """val_counts AS (SELECT head, y_true, count(*) AS n FROM predictions WHERE y_true <> -100 AND split = 'test' GROUP BY 1, 2),
base AS (
  SELECT head, 2.0::DOUBLE * n / (total + n) / k AS b FROM (
    SELECT *, sum(n) OVER (PARTITION BY head) AS total, count(*) OVER (PARTITION BY head) AS k, row_number() OVER (PARTITION BY head ORDER BY n DESC, y_true) AS rn FROM val_counts) WHERE rn = 1)""") + """,
v AS (SELECT head, macro FROM scores WHERE split = 'val'), t AS (SELECT head, macro FROM scores WHERE split = 'test')
SELECT 'threshold' AS section, head AS name, round(macro, 6) AS value, CASE head WHEN 'nivel_tecnico' THEN 0.42::DOUBLE WHEN 'urgencia' THEN 0.55 WHEN 'emocion' THEN 0.26 ELSE 0.18 END AS bound,
  macro >= CASE head WHEN 'nivel_tecnico' THEN 0.42 WHEN 'urgencia' THEN 0.55 WHEN 'emocion' THEN 0.26 ELSE 0.18 END AS passed FROM v
UNION ALL SELECT 'threshold', 'f1_macro_mean', round(avg(macro), 6), 0.38::DOUBLE, avg(macro) >= 0.38 FROM v
UNION ALL SELECT 'majority', head, round(macro, 6), round(b, 6), macro > b FROM v JOIN base USING (head)
UNION ALL SELECT 'overfit', v.head, round(t.macro - v.macro, 6), 0.15::DOUBLE, t.macro - v.macro <= 0.15 FROM v JOIN t USING (head) WHERE v.head IN ('nivel_tecnico', 'urgencia')
""")
def done_report(spark, sf):
    rows = predictions(spark, sf)
    val, test = (rows.where(F.col("split") == s) for s in ("val", "test"))
    report = G.done_report(M.metrics(val), M.majority_baseline(test), M.metrics(test))
    return report.select("section", "name", r6("value").alias("value"), r6("bound").alias("bound"), "passed")


@query(with_("""daily AS (SELECT event_type AS run, CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INT) AS epoch, avg(value) AS score FROM events GROUP BY 1, 2),
marked AS (
  SELECT *, row_number() OVER w AS n, score > greatest(coalesce(max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1), -1) AS up
  FROM daily WINDOW w AS (PARTITION BY run ORDER BY epoch)),
stale AS (SELECT *, n - coalesce(max(CASE WHEN up THEN n END) OVER (PARTITION BY run ORDER BY epoch), 0) AS stale FROM marked),
stops AS (SELECT run, min(n) FILTER (WHERE stale >= 4) AS stop FROM stale GROUP BY 1)""") + """
SELECT run, (max({'n': n, 'e': epoch}) FILTER (WHERE up)).e AS best_epoch, round(max(score) FILTER (WHERE up), 6) AS best_score,
  max(epoch) AS last_epoch, any_value(stop) IS NOT NULL AS stopped
FROM stale JOIN stops USING (run) WHERE stop IS NULL OR n <= stop GROUP BY 1
""")
def early_stop(spark, sf):
    events = table(spark, sf, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1
    daily = events.groupBy(F.col("event_type").alias("run"), day.alias("epoch")).agg(F.avg("value").alias("score"))
    return M.early_stop(daily, "score", 4, ["run"]).withColumn("best_score", r6("best_score"))


@query("""
SELECT run, epoch, round(CASE WHEN r IS NULL THEN m ELSE 0.70 * r + 0.30 * m END, 6) AS composite, round(coalesce(r, m), 6) AS real_score, round(m, 6) AS mixed
FROM (SELECT user_id AS run, CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INT) AS epoch, avg(value) AS m, avg(value) FILTER (WHERE event_type = 'purchase') AS r FROM events GROUP BY 1, 2)
""")
def checkpoint_metric(spark, sf):
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1
    daily = table(spark, sf, "events").groupBy(F.col("user_id").alias("run"), day.alias("epoch")).agg(
        F.avg("value").alias("m"), F.avg(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("r")
    )
    return daily.select(
        "run", "epoch",
        r6(M.checkpoint_metric("m", "r", "composite_f1_macro_mean")).alias("composite"),
        r6(M.checkpoint_metric("m", "r", "real_f1_macro_mean")).alias("real_score"),
        r6(M.checkpoint_metric("m", "r")).alias("mixed"),
    )


@query("""
SELECT epoch, round(a, 6) AS train_loss, round(b, 6) AS val_loss, round((a + b + 2 * m) / 4, 6) AS train_acc, round((m + 3 * a) / 4, 6) AS val_acc, round(m, 6) AS val_f1, round(r, 6) AS real_f1
FROM (SELECT CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INT) AS epoch, avg(value) AS m, avg(value) FILTER (WHERE event_type = 'click') AS a,
  avg(value) FILTER (WHERE event_type = 'view') AS b, avg(value) FILTER (WHERE event_type = 'purchase') AS r FROM events GROUP BY 1)
""")
def learning_curves(spark, sf):
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1

    def of(kind):
        return F.avg(F.when(F.col("event_type") == kind, F.col("value")))

    daily = table(spark, sf, "events").groupBy(day.alias("epoch")).agg(
        F.avg("value").alias("m"), of("click").alias("train_loss"), of("view").alias("val_loss"), of("purchase").alias("real_f1")
    )
    acc = [F.lit(f"acc_{h}") for h in HEADS]
    history = daily.select(
        "epoch", "train_loss", "val_loss", "real_f1",
        F.create_map(acc[0], F.col("train_loss"), acc[1], F.col("val_loss"), acc[2], F.col("m"), acc[3], F.col("m")).alias("metrics_train"),
        F.create_map(
            acc[0], F.col("m"), acc[1], F.col("train_loss"), acc[2], F.col("train_loss"), acc[3], F.col("train_loss"),
            F.lit("f1_macro_mean"), F.col("m"),
        ).alias("metrics_val"),
    )
    out = M.curves(history)
    return out.select("epoch", *[r6(c).alias(c) for c in out.columns if c != "epoch"])


@query(with_(PREDICTIONS) + """
SELECT section, count(*) AS n FROM (
  SELECT 'metrics' AS section FROM range(14) UNION ALL SELECT 'per_class' FROM range(92)
  UNION ALL SELECT 'confusion' FROM range(163) UNION ALL SELECT 'per_source' FROM (SELECT unnest([1, 2]), fuente FROM predictions GROUP BY fuente)) GROUP BY 1
""")
def diagnosis_sections(spark, sf):
    return M.diagnose(predictions(spark, sf)).groupBy("section").agg(F.count(F.lit(1)).alias("n"))


@query()
def diagnosis(spark, sf):
    """The whole diagnosis report (its parts are checked one by one under their own names)."""
    return M.diagnose(predictions(spark, sf))


# --- scoring ----------------------------------------------------------------------------
_SOFT = """soft AS (
  SELECT row_id, head, view, CAST(list_position(logits, list_max(logits)) AS INT) AS i, 1.0 / list_sum([exp(x - list_max(logits)) FOR x IN logits]) AS conf FROM logits)"""
_NAME = "CASE head " + " ".join(f"WHEN '{h}' THEN {sql_list(fixed.LABELS[h])}[i]" for h in HEADS) + " END"
_DECODED = f"""named AS (SELECT *, {_NAME} AS label FROM soft WHERE view = 0),
decoded AS (
  SELECT row_id, {', '.join(f"max(label) FILTER (WHERE head = '{h}') AS {h}, max(conf) FILTER (WHERE head = '{h}') AS conf_{h}" for h in HEADS)},
    exp(avg(ln(conf))) AS confianza, min(conf) AS min_head FROM named GROUP BY 1)"""


@query(with_(LOGITS, _SOFT, _DECODED) + "SELECT row_id, " + ", ".join(f"{h}, round(conf_{h}, 6) AS conf_{h}" for h in HEADS) + ", round(confianza, 6) AS confianza FROM decoded")
def decode_logits(spark, sf):
    out = SC.decode_logits(wide_logits(spark, sf))
    return out.select("row_id", *HEADS, *[r6(f"conf_{h}").alias(f"conf_{h}") for h in HEADS], r6("confianza").alias("confianza"))


def both_views(spark, sf):
    parts = [SC.logits_long(wide_logits(spark, sf, v)).withColumn("view", F.lit(v)) for v in (0, 1)]
    return parts[0].unionByName(parts[1])


@query(with_(LOGITS) + """
SELECT a.row_id, a.head, round((a.logits[1] + b.logits[1]) / 2, 6) AS first_logit, round(list_sum([(a.logits[i] + b.logits[i]) / 2 FOR i IN range(1, len(a.logits) + 1)]), 6) AS logit_sum
FROM logits a JOIN logits b ON a.row_id = b.row_id AND a.head = b.head AND a.view = 0 AND b.view = 1
""")
def average_views(spark, sf):
    out = SC.average_views(both_views(spark, sf))
    return out.select(
        "row_id", "head", F.round(F.get("logits", F.lit(0)), 6).alias("first_logit"),
        F.round(F.aggregate("logits", F.lit(0.0), lambda a, x: a + x), 6).alias("logit_sum"),
    )


_GRID = ", ".join(f"({v}::DOUBLE)" for v in fixed.BIAS_GRID)


@query(with_(PREDICTIONS, f"grid(bias) AS (VALUES {_GRID})", """trial AS (
  SELECT head, bias, y_true, CAST(list_position(l, list_max(l)) - 1 AS INT) AS y_pred FROM (
    SELECT head, bias, y_true, [CASE WHEN i = 3 THEN logits[i] + bias ELSE logits[i] END FOR i IN range(1, len(logits) + 1)] AS l FROM predictions, grid WHERE y_true <> -100))""",
    _sums("trial", "bias, ")) + "SELECT head, bias, round(macro, 6) AS f1_macro FROM scores")
def bias_trials(spark, sf):
    return SC.bias_trials(predictions(spark, sf), 2).withColumn("f1_macro", r6("f1_macro"))


@query()
def bias_calibration(spark, sf):
    """Fitted biases per head and class (checked against a plain loop in the tests)."""
    rows = predictions(spark, sf).where(F.col("split") == "val")
    found = SC.fit_bias(rows)
    flat = [(h, fixed.LABELS[h][i], float(b)) for h in HEADS for i, b in enumerate(found[h])]
    return spark.createDataFrame(flat, "head string, label string, bias double")


_BIASES = {h: [round(0.05 * ((i * 7) % 5 - 2), 2) for i in range(len(fixed.LABELS[h]))] for h in HEADS}
_SQL_BIAS = "CASE head " + " ".join(f"WHEN '{h}' THEN [{', '.join(f'{b}::DOUBLE' for b in v)}]" for h, v in _BIASES.items()) + " END"


@query(with_(PREDICTIONS, f"""staged AS (
  SELECT split, 'baseline' AS stage, head, y_true, y_pred FROM predictions
  UNION ALL SELECT split, 'calibrated', head, y_true, CAST(list_position(l, list_max(l)) - 1 AS INT) FROM (
    SELECT *, [logits[i] + ({_SQL_BIAS})[i] FOR i IN range(1, len(logits) + 1)] AS l FROM predictions))""", _sums("staged", "split, stage, ")) + "SELECT split, stage, " + ", ".join(
    f"round(coalesce(max(macro) FILTER (WHERE head = '{h}'), 0), 6) AS f1_macro_{h}" for h in HEADS) + f", {_MEAN} FROM scores GROUP BY 1, 2")
def calibration_report(spark, sf):
    out = SC.calibration_report(predictions(spark, sf), _BIASES)
    return out.select("split", "stage", *[r6(c).alias(c) for c in out.columns if c.startswith("f1")])


@query(with_(LOGITS, _SOFT, _DECODED) + f"""
SELECT row_id, dominio = want AS domain_ok, confianza >= 0.2 AS confidence_ok, min_head >= 0.13 AS head_ok, dominio = want AND confianza >= 0.2 AND min_head >= 0.13 AS passed
FROM decoded d JOIN (SELECT vec_id, {sql_list(fixed.LABELS['dominio'])}[label % 8 + 1] AS want FROM embeddings) e ON e.vec_id = d.row_id
""")
def validate_examples(spark, sf):
    wide = wide_logits(spark, sf)
    want = F.get(A.literal_array(fixed.LABELS["dominio"]), F.col("y_dominio")).alias("expected_domain")
    decoded = SC.decode_logits(wide.select("*", want), ["row_id", "expected_domain"])
    return SC.validate_examples(decoded, min_confidence=0.2, min_head=0.13).select(
        "row_id", "domain_ok", "confidence_ok", "head_ok", "passed"
    )


@query()
def fit_and_score(spark, sf):
    """Linear heads fitted on the train rows and scored on the rest, as metrics per split."""
    from lectern.workloads.corpus import split_rows

    rows = settle(split_rows(spark, sf), "rows")
    models = SC.fit_heads(rows.where(F.col("split") == "train"))
    held = rows.where(F.col("split") != "train")
    scored = SC.logits_long(SC.score(held, models, ["ord", "split"]), ["ord", "split"])
    guess = SC.with_prediction(scored).select("ord", "split", "head", "y_pred")
    truth = M.index_labels(held)
    return M.metrics(M.join_predictions(truth, guess, "ord"), ["split"])


@query()
def view_scores(spark, sf):
    """Scores averaged over the views of every document."""
    from lectern.workloads.corpus import split_rows

    rows = settle(split_rows(spark, sf), "rows")
    models = SC.fit_heads(rows.where(F.col("split") == "train"))
    scored = SC.with_prediction(SC.score_views(rows, models))
    return scored.select("ord", "head", "y_pred")


# --- linear heads as a table ----------------------------------------------------------------
_SLOT = "('0x' || substr(md5(word), 1, 4))::INT"
_DEFAULTS = " ".join(f"WHEN '{h}' THEN '{fixed.HEAD_DEFAULT[h]}'" for h in HEADS)
_TABLE_MODEL = f"""marked AS (
  SELECT r.ord, l.head, l.idx AS cls FROM long_rows r JOIN label_sets l ON l.head = r.head AND l.label = coalesce(r.label, CASE r.head {_DEFAULTS} END) WHERE r.supervised),
worded AS (SELECT ord, {_SLOT} AS slot, count(*) AS n FROM (SELECT ord, unnest({sql_tokens("coalesce(texto, '')")}) AS word FROM final_rows) GROUP BY 1, 2),
shares AS (SELECT l.head, l.idx AS cls, ln((count(m.ord) + 0.5::DOUBLE) / (sum(count(m.ord)) OVER (PARTITION BY l.head) + 0.5 * count(*) OVER (PARTITION BY l.head))) AS share
  FROM label_sets l LEFT JOIN marked m ON m.head = l.head AND m.cls = l.idx GROUP BY 1, 2),
seen AS (SELECT head, cls, slot, sum(n) AS n FROM marked JOIN worded USING (ord) GROUP BY ALL),
total AS (SELECT l.head, l.idx AS cls, coalesce(sum(s.n), 0) + 32768.0::DOUBLE AS size FROM label_sets l LEFT JOIN seen s ON s.head = l.head AND s.cls = l.idx GROUP BY 1, 2),
weights AS (SELECT head, cls, slot, ln((n + 0.5::DOUBLE) / 0.5) AS w FROM seen),
edges AS (SELECT head, cls, share, ln(0.5::DOUBLE / size) AS unseen FROM shares JOIN total USING (head, cls))"""


def _table_scores(rows: str, key: str) -> str:
    """Logits of token counts ``key, slot, n`` of ``rows``."""
    return f"""sized AS (SELECT {key}, coalesce(sum(n), 0) AS size FROM {rows} GROUP BY ALL),
hit AS (SELECT {key}, head, cls, sum(n * w) AS s FROM {rows} JOIN weights USING (slot) GROUP BY ALL),
logit AS (SELECT {key}, e.head, e.cls, share + size * unseen + coalesce(s, 0) AS v FROM sized CROSS JOIN edges e LEFT JOIN hit USING ({key}, head, cls))"""


_TABLE_OUT = """
SELECT ord, head, CAST(arg_max(cls, v) AS INT) AS y_pred, round(max(v), 3) AS top FROM {src} GROUP BY 1, 2
"""


def _top(scored):
    long = SC.logits_long(scored, ["ord"])
    return long.select("ord", "head", A.argmax("logits").alias("y_pred"), F.round(F.array_max("logits"), 3).alias("top"))


@query(with_(FINAL, FINAL_LONG, LABEL_TABLE, _TABLE_MODEL, "counted AS (SELECT f.ord, w.slot, w.n FROM final_rows f LEFT JOIN worded w USING (ord))", _table_scores("counted", "ord")) + _TABLE_OUT.format(src="logit"))
def table_scores(spark, sf):
    """Linear heads fitted by counting on all rows, applied to all texts."""
    rows = final_rows(spark, sf)
    return _top(LT.score_texts(rows, settle(LT.fit_table(rows), "model")))


@query(with_(FINAL, FINAL_LONG, LABEL_TABLE, _TABLE_MODEL, f"""t AS (SELECT ord, {sql_tokens("coalesce(texto, '')")} AS t, len({sql_tokens("coalesce(texto, '')")}) AS n FROM final_rows),
windows AS (
  SELECT ord, 0 AS view, t[1:160] AS w FROM t
  UNION ALL SELECT ord, 1, t[n - 159:n] FROM t WHERE n > 160
  UNION ALL SELECT ord, 2, list_concat(t[1:80], t[n - 79:n]) FROM t WHERE n > 160
  UNION ALL SELECT ord, 3, t[greatest(0, n // 2 - 80) + 1:greatest(0, n // 2 - 80) + 160] FROM t WHERE n > 320),
counted AS (SELECT ord, view, slot, count(slot) AS n FROM (
  SELECT ord, view, {_SLOT} AS slot FROM (SELECT ord, view, unnest(CASE WHEN len(w) = 0 THEN [NULL] ELSE w END) AS word FROM windows)) GROUP BY ALL)""",
    _table_scores("counted", "ord, view"), "mean AS (SELECT ord, head, cls, avg(v) AS v FROM logit GROUP BY ALL)") + _TABLE_OUT.format(src="mean"))
def table_view_scores(spark, sf):
    """The same heads over the windows of every text, averaged."""
    rows = final_rows(spark, sf)
    return _top(LT.score_text_views(rows, settle(LT.fit_table(rows), "model")))
