"""Token streams: frames of the assistant messages, static and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import fixed
from lectern.plans.scratch import scratch_path
from lectern.streaming import frames as X
from lectern.streaming import replies as RP
from lectern.streaming import sessions as SS
from lectern.workloads.base import PREDICTIONS, query, table, wide_logits, with_
from lectern.workloads.prompting import SYSTEM

_START = "2024-01-01 00:00:00"


def frames(spark, sf):
    """Frames of every assistant message: one per word, then usage, then the end mark; every
    fifth request breaks off with an error and every third has no usage."""
    said = table(spark, sf, "conversations").where(F.col("role") == "assistant")
    conv, turn = F.col("conv_id"), F.col("turn")
    started = F.lit(_START).cast("timestamp") + F.make_dt_interval(mins=(conv * 10 + turn).cast("int"))
    words = F.split("text", "(?<= )")
    replies = said.select(
        F.concat_ws("-", conv, turn).alias("request_id"), "conv_id", "turn", started.alias("started"), words.alias("words"),
        ((conv + turn) % 5 == 4).alias("fails"), ((conv + turn) % 3 != 0).alias("counts"),
    )
    n = F.size("words")

    def frame(payload):
        return F.concat(F.lit("data: "), payload, F.lit("\n\n"))

    tokens = F.transform("words", lambda w: frame(F.to_json(F.struct(w.alias("token")))))
    usage = F.struct(
        F.lit("usage").alias("type"), F.lit("p").alias("provider"), (F.col("turn") + 7).alias("tokens_input"),
        n.cast("long").alias("tokens_output"), F.lit(5).cast("long").alias("latency_ms"),
    )
    failure = F.struct(F.lit("service_unavailable").alias("error"), F.lit("corte").alias("detail"))
    tail = F.when(F.col("fails"), F.array(frame(F.to_json(failure)))).when(
        F.col("counts"), F.array(frame(F.to_json(usage)), F.lit("data: {bad json\n\n"), F.lit("data: [DONE]\n\n"))
    ).otherwise(F.array(F.lit(": ping\n\n"), F.lit("data: [DONE]\n\n")))
    laid = replies.select("request_id", "conv_id", "turn", "started", F.posexplode(F.concat(tokens, tail)).alias("seq", "frame"))
    ts = F.timestamp_micros(F.unix_micros("started") + F.col("seq") * 1000)
    return laid.select("request_id", F.col("seq").cast("long").alias("seq"), ts.alias("ts"), "frame")


_REQUESTS = f"""requests AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS request_id, conv_id, turn, text,
    len(regexp_extract_all(text, '[^ ]* |[^ ]+$')) AS n, (conv_id + turn) % 5 = 4 AS fails, (conv_id + turn) % 3 <> 0 AS counts,
    TIMESTAMP '{_START}' + to_minutes(conv_id * 10 + turn) AS started
  FROM conversations WHERE role = 'assistant'
),
assembled AS (
  SELECT request_id, CASE WHEN fails THEN 'error' ELSE 'done' END AS status, text AS response, CASE WHEN fails THEN 'corte' END AS error,
    CASE WHEN counts AND NOT fails THEN turn + 7 ELSE 0 END AS tokens_input, CASE WHEN counts AND NOT fails THEN n ELSE 0 END AS tokens_output,
    CASE WHEN fails OR counts THEN n ELSE n - 1 END AS latency_ms FROM requests
)"""


@query(with_(_REQUESTS) + """
SELECT kind, count(*) AS n_requests, CAST(sum(n) AS BIGINT) AS n_events FROM (
  SELECT 'token' AS kind, n FROM requests UNION ALL SELECT 'usage', 1 FROM requests WHERE counts AND NOT fails UNION ALL SELECT 'error', 1 FROM requests WHERE fails) GROUP BY 1
""")
def route_events(spark, sf):
    routed = X.route_events(X.parse_sse(frames(spark, sf)))
    per = routed.groupBy("request_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("kind").agg(F.count(F.lit(1)).alias("n_requests"), F.sum("n").alias("n_events"))


@query(with_(_REQUESTS) + "SELECT * FROM assembled")
def assemble_responses(spark, sf):
    return X.assemble_responses(X.route_events(X.parse_sse(frames(spark, sf)))).drop("started")


@query(with_(_REQUESTS) + "SELECT * FROM assembled")
def stream_assemble(spark, sf):
    """The same through a stream: frames from files, sessions closed by the watermark."""
    landed = frames(spark, sf)
    path = scratch_path(spark, "frames")
    landed.write.parquet(path)
    stream = spark.readStream.schema(landed.schema).parquet(path)
    last = landed.agg(F.max("ts")).first()[0]
    clocked = stream.unionByName(X.heartbeat(stream, str(last)))
    out = X.replay(X.assemble_responses(X.route_events(X.parse_sse(clocked))), "responses")
    return out.drop("started")


@query(with_(_REQUESTS) + """
SELECT * REPLACE (latency_ms + CASE WHEN split_part(request_id, '-', 1)::INT % 7 = 0 AND latency_ms >= 3 THEN 60000 ELSE 0 END AS latency_ms) FROM assembled
""")
def stream_replies(spark, sf):
    """Frames in four slices of time, out of order in each; every seventh conversation pauses for a minute within
    its replies. Each reply ends by its end mark or error and is one row."""
    whole = frames(spark, sf)
    pause = F.when((F.split("request_id", "-")[0].cast("int") % 7 == 0) & (F.col("seq") >= 3), 60_000_000).otherwise(0)
    paused = whole.withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + pause))
    path, span = X.land(paused, "ts", "reply_frames")
    stream = spark.readStream.schema(paused.schema).option("maxFilesPerTrigger", 16).parquet(path)
    return X.replay(RP.stream_replies(RP.numbered_events(stream), 120, f"{span} seconds"), "replies")


@query(with_(_REQUESTS) + "SELECT request_id, n AS n_tokens, tokens_input, tokens_output, latency_ms FROM requests JOIN assembled USING (request_id)")
def usage_records(spark, sf):
    return X.usage(X.route_events(X.parse_sse(frames(spark, sf))))


@query(with_(_REQUESTS) + """
SELECT request_id, seq, md5(frame) AS frame_key FROM (
  SELECT request_id, unnest(f) AS frame, CAST(unnest(range(len(f))) AS BIGINT) AS seq FROM (
    SELECT request_id, list_concat(list_transform(regexp_extract_all(text, '[^ ]* |[^ ]+$'), lambda w: 'data: {"token":' || CAST(to_json(w) AS VARCHAR) || '}'),
      CASE WHEN fails THEN ['data: {"error":"service_unavailable","detail":"corte"}']
        WHEN counts THEN ['data: {"type":"usage","provider":"p","tokens_input":' || CAST(turn + 7 AS VARCHAR) || ',"tokens_output":' || CAST(n AS VARCHAR) || ',"latency_ms":5}',
          'data: {bad json', 'data: [DONE]']
        ELSE [': ping', 'data: [DONE]'] END) AS f FROM requests))
""")
def reframe_chunks(spark, sf):
    """Frames cut into chunks of 7 characters that ignore frame borders, and put together again."""
    whole = frames(spark, sf)
    # pieces of a frame are numbered by (frame, piece); a border falls inside the frames
    size = 7
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor((F.length("frame") - 1) / size).cast("int")),
        lambda i: F.substring("frame", i * size + 1, F.lit(size)),
    )
    chunks = whole.select("request_id", "ts", F.col("seq").alias("f"), F.posexplode(pieces).alias("p", "chunk"))
    numbered = chunks.select("request_id", "ts", (F.col("f") * 1_000_000 + F.col("p")).alias("seq"), "chunk")
    return X.reframe(numbered).select("request_id", "seq", F.md5("frame").alias("frame_key"))


@query("""
SELECT event_id, 'data: {"error":"service_unavailable","detail":"fallo ' || CAST(user_id AS VARCHAR) || '"}' || chr(10) || chr(10) AS frame
FROM events WHERE event_type = 'error'
""")
def error_frames(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "error", 503).otherwise(200).alias("status_code"),
        F.concat(F.lit("fallo "), F.col("user_id").cast("string")).alias("detail"),
    )
    return X.error_frames(events).select("event_id", "frame")


_SUPERSEDED = f"""
WITH reqs AS (
  SELECT user_id AS conv_id, event_id AS request_id, epoch_us(ts) AS started, epoch_us(ts) + CAST(value * 60000000 AS BIGINT) AS ended,
    CASE WHEN event_type IN ('view', 'click') THEN 'texto' ELSE '' END AS response FROM events),
nexts AS (SELECT *, lead(started) OVER (PARTITION BY conv_id ORDER BY started, request_id) AS next_started FROM reqs)
SELECT conv_id, request_id, coalesce(next_started < ended, false) AS superseded,
  CASE WHEN coalesce(next_started < ended, false) AND response = '' THEN 'error' ELSE 'done' END AS status,
  CASE WHEN coalesce(next_started < ended, false) AND response = '' THEN 'Respuesta interrumpida por una nueva consulta.' END AS error
FROM nexts
"""


def _requests(spark, sf):
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select(
        F.col("user_id").alias("conv_id"), F.col("event_id").alias("request_id"), start.alias("started"),
        (start + F.round(F.col("value") * 60000000).cast("long")).alias("ended"),
        F.when(F.col("event_type").isin("view", "click"), "texto").otherwise("").alias("response"), F.lit("done").alias("status"),
    )


@query(_SUPERSEDED)
def supersede(spark, sf):
    return SS.supersede(_requests(spark, sf)).select("conv_id", "request_id", "superseded", "status", "error")


@query(_SUPERSEDED)
def stream_supersede(spark, sf):
    """The same on a stream: requests in four slices of time, out of order in each."""
    timed = _requests(spark, sf).withColumns({c: F.timestamp_micros(c) for c in ("started", "ended")})
    path, span = X.land(timed, "started", "requests")
    stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 16).parquet(path)
    return X.replay(RP.stream_supersede(stream, f"{span} seconds"), "superseded")


_SOFT = """soft AS (
  SELECT row_id, head, CAST(list_position(logits, list_max(logits)) AS INT) AS i, 1.0 / list_sum([exp(x - list_max(logits)) FOR x IN logits]) AS conf FROM predictions),
classified AS (
  SELECT row_id, """ + ", ".join(
    f"[{', '.join(repr(x) for x in fixed.LABELS[h])}][max(i) FILTER (WHERE head = '{h}')] AS {h}, max(conf) FILTER (WHERE head = '{h}') AS conf_{h}" for h in fixed.HEADS
) + ", exp(avg(ln(conf))) AS confianza FROM soft GROUP BY 1)"


@query(with_(PREDICTIONS, _SOFT, SYSTEM) + "SELECT row_id, dominio, md5(prompt) AS prompt_key FROM prompted")
def stream_prompts(spark, sf):
    """Logits arriving as a stream, decoded and turned into system prompts."""
    wide = wide_logits(spark, sf).select("row_id", *[f"logits_{h}" for h in fixed.HEADS])
    path = scratch_path(spark, "landed")
    wide.write.parquet(path)
    stream = spark.readStream.schema(wide.schema).parquet(path)
    prompted = SS.enrich_stream(stream, "Ada").select("row_id", "dominio", F.md5("system_prompt").alias("prompt_key"))
    return X.replay(prompted, "prompts")
