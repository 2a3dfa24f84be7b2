"""Token stream frames: parsing, routing, assembly. The same functions take a static frame or a
stream; only :func:`replay` starts a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.functions.text import strip
from lectern.plans.ranking import number_rows
from lectern.plans.scratch import once, scratch_path, settle

PAYLOAD = (
    "token string, type string, provider string, tokens_input long, tokens_output long, "
    "latency_ms long, error string, detail string"
)


def frame_data(frame: Column | str) -> Column:
    """Joined ``data:`` lines of a frame; null without any or for the end mark."""
    text = F.col(frame) if isinstance(frame, str) else frame
    lines = F.transform(F.split(text, "\n"), strip)
    data = F.filter(lines, lambda x: x.startswith("data:"))
    joined = F.array_join(F.transform(data, lambda x: strip(F.substring(x, 6, 1 << 30))), "\n")
    return F.when((F.size(data) > 0) & (joined != "[DONE]"), joined)


def parse_sse(df: DataFrame, frame: str = "frame") -> DataFrame:
    """Frames to payload fields; frames without data, end marks and bad JSON are dropped."""
    data = once(df, {"__data": frame_data(frame)}).where(F.col("__data").isNotNull())
    options = {"columnNameOfCorruptRecord": "bad"}
    parsed = once(data, {"payload": F.from_json("__data", f"{PAYLOAD}, bad string", options)})
    return parsed.where(F.col("payload.bad").isNull()).drop("__data")


def route_events(parsed: DataFrame) -> DataFrame:
    """Payloads to ``kind`` (token, usage, error) and ``value``; anything else is dropped."""
    p = F.col("payload")
    kind = (
        F.when(p["token"].isNotNull(), "token")
        .when(p["type"] == "usage", "usage")
        .when(p["error"].isNotNull(), "error")
    )
    value = (
        F.when(F.col("kind") == "token", p["token"])
        .when(F.col("kind") == "usage", p["provider"])
        .when(F.col("kind") == "error", F.coalesce(p["detail"], p["error"]))
    )
    return parsed.withColumn("kind", kind).where(F.col("kind").isNotNull()).withColumn("value", value)


def error_frames(
    df: DataFrame, status: str = "status_code", detail: str = "detail", max_chars: int | None = None
) -> DataFrame:
    """Upstream failures (status 400 and above) as error payloads; ``max_chars`` cuts the detail."""
    failed = df.where(F.col(status) >= 400)
    payload = F.struct(F.lit("service_unavailable").alias("error"), (F.col(detail) if max_chars is None else F.substring(detail, 1, max_chars)).alias("detail"))
    return failed.withColumn("frame", F.concat(F.lit("data: "), F.to_json(payload), F.lit("\n\n")))


def reframe(chunks: DataFrame, request: str = "request_id", chunk: str = "chunk", size: int = 256) -> DataFrame:
    """Raw chunks of a request (ordered by ``seq``) to whole frames ``request, ts, seq, frame``: a frame cut by chunk
    borders is put together, an unfinished last one is not delivered, blank ones are dropped.

    A segmented scan: ranges of ``size`` chunks are joined and cut by themselves. One window over the
    ranges (not the chunks) of a request gives the number of the first frame of each range, and only the pieces at
    the ends of ranges are grouped again by that number, so no row holds more than a range or a frame.
    """
    slim = chunks.select(request, "seq", "ts", F.col(chunk).alias("__c"))
    numbered = number_rows(slim, [F.asc("seq")], [request], "__n")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__c"))), lambda p: p["__c"]), "")
    ranges = numbered.groupBy(request, F.floor((F.col("__n") - 1) / size).alias("__r")).agg(joined.alias("__t"), F.min("ts").alias("__ts"))
    bare = F.regexp_replace("__t", "^\n+", "")
    ranges = settle(ranges.withColumn("__lead", F.length("__t") - F.length(bare)).withColumn("__t", bare), "ranges")
    # a run of newlines belongs to the range it starts in, so that no end of a frame lies on a border
    order = W.partitionBy(request).orderBy("__r")
    owner = F.sum((F.col("__t") != "").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    blank = F.col("__t") == ""
    owned = ranges.withColumn("__g", owner).groupBy(request, "__g").agg(
        F.max("__t").alias("__t"), F.min("__ts").alias("__ts"),
        F.sum(F.when(blank, F.col("__lead")).otherwise(0)).alias("__after"), F.sum(F.when(blank, 0).otherwise(F.col("__lead"))).alias("__lead"),
    )
    order = W.partitionBy(request).orderBy("__g")
    newlines = lambda n: F.repeat(F.lit("\n"), n.cast("int"))
    first = F.lag("__g").over(order).isNull()
    after = F.col("__after") + F.coalesce(F.lead("__lead").over(order), F.lit(0))
    text = F.concat(F.when(first, newlines(F.col("__lead"))).otherwise(""), "__t", newlines(after))
    parts = owned.select(request, "__g", "__ts", F.split(text, "\n\n", -1).alias("__p")).withColumn("__d", F.size("__p") - 1)
    every = W.partitionBy(request)
    placed = parts.select(
        request, "__g", "__p", "__d", F.coalesce(F.sum("__d").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__d").over(every).alias("__total"), F.min("__ts").over(every).alias("ts"),
    )
    pieces = placed.select(request, "ts", "__g", "__d", "__total", "__before", F.posexplode("__p").alias("__j", "frame"))
    pieces = settle(pieces.withColumn("seq", F.col("__before") + F.col("__j")).where("seq < __total"), "pieces")
    at_end = (F.col("__j") == 0) | (F.col("__j") == F.col("__d"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__g", "frame"))), lambda p: p["frame"]), "")
    cut = pieces.where(at_end).groupBy(request, "seq").agg(F.min("ts").alias("ts"), whole.alias("frame"))
    out = pieces.where(~at_end).select(request, "ts", "seq", "frame").unionByName(cut.select(request, "ts", "seq", "frame"))
    return out.where(strip("frame") != "")


def assemble_responses(
    routed: DataFrame, gap: str = "30 seconds", watermark: str | None = "1 minute", conv: str = "request_id"
) -> DataFrame:
    """One row per request: text in sequence order, status, error, usage, latency.

    On a static frame a request is one reply, however long it pauses. On a stream it is a session that
    ends when no frame arrives for ``gap``; it is emitted once when the watermark passes it, which
    also frees its state. Tokens after an error do not count. The frames of one request are
    bounded by the token limit of a reply.
    """
    timed = routed.withWatermark("ts", watermark) if watermark and routed.isStreaming else routed
    events = timed.where(F.col(conv).isNotNull())
    item = F.struct("seq", "kind", "value")
    usage = F.when(F.col("kind") == "usage", F.struct("seq", F.col("payload.tokens_input").alias("i"), F.col("payload.tokens_output").alias("o")))
    # a pause ends a reply only where nothing else can: on a stream
    ends = [F.session_window("ts", gap)] if routed.isStreaming else []
    grouped = events.groupBy(conv, *ends).agg(
        F.array_sort(F.collect_list(item)).alias("items"),
        F.max(usage).alias("u"),
        F.min("ts").alias("started"),
        F.max("ts").alias("ended"),
    )
    failure = F.get(F.filter("items", lambda e: e["kind"] == "error"), F.lit(0))
    kept = F.filter(
        "items", lambda e: (e["kind"] == "token") & (failure.isNull() | (e["seq"] < failure["seq"]))
    )
    latency = (F.unix_micros("ended") - F.unix_micros("started")) / 1000.0
    return grouped.select(
        conv,
        F.when(failure.isNotNull(), "error").otherwise("done").alias("status"),
        F.array_join(F.transform(kept, lambda e: e["value"]), "").alias("response"),
        failure["value"].alias("error"),
        F.coalesce("u.i", F.lit(0).cast("long")).alias("tokens_input"),
        F.coalesce("u.o", F.lit(0).cast("long")).alias("tokens_output"),
        F.bround(latency).cast("long").alias("latency_ms"),
        "started",
    )


def usage(routed: DataFrame, request: str = "request_id") -> DataFrame:
    """Usage per request, zeros when none came (aggregated map-side)."""
    mark = F.when(F.col("kind") == "usage", F.struct("seq", F.col("payload.tokens_input").alias("i"), F.col("payload.tokens_output").alias("o")))
    grouped = routed.groupBy(request).agg(
        F.max(mark).alias("u"), F.count_if(F.col("kind") == "token").alias("n_tokens"),
        F.min("ts").alias("a"), F.max("ts").alias("b"),
    )
    return grouped.select(
        request, "n_tokens",
        F.coalesce("u.i", F.lit(0).cast("long")).alias("tokens_input"),
        F.coalesce("u.o", F.lit(0).cast("long")).alias("tokens_output"),
        F.bround((F.unix_micros("b") - F.unix_micros("a")) / 1000.0).cast("long").alias("latency_ms"),
    )


def heartbeat(frames: DataFrame, until: str, request: str = "request_id") -> DataFrame:
    """A stream of one clock row a day later than ``until``.

    It moves the watermark past the last session when a finished table is replayed; its own
    session stays open, so nothing is emitted for it.
    """
    spark = frames.sparkSession
    path = scratch_path(spark, "clock")
    values = {
        request: F.lit("clock"),
        "ts": F.lit(until).cast("timestamp") + F.expr("interval 1 day"),
        "frame": F.lit('data: {"token": ""}'),
    }
    columns = [values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in frames.schema]
    spark.range(1).select(*columns).write.parquet(path)
    return spark.readStream.schema(frames.schema).parquet(path)


def land(df: DataFrame, ts: str, name: str, parts: int = 4) -> tuple[str, int]:
    """Write a finished table as a stream would arrive: ``parts`` slices of time one after the other, and a last row
    far behind them that only moves the watermark. Returns the folder and the longest slice in seconds,
    by which rows of one slice can be out of order. The table is evaluated once, borders and slices read what was written."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df = settle(df, f"{name}_whole")
    micros = F.unix_micros(ts)
    low, high = df.agg(F.min(micros), F.max(micros)).first()
    cuts = df.select(micros.cast("double").alias("m")).approxQuantile("m", [i / parts for i in range(1, parts)], 0.01)
    borders = [low or 0, *sorted({int(c) for c in cuts if low < c <= high}), (high or 0) + 1]
    for start, end in zip(borders, borders[1:], strict=False):
        df.where((micros >= start) & (micros < end)).write.mode("append").parquet(path)
    longest = max(b - a for a, b in zip(borders, borders[1:], strict=False)) // 1_000_000 + 1
    late = F.timestamp_micros(F.lit(borders[-1] + longest * 1_000_000)) + F.expr("interval 2 days")
    clock = [(late if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema]
    spark.range(1).select(*clock).write.mode("append").parquet(path)
    return path, longest


def replay(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything that is there now into a file sink, and read the sink."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", out)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
