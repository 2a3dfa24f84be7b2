"""Replies and requests as state on streams, and frames put together from chunks, in literal cases and against loops."""

import random

from pyspark.sql import functions as F

from lectern.streaming import frames as X
from lectern.streaming import replies as RP
from lectern.streaming import sessions as SS

T0 = 1_700_000_000
TOKEN = 'data: {{"token": "{}"}}'.format
USAGE = 'data: {"type": "usage", "provider": "p", "tokens_input": 3, "tokens_output": 2, "latency_ms": 1}'
ERROR = 'data: {"error": "e", "detail": "caída"}'
DONE = "data: [DONE]"
SCHEMA = "request_id string, seq long, frame string, ts timestamp"


def replied(spark, tmp_path, batches, timeout_s=120):
    """Each batch is one file and one trigger; rows are (request, seq, second, frame)."""
    path = str(tmp_path / "in")
    for rows in batches:
        df = spark.createDataFrame([(r, q, f, t * 1_000_000) for r, q, t, f in rows], "request_id string, seq long, frame string, at long")
        df.select("request_id", "seq", "frame", F.timestamp_micros(F.col("at") + T0 * 1_000_000).alias("ts")).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    out = X.replay(RP.stream_replies(RP.numbered_events(stream), timeout_s, "10 seconds"), "replies").collect()
    return sorted((r.request_id, r.status, r.response, r.error, r.tokens_input, r.latency_ms) for r in out)


def test_a_pause_does_not_end_a_reply(spark, tmp_path):
    got = replied(spark, tmp_path, [
        [("a", 0, 0, TOKEN("Ho"))],
        [("a", 1, 60, TOKEN("la")), ("clock", 0, 70, ": ping")],
        [("a", 3, 61, DONE), ("a", 2, 61, USAGE)],
        [("clock", 1, 9999, ": ping")],
    ])
    assert got == [("a", "done", "Hola", None, 3, 61000)]


def test_frames_out_of_order_twice_and_after_the_end(spark, tmp_path):
    got = replied(spark, tmp_path, [
        [("a", 2, 2, DONE), ("a", 1, 1, TOKEN("la")), ("b", 1, 1, ERROR), ("b", 0, 0, TOKEN("x"))],
        [("a", 0, 0, TOKEN("Ho")), ("a", 1, 1, TOKEN("la")), ("b", 2, 3, TOKEN("tarde"))],
        [("a", 3, 4, TOKEN("más")), ("b", 0, 2, TOKEN("x"))],
        [("clock", 0, 9999, ": ping")],
    ])
    assert got == [("a", "done", "Hola", None, 0, 1000), ("b", "error", "x", "caída", 0, 1000)]


def test_without_an_end_the_timer_ends_it(spark, tmp_path):
    got = replied(spark, tmp_path, [
        [("a", 0, 0, TOKEN("u")), ("a", 2, 2, TOKEN("s")), ("a", 3, 3, DONE), ("b", 0, 0, ": ping")],
        [("clock", 0, 100, ": ping")],
        [("a", 9, 50, TOKEN("tarde"))],  # older than the watermark
        [("clock", 1, 9999, ": ping")],
        [("clock", 2, 9999, ": ping")],
    ], timeout_s=60)
    # frame 1 of a never came: what there is, with its end mark
    assert got == [("a", "done", "us", None, 0, 2000), ("b", "timeout", "", None, 0, 0)]


def test_stream_supersede_is_the_static_one(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for i in range(120):
        start = rng.randint(0, 3000)
        rows.append((rng.randint(0, 5), i, start, start + rng.randint(0, 200), rng.choice(["", "texto", None]), "done"))
    rows += [(9, 500, 100, 400, "x", "done"), (9, 501, 100, 100, "", "done"), (9, 502, 400, 500, "", "done")]
    df = spark.createDataFrame(rows, "conv_id long, request_id long, a long, b long, response string, status string")
    micros = lambda c: (F.col(c) + T0) * 1_000_000
    static = SS.supersede(df.withColumn("started", micros("a")).withColumn("ended", micros("b")))
    timed = df.select("conv_id", "request_id", F.timestamp_micros(micros("a")).alias("started"), F.timestamp_micros(micros("b")).alias("ended"), "response", "status")
    path, span = X.land(timed, "started", "requests", 5)
    stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 2).parquet(path)
    out = X.replay(RP.stream_supersede(stream, f"{span} seconds"), "superseded")
    names = ["conv_id", "request_id", "superseded", "status", "error"]
    assert sorted(map(tuple, out.select(*names).collect())) == sorted(map(tuple, static.select(*names).collect()))
    assert out.count() == len(rows)


def test_a_request_is_certain_when_nothing_can_come_before_its_successor():
    waiting = [[10, "a", 50, True, "done"], [20, "b", 25, False, "done"], [60, "c", 90, True, "done"]]
    done, rest = RP._settled(waiting, 19)
    assert not done and rest == waiting
    done, rest = RP._settled(waiting, 25)
    assert [(one[1], cut) for one, cut in done] == [("a", True), ("b", False)] and [r[1] for r in rest] == ["c"]


def test_frames_from_chunks_are_those_of_the_whole_text(spark):
    rng = random.Random(6)
    rows, want = [], []
    for r in range(25):
        text = "".join(rng.choice(["\n", "\n\n", "a", "data: é", "b" * 9, "\n\n\n", " "]) for _ in range(rng.randint(0, 40)))
        at = seq = 0
        while at < len(text):
            n = rng.choice([1, 1, 2, 3, 8])
            rows.append((f"r{r}", seq, text[at:at + n]))
            at, seq = at + n, seq + rng.choice([1, 2])
        want += [(f"r{r}", i, f) for i, f in enumerate(text.split("\n\n")[:-1]) if f.strip()]
    rows += [("x", i, "\n") for i in range(9)] + [("y", 0, ""), ("y", 1, "ab"), ("y", 2, ""), ("y", 3, "\n\n")]
    want.append(("y", 0, "ab"))
    df = spark.createDataFrame(rows, "request_id string, seq long, chunk string").withColumn("ts", F.current_timestamp())
    for size in (1, 2, 5, 256):
        got = sorted((r.request_id, r.seq, r.frame) for r in X.reframe(df.repartition(3), size=size).collect())
        assert got == sorted(want), size


def test_a_landed_table_is_evaluated_once(spark):
    made = spark.sparkContext.accumulator(0)

    def at(i):
        made.add(1)
        return T0 + i

    df = spark.range(0, 40, numPartitions=2).select("id", F.timestamp_seconds(F.udf(at, "long")("id")).alias("ts"))
    path, span = X.land(df, "ts", "landed")
    assert made.value == 40 and span < 40
    landed = spark.read.parquet(path).where("id IS NOT NULL")
    assert sorted(r["id"] for r in landed.collect()) == list(range(40))
