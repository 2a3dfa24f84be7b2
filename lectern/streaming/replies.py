"""Replies and requests as state on a stream: one small state per request or conversation, ended by a
mark, by what comes next, or by an event-time timer.

The state of a request holds the text so far and the frames that came too early; the state of a
conversation holds the requests whose successor is not certain yet. Both are bounded by what can arrive
within the watermark, and both end: nothing is kept for a key once the watermark has passed it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern import fixed_prompts as P
from lectern.functions.text import strip
from lectern.plans.scratch import once
from lectern.streaming.frames import PAYLOAD

_MS = 1000


def numbered_events(df: DataFrame, frame: str = "frame") -> DataFrame:
    """Frames to ``kind`` (token, usage, error, end, none) and ``payload``; every frame keeps its row, so
    that gaps in ``seq`` mean frames that have not come yet."""
    lines = F.transform(F.split(frame, "\n"), strip)
    data = F.filter(lines, lambda x: x.startswith("data:"))
    text = F.array_join(F.transform(data, lambda x: strip(F.substring(x, 6, 1 << 30))), "\n")
    read = once(df, {"__data": text})
    options = {"columnNameOfCorruptRecord": "bad"}
    read = once(read, {"payload": F.from_json("__data", f"{PAYLOAD}, bad string", options)})
    p = F.col("payload")
    good = p["bad"].isNull()
    kind = (
        F.when(F.col("__data") == "[DONE]", "end").when(good & p["token"].isNotNull(), "token")
        .when(good & (p["type"] == "usage"), "usage").when(good & p["error"].isNotNull(), "error").otherwise("none")
    )
    return read.withColumn("kind", kind).drop("__data")


class _Reply:
    """What is known of a request; ``step`` takes frames in sequence."""

    def __init__(self, held: str | None):
        state = json.loads(held) if held else {}
        self.next = state.get("next", 0)
        self.parts = [state["text"]] if state.get("text") else []
        self.early = {int(k): v for k, v in state.get("early", {}).items()}
        self.usage = state.get("usage", [0, 0])
        self.first, self.last = state.get("first"), state.get("last")
        self.heard = state.get("heard", 0)
        self.status, self.error = state.get("status"), state.get("error")

    def dump(self) -> str:
        text = "" if self.status else "".join(self.parts)
        early = {} if self.status else self.early
        return json.dumps({
            "next": self.next, "text": text, "early": early, "usage": self.usage, "first": self.first, "last": self.last,
            "heard": self.heard, "status": self.status, "error": self.error,
        })

    def hear(self, seq: int, ts: int, kind: str, value: str | None, tokens_in: int, tokens_out: int) -> None:
        """Take one frame, in whatever order; a repeated one is dropped."""
        if self.status or seq < self.next or seq in self.early:
            return
        self.heard = max(self.heard, ts // _MS)
        self.early[seq] = [ts, kind, value, tokens_in, tokens_out]
        while self.next in self.early and not self.status:
            self._step(*self.early.pop(self.next))
            self.next += 1

    def _step(self, ts: int, kind: str, value: str | None, tokens_in: int, tokens_out: int) -> None:
        if kind in ("token", "usage", "error"):
            self.first = ts if self.first is None else min(self.first, ts)
            self.last = ts if self.last is None else max(self.last, ts)
        if kind == "token":
            self.parts.append(value or "")
        elif kind == "usage":
            self.usage = [tokens_in, tokens_out]
        elif kind == "error":
            self.status, self.error = "error", value
        elif kind == "end":
            self.status = "done"

    def cut(self) -> None:
        """No frame came in time: what came, in sequence and without the missing ones, is the reply."""
        for seq in sorted(self.early):
            if not self.status:
                self._step(*self.early[seq])
        self.status = self.status or "timeout"

    def row(self, key: str) -> dict:
        latency = round((self.last - self.first) / 1000) if self.first is not None else 0
        return {
            "request_id": key, "status": self.status, "response": "".join(self.parts), "error": self.error,
            "tokens_input": self.usage[0], "tokens_output": self.usage[1], "latency_ms": latency,
        }


REPLY = "request_id string, status string, response string, error string, tokens_input bigint, tokens_output bigint, latency_ms bigint"


def stream_replies(events: DataFrame, timeout_s: int = 120, watermark: str = "1 minute", request: str = "request_id") -> DataFrame:
    """One row per request of a stream of :func:`numbered_events`, when its end is certain.

    ``status`` says how it ended: ``done`` with the end mark, ``error`` with an error frame, once all frames
    before them are there; ``timeout`` when the watermark is ``timeout_s`` past the last frame. Pauses
    below that do not end a reply. Frames that come after the end, or twice, change nothing: a closed request is
    remembered until its timer, then its state goes.
    """

    def value(kind: str, pdf: pd.DataFrame):
        return pdf[kind].tolist()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reply = _Reply(state.get[0] if state.exists else None)
        closed = reply.status is not None
        if state.hasTimedOut:
            state.remove()
            if not closed:
                reply.cut()
                yield pd.DataFrame([reply.row(key[0])])
            return
        for pdf in frames:
            for row in zip(*(value(c, pdf) for c in ("seq", "at", "kind", "value", "tokens_input", "tokens_output")), strict=True):
                reply.hear(*row)
        if reply.status and not closed:
            yield pd.DataFrame([reply.row(key[0])])
        state.update((reply.dump(),))
        state.setTimeoutTimestamp(max(reply.heard + timeout_s * _MS, state.getCurrentWatermarkMs() + 1))

    p = F.col("payload")
    slim = events.where(F.col(request).isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", watermark).select(
        F.col(request).alias("request_id"), "ts", F.col("seq").cast("bigint").alias("seq"), F.unix_micros("ts").alias("at"), "kind",
        F.when(F.col("kind") == "token", p["token"]).when(F.col("kind") == "error", F.coalesce(p["detail"], p["error"])).alias("value"),
        F.coalesce(p["tokens_input"], F.lit(0)).alias("tokens_input"), F.coalesce(p["tokens_output"], F.lit(0)).alias("tokens_output"),
    )
    return slim.groupBy("request_id").applyInPandasWithState(step, REPLY, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def _settled(waiting: list[list], watermark: int) -> tuple[list[tuple], list[list]]:
    """Requests whose end is certain, with whether the next one cut them, and those that still wait.

    ``waiting`` is in order of start; a request is certain when nothing can come before its successor
    any more, or when the watermark has passed its own end.
    """
    out, rest = [], []
    for i, one in enumerate(waiting):
        follower = waiting[i + 1] if i + 1 < len(waiting) else None
        if follower is not None and follower[0] <= watermark:
            out.append((one, follower[0] < one[2]))
        elif one[2] <= watermark:
            out.append((one, follower is not None and follower[0] < one[2]))
        else:
            rest.append(one)
    return out, rest


SUPERSEDED = "{conv} {conv_kind}, {request} {request_kind}, superseded boolean, status string, error string"


def stream_supersede(
    requests: DataFrame, watermark: str = "10 minutes", conv: str = "conv_id", request: str = "request_id"
) -> DataFrame:
    """:func:`lectern.streaming.sessions.supersede` on a stream of ``started, ended`` (timestamps), ``response, status``.

    A request waits in the state of its conversation until its successor, or its own end, is older than the
    watermark; a timer at that moment ends the state when no further request comes. Requests may come out of
    order by as much as the watermark allows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = json.loads(state.get[0]) if state.exists else []
        for pdf in frames:
            waiting += [list(r) for r in zip(*(pdf[c].tolist() for c in ("__from", "__id", "__to", "__some", "__status")), strict=True)]
        waiting.sort(key=lambda r: (r[0], r[1]))
        mark = state.getCurrentWatermarkMs() * _MS
        done, rest = _settled(waiting, mark)
        if rest:
            # the last one that is done stays known through its follower only, which is among the rest
            state.update((json.dumps(rest),))
            ends = [min(one[2], rest[i + 1][0] if i + 1 < len(rest) else one[2]) for i, one in enumerate(rest)]
            state.setTimeoutTimestamp(max(min(ends) // _MS + 1, mark // _MS + 1))
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame({
                conv: [key[0]] * len(done), request: [one[1] for one, _ in done], "superseded": [cut for _, cut in done],
                "status": ["done" if cut and one[3] else "error" if cut else one[4] for one, cut in done],
                "error": [P.SUPERSEDED if cut and not one[3] else None for one, cut in done],
            })

    slim = requests.where(F.col("started").isNotNull()).withWatermark("started", watermark).select(
        conv, "started", F.unix_micros("started").alias("__from"), F.col(request).alias("__id"),
        F.coalesce(F.unix_micros("ended"), F.unix_micros("started")).alias("__to"), F.coalesce(F.length("response") > 0, F.lit(False)).alias("__some"),
        F.col("status").alias("__status"),
    )
    schema = SUPERSEDED.format(conv=f"`{conv}`", conv_kind=kinds[conv], request=f"`{request}`", request_kind=kinds[request])
    return slim.groupBy(conv).applyInPandasWithState(step, schema, "held string", "append", GroupStateTimeout.EventTimeTimeout)
