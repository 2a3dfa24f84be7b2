"""Relations between the requests of a conversation, and the continuous prompt path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern import fixed_prompts as P
from lectern.operators.prompts import system_prompt
from lectern.operators.scoring import decode_logits
from lectern.plans.ranking import null_safe_join, number_rows


def supersede(requests: DataFrame, conv: str = "conv_id", request: str = "request_id") -> DataFrame:
    """A request still running when the next one of its conversation starts is ended by it:
    ``done`` when it has text, else ``error``.

    Input ``started, ended, response, status``. The next request is found by rank within the
    conversation and an equi join on (conversation, rank), so no conversation is held in one task.
    """
    numbered = number_rows(requests, [F.asc("started"), F.asc(request)], [conv], "__k")
    following = numbered.select(conv, (F.col("__k") - 1).alias("__k"), F.col("started").alias("next_started"))
    joined = null_safe_join(numbered, following, [conv, "__k"], "left")
    cut = F.coalesce(F.col("next_started") < F.col("ended"), F.lit(False))
    partial = F.coalesce(F.length("response") > 0, F.lit(False))
    status = F.when(cut & partial, "done").when(cut, "error").otherwise(F.col("status"))
    note = F.when(cut & ~partial, P.SUPERSEDED)
    return joined.select(
        conv, request, "started", "next_started", cut.alias("superseded"), status.alias("status"), note.alias("error")
    )


def enrich_stream(scored: DataFrame, assistant: str, keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Scored messages to labels and system prompt; stateless, for streams and static frames."""
    decoded = decode_logits(scored, keep)
    return decoded.withColumn("system_prompt", system_prompt(assistant))
