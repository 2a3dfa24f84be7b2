"""Conversation history and prompt assembly for tables of classified messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern import fixed
from lectern import fixed_prompts as P
from lectern.functions.arrays import map_value, pct_display
from lectern.functions.text import render, strip
from lectern.plans.ranking import number_rows

_BLOCK = 1024


def history(turns: DataFrame, n: int = 10, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Per turn the last ``n`` messages of earlier turns: question, then reply when it is done.

    Input ``submitted_text, llm_status, llm_response``; turns without a question do not exist.
    Messages are numbered per conversation and cut into blocks; a block also gets the last ``n``
    messages of the block before it. A long conversation is thus spread over many windows.
    """
    question = strip("submitted_text")
    reply = strip(F.coalesce("llm_response", F.lit("")))
    answered = (F.col("llm_status") == "done") & (reply != "")
    said = F.array_compact(
        F.array(
            F.struct(F.lit(0).alias("kind"), question.alias("contenido")),
            F.when(answered, F.struct(F.lit(1).alias("kind"), reply.alias("contenido"))),
        )
    )
    messages = turns.where(question != "").select(conv, turn, F.inline(said))
    numbered = number_rows(messages, [F.asc(turn), F.asc("kind")], [conv], "__m")
    size = max(_BLOCK, n)  # so that the block before always holds enough messages
    block = F.floor((F.col("__m") - 1) / size)
    near_end = (F.col("__m") - 1) % size >= size - n
    blocks = F.array_compact(F.array(block, F.when(near_end, block + 1)))
    spread = numbered.withColumn("__own", block).withColumn("__block", F.explode(blocks))
    before = W.partitionBy(conv, "__block").orderBy("__m").rowsBetween(-n, -1)
    role = F.when(F.col("kind") == 0, "user").otherwise("assistant")
    message = F.struct(role.alias("rol"), F.col("contenido"))
    framed = spread.withColumn("historial", F.collect_list(message).over(before))
    own = framed.where((F.col("__block") == F.col("__own")) & (F.col("kind") == 0))
    return own.select(conv, turn, F.col("contenido").alias("pregunta"), "historial")


def confidence_policy(confidence: Column | str = "confianza") -> Column:
    value = F.col(confidence) if isinstance(confidence, str) else confidence
    pct = pct_display(value).cast("string")
    return F.when(value >= fixed.RELIABLE_CONFIDENCE, render(P.RELIABLE, {"pct": pct})).otherwise(
        render(P.UNCERTAIN, {"pct": pct})
    )


def _weak(head: str) -> Column:
    return F.coalesce(F.col(f"conf_{head}") < fixed.WEAK_HEAD, F.lit(False))


def uncertainty_notes() -> Column:
    """One note per head below the weak threshold, in head order; null when there is none."""
    notes = [
        F.when(
            _weak(h),
            render(
                P.WEAK_NOTE,
                {
                    "title": fixed.HEAD_TITLES[h],
                    "label": F.col(h),
                    "pct": F.bround(F.col(f"conf_{h}") * 100).cast("int").cast("string"),
                },
            ),
        )
        for h in fixed.HEADS
    ]
    return F.nullif(F.array_join(F.array_compact(F.array(*notes)), "\n"), F.lit(""))


def rule(head: str) -> Column:
    """Rule text of the row's label, with the suffix of a weak head."""
    text = map_value(head, P.RULES[head], P.RULE_DEFAULT[head])
    suffix = F.when(_weak(head), P.WEAK_SUFFIX[head]).otherwise("")
    return F.concat(F.lit(P.RULE_TITLES[head]), text, suffix)


def select_rules() -> Column:
    return F.concat_ws("\n", *[rule(h) for h in P.RULE_TITLES])


def output_format() -> Column:
    urgent = (F.col("urgencia") == "alta") | F.col("emocion").isin("desesperado", "ansiedad")
    curious = (F.col("emocion") == "curiosidad") & (F.col("urgencia") == "baja")
    body = (
        F.when(urgent, P.FORMAT_URGENT)
        .when(F.col("emocion") == "abrumado", P.FORMAT_OVERWHELMED)
        .when(curious, P.FORMAT_CURIOUS)
        .otherwise(P.FORMAT_DEFAULT)
    )
    return F.concat(body, F.lit(P.FORMAT_FOOTER))


def system_prompt(assistant: str) -> Column:
    """The system prompt of a row with the four labels, ``confianza`` and (nullable)
    ``conf_<head>`` columns; ``assistant`` is the name the tutor goes by."""
    profile = {h: F.col(h) for h in fixed.HEADS}
    profile["pct"] = pct_display("confianza").cast("string")
    notes = uncertainty_notes()
    return F.concat_ws(
        "\n\n",
        F.lit(P.IDENTITY.format(assistant=assistant)),
        render(P.PROFILE, profile),
        confidence_policy(),
        F.when(notes.isNotNull(), F.concat(F.lit(P.WEAK_TITLE + "\n"), notes)),
        select_rules(),
        F.lit(P.PRIORITY_RULE),
        output_format(),
    )


def messages(system: Column, past: Column | str = "historial", question: Column | str = "pregunta") -> Column:
    """Message array of a request: system, history, user."""
    earlier = F.col(past) if isinstance(past, str) else past
    asked = F.col(question) if isinstance(question, str) else question

    def message(role: str, text: Column) -> Column:
        return F.array(F.struct(F.lit(role).alias("role"), text.alias("content")))

    renamed = F.transform(
        earlier, lambda m: F.struct(m["rol"].alias("role"), m["contenido"].alias("content"))
    )
    return F.concat(message("system", system), renamed, message("user", asked))


def render_prompts(df: DataFrame, assistant: str, keep: Sequence[str] = ()) -> DataFrame:
    """``messages`` of every row that has labels, confidences, ``historial`` and ``pregunta``."""
    return df.select(*keep, messages(system_prompt(assistant)).alias("messages"))
