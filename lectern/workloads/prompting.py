"""Histories and prompts over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import fixed
from lectern import fixed_prompts as P
from lectern.operators import prompts as PR
from lectern.workloads.base import CLASSIFIED, TURNS, classified, q, query, sql_map, sql_strip, turns, with_

_MESSAGES = f"""said AS (
  SELECT conv_id, turn, 0 AS kind, 'user' AS rol, {sql_strip('submitted_text')} AS contenido FROM turns WHERE {sql_strip('submitted_text')} <> ''
  UNION ALL SELECT conv_id, turn, 1, 'assistant', {sql_strip('llm_response')} FROM turns WHERE llm_status = 'done' AND {sql_strip('llm_response')} <> '' AND {sql_strip('submitted_text')} <> ''),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, kind) AS m FROM said),
hist AS (
  SELECT conv_id, turn, kind, contenido AS pregunta,
    coalesce(list({{'rol': rol, 'contenido': contenido}}) OVER (PARTITION BY conv_id ORDER BY m ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), []) AS historial FROM numbered)"""


@query(with_(TURNS, _MESSAGES) + """
SELECT conv_id, turn, pregunta, CAST(len(historial) AS INT) AS n_messages,
  array_to_string([x.rol || ': ' || x.contenido FOR x IN historial], chr(10)) AS historial FROM hist WHERE kind = 0
""")
def history_window(spark, sf):
    past = PR.history(turns(spark, sf))
    lines = F.transform("historial", lambda m: F.concat(m["rol"], F.lit(": "), m["contenido"]))
    return past.select("conv_id", "turn", "pregunta", F.size("historial").alias("n_messages"), F.array_join(lines, "\n").alias("historial"))


def _even(value: str) -> str:
    """round half to even"""
    return f"round_even({value}, 0)"


def _filled(template: str, values: dict[str, str]) -> str:
    text = q(template)
    for name, sql in values.items():
        text = text.replace("{" + name + "}", f"' || {sql} || '")
    return f"({text})"


_PCT = f"CAST(CAST({_even('confianza * 100')} AS INT) AS VARCHAR)"
_POLICY = f"CASE WHEN confianza >= 0.65 THEN {_filled(P.RELIABLE, {'pct': _PCT})} ELSE {_filled(P.UNCERTAIN, {'pct': _PCT})} END"
_NOTES = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN conf_{h} < 0.5 THEN " + _filled(
        P.WEAK_NOTE.replace("{title}", fixed.HEAD_TITLES[h]),
        {"label": h, "pct": f"CAST(CAST({_even(f'conf_{h} * 100')} AS INT) AS VARCHAR)"},
    ) + " END"
    for h in fixed.HEADS
) + "], lambda x: x IS NOT NULL), chr(10))"
_RULES = "array_to_string([" + ", ".join(
    f"{q(t)} || coalesce({sql_map(P.RULES[h])}[{h}], {q(P.RULE_DEFAULT[h])}) || CASE WHEN conf_{h} < 0.5 THEN {q(P.WEAK_SUFFIX[h])} ELSE '' END"
    for h, t in P.RULE_TITLES.items()
) + "], chr(10))"
_FORMAT = f"""CASE WHEN urgencia = 'alta' OR emocion IN ('desesperado', 'ansiedad') THEN {q(P.FORMAT_URGENT)} WHEN emocion = 'abrumado' THEN {q(P.FORMAT_OVERWHELMED)}
  WHEN emocion = 'curiosidad' AND urgencia = 'baja' THEN {q(P.FORMAT_CURIOUS)} ELSE {q(P.FORMAT_DEFAULT)} END || {q(P.FORMAT_FOOTER)}"""
_SYSTEM = f"""array_to_string(list_filter([{q(P.IDENTITY.format(assistant='Ada'))},
  {_filled(P.PROFILE, {**{h: h for h in fixed.HEADS}, 'pct': _PCT})}, {_POLICY},
  CASE WHEN notes <> '' THEN {q(P.WEAK_TITLE + chr(10))} || notes END, {_RULES}, {q(P.PRIORITY_RULE)}, {_FORMAT}], lambda x: x IS NOT NULL), chr(10) || chr(10))"""
SYSTEM = f"prompted AS (SELECT *, {_SYSTEM} AS prompt FROM (SELECT *, {_NOTES} AS notes FROM classified))"


@query(with_(CLASSIFIED, SYSTEM) + "SELECT conv_id, turn, prompt FROM prompted")
def system_prompt(spark, sf):
    return classified(spark, sf).select("conv_id", "turn", PR.system_prompt("Ada").alias("prompt"))


@query(with_(CLASSIFIED, SYSTEM) + f"""
SELECT conv_id, turn, {_POLICY} AS policy, nullif(notes, '') AS notes, {_RULES} AS rules, {_FORMAT} AS format FROM prompted
""")
def prompt_parts(spark, sf):
    return classified(spark, sf).select(
        "conv_id", "turn", PR.confidence_policy().alias("policy"), PR.uncertainty_notes().alias("notes"),
        PR.select_rules().alias("rules"), PR.output_format().alias("format"),
    )


@query(with_(CLASSIFIED, SYSTEM, TURNS, _MESSAGES) + """
SELECT h.conv_id, h.turn, CAST(len(historial) + 2 AS INT) AS n_messages,
  md5('system=' || prompt || chr(10) || coalesce(array_to_string([x.rol || '=' || x.contenido FOR x IN historial], chr(10)) || CASE WHEN len(historial) > 0 THEN chr(10) ELSE '' END, '') || 'user=' || h.pregunta) AS messages_key
FROM hist h JOIN prompted p USING (conv_id, turn) WHERE h.kind = 0
""")
def prompt_messages(spark, sf):
    past = PR.history(turns(spark, sf))
    rows = classified(spark, sf).drop("pregunta").join(past, ["conv_id", "turn"])
    sent = PR.render_prompts(rows, "Ada", ["conv_id", "turn"])
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit("="), m["content"]))
    return sent.select("conv_id", "turn", F.size("messages").alias("n_messages"), F.md5(F.array_join(lines, "\n")).alias("messages_key"))
