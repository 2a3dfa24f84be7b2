"""Table functions for SQL: windows over a text's tokens, and its tokens with their vocabulary ids.

They are SQL functions, so their bodies are part of the caller's plan and stay in the JVM::

    register(spark, "vocab")
    SELECT ord, v.* FROM docs, LATERAL token_views(texto, 160, 'score') v
    SELECT ord, t.* FROM docs, LATERAL token_table(texto) t
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from lectern import fixed
from lectern.functions.text import TOKEN_PATTERN


def _tokens(text: str) -> str:
    pattern = TOKEN_PATTERN.replace("\\", "\\\\").replace("'", "\\'")
    return f"regexp_extract_all(lower({text}), '{pattern}', 0)"


def register(spark: SparkSession, vocabulary: str | None = None) -> None:
    """Create ``token_views(body, width, mode)`` and, with the name of a view ``word, idx``, ``token_table(body)``."""
    # the inner table function sees the columns of x only, so the parameters are among them
    rest, half = "(w - greatest(1, w div 2))", "greatest(1, w div 2)"
    tail = f"if({rest} > 0, slice(t, -least({rest}, size(t)), {rest}), t)"
    views = (
        "slice(t, 1, w)",
        "if(m <> 'head' AND size(t) > w, slice(t, -w, w), NULL)",
        f"if(m <> 'head' AND size(t) > w, slice(concat(slice(t, 1, {half}), {tail}), 1, w), NULL)",
        "if(m = 'score' AND size(t) > 2 * w, slice(t, CAST(greatest(0, size(t) div 2 - w div 2) + 1 AS INT), w), NULL)",
    )
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION token_views(body STRING, width INT, mode STRING)
        RETURNS TABLE (view INT, toks ARRAY<STRING>)
        RETURN SELECT v.pos, v.col FROM (SELECT {_tokens('body')} AS t, width AS w, mode AS m) AS x,
          LATERAL posexplode(if(t IS NULL, array(t), array_compact(array({', '.join(views)})))) AS v
    """)
    if vocabulary is not None:
        spark.sql(f"""
            CREATE OR REPLACE TEMPORARY FUNCTION token_table(body STRING)
            RETURNS TABLE (pos INT, word STRING, idx INT, is_unk BOOLEAN)
            RETURN SELECT t.pos, t.col, coalesce(v.idx, {fixed.UNK_ID}), v.idx IS NULL
              FROM posexplode({_tokens('body')}) AS t LEFT JOIN `{vocabulary}` AS v ON v.word = t.col
        """)
