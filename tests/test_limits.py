"""Inputs beyond the sizes at which operators once stopped counting."""

import datetime as dt

import pytest

from lectern.operators import prompts as P
from lectern.operators import rows as R
from lectern.operators import scoring as S
from lectern.operators import splitting as SP
from lectern.streaming import frames as FR


def test_every_view_counts(spark):
    df = spark.createDataFrame([(1, "dominio", v, [1.0, float(v)]) for v in range(12)], "row_id int, head string, view int, logits array<double>")
    assert S.average_views(df).first()["logits"] == pytest.approx([1.0, 5.5])


def test_long_histories(spark):
    turns = spark.range(2600).selectExpr("'c' AS conv_id", "id AS turn", "concat('q', id) AS submitted_text", "'x' AS llm_status", "'' AS llm_response")
    rows = {r["turn"]: r["historial"] for r in P.history(turns, n=2000).collect()}
    for turn in (1, 1024, 1999, 2000, 2001, 2599):
        assert [m["contenido"] for m in rows[turn]] == [f"q{i}" for i in range(max(0, turn - 2000), turn)]


def test_a_pause_does_not_split_a_reply(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("r", i, start + dt.timedelta(seconds=60 * i), "token", f"t{i}", None) for i in range(4)]
    schema = "request_id string, seq long, ts timestamp, kind string, value string, payload struct<tokens_input: long, tokens_output: long>"
    out = FR.assemble_responses(spark.createDataFrame(rows, schema)).collect()
    assert [(r["request_id"], r["response"], r["latency_ms"]) for r in out] == [("r", "t0t1t2t3", 180_000)]


def test_all_bad_labels(spark):
    df = spark.createDataFrame([("train", f"bad{i:02d}", None, None, None) for i in range(25)], "split string, nivel_tecnico string, urgencia string, emocion string, dominio string")
    assert R.bad_labels(df).count() == 25
    assert R.bad_labels(df, shown=10).count() == 10


def test_all_pairs(spark):
    left, right = (spark.range(n).withColumnRenamed("id", "ord") for n in (60_000, 60_500))
    assert SP.paired_swap(left, right).count() == 60_000
    assert SP.paired_swap(left, right, 7).count() == 7


