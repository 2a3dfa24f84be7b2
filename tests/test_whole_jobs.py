"""Queries and tables that cover all their rows and whole texts."""

from lectern.operators import labeling as LB
from lectern.streaming import frames as X
from lectern.workloads import models
from lectern.workloads.corpus import split_rows


def test_audit_and_error_texts_are_whole(spark):
    schema = "question_id int, attempt int, status string, reply string, error string"
    rows = spark.createDataFrame([(1, 3, "http", "r" * 5000, "e" * 5000)], schema)
    got = LB.reply_audit(rows, "label").first()
    assert got.raw_excerpt == "r" * 5000 and got.message == "e" * 5000
    got = LB.reply_audit(rows, "label", error_chars=800, reply_chars=1200).first()
    assert len(got.raw_excerpt) == 1200 and len(got.message) == 800
    events = spark.createDataFrame([(500, "d" * 5000)], "status_code int, detail string")
    assert "d" * 5000 in X.error_frames(events).first().frame


def test_bootstrap_has_all_replicates(spark, sf):
    assert models.bootstrap_interval(spark, sf).first().n_boot == 500


def test_every_document_has_view_scores(spark, sf):
    assert models.view_scores(spark, sf).select("ord").distinct().count() == split_rows(spark, sf).count()
