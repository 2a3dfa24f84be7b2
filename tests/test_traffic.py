"""Limits, scores and providers in literal cases."""

from collections import Counter
from datetime import datetime, timedelta

from lectern.operators import traffic as TR

START = datetime(2024, 5, 1, 10, 0)


def _requests(spark):
    rows = [(c, START + timedelta(seconds=i % 60)) for c, n in (("a", 25), ("b", 20), (None, 70)) for i in range(n)]
    rows += [("a", START + timedelta(minutes=1)), ("a", None)]
    return spark.createDataFrame(rows, "client string, ts timestamp")


def test_rate_limits(spark):
    got = {(r.start.minute, r.scope, r.client): (r.n, r.refused) for r in TR.rate_limits(_requests(spark)).collect()}
    late = {k[1:]: v for k, v in got.items() if k[0] == 1}
    assert late == {("client", "a"): (1, 0), ("all", None): (1, 0)}
    assert {k[1:]: v for k, v in got.items() if k[0] == 0} == {
        ("client", "a"): (25, 5), ("client", "b"): (20, 0), ("client", None): (70, 50), ("all", None): (115, 15)
    }


def test_client_counts(spark):
    got = Counter({(r.start.minute, r.client): r.n for r in TR.client_counts(_requests(spark)).collect()})
    assert got == {(0, "a"): 25, (0, "b"): 20, (0, None): 70, (1, "a"): 1}


def test_keep_scored(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 2.9), (3, None), (4, 5.0)], "id int, score double")
    assert {r.id for r in TR.keep_scored(df).collect()} == {1, 4}


def test_provider_share(spark):
    df = spark.createDataFrame([("x",)] * 3 + [("y",)] + [(None,)], "provider string")
    got = {r.provider: (r.n, r.fraction, r.fallback) for r in TR.provider_share(df, primary="x").collect()}
    assert got == {"x": (3, 0.6, False), "y": (1, 0.2, True), "unknown": (1, 0.2, True)}
    assert TR.provider_share(df.limit(0), primary="x").collect() == []
