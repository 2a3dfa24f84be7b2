import random

import pytest
from pyspark.sql import functions as F

from lectern import fixed
from lectern.operators import dedupe as D
from lectern.operators import rows as R
from lectern.operators import selection as S
from lectern.plans.ranking import number_by_hash, number_rows


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_number_rows_with_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 7}", rng.randrange(5), i) for i in range(3000)] + [(None, 1, 9999)]
    df = spark.createDataFrame(rows, "g string, s int, i long")
    got = {r["i"]: r["rn"] for r in number_rows(df, [F.desc("s"), F.asc("i")], ["g"]).collect()}
    for group in {r[0] for r in rows}:
        inside = sorted([r for r in rows if r[0] == group], key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in inside] == list(range(1, len(inside) + 1))
    whole = number_rows(df, [F.asc("i")], out="k")
    assert [r["k"] for r in whole.orderBy("i").collect()] == list(range(1, len(rows) + 1))


def test_number_by_hash_is_a_permutation(spark):
    df = spark.range(2000).withColumn("g", F.when(F.col("id") % 3 > 0, "hot").otherwise("cold"))
    once = {r["id"]: r["hn"] for r in number_by_hash(df, "id", 5, ["g"]).collect()}
    again = {r["id"]: r["hn"] for r in number_by_hash(df.repartition(3), "id", 5, ["g"]).collect()}
    assert once == again
    assert sorted(v for k, v in once.items() if k % 3 == 0) == list(range(667))


def test_dedupe_limits_copies_before_the_shuffle(spark):
    df = spark.createDataFrame([(i, "Mismo  texto" if i % 3 else f"otro {i}") for i in range(90)] + [(100, " ")], "ord long, texto string")
    out = D.dedupe_text(df)
    plan = plan_text(out)
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("Exchange") < plan.rindex("WindowGroupLimit")
    kept = sorted(r["ord"] for r in out.collect())
    assert kept == sorted([1] + [i for i in range(90) if i % 3 == 0])
    assert sorted(r["ord"] for r in D.dedupe_text(out).collect()) == kept


def interleave(low, high, quota):
    out, i, j = [], 0, 0
    while len(out) < quota and (i < len(low) or j < len(high)):
        for _ in range(2):
            if i < len(low) and len(out) < quota:
                out.append(low[i])
                i += 1
        if j < len(high) and len(out) < quota:
            out.append(high[j])
            j += 1
    return out


@pytest.mark.parametrize("n_low,n_high", [(0, 5), (5, 0), (1, 9), (9, 1), (12, 5), (7, 7), (3, 20)])
def test_interleave_equals_the_loop(spark, n_low, n_high):
    rows = [(i, "d", 0, 0, 5, 1000 - i) for i in range(n_low)]
    rows += [(100 + i, "d", 0, 0, 50, 1000 - i) for i in range(n_high)]
    df = spark.createDataFrame(rows, "ord long, domain string, urgency_signal int, advanced_signal int, score int, creation_date long")
    placed = {r["place"]: r["ord"] for r in S.rank_diverse(df).collect()}
    expected = interleave(list(range(n_low)), [100 + i for i in range(n_high)], n_low + n_high)
    assert [placed[i] for i in range(len(rows))] == expected


def select_loop(rows, total, quotas):
    by = {}
    for r in rows:
        by.setdefault(r["domain"], []).append(r)
    budget = max(0, total - max(12, total // 30))
    want = {d: min(quotas.get(d, 0), len(v)) for d, v in by.items()}
    all_want = sum(want.values())
    alloc = want if all_want <= budget or all_want == 0 else {d: int(w * (budget / all_want)) for d, w in want.items()}
    chosen = []
    for d, items in by.items():
        ranked = sorted(items, key=lambda r: (r["urgency_signal"], r["advanced_signal"], min(10, max(-2, r["score"])), r["creation_date"]), reverse=True)
        chosen += interleave([r for r in ranked if r["score"] <= 10], [r for r in ranked if r["score"] > 10], alloc[d])
    used = {r["ord"] for r in chosen}
    rest = sorted([r for r in rows if r["ord"] not in used], key=lambda r: (r["urgency_signal"], r["advanced_signal"], r["creation_date"]), reverse=True)
    return used | {r["ord"] for r in rest[: total - len(used)]}


@pytest.mark.parametrize("total", [20, 60, 150])
def test_balanced_selection_equals_the_loop(spark, total):
    rng = random.Random(total)
    domains = ["backend", "frontend", "movil", "general", "seguridad"]
    rows = [
        {
            "ord": i, "question_id": i, "domain": rng.choice(domains[:2] if i % 2 else domains), "urgency_signal": rng.randrange(3),
            "advanced_signal": rng.randrange(2), "score": rng.randrange(-5, 30), "creation_date": rng.randrange(50),
        }
        for i in range(200)
    ]
    quotas = S.quotas("default", {"movil": 9, "general": -1})
    assert quotas["movil"] == 9 and quotas["general"] == 0
    got = {r["ord"] for r in S.select_balanced(spark.createDataFrame(rows), total, quotas).collect()}
    assert got == select_loop(rows, total, quotas)


def test_accept_within_deficit_equals_the_loop(spark):
    rng = random.Random(3)
    rows = [(i, rng.random() < 0.4, rng.random() < 0.3, rng.random() < 0.5) for i in range(300)]
    left = {"a": 20, "b": 0, "c": 500}
    expected = set()
    for i, *flags in rows:
        for axis, flag in zip("abc", flags):
            if flag and left[axis] > 0:
                left[axis] -= 1
                expected.add((i, axis))
    df = spark.createDataFrame(rows, "ord long, fa boolean, fb boolean, fc boolean")
    axes = {x: F.col(f"f{x}") for x in "abc"}
    got = S.accept_within_deficit(df, axes, {"a": 20, "b": 0, "c": 500}, [F.asc("ord")])
    assert {(r["ord"], r["axis"]) for r in got.collect()} == expected


def test_trim_sample_round_robin(spark):
    df = spark.createDataFrame([(i, "synthetic_x" if i % 3 == 0 else "so_es") for i in range(30)], "ord long, fuente string")
    assert sorted(r["ord"] for r in S.trim_to_target(df, 22).collect()) == sorted([i for i in range(30) if i % 3] + [0, 3])
    assert S.sample_n(df, 7, 1).count() == 7
    names = {r["ord"]: r["model"] for r in S.assign_round_robin(df, ["a", "b"], 1).collect()}
    assert names[0] == "b" and names[1] == "a"


def test_final_rows_and_validators(spark):
    questions = spark.createDataFrame(
        [(1, 10, "Titulo", "Cuerpo con examen", "experto", "alta", None, "algoritmos"), (2, 11, "", " ", "avanzado", "baja", "neutral", "movil")],
        "ord long, question_id long, title string, body string, nivel_tecnico string, urgencia string, emocion string, domain string",
    )
    row = R.to_final_questions(questions).collect()
    assert len(row) == 1
    row = row[0]
    assert (row["texto"], row["nivel_tecnico"], row["emocion"], row["dominio"], row["source_id"]) == (
        "Titulo\nCuerpo con examen", "intermedio", "ansiedad", "general", "so:10",
    )
    assert R.validate_rows(R.to_final_questions(questions)).count() == 0
    bad = spark.createDataFrame([(1, " ", None)], "ord long, texto string, emocion string").select(
        "*", *[F.lit("x").alias(h) for h in fixed.HEADS if h != "emocion"]
    )
    assert sorted(r["problem"] for r in R.validate_rows(bad).collect()) == ["emocion", "texto"]
    with pytest.raises(ValueError, match="emocion"):
        R.require_valid(bad)
    replies = spark.createDataFrame([(" Avanzado ", "ALTA", "neutral"), ("x", "alta", "neutral")], "nivel_tecnico string, urgencia string, emocion string")
    assert [r["valid"] for r in R.validate_labels(replies, True).collect()] == [True, False]
