import random

import pytest
from pyspark.sql import functions as F

from lectern import fixed
from lectern import fixed_prompts as P
from lectern.operators import labeling as LB
from lectern.operators import metrics as M
from lectern.operators import prompts as PR
from lectern.operators import scoring as SC
from lectern.operators import vocab as V
from lectern.sources import readers as RD
from lectern.sources import writers as WR
from lectern.streaming import frames as X

META = {"nivel_tecnico": "principiante", "urgencia": "alta", "emocion": "frustracion", "dominio": "backend", "confianza": 0.87}


def prompt(spark, **changes):
    row = {**META, **{f"conf_{h}": None for h in fixed.HEADS}, **changes}
    schema = ", ".join(f"{k} {'string' if k in fixed.HEADS else 'double'}" for k in row)
    return spark.createDataFrame([tuple(row.values())], schema).select(
        PR.system_prompt("Ada").alias("p"), PR.select_rules().alias("r"), PR.output_format().alias("f")
    ).first()


def test_system_prompt(spark):
    full = prompt(spark)["p"]
    for part in ("Ada", "principiante", "REGLAS POR URGENCIA", "REGLAS POR DOMINIO", "87%", P.PRIORITY_RULE):
        assert part in full
    assert P.WEAK_TITLE not in full
    assert "incierta" in prompt(spark, confianza=0.4)["p"] and "fiable" in prompt(spark, confianza=0.65)["p"]
    weak = prompt(spark, conf_nivel_tecnico=0.9, conf_urgencia=0.88, conf_emocion=0.3, conf_dominio=0.85)
    assert "debil" in weak["r"] and P.WEAK_TITLE in weak["p"] and "(30%)" in weak["p"]
    assert "ahora" in prompt(spark, emocion="desesperado")["f"]
    assert prompt(spark, emocion="abrumado", urgencia="baja")["f"].startswith(P.FORMAT_OVERWHELMED)


def history_loop(turns, current, n=10):
    out = []
    for turn, question, status, reply in turns:
        if turn == current:
            break
        if question.strip():
            out.append(("user", question.strip()))
        if status == "done" and (reply or "").strip():
            out.append(("assistant", reply.strip()))
    return out[-n:]


def test_history_equals_the_loop(spark):
    rng = random.Random(1)
    talks = {c: [(t, f"q{t} ", rng.choice(["done", "error"]), rng.choice(["a", " ", None, f"r{t}"])) for t in range(size)] for c, size in (("corta", 3), ("larga", 1500))}
    rows = [(c, *turn) for c, turns in talks.items() for turn in turns]
    df = spark.createDataFrame(rows, "conv_id string, turn int, submitted_text string, llm_status string, llm_response string")
    got = {(r["conv_id"], r["turn"]): [(m["rol"], m["contenido"]) for m in r["historial"]] for r in PR.history(df).collect()}
    assert len(got) == len(rows)
    for c, turns in talks.items():
        for turn, *_ in turns:
            if c == "corta" or turn % 37 == 0 or 505 < turn < 700:
                assert got[(c, turn)] == history_loop(turns, turn), (c, turn)


def test_messages_order(spark):
    row = spark.createDataFrame([("Como uso async?",)], "pregunta string").withColumn(
        "historial", F.array(F.struct(F.lit("user").alias("rol"), F.lit("Hola").alias("contenido")))
    )
    sent = row.select(PR.messages(F.lit("S")).alias("m")).first()["m"]
    assert [(m["role"], m["content"]) for m in sent] == [("system", "S"), ("user", "Hola"), ("user", "Como uso async?")]


def test_reply_attempts(spark):
    ok = '{"nivel_tecnico": "avanzado", "urgencia": "alta"}'
    rows = [
        (1, 1, None, "429 slow down"), (1, 2, ok, None),
        (2, 1, "nada", None), (2, 2, ok, None),
        (3, 1, None, "Rate limit"), (3, 2, None, "timeout"), (3, 3, None, "timeout"),
        (4, 1, '{"nivel_tecnico": "guru", "urgencia": "alta"}', None),
        (5, 1, None, "timeout"),
        (6, 1, None, "429"), (6, 2, None, "429"), (6, 3, "{", None),
    ]
    replies = spark.createDataFrame(rows, "question_id int, attempt int, reply string, error string")
    settled = LB.reply_status(replies)
    got = {r["question_id"]: (r["attempt"], r["status"]) for r in settled.collect()}
    assert got == {1: (2, "ok"), 2: (1, "json_parse"), 3: (3, "error"), 4: (1, "schema_validation"), 6: (3, "json_parse")}
    audit = sorted((r["question_id"], r["stage"]) for r in LB.reply_audit(settled, "label").collect())
    assert audit == [(2, "json_parse"), (3, "final_failure"), (4, "schema_validation"), (6, "final_failure"), (6, "json_parse")]


def test_vocabulary_and_encoding(spark):
    rows = spark.createDataFrame([(1, "cómo hago cómo hago esto"), (2, "xyz"), (3, "")], "ord long, texto string")
    vocab = V.build_vocab(V.token_freq(rows), min_freq=2)
    assert {r["word"]: r["idx"] for r in vocab.collect()} == {"<pad>": 0, "<unk>": 1, "cómo": 2, "hago": 3}
    ids = {r["ord"]: r["ids"] for r in V.encode(rows, vocab, 4).collect()}
    assert ids == {1: [2, 3, 2, 3], 2: [1], 3: []}
    assert V.vocab_summary(vocab).first()["vocab_size"] == 4
    vectors = spark.createDataFrame([("cómo", [1.0, 2.0]), ("otra", [3.0, 4.0]), ("hago", [1.0])], "word string, vec array<float>")
    aligned = {r["word"]: r for r in V.align_vectors(vocab, vectors, 2).collect()}
    assert aligned["cómo"]["vec"] == [1.0, 2.0] and aligned["<unk>"]["vec"] == [0.0, 0.0] and not aligned["hago"]["found"]
    again = {r["word"]: r["vec"] for r in V.align_vectors(vocab, vectors, 2).collect()}
    assert again["hago"] == aligned["hago"]["vec"] != [0.0, 0.0]


def test_json_array_reader(spark, tmp_path):
    good = tmp_path / "good.json"
    good.write_text('[{"a": 1, "b": "x"}, 3, "s", {"a": 2}]', encoding="utf-8")
    rows = RD.read_json_array(spark, str(good), "a int, b string").collect()
    assert [(r["a"], r["b"]) for r in rows] == [(1, "x"), (2, None)]
    bad = tmp_path / "bad.json"
    bad.write_text('{"a": 1}', encoding="utf-8")
    with pytest.raises(Exception, match="JSON array"):
        RD.read_json_array(spark, str(bad), "a int").collect()
    assert RD.read_optional(spark, str(tmp_path / "none"), "a int").count() == 0


def test_vectors_vocab_and_pages(spark, tmp_path):
    (tmp_path / "v.vec").write_text("3 2\nuno 0.5 1\ndos x 1\ntres 1\nuno 9 9\ncuatro 2 3\n", encoding="utf-8")
    got = {r["word"]: r["vec"] for r in RD.read_vec(spark, str(tmp_path / "v.vec")).collect()}
    assert got == {"uno": [0.5, 1.0], "cuatro": [2.0, 3.0]}
    (tmp_path / "vocab.json").write_text('{"word2idx": {"<pad>": 0, "sí": 2}, "meta": {}}', encoding="utf-8")
    assert {r["word"]: r["idx"] for r in RD.read_vocab(spark, str(tmp_path / "vocab.json")).collect()} == {"<pad>": 0, "sí": 2}
    page = '{"items": [{"question_id": 7, "title": "T&iacute;tulo largo", "body": "<p>Un cuerpo &amp; m&aacute;s de veinte letras</p>", "tags": ["C#", "css"]}, {"question_id": 8, "title": "corto", "body": "x"}], "has_more": true, "quota_remaining": 3}'
    (tmp_path / "p.json").write_text(page, encoding="utf-8")
    rows = RD.question_candidates(RD.read_pages(spark, str(tmp_path / "p.json"), "tag:css")).collect()
    assert [(r["title"], r["body"], r["domain"], r["source_strategy"]) for r in rows] == [("Título largo", "Un cuerpo & más de veinte letras", "backend", "tag:css")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "á\n\"b\"", ["x"]), (2, None, [])], "i int, t string, a array<string>")
    for fmt in ("parquet", "json"):
        WR.write_table(df, str(tmp_path / fmt), fmt)
        assert sorted(RD.read_table(spark, str(tmp_path / fmt), df.schema, fmt).collect()) == sorted(df.collect())
    WR.append_audit(df, str(tmp_path / "log"))
    WR.append_audit(df, str(tmp_path / "log"))
    assert spark.read.schema(df.schema).json(str(tmp_path / "log")).count() == 4


FRAMES = [
    ("a", 1, 'data: {"token": "Ho"}'), ("a", 2, 'data: {"token": "la"}'), ("a", 3, "data: [DONE]"), ("a", 4, 'data: {"type": "usage", "provider": "p", "tokens_input": 3, "tokens_output": 2, "latency_ms": 1}'),
    ("b", 1, ": ping"), ("b", 2, "data: {mal"), ("b", 3, 'data: {"token": "x"}'), ("b", 4, 'data: {"error": "e", "detail": "caída"}'), ("b", 5, 'data: {"token": "tarde"}'),
    ("c", 1, 'event: m\ndata: {"token":\ndata: "dos"}'),
]


def frames(spark):
    rows = spark.createDataFrame(FRAMES, "request_id string, seq long, frame string")
    return rows.withColumn("ts", F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("seq") * 250_000))


def assembled(rows):
    return {r["request_id"]: (r["status"], r["response"], r["error"], r["tokens_input"], r["latency_ms"]) for r in rows}


EXPECTED = {"a": ("done", "Hola", None, 3, 750), "b": ("error", "x", "caída", 0, 500), "c": ("done", "dos", None, 0, 0)}


def test_assembly_static_and_streamed(spark, tmp_path):
    static = X.assemble_responses(X.route_events(X.parse_sse(frames(spark))))
    assert assembled(static.collect()) == EXPECTED
    for seq in (1, 2, 3, 4, 5):
        frames(spark).where(F.col("seq") == seq).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames(spark).schema).parquet(str(tmp_path / "in"))
    clocked = stream.unionByName(X.heartbeat(stream, "2023-11-15 00:00:00"))
    out = X.replay(X.assemble_responses(X.route_events(X.parse_sse(clocked))), "responses")
    assert assembled(out.collect()) == EXPECTED


def test_late_frames_are_dropped(spark, tmp_path):
    path = str(tmp_path / "in")
    on_time = frames(spark)
    late = on_time.where("request_id = 'a' and seq = 1").withColumn("frame", F.lit('data: {"token": "TARDE"}'))
    clock = spark.createDataFrame([("z", 1, 'data: {"token": "z"}')], "request_id string, seq long, frame string").withColumn("ts", F.timestamp_micros(F.lit(1_700_009_000_000_000)))
    # the batch after the clock closes the sessions, the one after that drops late rows
    for part in (on_time, clock, clock, late):
        part.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(on_time.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = X.replay(X.assemble_responses(X.route_events(X.parse_sse(stream))), "late")
    assert assembled(out.collect()) == EXPECTED


def test_reframe_carries_cut_frames(spark):
    whole = "data: 1\n\ndata: 2\n\ndata: 3"
    chunks = [("r", i, whole[i * 5 : i * 5 + 5]) for i in range(6)]
    df = spark.createDataFrame(chunks, "request_id string, seq long, chunk string").withColumn("ts", F.current_timestamp())
    assert [r["frame"] for r in X.reframe(df).orderBy("seq").collect()] == ["data: 1", "data: 2"]


def test_linear_heads_learn(spark, tmp_path):
    words = {h: [f"{h.replace('_', '')}{chr(97 + i)}" for i in range(len(fixed.LABELS[h]))] for h in fixed.HEADS}
    rng = random.Random(0)
    rows = []
    for i in range(240):
        pick = {h: rng.randrange(len(fixed.LABELS[h])) for h in fixed.HEADS}
        rows.append((i, " ".join(words[h][k] for h, k in pick.items()), *[fixed.LABELS[h][k] for h, k in pick.items()]))
    df = spark.createDataFrame(rows, "ord long, texto string, " + ", ".join(f"{h} string" for h in fixed.HEADS))
    models = SC.fit_heads(df, buckets=1 << 10, max_iter=15, reg=0.001)
    models.save(str(tmp_path / "m"))
    loaded = SC.HeadModels.load(str(tmp_path / "m"), buckets=1 << 10)
    guess = SC.with_prediction(SC.logits_long(SC.score(df, loaded), ["ord"]))
    row = M.metrics(M.join_predictions(M.index_labels(df), guess.select("ord", "head", "y_pred"), "ord")).first()
    assert row["f1_macro_mean"] > 0.95
    views = SC.with_prediction(SC.score_views(df, loaded)).select("ord", "head", F.col("y_pred").alias("v"))
    assert views.join(guess, ["ord", "head"]).where("v <> y_pred").count() == 0


def test_heads_read_a_text_once(spark):
    read = spark.sparkContext.accumulator(0)

    def text(i):
        read.add(1)
        return f"w{i % 7} u{i % 3}"

    labels = [f"if(id % 2 = 0, '{fixed.LABELS[h][0]}', '{fixed.LABELS[h][1]}') AS {h}" for h in fixed.HEADS]
    df = spark.range(0, 60, numPartitions=3).selectExpr("id AS ord", *labels).withColumn("texto", F.udf(text)("ord"))
    SC.fit_heads(df, buckets=1 << 8, max_iter=2)
    assert read.value == 60


def test_views_cut_a_text_once(spark):
    df = spark.createDataFrame([(1, "Uno dos tres cuatro cinco"), (2, ""), (3, "uno, DOS")], "ord long, texto string")
    views = SC.view_rows(df, 2)
    plan = views._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    got = sorted((r["ord"], r["view"], r["toks"]) for r in views.collect())
    assert got == [
        (1, 0, ["uno", "dos"]), (1, 1, ["cuatro", "cinco"]), (1, 2, ["uno", "cinco"]), (1, 3, ["dos", "tres"]),
        (2, 0, []), (3, 0, ["uno", "dos"]),
    ]


def test_a_model_table_is_the_count_model(spark):
    import hashlib
    import math

    from lectern.operators import linear_tables as LT

    rng = random.Random(8)
    rows = []
    for i in range(80):
        label = {h: rng.choice([*fixed.LABELS[h], None]) for h in fixed.HEADS}
        words = [rng.choice("abcdef") * rng.randint(1, 3) for _ in range(rng.randint(0, 12))] + [f"{h[0]}{chr(97 + fixed.LABELS[h].index(x))}" for h, x in label.items() if x]
        rows.append((i, " ".join(words) if i % 9 else None, *label.values()))
    df = spark.createDataFrame(rows, "ord long, texto string, " + ", ".join(f"{h} string" for h in fixed.HEADS))
    slot = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:4], 16)
    toks = {r[0]: [slot(w) for w in (r[1] or "").split()] for r in rows}
    want = {i: {} for i in toks}
    for k, h in enumerate(fixed.HEADS):
        truth = {r[0]: fixed.LABELS[h].index(r[2 + k] or fixed.HEAD_DEFAULT[h]) for r in rows}
        size = len(fixed.LABELS[h])
        of = [[t for i, ts in toks.items() if truth[i] == c for t in ts] for c in range(size)]
        share = [math.log((sum(t == c for t in truth.values()) + 0.5) / (len(rows) + 0.5 * size)) for c in range(size)]
        for i, own in toks.items():
            want[i][h] = [share[c] + sum(math.log((of[c].count(t) + 0.5) / (len(of[c]) + 0.5 * 65536)) for t in own) for c in range(size)]
    model = LT.fit_table(df)
    for got in (LT.score_texts(df, model), LT.score_text_views(df, model)):
        found = {r["ord"]: r for r in got.collect()}
        assert len(found) == 80
        for i, heads in want.items():
            for h, values in heads.items():
                assert list(found[i][f"logits_{h}"]) == pytest.approx(values, rel=1e-9), (i, h)
    empty = LT.fit_table(df.limit(0))
    assert LT.score_texts(df, empty).count() == 80


def test_tokens_are_not_shuffled_for_scores(spark, sf):
    import re

    from lectern.operators import linear_tables as LT
    from lectern.workloads.base import final_rows

    rows = final_rows(spark, sf)
    model = LT.fit_table(rows).localCheckpoint()
    for df in (LT.score_texts(rows, model), LT.score_text_views(rows, model)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(ord" in plan and not re.search(r"hashpartitioning\([^)]*bucket", plan)
