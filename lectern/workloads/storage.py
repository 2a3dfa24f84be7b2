"""Sources and sinks: given tables written in the formats of the contract and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators.vocab import build_vocab, token_freq
from lectern.plans.scratch import scratch_path
from lectern.sources import readers as RD
from lectern.sources import writers as WR
from lectern.workloads.base import WS, query, r6, table
from lectern.workloads.models import VOCAB, docs

_DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@query("SELECT doc_id, sha256(text) AS text_key, lang, n_chars FROM documents")
def json_lines_table(spark, sf):
    path = scratch_path(spark, "docs-json")
    WR.write_table(table(spark, sf, "documents"), path, "json")
    back = RD.read_table(spark, path, _DOC_SCHEMA, "json")
    return back.select("doc_id", F.sha2("text", 256).alias("text_key"), "lang", "n_chars")


@query("SELECT doc_id, sha256(text) AS text_key, source, '[\"' || lang || '\",\"x\"]' AS tags FROM documents")
def csv_table(spark, sf):
    path = scratch_path(spark, "docs-csv")
    docs_ = table(spark, sf, "documents").select("doc_id", "text", "source", F.array("lang", F.lit("x")).alias("tags"))
    WR.write_table(docs_, path, "csv")
    back = RD.read_table(spark, path, "doc_id bigint, text string, source string, tags string", "csv")
    return back.select("doc_id", F.sha2("text", 256).alias("text_key"), "source", "tags")


@query("SELECT conv_id, turn, role, md5(text) AS text_key FROM conversations")
def json_arrays(spark, sf):
    """One JSON array document per message, with stray elements that have to be dropped."""
    path = scratch_path(spark, "arrays")
    said = table(spark, sf, "conversations")
    rows = F.to_json(F.array(F.struct("conv_id", "turn", "role", "text")))
    stray = F.regexp_replace(rows, "\\]\\z", ', 7, "x", null]')
    documents = said.select(F.concat(F.lit(" "), stray).alias("value"))
    documents.write.text(path)
    objects = RD.array_objects(spark.read.text(path), "conv_id bigint, turn bigint, role string, text string")
    return objects.select("conv_id", "turn", "role", F.md5("text").alias("text_key"))


@query("SELECT conv_id, turn, role, md5(text) AS text_key FROM conversations")
def json_array_file(spark, sf):
    """Every message in one JSON array file, with strays between the objects, read in byte ranges."""
    path = scratch_path(spark, "array-file")
    said = table(spark, sf, "conversations")
    note = F.when(F.col("turn") % 5 == 0, F.lit(', 7, "x } ]", null, [{"a": "]"}], ')).otherwise(",\n")
    order = ["conv_id", "turn"]
    # one file is one task to write; it is read by many
    rows = said.select(*order, F.concat(F.to_json(F.struct("conv_id", "turn", "role", "text")), note).alias("value"))
    edge = lambda at, text: spark.range(1).select(F.lit(at).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.lit(text).alias("value"))
    whole = edge(-1, " [").unionByName(rows).unionByName(edge((1 << 62), "null]"))
    whole.repartition(1).sortWithinPartitions(*order).select("value").write.option("lineSep", " ").text(path)
    out = RD.read_json_array(spark, path, "conv_id bigint, turn bigint, role string, text string")
    return out.select("conv_id", "turn", "role", F.md5("text").alias("text_key"))


@query(f"""
SELECT page_id AS question_id, 'landed:' || 'pages' AS source_strategy, page_id % 50 = 49 AS has_more, md5(trim(regexp_replace(
  regexp_replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&quot;', '"'), '&middot;', chr(183)), '&copy;', chr(169)), '&amp;?', '&', 'g'), '{WS}+', ' ', 'g'))) AS body_key
FROM pages WHERE length(url) >= 8
""")
def api_pages(spark, sf):
    """Web pages landed as API payloads of one item each, read as question candidates."""
    path = scratch_path(spark, "payloads")
    none = F.lit(None)
    item = F.struct(
        F.col("page_id").alias("question_id"), F.col("url").alias("title"), F.col("html").alias("body"),
        F.array(F.lit("python"), F.lit("c&amp;x")).alias("tags"), (F.col("page_id") % 20).cast("int").alias("score"),
        F.lit(1).alias("view_count"), F.lit(0).alias("answer_count"), none.cast("long").alias("creation_date"), F.col("url").alias("link"),
    )
    payloads = table(spark, sf, "pages").select(
        F.array(item).alias("items"), (F.col("page_id") % 50 == 49).alias("has_more"), F.lit(99).alias("quota_remaining"), none.cast("double").alias("backoff")
    )
    payloads.write.json(path)
    found = RD.question_candidates(RD.read_pages(spark, path, "landed:pages"))
    return found.select("question_id", "source_strategy", "has_more", F.md5("body").alias("body_key"))


@query("""
SELECT 'w' || CAST(vec_id AS VARCHAR) AS word, round(CAST(embedding[1] AS DOUBLE), 5) AS first_value, round(list_sum([x::DOUBLE FOR x IN embedding]), 5) AS total
FROM embeddings
""")
def vector_lines(spark, sf):
    path = scratch_path(spark, "vectors")
    rows = table(spark, sf, "embeddings")
    numbers = F.array_join(F.col("embedding").cast("array<string>"), " ")
    good = rows.select(F.concat(F.lit("w"), F.col("vec_id").cast("string"), F.lit(" "), numbers).alias("value"))
    short = rows.select(F.concat(F.lit("short"), F.col("vec_id").cast("string"), F.lit(" 0.5")).alias("value"))
    broken = rows.select(F.concat(F.lit("bad"), F.col("vec_id").cast("string"), F.lit(" x"), F.substring(numbers, 2, 1 << 20)).alias("value"))
    good.unionByName(short).unionByName(broken).write.text(path)
    vectors = RD.read_vec(spark, path, 64)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return vectors.select("word", F.round(F.get("vec", F.lit(0)).cast("double"), 5).alias("first_value"), F.round(total, 5).alias("total"))


@query(f"WITH {VOCAB}\nSELECT word, idx FROM vocab")
def vocab_table(spark, sf):
    """The vocabulary through its sink and back."""
    path = scratch_path(spark, "vocab-out")
    WR.write_vocab(build_vocab(token_freq(docs(spark, sf))), path)
    return RD.read_table(spark, path, "word string, idx int, freq bigint").select("word", "idx")


@query("""
SELECT split, count(*) AS n_rows, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM (
  SELECT CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, n_chars FROM documents) GROUP BY 1
""")
def split_files(spark, sf):
    """A table written in one file set per split and read as one table; a missing path is empty."""
    root = scratch_path(spark, "splits")
    rows = table(spark, sf, "documents")
    paths = {}
    for i, name in enumerate(("train", "val", "test")):
        paths[name] = f"{root}/{name}"
        WR.write_table(rows.where(F.col("doc_id") % 3 == i), paths[name])
    back = RD.read_splits(spark, paths, _DOC_SCHEMA)
    absent = RD.read_optional(spark, f"{root}/absent", _DOC_SCHEMA).withColumn("split", F.lit("absent"))
    return back.unionByName(absent).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_chars").alias("n_chars"))


@query("""
SELECT event_type AS stage, count(*) AS n FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1
""")
def audit_log(spark, sf):
    """Two appends to an audit log."""
    path = scratch_path(spark, "audit")
    events = table(spark, sf, "events").select("event_id", F.col("event_type").alias("stage"))
    for kind in ("error", "signup"):
        WR.append_audit(events.where(F.col("stage") == kind), path)
    back = RD.read_table(spark, path, "event_id bigint, stage string", "json")
    return back.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type AS stage, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, count(DISTINCT md5(props)) AS n_props FROM events GROUP BY 1")
def stream_audit(spark, sf):
    """Events as a stream into the audit log, every batch run twice as after a failure, and the log read back."""
    events = table(spark, sf, "events").select("event_id", F.col("event_type").alias("stage"), F.md5("props").alias("props_key"))
    landed, log, state = (scratch_path(spark, f"audit-{x}") for x in ("in", "log", "state"))
    for part in range(3):
        events.where(F.pmod("event_id", F.lit(3)) == part).write.mode("append").parquet(landed)
    sink = WR.audit_batches(log)

    def twice(batch, batch_id):
        sink(batch, batch_id)
        sink(batch, batch_id)

    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(landed)
    stream.writeStream.foreachBatch(twice).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    back = RD.read_table(spark, log, "event_id bigint, stage string, props_key string", "json")
    return back.groupBy("stage").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), F.count_distinct("props_key").alias("n_props"))


@query("""
SELECT section, count(*) AS n_rows, round(sum(value), 6) AS total FROM (
  SELECT 'lang' AS section, CAST(count(*) AS DOUBLE) AS value FROM documents GROUP BY lang UNION ALL SELECT 'source', CAST(count(*) AS DOUBLE) FROM documents GROUP BY source) GROUP BY 1
""")
def report_document(spark, sf):
    """A long report written as one document per section and read back."""
    path = scratch_path(spark, "report")
    rows = table(spark, sf, "documents")
    parts = [
        rows.groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(c).alias("section"), "key", "value")
        for c in ("lang", "source")
    ]
    WR.write_report(parts[0].unionByName(parts[1]), path)
    back = RD.read_table(spark, path, "section string, rows array<struct<key:string,value:double>>", "json")
    flat = back.select("section", F.inline("rows"))
    return flat.groupBy("section").agg(F.count(F.lit(1)).alias("n_rows"), r6(F.sum("value")).alias("total"))


@query("""
SELECT '42' AS seed, count(*) FILTER (WHERE doc_id % 2 = 0) AS even, count(*) FILTER (WHERE doc_id % 2 = 1) AS odd FROM documents
""")
def run_manifest(spark, sf):
    counts = table(spark, sf, "documents").agg(
        F.count_if(F.col("doc_id") % 2 == 0).alias("even"), F.count_if(F.col("doc_id") % 2 == 1).alias("odd")
    ).first()
    row = WR.run_manifest(spark, {"seed": 42, "input": sf}, counts.asDict())
    return row.select(F.col("settings")["seed"].alias("seed"), F.col("counts")["even"].alias("even"), F.col("counts")["odd"].alias("odd"))
