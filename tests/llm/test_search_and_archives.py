"""Searches against brute force, archives by exact round trips, the pipeline by its parts."""

import base64
import hashlib
import io
import random

import numpy as np
import pytest

from lectern.llm import codes, vectors, warc


def brute_nearest(rows, k):
    ids = sorted(rows)
    v = np.array([rows[i] for i in ids], dtype=float)
    norms, out = np.sqrt((v * v).sum(axis=1)), {}
    for at, q in enumerate(ids):
        score = (v * v[at]).sum(axis=1) / (norms * norms[at])
        best = [j for j in np.lexsort((ids, -score)) if j != at][:k]
        out[q] = [(ids[j], score[j]) for j in best]
    return out


@pytest.fixture(scope="module")
def embeddings(spark):
    rng = np.random.default_rng(1)
    rows = {i: rng.normal(size=16).astype(np.float32).tolist() for i in range(300)}
    rows |= {i: rows[7] for i in range(300, 340)}
    bad = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] + [1.0] * 15), (904, [float("inf")] * 16), (905, []), (906, [1.0] * 3), (None, [1.0] * 16)]
    df = spark.createDataFrame([(i, v, 3) for i, v in [*rows.items(), *bad, (5, rows[5])]], "vec_id bigint, embedding array<float>, rank int")
    return rows, df.repartition(3)


def test_all_cells_give_the_exact_result(embeddings):
    rows, df = embeddings
    found = {}
    for r in vectors.nearest(df, df.where("vec_id % 50 = 0 OR vec_id > 899"), share=1.0).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    want = brute_nearest(rows, 5)
    assert set(found) == {i for i in rows if i % 50 == 0}
    for q, best in found.items():
        assert [best[k] for k in range(1, 6)] == want[q]


def test_few_cells_find_most(embeddings, monkeypatch):
    rows, df = embeddings
    monkeypatch.setattr(vectors, "PART_ROWS", 9)
    got = vectors.nearest(df, df, centroids=6, share=0.6).collect()
    want = brute_nearest(rows, 5)
    hits = sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in got)
    assert hits >= 0.7 * sum(map(len, want.values()))


def test_recall_at_the_registered_parameters(spark):
    """Two thousand given rows and as many again between them, searched as the query does."""
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = {r.vec_id: np.array(r.embedding, dtype=float) for r in given.collect()}
    rng, ids = np.random.default_rng(4), sorted(rows)
    more = {max(ids) + 1 + i: rows[a] * 0.7 + rows[b] * 0.3 for i, (a, b) in enumerate(rng.choice(ids, (len(ids), 2)))}
    rows = {i: v.astype(np.float32).tolist() for i, v in (rows | more).items()}
    df = spark.createDataFrame(list(rows.items()), "vec_id bigint, embedding array<float>").repartition(4)
    found = vectors.nearest(df, df.where("vec_id % 50 = 0")).collect()
    want = {q: {i for i, _ in best} for q, best in brute_nearest(rows, 5).items() if q % 50 == 0}
    assert len(found) == 5 * len(want)
    assert sum(r.vec_id in want[r.query_id] for r in found) >= 0.9 * len(found)


def test_walk_is_in_order_of_the_sum():
    rng = np.random.default_rng(0)
    a, b = rng.random(7), rng.random(5)
    cells = vectors.walk(a, b, np.ones(35, np.int64), 35)
    sums = [a[c // 5] + b[c % 5] for c in cells]
    assert sorted(cells) == list(range(35)) and sums == sorted(sums)
    assert len(vectors.walk(a, b, np.arange(35) % 2 * 10, 25)) == 3


def test_few_or_no_vectors(spark):
    schema = "vec_id bigint, embedding array<float>"
    empty = spark.createDataFrame([], schema)
    assert vectors.nearest(empty, empty).count() == 0
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], schema)
    assert [(r.query_id, r.vec_id) for r in vectors.nearest(two, two).orderBy("query_id").collect()] == [(1, 2), (2, 1)]


@pytest.mark.parametrize("part", [10_000, 40])
def test_codes_are_those_of_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(codes, "PART", part)
    monkeypatch.setattr(codes, "BLOCK", 15)
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    rows = {i: centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 9))) & (1 << 64) - 1 for i in range(150)}
    rows |= {i: rng.getrandbits(64) for i in range(150, 200)} | {i: rows[4] for i in range(200, 230)} | {230: 0, 231: (1 << 64) - 1}
    signed = {i: c - (1 << 64) if c >= 1 << 63 else c for i, c in rows.items()}
    df = spark.createDataFrame([*signed.items(), (3, signed[3]), (None, 5), (999, None)], "id bigint, code bigint")
    got = {}
    for r in codes.search_codes(df, df.where("id % 5 = 0"), 7).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.distance, r.id)
    for q in (i for i in rows if i % 5 == 0):
        want = sorted(((rows[q] ^ c).bit_count(), i) for i, c in rows.items() if i != q)[:7]
        assert [got[q][k] for k in range(1, 8)] == want


def test_few_codes(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 4)], "id bigint, code bigint")
    got = [(r.query_id, r["rank"], r.id, r.distance) for r in codes.search_codes(df, df).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2, 0), (1, 2, 3, 1), (2, 1, 1, 0), (2, 2, 3, 1), (3, 1, 1, 1), (3, 2, 2, 1)]
    assert codes.search_codes(df.limit(0), df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(6)
    rows = [(i, f"http://a.example/{i}", "<p>" + " ".join(rng.choices(["ab", "cd", "é🙂", "\r\n\r\n"], k=rng.randint(0, 200)))) for i in range(80)]
    rows += [(i, None, rows[3][2]) for i in range(100, 140)]
    rows += [(200, "x\r\ny", None), (201, "", ""), (None, "u", "alone"), (None, "u", rows[3][2]), (5, rows[5][1], rows[5][2]), (6, "other", "z" * 300_000)]
    return rows


@pytest.mark.parametrize("size", [32 << 20, 2000])
def test_archives_give_back_every_record(spark, pages, size):
    df = spark.createDataFrame([(*p, 1, "r") for p in pages], "page_id bigint, url string, html string, digest int, refers_to string").repartition(3)
    archives = warc.write_archives(df, archive_bytes=size)
    got = warc.read_archives(archives).collect()
    top = {}
    for i, _, h in pages:
        if i is not None:
            top[h or ""] = max(i, top.get(h or "", i))
    want = []
    for i, _, h in pages:
        data = (h or "").encode()
        refers = top[h or ""] if i is not None and i < top[h or ""] else None
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if refers is not None else "response", refers, None if refers is not None else data))
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload) if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert (archives.count() > 3) == (size == 2000)


def test_records_stand_alone_behind_the_dictionary():
    import zstandard

    records = [warc._record("response", str(i), f"http://x/{i}", "D", None, b"<html>some page text %d</html>" % i * 5) for i in range(400)]
    data = warc.archive(records, 4096)
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
    end = 8 + int.from_bytes(data[4:8], "little")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:end]))
    at, seen = io.BytesIO(data[end:]), []
    rest = at.read()
    while rest:
        one = reader.decompressobj()
        seen.append(one.decompress(rest))
        rest = one.unused_data
    assert seen == records


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.read_archives(warc.write_archives(empty)).count() == 0


def test_pipeline_stages_act_on_what_is_kept(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    from lectern.llm.line_dedup import dedupe_lines
    from lectern.llm.near_dedup import near_duplicates
    from lectern.plans.scratch import settle

    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = settle(stage(spark, docs, sf), "stage")
        assert out.columns == columns
        after = {r.doc_id for r in out.select("doc_id").collect()}
        assert after <= before
        if name == "line dedup":
            assert after == before
            assert dedupe_lines(out).where("n_dropped > 0").count() == 0
        if name == "near dedup":
            assert near_duplicates(out).where("NOT kept").count() == 0
        docs, before = out, after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == before
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()} == before
