"""Toxicity, quality and language-model scores: parts against loops, wholes on planted texts."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import lm_score, quality, toxicity

GOOD = [f"{a}{b}" for a in ("the", "an", "or", "in", "re", "st") for b in ("", "at", "ing", "er", "ion")]
FOUL = ["zblargh", "zblorgh", "zblurgh"]


@pytest.fixture(scope="module")
def corpus():
    """Texts of one kind of words; some with foul words, some junk; labels; odd rows."""
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(400):
        words = rng.choices(GOOD, k=rng.randint(20, 80))
        toxic, good = i % 4 == 0, i % 5 != 1
        if not good:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = rng.choices(FOUL, k=4)
        docs.append((i, " ".join(words)))
        if i % 10 != 9:
            labels.append((i, int(good), int(toxic)))
    docs += [(400, None), (401, ""), (402, " \n "), (None, docs[0][1]), (403, "w " * 30_000), docs[7], docs[7]]
    labels += [(2, 1, 0), (None, 1, 1), (500, None, None)]
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark, corpus):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in corpus[0]], "doc_id bigint, text string, score string, label int").repartition(3)
    return docs, spark.createDataFrame(corpus[1], "doc_id bigint, quality int, toxic int")


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


def brute_segments(scores):
    """Ruzzo and Tompa's definition by recursion: the best segment, then what lies left and right of it."""
    best = None
    for a in range(len(scores)):
        for b in range(a, len(scores)):
            total = sum(scores[a:b + 1])
            if total > 1e-12 and (best is None or total > best[0] + 1e-12):
                best = (total, a, b)
    if best is None:
        return []
    _, a, b = best
    right = [(s, x + b + 1, y + b + 1) for s, x, y in brute_segments(scores[b + 1:])]
    return brute_segments(scores[:a]) + [best] + right


def test_all_maximal_segments():
    rng = random.Random(8)
    for _ in range(300):
        n, drift = rng.randint(1, 24), 0.25
        gains = {i: rng.randint(2, 9) * 0.37 for i in range(n) if rng.random() < 0.4}
        scores = [gains.get(i, 0.0) - drift for i in range(n)]
        found = toxicity.segments(sorted(gains.items()), drift)
        assert [(a, b) for _, a, b in found] == [(a, b) for _, a, b in brute_segments(scores)]
        for s, a, b in found:
            assert abs(s - sum(scores[a:b + 1])) < 1e-9


def test_toxic_texts_are_found(tables, corpus):
    docs, labels = tables
    model = toxicity.fit_toxicity(docs, labels)
    rows = toxicity.score_toxicity(docs, model).collect()
    assert len(rows) == len(corpus[0]) and all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        if r.doc_id is not None and r.doc_id < 400:
            assert (r.score >= 0.5) == (r.doc_id % 4 == 0), r
            assert bool(r.passages) >= (r.doc_id % 4 == 0)
        elif r.doc_id is not None:
            assert r.score < 0.5
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.5 for r in rows)


def test_filters_without_labels_or_rows(spark, tables):
    docs, labels = tables
    none, nothing = labels.limit(0), docs.limit(0)
    assert toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, none)).where("score >= 0.5").count() == 0
    assert {r.score for r in quality.score_quality(docs, quality.fit_quality(docs, none)).collect()} == {0.5}
    assert toxicity.score_toxicity(nothing, toxicity.fit_toxicity(nothing, labels)).count() == 0
    assert quality.score_quality(nothing, quality.fit_quality(nothing, labels)).count() == 0
    one = labels.where("toxic = 0 AND quality = 1")
    assert toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, one)).where("score >= 0.5").count() == 0
    assert {r.score for r in quality.score_quality(docs, quality.fit_quality(docs, one)).collect()} == {1.0}


def test_junk_is_found(tables):
    docs, labels = tables
    model = quality.fit_quality(docs, labels)
    rows = quality.score_quality(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    wrong = [r for r in rows if r.doc_id is not None and r.doc_id < 400 and (r.score >= 0.3) != (r.doc_id % 5 != 1)]
    assert len(wrong) <= 4
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.score >= 0.3 for r in rows)


def test_context_vectors_are_sums_over_neighbours(spark, corpus):
    texts = [t for _, t in corpus[0][:50]] + [None, "", "one"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    index, want, slots = quality.index_vectors(quality.WORDS, 1), np.zeros((quality.WORDS, quality.SIZE)), quality.Slots()
    for t in texts:
        ids = (slots.of(t) // quality.SHAPES).tolist()
        for i, w in enumerate(ids):
            for j in range(max(0, i - quality.WINDOW), min(len(ids), i + quality.WINDOW + 1)):
                if j != i:
                    want[w] += index[ids[j]]
    assert (quality.context_vectors(df) == want).all()


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(0)
    truth = rng.normal(0, 1, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-truth))).astype(float)
    assert 2.0 < quality.fit_temperature(truth * 3, y) < 4.5


def brute_base(docs):
    counts = {}
    for i, t in docs:
        if held(i) % 10:
            for w in [*(t or "").encode().lower().split(), b""]:
                counts[w] = counts.get(w, 0) + 1
    n, v, out = sum(counts.values()), len(counts), []
    for i, t in docs:
        words = [*(t or "").encode().lower().split(), b""]
        base = sum(np.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        out.append((i, held(i) % 10 == 0, len(words), sum(w in counts for w in words), n, base))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [lm_score.BLOCK_TOKENS, 500])
def test_counts_and_base_are_those_of_a_loop(tables, corpus, monkeypatch, block):
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", block)
    rows = lm_score.score_documents(tables[0]).collect()
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows), key=str)
    for a, b in zip(got, brute_base(corpus[0]), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5]))
    assert all(np.isfinite(r.score) and r.score < 0 and r.bits_per_byte > 0 for r in rows)
    fresh = [r for r in rows if r.held_out and r.n_tokens > 10]
    assert sum(r.score for r in fresh) > sum(r.base_score for r in fresh)


def test_scores_are_probabilities():
    """The mixed model's probabilities of all bytes after a beginning add up to one."""
    mixer = lm_score.Mixer([np.random.default_rng(k).integers(0, 9, (1 << size, 2)).astype(np.float32) for k, size in enumerate(lm_score.TABLES)])
    some = lm_score.Coded.of([b"abc", b"abd", b"zz" * 50, "é".encode()])
    mixer.learn(some)
    assert (mixer.lengths(some) > 0).all()
    # a word is coded up to its stop: sharing the beginning, two words differ by their last bytes only
    total = 0.0
    for last in range(256):
        if last != lm_score._STOP:
            coded = lm_score.Coded.of([b"ab" + bytes([last])])
            total += 2 ** -(mixer.lengths(coded)[0])
    assert 0 < total < 1


def test_scores_without_training_documents(spark):
    ids = [i for i in range(200) if held(i) % 10 == 0]
    rows = lm_score.score_documents(spark.createDataFrame([(i, "some words") for i in ids], "doc_id bigint, text string")).collect()
    assert len(rows) == len(ids) and all(r.n_known == 0 and r.train_tokens == 0 and np.isfinite(r.score) for r in rows)
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert lm_score.score_documents(empty).count() == 0


def test_better_than_the_base_on_real_texts(spark, sf):
    rows = [r for r in lm_score.op1_lm_score(spark, sf).collect() if not r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_order_of_words_counts(spark):
    """Words that always follow each other cost less in that order than shuffled."""
    rng, pairs = random.Random(4), [(f"a{i}x", f"b{i}y") for i in range(40)]
    train = [i for i in range(900) if held(i) % 10][:400]
    fresh = [i for i in range(900) if held(i) % 10 == 0][:40]
    rows = [(i, " ".join(w for p in rng.choices(pairs, k=40) for w in p)) for i in [*train, *fresh[:20]]]
    for i, (_, text) in zip(fresh[20:], rows[len(train):], strict=True):
        rows.append((i, " ".join(rng.sample(text.split(), 80))))
    got = {r.doc_id: r for r in lm_score.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for a, b in zip(fresh[:20], fresh[20:], strict=True):
        assert abs(got[a].base_score - got[b].base_score) < 1e-6 and got[a].score > got[b].score + 20


def test_word_codes_are_probabilities():
    """After any words, the codes' probabilities add up to one."""
    rng = np.random.default_rng(3)
    order = lm_score.Mixer([rng.integers(0, 9, (size, 2)).astype(np.float32) for size in lm_score.WORD_TABLES], lm_score.WORD_BITS)
    codes = np.arange(1 << lm_score.WORD_BITS, dtype=np.uint32)
    same = [np.full(len(codes), c, np.uint64) for c in (5, 77)]
    some = lm_score.Running(codes, np.full(len(codes), 2), same)
    order.learn(some)
    assert abs((2.0 ** -order.lengths(some)).sum() - 1) < 1e-9


def test_classes_see_every_training_document(spark):
    """The words of any one document, however late in hash order, have their say in the classes."""
    ids = spark.range(3600).withColumnRenamed("id", "doc_id")
    last = ids.where(lm_score.fold("doc_id", 10) != 0).orderBy(F.xxhash64("doc_id").desc()).first().doc_id
    text = F.when(F.col("doc_id") == last, "rareword " * 5).otherwise("common text")
    classes = lm_score.fit_classes(ids.withColumn("text", text), "doc_id", "text", 10, 0)
    slot = lm_score._slot(b"rareword")
    assert (classes[:, slot] > classes[:, :-1].min(axis=1)).any()


def test_spelling_is_learned_on_every_word(spark):
    words = spark.createDataFrame([(f"w{i}".encode(),) for i in range(100)], "word binary")
    # the map holds every bit of every byte, stops included
    assert lm_score.fit_mixer(words).map_[:, 0].sum() == sum(8 * len(f"w{i} ") for i in range(100))


def test_many_passages_are_counted_like_few():
    """Telling tokens inside of significant passages, for texts with one passage and with sixty."""
    model = toxicity.Toxicity({b"bad": 4.0, b"odd": 0.4}, rate=1.0, log_k=-3.0)
    for n in (1, 49, 60):
        tokens = ([b"bad"] * 6 + [b"plain"] * 80 + [b"odd"] + [b"plain"] * 80) * n
        row, found = model.features(tokens)
        hits = [at for at, _ in model.hits(tokens)]
        assert len(found) == n
        inside = sum(any(a <= at <= b for _, a, b in found) for at in hits)
        assert inside == 6 * n < len(hits)
        assert row[3] == pytest.approx(np.log1p(inside))


def test_the_labelled_sample_comes_as_arrays(tables, monkeypatch):
    docs, labels = tables
    seen, real = [], type(docs).collect

    def collect(self):
        seen.append(self.columns)
        return real(self)

    monkeypatch.setattr(type(docs), "collect", collect)
    model = quality.fit_quality(docs, labels)
    assert len(model.layers) == 4 and not any("x" in c for c in seen)


def test_scoring_tasks_keep_no_counts():
    import pickle

    mixer = lm_score.Mixer([np.random.default_rng(k).integers(0, 9, (1 << size, 2)).astype(np.float32) for k, size in enumerate(lm_score.TABLES)])
    some = lm_score.Coded.of([b"abc", b"abd", b"zz" * 50])
    sent = pickle.loads(pickle.dumps(mixer.scoring()))
    assert sent.counts == [] and (sent.lengths(some) == mixer.lengths(some)).all()
    # tables that learn are sent whole, whatever a worker has unpacked before
    again = pickle.loads(pickle.dumps(mixer))
    assert all((a == b).all() for a, b in zip(again.counts, mixer.counts, strict=True))
    own = again.fresh()
    own.learn(some)
    assert own.weights.any()


def test_tasks_that_learn_hold_only_counts():
    """What lookups need is made by the first text that is scored, not where weights are learned."""
    import pickle

    mixer = lm_score.Mixer([np.random.default_rng(k).integers(0, 9, (1 << size, 2)).astype(np.float32) for k, size in enumerate(lm_score.TABLES)])
    some = lm_score.Coded.of([b"abc", b"abd", b"zz" * 50])
    sent = pickle.loads(pickle.dumps(mixer))
    own = sent.fresh()
    own.learn(some)
    assert not sent.ready and not own.ready
    assert (sent.lengths(some) == mixer.lengths(some)).all()


def test_a_long_text_is_pooled_in_parts():
    import tracemalloc

    rng = np.random.default_rng(4)
    model, slots = quality.Quality(rng.normal(0, 1, (quality.WORDS, quality.SIZE))), quality.Slots()
    text = "a b c d e " * 60_000
    ids = slots.of(text) // quality.SHAPES
    want = (model.words[ids[:-1]] * model.words[ids[1:]]).sum(axis=1).mean()
    tracemalloc.start()
    row = model.pooled([text, "a"], slots)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert row[0, -2] == pytest.approx(want) and row[1, -2] == 0
    assert peak < 100e6


def test_tasks_hand_back_what_they_leave_free(monkeypatch):
    """A worker outlives its task; a following step of the pipeline has its memory."""
    import pyarrow as pa

    from lectern.llm import common

    done = []

    class Pool:
        def release_unused(self):
            done.append(True)

    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    monkeypatch.setattr(pa, "system_memory_pool", Pool)
    run = common.tidy(lambda batches: (b + 1 for b in batches))(iter([1, 2]))
    assert next(run) == 2 and not done
    assert list(run) == [3] and len(done) == 2


def test_packing_remembers_a_bounded_part_of_a_large_vocabulary(monkeypatch):
    from lectern.llm import packing

    monkeypatch.setattr(packing, "_word_ids", lambda tokenizer, new: ((w, w[:4]) for w in new))
    words = packing.Words.__new__(packing.Words)
    words.tokenizer, words.young, words.old, words.held = None, {}, {}, 0
    for at in range(0, 1_000_000, 10_000):
        text = [b"%07d" % i for i in range(at, at + 10_000)] + [b"often"]
        found = words.of([text])
        assert all(found[w] == w[:4] for w in text)
    assert len(words.young) + len(words.old) < 550_000 and b"often" in words.young


def test_learning_takes_a_word_out_of_its_own_counts_by_one_look():
    """What is looked up is the logit and the confidence of the counts without the word itself, at half the cost of counting anew."""
    counts = np.random.default_rng(2).integers(0, 40, (5000, 2)).astype(np.float32)
    counts[:4] = [[0, 1], [1, 0], [0, 0], [70_000, 1]]
    found = lm_score._apart(counts, together=700).reshape(-1, 2)
    for bit in (0, 1):
        left = counts.copy()
        left[:, bit] -= 1
        logit = np.log(np.maximum(left[:, 1], 0) + 0.3) - np.log(np.maximum(left[:, 0], 0) + 0.3)
        assert np.allclose(found[:, bit].copy().view(np.float32), logit, rtol=1e-5, atol=1e-5)
        assert (found[:, bit] & 3 == lm_score._confidence(left.sum(axis=1))).all()


def test_a_worker_that_learns_has_one_table_a_predictor():
    import pickle

    mixer = lm_score.Mixer([np.random.default_rng(k).integers(0, 9, (1 << size, 2)).astype(np.float32) for k, size in enumerate(lm_score.TABLES)])
    some = lm_score.Coded.of([b"abc", b"abd", b"zz" * 50])
    here, sent = mixer.fresh(), pickle.loads(pickle.dumps(mixer))
    there = sent.fresh()
    here.learn(some)
    there.learn(some)
    assert (here.weights == there.weights).all() and (here.map_ == there.map_).all()
    again = pickle.loads(pickle.dumps(mixer))  # as the next task of that worker
    assert again.apart is sent.apart and again._counts is None
    assert sum(x.nbytes for x in sent.apart) == sum(8 << size for size in lm_score.TABLES)


def test_prices_travel_in_as_few_bytes_as_they_need():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    numbers = rng.integers(0, 200, (900, 1 + lm_score.CLASSES))
    numbers[5, 2], numbers[6, 0], numbers[7, 6], numbers[8] = 256, 65_536, 1 << 32, (1 << 62)
    back, words = -rng.random(900) * 2000, pa.array([b"w%d" % i for i in range(900)])
    batches = list(lm_score._prices(words, back, numbers))
    sizes = np.concatenate([[len(p) for p in b.column(1).to_pylist()] for b in batches])
    assert len(sizes) == 900 and (sizes == 11).sum() == 896 and sizes.max() == 60
    at = pa.Table.from_batches(batches).take(pa.array(rng.permutation(900)))
    places = np.array([int(w[1:]) for w in at.column("word").to_pylist()])
    for column in (at.column("price"), pa.chunked_array([at.column("price").combine_chunks().slice(0, 400), at.column("price").combine_chunks().slice(400)])):
        got, found = lm_score._unpriced(places, column)
        assert (got == back.astype(np.float32)).all() and (found.T == numbers).all()


def test_other_steps_let_go_of_what_a_worker_keeps_for_packing(monkeypatch):
    from pyspark import cloudpickle

    from lectern.llm import common

    monkeypatch.setattr(common, "_KEPT", {})
    sent = [cloudpickle.loads(cloudpickle.dumps(common.tidy(lambda b: b, keeps))) for keeps in ("words", None)]
    first = common.kept("words", lambda: {b"a": b"1"})
    assert list(sent[0](iter([1]))) == [1] and common.kept("words", dict) is first
    assert list(sent[1](iter([1]))) == [1] and not common._KEPT
