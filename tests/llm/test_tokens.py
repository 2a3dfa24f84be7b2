"""BPE against the tiktoken library, pieces and packing against the tokenizers library and loops."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from lectern.llm import bpe, packing  # noqa: E402

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "\n\n \t", "a", "don't  stop", "aaaaaaaaaaaaaaaaaaaaaaaa", "Straße ÉÈ ñandú 数据 🙂🙂", "é ́x", "x" * 700,
    "word " * 3000, "\x1c\u0085  　end", "12345 67 8.9", "ΣΑΣ ΟΔΟΣ", "\x00\x01", "ab" * 400 + " ba", "<|endoftext|> x",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    letters = "aeiou tnrsh\n.,'1É數🙂"
    return ODD + ["".join(rng.choices(letters, k=rng.randint(1, 400))) for _ in range(60)]


@pytest.fixture(scope="module")
def table(spark, texts):
    rows = [(i if i != 3 else None, t, "ids", i) for i, t in enumerate(texts)] + [(7, texts[7], "again", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n_tokens int").repartition(3)


def test_ids_are_those_of_the_library(table):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = bpe.encode(table.select("doc_id", "text", "ids", "n_tokens"), RANKS, public_tokenizers.PATTERN).collect()
    want = {}
    for r in table.collect():
        want.setdefault(r.doc_id, np.array(library.encode_ordinary(r.text or ""), dtype="<u4").tobytes())
    assert len(coded) == table.count()
    for r in coded:
        assert bytes(r.ids) == want[r.doc_id] and r.n_tokens == len(r.ids) // 4


def test_round_trip(table):
    coded = bpe.encode(table, RANKS, public_tokenizers.PATTERN)
    got = sorted((str(r.doc_id), bytes(r.decoded)) for r in bpe.decode(coded, RANKS).collect())
    assert got == sorted((str(r.doc_id), (r.text or "").encode()) for r in table.collect())


def test_long_pieces_and_lanes_agree():
    ranks, rng = bpe.load_ranks(RANKS), random.Random(1)
    made = [bytes(rng.choices(b"abth e", k=rng.randint(2, 250))) for _ in range(200)]
    made = [p for p in made if p not in ranks.ranks]
    assert bpe.encode_pieces(made, ranks) == {p: bpe._encode_long(p, ranks) for p in made}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    coded = bpe.encode(empty, RANKS, public_tokenizers.PATTERN)
    assert bpe.decode(coded, RANKS).count() == 0
    assert packing.pack(packing.pieces(empty, WORDS)).count() == 0


def test_query_digests(spark, sf):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in bpe.op6_bpe(spark, sf).collect():
        ids = np.array(library.encode_ordinary(docs[r.doc_id]), dtype="<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def _library_pieces(texts, most):
    from tokenizers import Tokenizer

    tokenizer, out = Tokenizer.from_file(WORDS), []
    for text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append([np.array(ids[i:i + most], dtype="<u4") for i in range(0, len(ids), most)])
    return out


def test_pieces_are_those_of_the_library(table):
    limits = packing.Limits(tokens=512)
    got = packing.pieces(table, WORDS, limits, with_ids=True).collect()
    rows = table.collect()
    want = sorted(
        (str(r.doc_id), k, 512 * k, len(p), zlib.crc32(p.tobytes()), p.tobytes())
        for r, parts in zip(rows, _library_pieces([r.text for r in rows], 512), strict=True) for k, p in enumerate(parts)
    )
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == want


def _valid(rows, limits):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        ends = np.cumsum([n for _, n in parts])
        assert [o for o, _ in parts] == [0, *ends[:-1].tolist()]
        assert ends[-1] <= limits.tokens and len(parts) <= limits.documents
        assert sum(n * n for _, n in parts) <= limits.attention
    return len(bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_constraint_holds(spark, rule):
    rng = np.random.default_rng(3)
    lengths = np.minimum(100, rng.geometric(0.04, 900))
    limits = packing.Limits(100, 6, 5500.0 if rule == "dot" else 12_000.0, (1.0, 0.5, 0.5), rule)
    lengths = lengths[lengths.astype(float) ** 2 <= limits.attention]
    found = spark.createDataFrame([(i, 0, int(n)) for i, n in enumerate(lengths)], "doc_id bigint, piece int, length bigint")
    rows = packing.pack(found, limits, group_rows=150).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(lengths)))
    used = _valid(rows, limits)
    assert used <= 1.25 * max(lengths.sum() / 100, len(lengths) / 6, (lengths.astype(float) ** 2).sum() / limits.attention) + 2


def test_packs_tightly(spark, sf):
    rows = packing.op5_packing(spark, sf).collect()
    used = _valid(rows, packing.Limits())
    first_fit, full = [], sum(r.length for r in rows)
    for n in sorted((r.length for r in rows), reverse=True):
        at = next((i for i, room in enumerate(first_fit) if room >= n), None)
        if at is None:
            first_fit.append(4096 - n)
        else:
            first_fit[at] -= n
    assert -(-full // 4096) <= used <= len(first_fit) + 1


def test_too_large_a_piece_is_refused():
    with pytest.raises(ValueError, match="capacities"):
        packing.best_fit(np.array([5, 11]), packing.Limits(tokens=10))


def test_arrow_table_order_is_kept():
    bins, offsets = packing.best_fit(np.array([4, 6, 5, 5]), packing.Limits(tokens=10, attention=1e9))
    assert pa.array(bins).to_pylist() == [0, 0, 1, 1] and offsets.tolist() == [6, 0, 0, 5]


def test_no_group_holds_all_that_never_fills(spark):
    """Pieces of more than half a sequence never fill one; no task may get all of them."""
    rows = [(i, 0, 2049 + i % 2000) for i in range(1500)]
    found = spark.createDataFrame(rows, "doc_id bigint, piece int, length bigint")
    packed = packing.pack(found, group_rows=100).collect()
    groups = {}
    for r in packed:
        groups[r.sequence_id >> 28] = groups.get(r.sequence_id >> 28, 0) + 1
    assert len(packed) == 1500 and max(groups.values()) < 200
    assert _valid(packed, packing.Limits()) == 1500


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_index_finds_the_same_as_a_scan(rule):
    rng = np.random.default_rng(6)
    caps, weights = np.array([100.0, 6.0, 4000.0]), np.array([[1.0], [0.3], [0.3]])
    room = np.vstack([np.sort(rng.integers(1, 101, 700)), rng.integers(1, 7, 700), rng.integers(1, 4001, 700)]).astype(float)
    for size in range(1, 60):
        need = np.array([size, 1.0, size * size])
        fits = (room >= need[:, None]).all(axis=0)
        left, share = room / caps[:, None], (need / caps)[:, None]
        cost = -(weights * left * share).sum(axis=0) if rule == "dot" else (weights * (left - share) ** 2).sum(axis=0)
        at = packing._choice(room, need, caps, weights, rule)
        assert at < 0 if not fits.any() else fits[at] and abs(cost[at] - cost[fits].min()) < 1e-12
