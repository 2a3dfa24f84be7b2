"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A leaf of the tree belongs to a byte position and holds the rank of the pair that starts there,
followed by the position, so the root holds the leftmost pair of least rank. A merge changes three
leaves (the merged pair, its left neighbour, the right half that is gone) and their paths to the
root: logarithmic point updates. Short pieces are merged side by side, one lane of a numpy array per
piece; pieces beyond ``LANE_BYTES`` bytes have a tree of their own.

Spark deals out the texts; a task remembers the pieces it has met in a map of bounded size.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import query, short_batches, table

LANE_BYTES = 256
#: Pieces a task remembers; the map starts anew beyond it.
REMEMBERED = 400_000
_NONE = np.int64(1) << 62


class Ranks:
    """Merge ranks: token bytes by id, ids of single bytes, and the pairs that merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.bytes_ = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.fromiter(pairs.keys(), dtype=np.int64, count=len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.values = np.append(np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))[order], -1)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], -1)


@lru_cache(maxsize=4)
def load_ranks(path: str) -> Ranks:
    with open(path, "rb") as lines:
        return Ranks({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())})


def _encode_lanes(pieces: list[bytes], size: int, ranks: Ranks) -> list[bytes]:
    """Merge pieces of at most ``size`` bytes, all at once; ``size`` is a power of two."""
    n, shift = len(pieces), 8
    lengths = np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), dtype=np.uint8).reshape(n, size)
    token = np.zeros((n, size + 1), dtype=np.int64)  # column ``size`` is a spare place for what lies outside
    token[:, :size] = ranks.bytes_[raw]
    place = np.arange(size)
    inside = place[None, :] < lengths[:, None]
    after = np.tile(np.append(np.arange(1, size + 1), size), (n, 1))
    after = np.where(after < lengths[:, None], after, size)
    before = np.tile(np.append(np.arange(-1, size - 1), size), (n, 1))
    before[:, 0] = size
    tree = np.full((n, 2 * size), _NONE, dtype=np.int64)
    pairs = inside[:, :-1] & inside[:, 1:]
    rank = np.full((n, size), -1, dtype=np.int64)
    rank[:, :-1][pairs] = ranks.pair(token[:, :size - 1][pairs], token[:, 1:size][pairs])
    tree[:, size:] = np.where(rank >= 0, rank << shift | place, _NONE)
    width = size
    while width > 1:
        width //= 2
        tree[:, width:2 * width] = np.minimum(tree[:, 2 * width:4 * width:2], tree[:, 2 * width + 1:4 * width:2])
    lanes = np.arange(n)
    while True:
        lanes = lanes[tree[lanes, 1] < _NONE]
        if not len(lanes):
            break
        root = tree[lanes, 1]
        at, merged = root & (1 << shift) - 1, root >> shift
        gone = after[lanes, at]
        right = after[lanes, gone]
        left = before[lanes, at]
        token[lanes, at] = merged
        after[lanes, at] = right
        before[lanes, right] = at
        before[:, size] = size
        inside[lanes, gone] = False

        def leaf(start, first, second, absent):
            found = ranks.pair(first, second)
            return np.where(absent | (found < 0), _NONE, found << shift | start)

        changed = np.stack([at, np.where(left < size, left, at), gone], axis=1) + size
        tree[lanes, at + size] = leaf(at, merged, token[lanes, right], right == size)
        has = left < size
        tree[lanes[has], left[has] + size] = leaf(left[has], token[lanes[has], left[has]], merged[has], False)
        tree[lanes, gone + size] = _NONE
        rows = lanes[:, None]
        while changed[0, 0] > 1:
            changed >>= 1
            tree[rows, changed] = np.minimum(tree[rows, 2 * changed], tree[rows, 2 * changed + 1])
    ids = token[:, :size].astype("<u4")
    counts = inside.sum(axis=1)
    flat = ids[inside].tobytes()
    ends = np.cumsum(counts) * 4
    return [flat[end - 4 * count:end] for end, count in zip(ends.tolist(), counts.tolist(), strict=True)]


def _encode_long(piece: bytes, ranks: Ranks) -> bytes:
    """The same for one piece of any length, with a tree of Python integers."""
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    token = ranks.bytes_[np.frombuffer(piece, dtype=np.uint8)]
    first = ranks.pair(token[:-1], token[1:])
    none = 1 << 62
    leaves = np.where(first >= 0, first << 32 | np.arange(n - 1), none).tolist()
    tree = [none] * size + leaves + [none] * (size - n + 1)
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    token = token.tolist()
    after, before, alive = list(range(1, n + 1)), list(range(-1, n)), bytearray(b"\1" * n)

    def put(at: int, value: int) -> None:
        at += size
        tree[at] = value
        while at > 1:
            at >>= 1
            value = min(tree[2 * at], tree[2 * at + 1])
            if tree[at] == value:
                break
            tree[at] = value

    @lru_cache(maxsize=4096)
    def rank_of(a: int, b: int) -> int:
        key = a << 32 | b
        i = int(np.searchsorted(ranks.keys, key))
        return int(ranks.values[i]) if ranks.keys[i] == key else -1

    while tree[1] < none:
        merged, at = tree[1] >> 32, tree[1] & 0xFFFFFFFF
        gone = after[at]
        right, left = after[gone], before[at]
        token[at], after[at], alive[gone] = merged, right, 0
        put(gone, none)
        rank = -1
        if right < n:
            before[right] = at
            rank = rank_of(merged, token[right])
        put(at, rank << 32 | at if rank >= 0 else none)
        if left >= 0:
            rank = rank_of(token[left], merged)
            put(left, rank << 32 | left if rank >= 0 else none)
    return np.array([t for t, live in zip(token, alive, strict=True) if live], dtype="<u4").tobytes()


def encode_pieces(pieces: Iterable[bytes], ranks: Ranks) -> dict[bytes, bytes]:
    """Ids of each distinct piece, as little-endian unsigned 32-bit integers."""
    out: dict[bytes, bytes] = {}
    sizes: dict[int, list[bytes]] = {}
    for piece in pieces:
        whole = ranks.ranks.get(piece)
        if whole is not None:
            out[piece] = whole.to_bytes(4, "little")
        elif len(piece) > LANE_BYTES:
            out[piece] = _encode_long(piece, ranks)
        elif piece:
            sizes.setdefault(1 << (len(piece) - 1).bit_length(), []).append(piece)
    for size, group in sizes.items():
        step = max(64, (1 << 18) // size)
        for start in range(0, len(group), step):
            lanes = group[start:start + step]
            out.update(zip(lanes, _encode_lanes(lanes, size, ranks), strict=True))
    return out


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens`` and ``ids`` (packed little-endian unsigned 32-bit) of every row's whole text.

    Each match of ``pattern`` is encoded separately, without special tokens. A null or empty text
    has no ids; repeated rows and null ids stay as they are; further columns are not read.
    ``ranks_path`` names the vocabulary file on every machine.
    """
    short_batches(df.sparkSession)
    slim = df.select(F.col(id_col), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        ranks, find = load_ranks(ranks_path), regex.compile(pattern).findall
        known: dict[str, bytes] = {}
        for batch in batches:
            found = [find(t) if t else [] for t in batch.column(1).to_pylist()]
            new = set().union(*found).difference(known)
            if len(known) + len(new) > REMEMBERED:
                known, new = {}, set().union(*found)
            named = {p: p.encode("utf-8", "replace") for p in new}
            coded = encode_pieces(set(named.values()), ranks)
            known.update((p, coded[b]) for p, b in named.items())
            get = known.__getitem__
            ids = [b"".join(map(get, pieces)) for pieces in found]
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(ids, pa.binary())], [id_col, "n_tokens", "ids"])

    kind = slim.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids binary")


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Replace the packed ids by ``out``, the bytes they stand for; null ids give no bytes."""
    short_batches(df.sparkSession)
    kept = [c for c in df.columns if c != ids_col]
    slim = df.select(*kept, F.col(ids_col).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = load_ranks(ranks_path).tokens.__getitem__
        for batch in batches:
            columns = batch.columns
            texts = [b"".join(map(get, np.frombuffer(x or b"", dtype="<u4").tolist())) for x in columns[-1].to_pylist()]
            yield pa.RecordBatch.from_arrays([*columns[:-1], pa.array(texts, pa.binary())], [*kept, out])

    fields = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in kept)
    return slim.mapInArrow(run, f"{fields}, `{out}` binary")


@query()
def op6_bpe(spark, sf):
    """Ids of every document and the text they decode to, as digests."""
    import public_tokenizers as vocabularies

    path = vocabularies.path("byte_bpe_multi_50k.tiktoken")
    ids = encode(table(spark, sf, "documents"), path, vocabularies.PATTERN)
    texts = decode(ids.withColumn("ids_sha256", F.sha2("ids", 256)), path)
    return texts.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
