"""Vector best-fit packing of token pieces into sequences.

An open sequence has three residual capacities: tokens, documents and attention cost (the sum of
squared piece lengths). A piece goes, longest first, to the open sequence that has room in all
three and the least weighted norm of what would be left (``rule="norm"``) or the greatest weighted
dot product of piece and residual (``rule="dot"``); if none has room, it opens a new one.

Pieces are dealt by a hash into groups of about ``group_rows``, each packed by one task. Sequences
that are not nearly full are opened again and their pieces dealt anew, until one group holds what
is left or a round fills few sequences: then all that are open are closed in their own groups. No
piece is dropped, and no task sees more than about ``group_rows`` pieces, however many are left.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import encoded, kept, query, slices, table, tidy
from lectern.plans.scratch import settle

#: Bytes of words and ids that a worker process remembers: twice as many at most, see :class:`Words`.
REMEMBERED = 40_000_000
#: Words whose ids are looked up by one call of the tokenizer.
_TOGETHER = 2000
#: The tokenizer lower-cases, and parts a letter from the one comma or full stop that ends a word; so words are
#: looked up without either.
_END = re.compile(rb"(?<=[a-z])([.,])(?=[\x20\x09-\x0D]|\Z)")
#: Bytes of text that are looked up at once.
_AT_ONCE = 2_000_000
#: Open sequences compared at once.
_LOOKED_AT = 128


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence, and the weights of the three in the choice."""

    tokens: int = 4096
    documents: int = 4096
    attention: float = 4096.0 * 4096.0
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"


def _word_ids(tokenizer, new: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """Ids of words that stand between white space; many words share one call."""
    for start in range(0, len(new), _TOGETHER):
        part = new[start:start + _TOGETHER]
        texts = [w.decode("utf-8") for w in part]
        ends = np.cumsum([len(t) + 1 for t in texts])
        found = tokenizer.encode(" ".join(texts), add_special_tokens=False)
        begins = np.array([o[0] for o in found.offsets], dtype=np.int64)
        ids = np.array(found.ids, dtype="<u4")
        cuts = np.searchsorted(begins, np.append(0, ends), side="left").tolist()
        flat = ids.tobytes()
        for i, word in enumerate(part):
            yield word, flat[4 * cuts[i]:4 * cuts[i + 1]]


class Words:
    """Ids of words, remembered in two maps: when the young one is full it becomes the old one, and words that
    are still asked for move on, so frequent words are never looked up again."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0

    def of(self, texts: list[list[bytes]]) -> dict[bytes, bytes]:
        """A map that has all words of the texts."""
        new = set().union(*texts).difference(self.young)
        if self.held > REMEMBERED:
            self.young, self.old, self.held = {}, self.young, 0
            new = set().union(*texts)
        moved = {w: self.old[w] for w in new if w in self.old} if self.old else {}
        moved.update(_word_ids(self.tokenizer, [w for w in new if w not in moved]))
        self.held += sum(len(w) + len(ids) + 150 for w, ids in moved.items())  # 150: two objects and their place
        self.young.update(moved)
        return self.young


def pieces(
    df: DataFrame, tokenizer_path: str, limits: Limits = Limits(), end_id: int = 1,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Every document's ids and ``end_id``, cut into pieces of at most ``limits.tokens``.

    Columns: ``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids``
    (packed little-endian). A null or empty text is the end id alone. The tokenizer drops white
    space, so words are looked up separately and remembered.
    """
    slim = df.select(F.col(id_col), F.col(text_col).alias("__text"))
    names = [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    name = f"words of {tokenizer_path}"
    closing, most = int(end_id).to_bytes(4, "little"), 4 * limits.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # tasks that follow each other find the words of those before
        words = kept(name, lambda: Words(tokenizer_path))
        for batch in slices(batches, 1, _AT_ONCE):
            texts = [_END.sub(rb" \1", encoded(t).lower()).split() for t in batch.column(1).to_pylist()]
            get = words.of(texts).__getitem__
            rows: list[tuple] = []
            for i, text in enumerate(texts):
                ids = b"".join(map(get, text)) + closing
                for k, at in enumerate(range(0, len(ids), most)):
                    part = ids[at:at + most]
                    rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part), part))
            columns = list(zip(*rows, strict=True))
            arrays = [batch.column(0).take(pa.array(columns[0]))]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            for j, kind in enumerate(kinds[:len(names) - 1], 1):
                arrays.append(pa.array(columns[j], kind))
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = slim.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return slim.mapInArrow(tidy(run, name), schema + (", ids binary" if with_ids else ""))


def _choice(room: np.ndarray, need: np.ndarray, caps: np.ndarray, weights: np.ndarray, rule: str) -> int:
    """The best open sequence with room for a piece, or -1. It is looked for from the best room for
    tokens on, as far as that room alone does not rule out what comes after."""
    n, share, at = room.shape[1], (need / caps)[:, None], -1
    first = int(np.searchsorted(room[0], need[0]))
    dot, best = rule == "dot", np.inf
    for k in range(first, n, _LOOKED_AT):
        a, b = (max(first, n - (k - first) - _LOOKED_AT), n - (k - first)) if dot else (k, min(n, k + _LOOKED_AT))
        part = room[:, a:b]
        if dot:
            least = -float(weights[0, 0] * part[0, -1] / caps[0] * share[0, 0] + (weights[1:] * share[1:]).sum())
        else:
            least = float(weights[0, 0] * (part[0, 0] / caps[0] - share[0, 0]) ** 2)
        if least > best:
            break
        fits = np.flatnonzero((part[1] >= need[1]) & (part[2] >= need[2]))
        if len(fits):
            left = part[:, fits] / caps[:, None]
            cost = -(weights * left * share).sum(axis=0) if dot else (weights * (left - share) ** 2).sum(axis=0)
            one = int(np.argmin(cost))
            if cost[one] < best:
                best, at = float(cost[one]), a + int(fits[one])
    return at


def best_fit(lengths: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, the pieces taken longest first."""
    caps = np.array([limits.tokens, limits.documents, limits.attention], dtype=np.float64)
    weights = np.asarray(limits.weights, dtype=np.float64)[:, None]
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room = np.empty((3, 1024))  # of the open sequences, in the order of their room for tokens
    label = np.empty(1024, np.int64)
    n = made = 0
    for i in order.tolist():
        size = float(lengths[i])
        need = np.array([size, 1.0, size * size])
        if (need > caps).any():
            raise ValueError(f"a piece of {int(size)} tokens is beyond the capacities of a sequence")
        at = _choice(room[:, :n], need, caps, weights, limits.rule)
        if at < 0:
            if n == len(label):
                room, label = np.hstack([room, np.empty_like(room)]), np.append(label, np.empty_like(label))
            room[:, n], label[n] = caps, made
            at, n, made = n, n + 1, made + 1
        bins[i], offsets[i] = label[at], limits.tokens - int(room[0, at])
        left, own = room[:, at] - need, label[at]
        if (left < 1).any():  # full: no piece has less than one token
            room[:, at:n - 1], label[at:n - 1] = room[:, at + 1:n], label[at + 1:n]
            n -= 1
        else:
            to = int(np.searchsorted(room[0, :at], left[0]))
            room[:, to + 1:at + 1], label[to + 1:at + 1] = room[:, to:at], label[to:at]
            room[:, to], label[to] = left, own
    return bins, offsets


def pack(
    found: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", group_rows: int = 20_000, full: float = 0.995
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with ``id_col``, ``piece`` and ``length``.

    Dealing goes on while a round fills sequences with a quarter of its rows or more.
    All columns stay. Repeated rows are pieces of their own. An empty table gives no row.
    """
    # numbered, so that rows of one id and piece are dealt apart as well
    rest, round_, done = settle(found.withColumn("__row", F.monotonically_increasing_id()), "pieces"), 0, []
    kinds = {f.name: f.dataType.simpleString() for f in rest.schema}
    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", sequence_id bigint, offset bigint, __full boolean"
    while True:
        left = rest.count()
        groups = max(1, -(-left // group_rows))

        first = round_ << 56

        def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
            rows = rows.drop_columns(["__group"]).sort_by([(id_col, "ascending"), ("piece", "ascending")])
            lengths = rows.column("length").to_numpy()
            bins, offsets = best_fit(lengths, limits)
            filled = np.bincount(bins, lengths) >= full * limits.tokens
            rows = rows.append_column("sequence_id", pa.array(bins + (key[0].as_py() << 28) + first))
            return rows.append_column("offset", pa.array(offsets)).append_column("__full", pa.array(filled[bins]))

        group = F.pmod(F.xxhash64("__row", F.lit(round_)), F.lit(groups))
        packed = settle(rest.withColumn("__group", group).groupBy("__group").applyInArrow(run, schema), "packed")
        if groups == 1 or 4 * packed.where("__full").count() < left:
            done.append(packed)
            break
        done.append(packed.where("__full"))
        rest, round_ = packed.where("NOT __full").select(*kinds), round_ + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("__full", "__row")


@query()
def op5_packing(spark, sf):
    """All documents, cut at 4096 tokens and packed into as few sequences as best fit finds."""
    import public_tokenizers as vocabularies

    found = pieces(table(spark, sf, "documents"), vocabularies.path("word_bpe_49k.json"))
    return pack(found)
