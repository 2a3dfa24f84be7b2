"""Language-model scores of documents by logistic context mixing.

A word is coded bit by bit. For every bit several predictors look up how often it was 0 and 1 after a
hashed context: the last one to four bytes of the word, and the whole beginning of the word. Their
logits are combined by weights that are chosen by a gate (bit place and how much the two longest
contexts have seen) and learned online, batch after batch, with every word's own counts left out.
The result is refined by an adaptive map from (previous byte, mixed logit) to what really came. This
gives every word a length in bits, as if it had not been seen.

Words of the training documents are remembered with their counts, without a bound. A known word costs
what a second mixer says of its code (``WORD_BITS`` bits of its hash), and its share of the discounted
counts of the known words with that code; the discounts are handed to the spelling above for all other
words. The contexts of the second mixer cross words: the likeliest class of the text so far, the word
before, and the two words before, counted over the running text of all training documents. The same is
done once more inside ``CLASSES`` classes of documents (found by a mixture of unigrams on all training
documents), backed by the counts of all. A text is a sequence of words of one unknown class, so the
weights of the classes adapt from word to word by what was read so far.

How Spark does it: one pass writes how often the words of a document fall in each of ``CLASS_SLOTS``
slots, and each round of the mixture sums over these rows, a fixed-size table per task; one pass cuts the documents into blocks (numbers of words and the block's own
words, compressed) and counts what follows which words; one pass over the blocks learns the weights of
these contexts; spelling runs over distinct words. Counts are joined by word, so the vocabulary grows
with the corpus and is never collected. Only the predictor tables have a fixed size (``TABLES``,
``WORD_TABLES``), are added up over all words and handed to all tasks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import encoded, fold, query, short_batches, table
from lectern.plans.scratch import settle

#: Bits of the slot number of each predictor: one to four bytes, whole beginning.
TABLES = (16, 18, 19, 19, 20)
#: Words of a block, bytes that are learned together, and bytes that are coded together where nothing is learned.
BLOCK_TOKENS, CHUNK, SHORT_CHUNK = 5_000_000, 400_000, 50_000
#: Classes of documents, slots of their words, and documents that a row of slot counts holds.
CLASSES, CLASS_SLOTS, CLASS_TOGETHER = 6, 1024, 1000
_CLASS_COLUMNS = [f"c{z}" for z in range(CLASSES)]
#: Size of the steps of the weights.
RATE = 0.02
_LEVELS, _SLOTS = 24, 4096
#: Bits of a word's code, slots of each predictor of it (class so far, one word before, two words before), and words learned together.
WORD_BITS = 10
WORD_TABLES = (CLASSES << WORD_BITS, 1 << 21, 1 << 22)
LEARN_TOGETHER, COUNT_TOGETHER = 5000, 200_000
#: Words of a longer batch where nothing is learned.
GATHERED = 20_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STOP = 0x20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _slots_of(context: np.ndarray, of_node: np.ndarray, size: int) -> np.ndarray:
    """Slots of contexts at their places within a code, in a table of ``size`` bits."""
    x = context + of_node
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x >>= np.uint64(64 - size)
    return x.view(np.int64)


@dataclass
class Coded:
    """All bytes of some words, each word closed by a stop byte, and the hashes of their contexts."""

    bytes_: np.ndarray
    before: np.ndarray
    contexts: list[np.ndarray]
    starts: np.ndarray

    @classmethod
    def of(cls, words: list[bytes]) -> Coded:
        sizes = np.array([len(w) + 1 for w in words])
        starts = np.append(0, np.cumsum(sizes)[:-1])
        data = np.frombuffer(bytes([_STOP]).join(words) + bytes([_STOP]), dtype=np.uint8)
        place = np.arange(len(data)) - np.repeat(starts, sizes)
        wide = data.astype(np.uint64) + np.uint64(1)
        last = []
        for k in range(1, 5):
            shifted = np.zeros_like(wide)
            shifted[k:] = wide[:-k]
            shifted[place < k] = 0
            last.append(shifted)
        contexts, held = [], np.zeros_like(wide)
        for k, one in enumerate(last):
            held = _mixed(held * _MIX + one + np.uint64(k << 20))
            contexts.append(held)
        # a sum of bytes times a random number of their place tells beginnings apart
        sums = np.cumsum(wide * _mixed((place.astype(np.uint64) + np.uint64(1)) * _MIX))
        upto = np.append(np.uint64(0), sums[:-1])
        contexts.append(_mixed(upto - np.repeat(upto[starts], sizes) + place.astype(np.uint64)))
        return cls(data, last[0].astype(np.int64), contexts, starts)

    def steps(self) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        """For each bit place: the place, the bits, and the slot of each predictor."""
        node = np.ones(len(self.bytes_), np.uint64)
        for place in range(8):
            bit = (self.bytes_ >> np.uint8(7 - place)) & np.uint8(1)
            of_node = node * _MIX
            slots = [
                _slots_of(c, of_node, size)
                for c, size in zip(self.contexts, TABLES, strict=True)
            ]
            yield place, bit, slots
            node = node * np.uint64(2) + bit


@dataclass
class Running:
    """The words of some texts in their order: code, likeliest class before, hashes of the words before."""

    codes: np.ndarray
    before: np.ndarray
    contexts: list[np.ndarray]

    @classmethod
    def of(cls, keys: np.ndarray, flat: np.ndarray, sizes: np.ndarray, classes: np.ndarray) -> Running:
        """``keys``: hashes of the words, of which ``flat`` are the numbers in the texts; no context crosses texts."""
        starts = np.append(0, np.cumsum(sizes)[:-1]).astype(np.int64)
        own = keys.take(flat)
        slots = (own % np.uint32(CLASS_SLOTS)).astype(np.int64)
        best = before = None
        for z, row in enumerate(classes):
            each = row.take(slots)
            fit = np.cumsum(each)
            fit -= each
            fit += np.repeat(row[-1] - fit[starts], sizes)
            if best is None:
                best, before = fit, np.zeros(len(flat), np.int64)
            else:
                before[fit > best] = z
                np.maximum(best, fit, out=best)
        wide = own.astype(np.uint64) + np.uint64(1)
        one, two = np.zeros_like(wide), np.zeros_like(wide)
        one[1:], two[2:] = wide[:-1], wide[:-2]
        one[starts], two[starts], two[np.minimum(starts + 1, len(two) - 1)] = 0, 0, 0
        first = _mixed(one * _MIX + np.uint64(1))
        return cls(own >> np.uint32(32 - WORD_BITS), before, [first, _mixed((first + two) * _MIX + np.uint64(2))])

    @classmethod
    def over(cls, keys: np.ndarray, flat: np.ndarray, sizes: np.ndarray, classes: np.ndarray, only: np.ndarray | None = None, together: int = 20_000) -> Iterator[Running]:
        """The texts (those of ``only``) in parts of whole texts of about ``COUNT_TOGETHER`` words, each in runs of ``together``."""
        ends = np.append(0, np.cumsum(sizes))
        first = 0
        while first < len(sizes):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + COUNT_TOGETHER)))
            last = min(last, len(sizes))
            own = cls.of(keys, flat[ends[first]:ends[last]], sizes[first:last], classes)
            if only is not None:
                own = own.of_rows(np.repeat(only[first:last], sizes[first:last]))
            yield from own.parts(together)
            first = last

    def parts(self, together: int) -> Iterator[Running]:
        for at in range(0, len(self.codes), together):
            yield self.of_rows(slice(at, at + together))

    def of_rows(self, rows) -> Running:
        return Running(self.codes[rows], self.before[rows], [c[rows] for c in self.contexts])

    @property
    def starts(self) -> np.ndarray:
        return np.arange(len(self.codes))

    def steps(self) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        node = np.ones(len(self.codes), np.uint64)
        for place in range(WORD_BITS):
            bit = (self.codes >> np.uint32(WORD_BITS - 1 - place)) & np.uint32(1)
            slots, of_node = [(self.before << WORD_BITS) + node.view(np.int64)], node * _MIX
            for c, size in zip(self.contexts, WORD_TABLES[1:], strict=True):
                slots.append(_slots_of(c, of_node, size.bit_length() - 1))
            yield place, bit, slots
            node = node * np.uint64(2) + bit


def _key(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word) & 0xFFFFFFFF


def _unpacked(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a block's words, their numbers in the texts, and the texts' sizes."""
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block["packed"]), dtype=np.uint8)
    flat = np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel() if len(raw) else np.empty(0, np.uint32)
    return np.frombuffer(block["keys"], "<u4"), flat, np.array(block["sizes"])


def _parts(flat: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """First and last text (excluded) of parts of whole texts of about ``COUNT_TOGETHER`` words, and their words."""
    ends, first = np.append(0, np.cumsum(sizes)), 0
    while first < len(sizes):
        last = min(len(sizes), max(first + 1, int(np.searchsorted(ends, ends[first] + COUNT_TOGETHER))))
        yield first, last, flat[ends[first]:ends[last]]
        first = last


def _chunks(words: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of words of about ``size`` bytes, with the number of their first."""
    first, held = 0, 0
    for i, word in enumerate(words):
        held += len(word) + 1
        if held >= size:
            yield first, words[first:i + 1]
            first, held = i + 1, 0
    if first < len(words):
        yield first, words[first:]


_LOGS = np.log(np.arange(1 << 16) + 0.3).astype(np.float32)


def _log(counts: np.ndarray) -> np.ndarray:
    """log(count + 0.3) of whole numbers, which are small ones mostly."""
    out = _LOGS[np.minimum(counts, len(_LOGS) - 1).astype(np.int32)]
    large = counts >= len(_LOGS)
    if large.any():
        out[large] = np.log(counts[large] + 0.3)
    return out


def _logit(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _log(ones) - _log(zeros)


def _confidence(all_: np.ndarray) -> np.ndarray:
    return (all_ >= 0.5).astype(np.int64) + (all_ >= 2.5) + (all_ >= 12.5)


def _joined(zeros: np.ndarray, ones: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """Logit and confidence, looked up together: the confidence has the two lowest bits."""
    return _logit(zeros, ones).view(np.uint32) & ~np.uint32(3) | _confidence(all_).astype(np.uint32)


def _ready(counts: np.ndarray, together: int = 1 << 18) -> np.ndarray:
    """Logit and confidence of each slot."""
    out = np.empty(len(counts), np.uint32)
    for at in range(0, len(counts), together):
        c = counts[at:at + together]
        out[at:at + together] = _joined(c[:, 0], c[:, 1], c.sum(axis=1))
    return out


def _apart(counts: np.ndarray, together: int = 1 << 16) -> np.ndarray:
    """Logit and confidence of each slot without the word itself, at twice the slot and the word's own bit."""
    out = np.empty((len(counts), 2), np.uint32)
    for at in range(0, len(counts), together):
        c = counts[at:at + together]
        less, all_ = np.maximum(c - 1, 0), c.sum(axis=1) - 1
        out[at:at + together, 0] = _joined(less[:, 0], c[:, 1], all_)
        out[at:at + together, 1] = _joined(c[:, 0], less[:, 1], all_)
    return out.ravel()


_UNPACKED: dict[int, tuple] = {}


class Mixer:
    """Predictor tables, gated weights and the adaptive map."""

    learns = True

    def __init__(self, counts: list[np.ndarray], places: int = 8):
        """``counts``: for each predictor an array of (zeros, ones) by slot; the two longest contexts last."""
        self._counts, self._packed, self.ready, self.apart = counts, None, [], []
        self.weights = np.zeros((places * 4 * 4, len(counts) + 1))
        self.weights[:, :-1] = 0.4
        self.map_ = np.zeros((257 * _LEVELS, 2))

    @property
    def counts(self) -> list[np.ndarray]:
        """Tasks are sent the counts compressed and make of them what they look up, one table after the other."""
        return list(self._tables()) if self._counts is None else self._counts

    def _tables(self) -> Iterator[np.ndarray]:
        import zstandard

        if self._counts is not None:
            yield from self._counts
            return
        for one in self._packed if self.learns else []:
            yield np.frombuffer(zstandard.ZstdDecompressor().decompress(one), "<f4").reshape(-1, 2)

    def scoring(self) -> Mixer:
        """The same mixer for :meth:`lengths` alone: tasks do not keep the counts."""
        own = Mixer.__new__(Mixer)
        own.__dict__.update(self.__dict__, learns=False)
        return own

    def __getstate__(self) -> tuple:
        """Tables go to tasks compressed, as every executor writes what it is sent to its disk."""
        import zstandard

        if self._packed is None:
            self._packed = [zstandard.ZstdCompressor(level=1).compress(c.astype("<f4").tobytes()) for c in self._counts]
        return self._packed, self.weights, self.map_, self.learns

    def __setstate__(self, state: tuple) -> None:
        import zstandard

        self._packed, self.weights, self.map_, self.learns = state
        self._counts = None
        key = hash((*self._packed, self.learns))
        if key not in _UNPACKED:  # a worker unpacks tables once, not for every task
            _UNPACKED.clear()
            _UNPACKED[key] = [], []
            if not self.learns:
                for one in self._packed:
                    _UNPACKED[key][0].append(_ready(np.frombuffer(zstandard.ZstdDecompressor().decompress(one), "<f4").reshape(-1, 2)))
        self.ready, self.apart = _UNPACKED[key]
        if not self.learns:
            self._packed = []

    def fresh(self) -> Mixer:
        """The same tables with weights that have learned nothing."""
        own = Mixer.__new__(Mixer)
        own.__dict__.update(self.__dict__)
        own.weights, own.map_ = np.zeros_like(self.weights), np.zeros_like(self.map_)
        own.weights[:, :-1] = 0.4
        return own

    @staticmethod
    def _gate(place: int, found: list[np.ndarray]) -> np.ndarray:
        gate = (found[-1] & np.uint32(3)) * np.uint32(4)
        gate += found[-2] & np.uint32(3)
        gate += np.uint32(place * 16)
        return gate.astype(np.int64)

    def _mix(self, gate: np.ndarray, inputs: list[np.ndarray]) -> np.ndarray:
        weights = self.weights.T.astype(np.float32)
        x = weights[-1].take(gate)
        for own, one in zip(weights, inputs, strict=False):
            x += own.take(gate) * one
        return np.clip(x, -11.5, 11.5, out=x)

    @staticmethod
    def _cell(before: np.ndarray, x: np.ndarray) -> np.ndarray:
        return before * _LEVELS + ((x + 12.0) * (_LEVELS / 24.0)).astype(np.int64)

    def learn(self, coded: Coded) -> None:
        """One online step per bit place: weights along the coding error, then the map's counts."""
        if not self.apart:
            self.apart.extend(map(_apart, self._tables()))
        gates = len(self.weights)
        for place, bit, slots in coded.steps():
            y = bit.astype(np.float32)
            found = [apart.take(slot * 2 + bit) for apart, slot in zip(self.apart, slots, strict=True)]  # without the word itself
            gate, inputs = self._gate(place, found), [f.view(np.float32) for f in found]
            x = self._mix(gate, inputs)
            error = y - 1 / (1 + np.exp(-x))
            step = 20 * RATE / np.maximum(np.bincount(gate, minlength=gates), 50)
            for k, one in enumerate(inputs):
                self.weights[:, k] += step * np.bincount(gate, error * one, gates)
            self.weights[:, -1] += step * np.bincount(gate, error, gates)
            cell = 2 * self._cell(coded.before, x) + bit
            seen = np.bincount(cell, minlength=2 * (cell.max(initial=0) // 2 + 1)).reshape(-1, 2)
            self.map_[:len(seen), 0] += seen.sum(axis=1)
            self.map_[:len(seen), 1] += seen[:, 1]

    def lengths(self, coded: Coded) -> np.ndarray:
        """Bits of each word."""
        if not self.ready:
            self.ready.extend(map(_ready, self._tables()))
        product = np.ones(len(coded.before))  # of at most 10 probabilities, none below 1e-6
        middle = 1 / (1 + np.exp(-((np.arange(257 * _LEVELS) % _LEVELS + 0.5) * (24.0 / _LEVELS) - 12.0)))
        refined = 0.5 * (self.map_[:, 1] + 8 * middle) / (self.map_[:, 0] + 8)
        for place, bit, slots in coded.steps():
            found = [ready.take(slot) for ready, slot in zip(self.ready, slots, strict=True)]
            x = self._mix(self._gate(place, found), [f.view(np.float32) for f in found])
            # in double precision from here on, so that the probabilities of all words add up to one
            p = (np.float32(0.5) / (1 + np.exp(-x))).astype(np.float64)
            p += refined.take(self._cell(coded.before, x))
            np.clip(p, 1e-6, 1 - 1e-6, out=p)
            product *= np.abs((1 - bit.astype(np.int8)) - p)
        return np.add.reduceat(-np.log2(product), coded.starts)


def _slot(word: bytes) -> int:
    return _key(word) % CLASS_SLOTS


def _slot_counts(df: DataFrame, id_col: str, text_col: str, folds: int, held: int) -> DataFrame:
    """The training documents' words by slot, ``CLASS_TOGETHER`` documents a row: for each document the
    number of its slots (``sizes``), and its ``slots`` and ``counts`` one after the other, compressed."""
    training = df.where(fold(id_col, folds) != held).select(F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        sizes, slots, counts = [], [], []

        def row() -> pa.RecordBatch:
            flat = [np.array(sizes, "<i4"), np.concatenate(slots).astype("<u2"), np.concatenate(counts).astype("<i4")]
            return pa.RecordBatch.from_arrays([pa.array([pack(x.tobytes())], pa.binary()) for x in flat], ["sizes", "slots", "counts"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = encoded(text).lower().split()
                found = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).astype(np.uint32) % np.uint32(CLASS_SLOTS)
                n = np.bincount(found, minlength=CLASS_SLOTS)
                at = np.flatnonzero(n)
                sizes.append(len(at))
                slots.append(at)
                counts.append(n[at])
                if len(sizes) == CLASS_TOGETHER:
                    yield row()
                    sizes, slots, counts = [], [], []
        if sizes:
            yield row()

    return training.mapInArrow(run, "sizes binary, slots binary, counts binary")


def fit_classes(df: DataFrame, id_col: str, text_col: str, folds: int, held: int, rounds: int = 25) -> np.ndarray:
    """Log-probabilities of word slots in each class, by a mixture of unigrams on all training documents;
    the weight of the class is the last column.

    The first classes come from random word tables, so they differ as much at any number of documents.
    """
    written = settle(_slot_counts(df, id_col, text_col, folds, held), "slots")

    def expected(table_: np.ndarray, middle: np.ndarray) -> np.ndarray:
        """What each class would count of each slot, and its documents; ``middle`` is taken off per word."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import zstandard

            read = zstandard.ZstdDecompressor().decompress
            total = np.zeros((CLASSES, CLASS_SLOTS + 1))
            for batch in batches:
                for one in batch.to_pylist():
                    sizes, slots, counts = (np.frombuffer(read(one[c]), k) for c, k in (("sizes", "<i4"), ("slots", "<u2"), ("counts", "<i4")))
                    x = np.zeros((len(sizes), CLASS_SLOTS))
                    x[np.repeat(np.arange(len(sizes)), sizes), slots] = np.log1p(counts)  # a repeated word counts less
                    fit = x @ table_[:, :-1].T + table_[:, -1] - x.sum(axis=1, keepdims=True) * middle
                    own = np.exp(fit - fit.max(axis=1, keepdims=True))
                    own /= own.sum(axis=1, keepdims=True)
                    total[:, :-1] += own.T @ x
                    total[:, -1] += own.sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        out = np.zeros((CLASSES, CLASS_SLOTS + 1))
        for r in sorted(bytes(r.sums) for r in written.mapInArrow(run, "sums binary").collect()):
            out += np.frombuffer(r).reshape(out.shape)
        return out

    table_, middle = np.zeros((CLASSES, CLASS_SLOTS + 1)), np.zeros(CLASSES)
    own = expected(table_, middle)
    if not own.any():
        return table_
    # random tables, less what they say of all words together, or all documents would begin in one class
    table_[:, :-1] = np.random.default_rng(17).normal(0, 0.5, (CLASSES, CLASS_SLOTS))
    middle = table_[:, :-1] @ own[0, :-1] / max(own[0, :-1].sum(), 1e-9)
    for _ in range(rounds):
        own = expected(table_, middle)
        before, table_, middle = table_, np.zeros_like(table_), np.zeros(CLASSES)
        words = own[:, :-1] + 0.05
        table_[:, :-1] = np.log(words / words.sum(axis=1, keepdims=True))
        table_[:, -1] = np.log((own[:, -1] + 1) / (own[:, -1].sum() + CLASSES))
        if np.abs(table_ - before).max() < 1e-6:  # nothing moves any more
            break
    return table_


_PIECE = [("k", pa.int32()), ("part", pa.int32()), ("sums", pa.binary())]
_PIECE_SCHEMA = "k int, part int, sums binary"


def _pieces(tables: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A task's predictor tables as compressed pieces that are not all zero."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    for k, own in enumerate(tables):
        for part in range(0, len(own), 2 * _SLOTS):
            piece = own[part:part + 2 * _SLOTS]
            if piece.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([pack(piece.astype("<f4").tobytes())], pa.binary())], schema=pa.schema(_PIECE)
                )


def _added(pieces: DataFrame, slots: list[int]) -> list[np.ndarray]:
    """The tasks' tables added up: (zeros, ones) of each slot."""

    def add(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        import zstandard

        total = np.zeros(2 * _SLOTS)
        for one in rows.column("sums").to_pylist():
            own = np.frombuffer(zstandard.ZstdDecompressor().decompress(one), dtype="<f4")
            total[:len(own)] += own
        return pa.table({"k": [key[0]], "part": [key[1]], "sums": pa.array([total.astype("<f4").tobytes()], pa.binary())}, schema=pa.schema(_PIECE))

    out = [np.zeros(2 * size, np.float32) for size in slots]
    for r in pieces.groupBy("k", "part").applyInArrow(add, _PIECE_SCHEMA).toLocalIterator():  # at most the size of the tables
        piece = np.frombuffer(r.sums, dtype="<f4")
        out[r.k][r.part:r.part + len(piece)] = piece[:len(out[r.k]) - r.part]
    return [c.reshape(-1, 2) for c in out]


def _blocks(df: DataFrame, id_col: str, text_col: str, folds: int, held: int, classes: np.ndarray) -> DataFrame:
    """Three kinds of rows: a block (``ids, held, sizes, packed, keys``: documents as numbers of the block's
    words, and the words' hashes), every word of the block (``at, word, c0, c1, ..``), and a task's counts
    of words after their contexts (``k, part, sums``).

    The empty word stands for the end of a document; ``c0, c1, ..`` count a word in the training documents
    of each class. A block has the number of its task and its number there.
    """
    slim = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), (fold(id_col, folds) == held).alias("held"))
    kinds = pa.schema([
        ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())),
        ("packed", pa.binary()), ("keys", pa.binary()), ("at", pa.int32()), ("word", pa.binary()), *((c, pa.int32()) for c in _CLASS_COLUMNS),
        *_PIECE,
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__  # a new word has the next number
        block_names = count(TaskContext.get().partitionId() << 32)
        ids, held_, sizes, at = [], [], [], []
        n = 0
        follow = [np.zeros(2 * size, np.int32) for size in WORD_TABLES]

        def close() -> Iterator[pa.RecordBatch]:
            flat, words = np.concatenate(at), list(numbers)
            at.clear()
            numbers.clear()
            starts = np.append(0, np.cumsum(sizes)[:-1])
            learned = ~np.array(held_, dtype=bool)
            keys = np.fromiter(map(_key, words), np.uint32, len(words))
            trained = np.zeros(len(words) * CLASSES, np.int32)
            for a, b, own in _parts(flat, np.array(sizes)):
                slots = (keys.take(own) % np.uint32(CLASS_SLOTS)).astype(np.int64)
                best = np.argmax([np.add.reduceat(row.take(slots), starts[a:b] - starts[a]) + row[-1] for row in classes], axis=0)
                train = np.repeat(learned[a:b], sizes[a:b])
                np.add.at(trained, own[train].astype(np.int64) * CLASSES + np.repeat(best, sizes[a:b])[train], np.int32(1))
            trained = trained.reshape(-1, CLASSES)
            for some in Running.over(keys, flat, np.array(sizes), classes, learned):
                for _, bit, at_ in some.steps():
                    for own, slot in zip(follow, at_, strict=True):
                        if len(own) <= len(slot):  # a small table is counted faster as a whole
                            own += np.bincount(slot * 2 + bit, minlength=len(own)).astype(np.int32)
                        else:
                            np.add.at(own, slot * 2 + bit, np.int32(1))
            packed = zstandard.ZstdCompressor(level=1).compress(flat.astype("<u4").reshape(-1, 1).view(np.uint8).T.tobytes())
            name = next(block_names)
            none = [pa.nulls(1, k.type) for k in kinds]
            values = [[name], [ids], [held_], [sizes], [packed], [keys.astype("<u4").tobytes()]]
            yield pa.RecordBatch.from_arrays([*(pa.array(v, k.type) for v, k in zip(values, kinds, strict=False)), *none[6:]], schema=kinds)
            for first in range(0, len(words), 50_000):
                part = words[first:first + 50_000]
                m = len(part)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(m, name)), *(pa.nulls(m, k.type) for k in list(kinds)[1:6]),
                    pa.array(np.arange(first, first + m, dtype=np.int32)), pa.array(part, pa.binary()),
                    *(pa.array(np.ascontiguousarray(trained[first:first + m, z])) for z in range(CLASSES)),
                    *(pa.nulls(m, k.type) for k in list(kinds)[-3:]),
                ], schema=kinds)

        for batch in batches:
            for i, text, out in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                found = encoded(text).lower().split()
                found.append(b"")
                at.append(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found)))
                ids.append(i)
                held_.append(out)
                sizes.append(len(found))
                n += len(found)
                if n >= BLOCK_TOKENS:
                    yield from close()
                    ids, held_, sizes, at = [], [], [], []
                    n = 0
        if ids:
            yield from close()
        for piece in _pieces(follow):
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k.type) for k in list(kinds)[:-3]), *piece.columns], schema=kinds)

    counts = ", ".join(f"{c} int" for c in _CLASS_COLUMNS)
    schema = f"block bigint, ids array<bigint>, held array<boolean>, sizes array<bigint>, packed binary, keys binary, at int, word binary, {counts}, {_PIECE_SCHEMA}"
    return slim.mapInArrow(run, schema)


def _words_of(batch: pa.RecordBatch) -> list[bytes]:
    return [w or b"" for w in batch.column(0).to_pylist()]


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in longer batches; a row is one word."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _tables(words: DataFrame) -> list[np.ndarray]:
    """The predictor tables, added up over all words of the training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(2 << size, np.int32) for size in TABLES]
        for batch in _gathered(batches, GATHERED):
            for _, some in _chunks(_words_of(batch), SHORT_CHUNK):
                for _, bit, slots in Coded.of(some).steps():
                    for own, slot in zip(sums, slots, strict=True):
                        np.add.at(own, slot * 2 + bit, np.int32(1))
        yield from _pieces(sums)

    return _added(words.mapInArrow(run, _PIECE_SCHEMA), [1 << size for size in TABLES])


def fit_mixer(words: DataFrame) -> Mixer:
    """Learn from the distinct words (column ``word``) of the training documents."""
    words = words.select("word")
    mixer = Mixer(_tables(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = mixer.fresh(), 0
        for batch in _gathered(batches, 5000):
            for _, part in _chunks(_words_of(batch)):
                own.learn(Coded.of(part))
                n += len(part)
        yield _learned(own, n)

    return _averaged(mixer, words.mapInArrow(run, "at int, value double"))


def fit_order(blocks: DataFrame, counts: list[np.ndarray], classes: np.ndarray) -> Mixer:
    """Learn to mix the contexts that cross words, from the running text of all training documents."""
    mixer = Mixer(counts, WORD_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = mixer.fresh(), 0
        for batch in batches:
            for block in batch.to_pylist():
                keys, flat, sizes = _unpacked(block)
                for some in Running.over(keys, flat, sizes, classes, ~np.array(block["held"], dtype=bool), LEARN_TOGETHER):
                    own.learn(some)
                    n += len(some.codes)
        yield _learned(own, n)

    return _averaged(mixer, blocks.select("held", "sizes", "packed", "keys").mapInArrow(run, "at int, value double"))


def _learned(own: Mixer, n: int) -> pa.RecordBatch:
    values = np.concatenate([own.weights.ravel() * n, own.map_.ravel(), [n]])
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["at", "value"])


def _averaged(mixer: Mixer, rows: DataFrame) -> Mixer:
    values = np.zeros(mixer.weights.size + mixer.map_.size + 1)
    for r in rows.groupBy("at").agg(F.sum("value").alias("value")).collect():
        values[r["at"]] = r["value"]
    if values[-1] > 0:  # the tasks' weights are averaged by the words they saw
        mixer.weights = (values[:mixer.weights.size] / values[-1]).reshape(mixer.weights.shape)
        mixer.map_ = values[mixer.weights.size:-1].reshape(mixer.map_.shape)
    return mixer


def _price_kind(width: int) -> np.dtype:
    return np.dtype([("back", "<f4"), ("numbers", f"<u{width}", (1 + CLASSES,))])


def _prices(words: pa.Array, back: np.ndarray, numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``word, price``: log-probability, size and counts of a word packed into as few bytes as the largest
    number asks for. Words of one width follow each other."""
    most, least = numbers.max(axis=1, initial=0), -1
    for width in (1, 2, 4, 8):
        last = (1 << 8 * width) - 1 if width < 8 else np.iinfo(np.int64).max
        at = np.flatnonzero((most > least) & (most <= last))
        least = last
        if len(at):
            kind = _price_kind(width)
            packed = np.empty(len(at), kind)
            packed["back"], packed["numbers"] = back[at], numbers[at]
            ends = np.arange(len(at) + 1, dtype=np.int32) * np.int32(kind.itemsize)
            price = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
            yield pa.RecordBatch.from_arrays([words.take(pa.array(at)), price], ["word", "price"])


def _unpriced(places: np.ndarray, column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """By place: log-probabilities, and sizes and counts (a row each) of words packed by :func:`_prices`."""
    back, numbers = np.zeros(len(places)), np.zeros((1 + CLASSES, len(places)), np.int64)
    sizes = pc.binary_length(column).to_numpy()
    for width in (1, 2, 4, 8):
        kind = _price_kind(width)
        own = sizes == kind.itemsize
        at, first = places[own], 0
        for chunk in column.filter(pa.array(own)).chunks:
            if len(chunk):
                start = np.frombuffer(chunk.buffers()[1], "<i4" if pa.types.is_binary(chunk.type) else "<i8")[chunk.offset]
                read = np.frombuffer(chunk.buffers()[2], kind, len(chunk), int(start))
                some = at[first:first + len(chunk)]
                back[some], numbers[:, some] = read["back"], read["numbers"].T
                first += len(chunk)
    return back, numbers


def _by_code(known: DataFrame, names: list[str]) -> np.ndarray:
    """For each column and code: how often its known words came, and how many they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), 2, 1 << WORD_BITS))
        for batch in _gathered(batches, GATHERED):
            codes = np.fromiter(map(_key, _words_of(batch)), np.uint32, len(batch)) >> np.uint32(32 - WORD_BITS)
            for own, column in zip(total, batch.columns[1:], strict=True):
                counts = column.to_numpy()
                own[0] += np.bincount(codes, counts, 1 << WORD_BITS)
                own[1] += np.bincount(codes, counts > 0, 1 << WORD_BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at])], ["at", "value"])

    out = np.zeros((len(names), 2, 1 << WORD_BITS))
    for r in known.select("word", *names).mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out.reshape(-1)[r["at"]] = r["value"]
    return out


def score_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held: int = 0
) -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` of every row.

    Learns from the rows outside the held-out fold. Scores are log10 probabilities of a text's words and
    its end; ``bits_per_byte`` is the same for each byte of words and separators. A null text is an
    empty one: the end alone. Repeated rows stay and count, a null id is in the fold of the empty
    text; further columns are not read. Without training documents known counts are zero.
    """
    spark = df.sparkSession
    short_batches(spark)
    classes = fit_classes(df, id_col, text_col, folds, held)
    written = settle(_blocks(df, id_col, text_col, folds, held, classes), "blocks")
    names = _CLASS_COLUMNS
    entries = written.where("word IS NOT NULL").select("block", "at", "word", *names)
    vocabulary = entries.groupBy("word").agg(*[F.sum(c).alias(c) for c in names])
    vocabulary = settle(vocabulary, "vocabulary").withColumn("c", sum(F.col(c) for c in names))
    known = vocabulary.where("c > 0")

    def measures(c: str) -> list:
        return [F.sum(c), *[F.sum((when).cast("long")) for when in (F.col(c) > 0, F.col(c) == 1, F.col(c) == 2)]]

    sums_ = np.array([x or 0 for x in known.agg(*[m for c in ("c", *names) for m in measures(c)]).first()], dtype=float).reshape(-1, 4)
    total, distinct = int(sums_[0, 0]), int(sums_[0, 1])
    mixer = fit_mixer(known.where(F.octet_length("word") > 0)).scoring()

    slim = written.where("packed IS NOT NULL").select("block", "ids", "held", "sizes", "packed", "keys")
    order = fit_order(slim, _added(written.where("sums IS NOT NULL").select("k", "part", "sums"), list(WORD_TABLES)), classes).scoring()
    of_code = _by_code(known, ["c", *names])
    discounts = [ones / (ones + 2 * twos) if ones and twos else 0.5 for _, _, ones, twos in sums_]

    def memory(counts: np.ndarray, of: int, codes: np.ndarray) -> tuple[np.ndarray, float]:
        """Shares of words in their code by discounted counts, as a factor of the code's probability, and what is left to others."""
        n, kinds = sums_[of, :2]
        if not n:
            return np.zeros(len(counts)), 1.0
        discount = discounts[of]
        left = discount * kinds / n
        mass = np.maximum(of_code[of, 0] - discount * of_code[of, 1], 0) / n
        share = np.divide(1 - left, mass, out=np.ones_like(mass), where=mass > 0)
        return np.maximum(counts - discount, 0) / n * share[codes], left

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, GATHERED):
            words = _words_of(batch)
            bits = np.zeros(len(words))
            for first, some in _chunks(words, SHORT_CHUNK):
                bits[first:first + len(some)] = mixer.lengths(Coded.of(some))
            # in logarithms, as the probability of a very long word is below any double
            counts = [np.array([len(w) for w in words]), *(c.to_numpy() for c in batch.columns[1:])]
            yield from _prices(batch.column(0), -bits * np.log(2.0), np.stack(counts, axis=1))

    scored = vocabulary.select("word", *names).mapInArrow(run, "word binary, price binary")
    priced = entries.select("block", "at", "word").join(scored, "word").select(F.col("block").alias("of"), "at", "price")
    weights = classes[:, -1] / np.log(10.0) if total else np.full(CLASSES, -np.log10(CLASSES))

    def sums(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        block = left.to_pylist()[0]
        spelled, (size, *counts) = _unpriced(right.column("at").to_numpy(), right.column("price"))
        c = sum(counts)
        keys, flat, sizes = _unpacked(block)
        base, known_ = np.log10((c + 0.1) / (total + 0.1 * (distinct + 1))), (c > 0).astype(np.int64)
        codes, out = (keys >> np.uint32(32 - WORD_BITS)).astype(np.int64), []
        (all_, left), *by_class = [memory(x, of, codes) for of, x in enumerate((c, *counts))]
        with np.errstate(divide="ignore"):
            all_, spelled = np.log(all_), spelled + np.log(left)
        # nothing is held by running word but for one part of the texts at a time
        for a, b, part in _parts(flat, sizes):
            starts = np.append(0, np.cumsum(sizes[a:b])[:-1])
            per = lambda x: np.add.reduceat(x.take(part), starts)  # noqa: E731, B023
            bits = np.concatenate([order.lengths(some) for some in Running.over(keys, part, sizes[a:b], classes)]) * -np.log(2.0)
            back = np.logaddexp(all_.take(part) + bits, spelled.take(part))
            # in a class, as multiples of that; a word without a share has a large one perhaps, and does not use it
            ahead = np.exp(np.minimum(bits - back, 700))
            backs = np.add.reduceat(back, starts)
            fit = [(np.add.reduceat(np.log(own.take(part) * ahead + left_), starts) + backs) / np.log(10.0) for own, left_ in by_class]
            fit = np.array(fit) + weights[:, None]
            scores = fit.max(axis=0)
            scores = scores + np.log10((10.0 ** (fit - scores)).sum(axis=0))
            out.append((per(known_), per(base), scores, per(size + 1)))
        n_known, base_score, scores, n_bytes = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({
            id_col: pa.array(block["ids"], pa.int64()), "held_out": pa.array(block["held"]), "n_tokens": pa.array(sizes, pa.int64()),
            "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array(np.full(len(sizes), total), pa.int64()),
            "base_score": pa.array(base_score), "score": pa.array(scores),
            "bits_per_byte": pa.array(-scores * np.log2(10.0) / n_bytes),
        })

    schema = (
        f"`{id_col}` bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double, bits_per_byte double"
    )
    return slim.groupBy("block").cogroup(priced.groupBy("of")).applyInArrow(sums, schema)


@query()
def op1_lm_score(spark, sf):
    """The mixed model's and the plain score of every document."""
    return score_documents(table(spark, sf, "documents"))
