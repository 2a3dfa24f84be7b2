"""Cross-tokenizer alignment: which tokens of one tokenizer cover the same bytes as tokens of another.

Tokenizer A is byte-level BPE (``tokenizers``), B is a piece model with byte fallback (``sentencepiece``).
A's character offsets and B's proto spans are coarse cuts; where a character is split over several
tokens, or B falls back to bytes, the ends come from the decoded bytes of the tokens. (The immutable
proto of the method is gone from the installed sentencepiece; its ``proto`` holds the same spans.)

Neither tokenizer joins anything across a blank or newline between two plain characters (A's pattern
starts a new match there, B has no piece with a blank inside; :class:`Aligner` checks that). So a text is
cut there into units, and a unit is encoded and aligned once per worker process and remembered, up to
``HELD_UNITS`` of them.

Corpus-wide counts of id pairs come in two passes. The first writes, per block of documents, the
distinct pairs of the block with their counts, and per document which pairs of its block it links how often.
The pairs of all blocks are summed by Spark, and every block then fetches the counts of its own pairs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import query, slices, table
from lectern.plans.scratch import settle

#: Characters of a block of documents; a longer text is a block of its own.
BLOCK_CHARS = 2_000_000
#: Units a worker process remembers; beyond that it keeps the half that most blocks had.
HELD_UNITS = 400_000
#: Units that are encoded by one call.
_TOGETHER = 5000
#: Characters that no tokenizer treats as white space or joins with it: printable ASCII and Latin letters.
_PLAIN = "!-~À-ɏ"
_CUT = re.compile(f"(?<=[{_PLAIN}])(?=[ \n][{_PLAIN}])")
_ENDS_PLAIN = re.compile(f"[{_PLAIN}]$")
#: Stands in front of units that are encoded apart from their text.
_LEAD = " a"


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level BPE entry stands for: printable ones for themselves,
    the others, in order, for the characters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Aligns texts, remembering units: text of the groups, token and group counts, linked pairs."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = _byte_of_char()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            plain = all(c in byte_of for c in entry)
            self.a_bytes[i] = bytes(map(byte_of.__getitem__, entry)) if plain else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        byte = [self.b.is_byte(i) for i in range(len(pieces))]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if b else p.replace("\u2581", " ").encode() for p, b in zip(pieces, byte, strict=True)
        ]
        self.a_len, self.b_len = (np.array([len(x) for x in entries]) for entries in (self.a_bytes, self.b_bytes))
        self.b_byte = np.array(byte)
        self.cuts = not any(re.search("[^\u2581]\u2581|[^\u2581\n]\n|\n[^\n]", p) for p in pieces)
        # an id with the separator after it: A's ids before "," and "|", then B's before "," and ";"
        sides = ((len(self.a_bytes), ",|"), (len(pieces), ",;"))
        self.printed = [f"{i}{end}" for n, ends in sides for end in ends for i in range(n)]
        self.known: dict[str, int] = {}
        self.texts: list[str] = []  # of the groups of each unit
        self.pairs: dict[int, int] = {}
        self.sizes = np.empty((0, 4), np.int64)  # A tokens (-1: the bytes differ from the text), B tokens, groups, links
        self.links = np.empty(0, np.int32)  # of all units, as places in self.pairs
        self.uses = np.empty(0, np.int64)  # blocks that each unit was in

    def units(self, text: str) -> list[str]:
        """Parts of blank + text that are encoded independently of each other."""
        return _CUT.split(" " + text) if self.cuts else [" " + text]

    def forget(self, keep: int) -> None:
        """Only the ``keep`` units that most blocks had stay."""
        kept = np.sort(np.argsort(-self.uses, kind="stable")[:keep])
        names = list(self.known)
        linked = self.linked(kept)
        used, places = np.unique(linked, return_inverse=True)
        codes = np.fromiter(self.pairs, np.int64, len(self.pairs))[used]
        self.known = {names[i]: k for k, i in enumerate(kept.tolist())}
        self.texts = [self.texts[i] for i in kept.tolist()]
        self.pairs = {code: k for k, code in enumerate(codes.tolist())}
        self.sizes, self.links, self.uses = self.sizes[kept], places.astype(np.int32), np.zeros(len(kept), np.int64)

    def linked(self, at: np.ndarray) -> np.ndarray:
        """Places of the pairs of the units ``at``, one after the other."""
        n = self.sizes[:, 3]
        begins = (np.cumsum(n) - n)[at]
        n = n[at]
        return self.links[np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def learn(self, units: list[str]) -> None:
        plain, alone, found = [], [], []
        for u in units:
            (plain if self.cuts and _CUT.match("a" + u, 1) and _ENDS_PLAIN.search(u) else alone).append(u)
        for at in range(0, len(plain), _TOGETHER):
            part = plain[at:at + _TOGETHER]
            got = self._aligned([_LEAD, *part], 1)
            if got is None:
                alone += part
            else:
                found.append((part, *got))
        for u in alone:
            led = self.cuts and _CUT.match("a" + u, 1) is not None
            got = self._aligned([_LEAD, u] if led else [u], int(led))
            found.append(([u], *(got or ([""], np.array([[-1, 0, 0, 0]]), np.empty(0, np.int64)))))
        for part, texts, _, _ in found:
            self.known.update(zip(part, range(len(self.texts), len(self.texts) + len(part)), strict=True))
            self.texts += texts
        codes, back = np.unique(np.concatenate([np.empty(0, np.int64), *(f[3] for f in found)]), return_inverse=True)
        put = self.pairs.setdefault
        places = np.array([put(c, len(self.pairs)) for c in codes.tolist()], np.int32)
        self.links = np.concatenate([self.links, places[back]])
        self.sizes = np.concatenate([self.sizes, *(f[2] for f in found)])
        self.uses = np.append(self.uses, np.zeros(len(self.sizes) - len(self.uses), np.int64))

    def ends(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids and byte ends of A's and B's tokens of ``text``, which starts with a blank; None where joined bytes differ."""
        whole = text.encode()
        found = self.a.encode(text, add_special_tokens=False)
        a = np.array(found.ids, np.int64)
        pieces = self.b.encode(text[1:], return_type="proto").pieces
        b = np.array([p.id for p in pieces], np.int64)
        for ids, entries in ((a, self.a_bytes), (b, self.b_bytes)):
            if b"".join(map(entries.__getitem__, ids.tolist())) != whole:
                return None
        spans = np.array(found.offsets, np.int64).reshape(-1, 2)
        width = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        width = 1 + (width > 0x7F) + (width > 0x7FF) + (width > 0xFFFF)
        after = np.cumsum(np.append(0, width))
        shared = np.zeros(len(a), bool)  # tokens that have a character in common with a neighbour
        shared[1:] = spans[1:, 0] < spans[:-1, 1]
        shared[:-1] |= shared[1:]
        a_ends = np.where(shared, np.cumsum(self.a_len[a]), after[spans[:, 1]])
        coarse = np.array([p.end for p in pieces], np.int64) + 1
        b_ends = np.where(self.b_byte[b], np.cumsum(self.b_len[b]), coarse)
        return a, a_ends, b, b_ends

    def _aligned(self, units: list[str], skip: int) -> tuple[list[str], np.ndarray, np.ndarray] | None:
        """Groups, sizes and pairs of the joined units after the first ``skip``; None where bytes differ from the text."""
        found = self.ends("".join(units))
        if found is None:
            return None
        a, a_ends, b, b_ends = found
        both = np.intersect1d(a_ends, b_ends, assume_unique=True)
        cuts = np.union1d(a_ends, b_ends)  # a link for each stretch between two cuts
        pairs = a[np.searchsorted(a_ends, cuts)] << 32 | b[np.searchsorted(b_ends, cuts)]
        unit_ends = np.cumsum([len(u.encode()) for u in units])
        if not np.isin(unit_ends, both).all():
            return None
        # A's and B's tokens by group, each with the separator that follows it
        a_last, b_last = np.isin(a_ends, both), np.isin(b_ends, both)
        group = np.concatenate([np.searchsorted(both, a_ends), np.searchsorted(both, b_ends)])
        shift = 2 * len(self.a_bytes)
        shown = np.concatenate([a + len(self.a_bytes) * a_last, b + shift + len(self.b_bytes) * b_last])
        shown = shown[np.argsort(2 * group + (np.arange(len(group)) >= len(a)), kind="stable")]
        printed = list(map(self.printed.__getitem__, shown.tolist()))
        upto = lambda ends: np.append(0, np.searchsorted(ends, unit_ends, side="right"))
        sizes = np.stack([np.diff(upto(x)) for x in (a_ends, b_ends, both, cuts)], axis=1)
        borders = np.append(0, np.cumsum(sizes[:, 0] + sizes[:, 1])).tolist()
        texts = ["".join(printed[borders[k]:borders[k + 1]])[:-1] for k in range(skip, len(units))]
        return texts, sizes[skip:], pairs[sizes[:skip, 3].sum():]


@cache
def _aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker process."""
    return Aligner(a_path, b_path)



def _block(aligner: Aligner, texts: list[str | None]) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """Columns of each document, and the pairs of the block with their counts."""
    split = [aligner.units(t) if t else [] for t in texts]
    wanted = set(chain.from_iterable(split))
    new = wanted.difference(aligner.known)
    if len(aligner.known) + len(new) > HELD_UNITS and aligner.known:
        aligner.forget(HELD_UNITS // 2)
        new = wanted.difference(aligner.known)
    aligner.learn(list(new))
    n_units = np.array([len(units) for units in split])
    at = np.fromiter(map(aligner.known.__getitem__, chain.from_iterable(split)), np.int64, n_units.sum())
    aligner.uses[np.unique(at)] += 1
    doc = np.repeat(np.arange(len(texts)), n_units)
    bad = np.isin(np.arange(len(texts)), doc[aligner.sizes[at, 0] < 0]) | (n_units == 0)
    keep = ~bad[doc]
    doc, at = doc[keep], at[keep]
    sizes = np.stack([np.bincount(doc, aligner.sizes[at, i], len(texts)) for i in range(4)], axis=1).astype(np.int64)
    linked = aligner.linked(at)
    total = np.bincount(linked, minlength=len(aligner.pairs))
    used = np.flatnonzero(total)
    local = np.cumsum(total > 0) - 1
    pairs = np.fromiter(aligner.pairs, np.int64, len(aligner.pairs))[used]
    width = max(1, len(used))
    own, times = np.unique(np.repeat(np.arange(len(texts)), sizes[:, 3]) * width + local[linked], return_counts=True)
    cuts = np.searchsorted(own, np.arange(len(texts) + 1) * width).tolist()
    at, first = at.tolist(), np.append(0, np.cumsum(np.bincount(doc, minlength=len(texts)))).tolist()
    rows = []
    for i, counts in enumerate(sizes.tolist()):
        if bad[i]:
            rows.append((0, 0, 0, 0, "", b""))
            continue
        text = ";".join(map(aligner.texts.__getitem__, at[first[i]:first[i + 1]]))
        pair, n = own[cuts[i]:cuts[i + 1]] - i * width, times[cuts[i]:cuts[i + 1]]
        packed = np.concatenate([np.diff(pair, prepend=0), n]).astype("<u4").tobytes()
        rows.append((*counts, hashlib.sha256(text.encode()).hexdigest(), packed))
    return rows, pairs, total[used]


def _first_pass(df: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    """A row per document, and for each block one row that holds its pairs (``at`` null)."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = (
        f"block bigint, at int, `{id_col}` {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint,"
        " groups_sha256 string, links binary, pairs binary, counts binary"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        aligner, press = _aligner(a_path, b_path), zstandard.ZstdCompressor(level=3).compress
        block = TaskContext.get().partitionId() << 32
        for part in slices(batches, 1, BLOCK_CHARS):
            rows, pairs, counts = _block(aligner, part.column(1).to_pylist())
            n = len(rows)
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            columns[5] = [press(x) for x in columns[5]]
            none = pa.nulls(n, pa.binary())
            names = ["block", "at", id_col, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "pairs", "counts"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * n, pa.int64()), pa.array(range(n), pa.int32()), part.column(0),
                 *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], none, none], names)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, part.column(0).type),
                 *[pa.nulls(1, k) for k in kinds],
                 pa.array([press(pairs.astype("<i8").tobytes())], pa.binary()),
                 pa.array([press(counts.astype("<i8").tobytes())], pa.binary())], names)
            block += 1

    return df.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(run, schema)


def _pairs(parts: DataFrame) -> DataFrame:
    """``block, k, a, b, n`` of the pairs of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for block, pairs, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pairs, counts = (np.frombuffer(open_(x), "<i8") for x in (pairs, counts))
                n = len(pairs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), pa.array((pairs >> 32).astype(np.int32)),
                     pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(counts)], ["block", "k", "a", "b", "n"])

    slim = parts.where("at IS NULL").select("block", "pairs", "counts")
    return slim.mapInArrow(run, "block bigint, k int, a int, b int, n bigint")


def align(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents and id pairs of the alignment of two tokenizers.

    The first frame has a row per row of ``df``: ``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256``; a link is a pair of an A and a B token whose bytes overlap, ``n_best`` counts the links
    whose pair is the most frequent one of its B id in the corpus (ties included), ``count_sum`` adds up the
    corpus counts of the links. Null or empty texts, and texts that either tokenizer does not give
    back byte by byte, have zeros and an empty hash. Ids may be null or repeat. Other columns are not read.
    The second frame is ``a, b, n, best``: how often the corpus links the two ids.
    """
    parts = settle(_first_pass(df, a_path, b_path, id_col, text_col), "aligned")
    pairs = _pairs(parts)
    counted = settle(pairs.groupBy("a", "b").agg(F.sum("n").alias("n")), "pair_counts")
    most = counted.groupBy("b").agg(F.max("n").alias("most"))
    ranked = counted.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))
    fetched = pairs.select("block", "k", "a", "b").join(ranked, ["a", "b"]).select("block", "k", "n", "best")
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def finish(docs: pa.Table, own: pa.Table) -> pa.Table:
        import zstandard

        open_ = zstandard.ZstdDecompressor().decompress
        k = own.column("k").to_numpy()
        n, best = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
        n[k], best[k] = own.column("n").to_numpy(), own.column("best").to_numpy()
        sums = []
        for packed in docs.column("links").to_pylist():
            steps, times = np.frombuffer(open_(packed), "<u4").astype(np.int64).reshape(2, -1)
            pair = np.cumsum(steps)
            sums.append((int((times * best[pair]).sum()), int((times * n[pair]).sum())))
        out = docs.select(names)
        for i, name in enumerate(("n_best", "count_sum")):
            out = out.append_column(name, pa.array([s[i] for s in sums], pa.int64()))
        return out

    schema = f"`{id_col}` {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    docs = parts.where("at IS NOT NULL").select("block", *names, "links")
    out = docs.groupBy("block").cogroup(fetched.groupBy("block")).applyInArrow(finish, schema)
    return out, ranked


@query()
def op13_alignment(spark, sf):
    """Every document aligned between a byte-level BPE and a piece model."""
    import public_tokenizers as vocabularies

    docs = table(spark, sf, "documents")
    out, _ = align(docs, vocabularies.path("byte_bpe_50k.json"), vocabularies.path("piece_bpe_32k.model"))
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))
