"""Removal of repeated word sequences with suffix automata of reference shards.

A word goes if a window of ``window`` words that covers it also starts in a document with a smaller id.

The reference of a document is all of the corpus before it, so what can match at all is found first, by
hashes that only decide what is looked at, never what is removed:

1. the least hash of the five-word grams of a window is its anchor, the same wherever the window
   occurs; anchors with one row are dropped, and the windows of the others, merged, are stretches;
2. equal stretches become one, and of each window in two documents or more the first document is known. The
   windows of a stretch that no earlier document has are the reference, each repeated window about once.

The reference is dealt by its document into shards of about ``SHARD_WINDOWS``, and a task builds the suffix
automaton of a shard over its words, every state with the least id of its occurrences; a shard beyond
``AUTOMATON`` words (a very long document) gets several. Stretches stream through the automata of the shard that
holds the first document of their windows: matching statistics of ``window`` or more give, with the least id
of the state, the maximal spans that an earlier document holds. Automata are written, not sent through the
driver; a shard that many stretches ask for is copied to as many tasks as its stretches need, so popular
passages do not meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import encoded, query, slices, table
from lectern.plans.scratch import settle

#: Words of the grams whose least hash is the anchor of a window.
GRAM = 5
#: Windows of a stretch at most, of a reference shard, and of the stretches that one task streams, about.
STRETCH, SHARD_WINDOWS, STREAMED = 2048, 50_000, 200_000
#: Words of one automaton, about.
AUTOMATON = 150_000
#: Bytes of a word, about.
_WORD = 6
#: Bytes of text that a task unpacks at once.
_TOGETHER = 2_000_000
_P = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _grams(hashed: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words."""
    out = np.full(max(0, len(hashed) - n + 1), n, np.uint64)
    for i in range(n):
        out = (out ^ hashed[i:i + len(out)]) * _P
        out ^= out >> np.uint64(32)
    return _mixed(out)


def _hashed(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after the other, and how many each text has."""
    import xxhash

    sizes = np.array([len(words) for words in texts], np.int64)
    flat = map(xxhash.xxh3_64_intdigest, chain.from_iterable(texts))
    return np.fromiter(flat, np.uint64, sizes.sum()), sizes


def _starts(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and place of each window that lies within one text, as places in all words."""
    n = np.maximum(sizes - window + 1, 0)
    text = np.repeat(np.arange(len(sizes)), n)
    return text, np.arange(n.sum()) + ((np.cumsum(sizes) - sizes) - (np.cumsum(n) - n))[text]


def windows_of(texts: list[list[bytes]], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each window."""
    hashed, sizes = _hashed(texts)
    text, at = _starts(sizes, window)
    return text, _grams(hashed, window)[at].view(np.int64)


def anchors(texts: list[list[bytes]], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Text of each window, and the least hash of the window's grams."""
    hashed, sizes = _hashed(texts)
    gram = min(GRAM, window)
    least, have = _grams(hashed, gram), 1
    want = window - gram + 1
    while have < want:  # the least of ``have`` grams from each place on
        step = min(have, want - have)
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        have += step
    text, at = _starts(sizes, window)
    return text, least[at].view(np.int64)


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``__doc`` tells rows of one id with different texts apart; null without an id."""
    doc = F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col, text_col))
    return df.select(doc.alias("__doc"), F.col(id_col).cast("bigint").alias("__id"), F.col(text_col).alias("__text"))


def _entries(rows: DataFrame, window: int) -> DataFrame:
    """``h, doc`` for every distinct anchor of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, _TOGETHER):
            text, h = anchors([encoded(t).split() for t in batch.column(1).to_pylist()], window)
            new = np.append(True, (text[1:] != text[:-1]) | (h[1:] != h[:-1]))[:len(h)]  # neighbours mostly share it
            text, h = text[new], h[new]
            order = np.lexsort((h, text))
            text, h = text[order], h[order]
            new = np.append(True, (text[1:] != text[:-1]) | (h[1:] != h[:-1]))[:len(h)]
            yield pa.RecordBatch.from_arrays([pa.array(h[new]), pa.array(batch.column(0).to_numpy()[text[new]])], ["h", "doc"])

    return rows.where("__doc IS NOT NULL").select("__doc", "__text").mapInArrow(run, "h bigint, doc bigint")


def _packed(rows: DataFrame) -> DataFrame:
    """``doc, id, packed``: the compressed words of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches, 2, _TOGETHER):
            packed = [press(b" ".join(encoded(t).split())) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["doc", "id", "packed"])

    return rows.mapInArrow(run, "doc bigint, id bigint, packed binary")


def _runs(places: np.ndarray, *also: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of indexes in which ``places`` count up by one and all of ``also`` stay the same, of at most ``most``."""
    if not len(places):
        return
    new = np.diff(places) != 1
    for values in also:
        new |= values[1:] != values[:-1]
    for a, b in zip(np.flatnonzero(np.append(True, new)).tolist(), np.flatnonzero(np.append(new, True)).tolist(), strict=True):
        for start in range(a, b + 1, most or b + 1 - a):
            yield start, min(b + 1, start + (most or b + 1 - a))


def _lists(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Where the list of each row begins and ends, and the values of all rows one after the other."""
    ends = np.cumsum(np.append(0, pc.fill_null(pc.list_value_length(column), 0).to_numpy()))
    return ends, column.flatten()


def _stretches(packed: DataFrame, shared: DataFrame, window: int) -> DataFrame:
    """``doc, id, start, digest, words`` of the merged windows whose anchors are shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        open_ = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, 2, _TOGETHER // 2):
            out = []
            ends, shared = _lists(batch.column(3))
            shared = shared.to_numpy()
            texts = [open_(text).split() for text in batch.column(2).to_pylist()]
            text, h = anchors(texts, window)
            first = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
            for k, (doc, i, words) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True)):
                own, found = np.sort(shared[ends[k]:ends[k + 1]]), h[first[k]:first[k + 1]]
                found = np.flatnonzero(own[np.minimum(np.searchsorted(own, found), len(own) - 1)] == found)
                for a, b in _runs(found, most=STRETCH):
                    part = b" ".join(words[found[a]:found[b - 1] + window])
                    out.append((doc, i, int(found[a]), xxhash.xxh3_128_digest(part), part))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc", "id", "start", "digest", "words"])

    joined = packed.join(shared, "doc").select("doc", "id", "packed", "own")
    return joined.mapInArrow(run, "doc bigint, id bigint, start int, digest binary, words binary")


def _windows(stretches: DataFrame, window: int) -> DataFrame:
    """``w, sid, lo, hi, pos`` of every window of the distinct stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3, _TOGETHER // 2):
            text, w = windows_of([text.split() for text in batch.column(3).to_pylist()], window)
            pos = (np.arange(len(text)) - np.searchsorted(text, np.arange(len(batch)))[text]).astype(np.int32)
            sid, lo, hi = (batch.column(k).to_numpy()[text] for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (w, sid, lo, hi, pos)], ["w", "sid", "lo", "hi", "pos"])

    return stretches.select("sid", "lo", "hi", "words").mapInArrow(run, "w bigint, sid bigint, lo bigint, hi bigint, pos int")


def _dealt(stretches: DataFrame, places: DataFrame, window: int) -> DataFrame:
    """``home, sid, start, least, words``: reference runs (``sid`` null) and the runs of stretches that ask for them.

    ``home`` is the first document of the windows of the run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3, _TOGETHER // 2):
            out = []
            (ends, places), (_, firsts) = (_lists(batch.column(k)) for k in (4, 5))
            places, firsts = places.to_numpy(), firsts.to_numpy()
            for k, (sid, lo, hi, text) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True)):
                words = text.split()
                pos, first = places[ends[k]:ends[k + 1]], firsts[ends[k]:ends[k + 1]]
                order = np.argsort(pos)
                pos, first = pos[order], first[order]
                cut = lambda places, a, b: b" ".join(words[places[a]:places[b - 1] + window])
                own = pos[first == lo]
                out += [(lo, None, 0, lo, cut(own, a, b)) for a, b in _runs(own)]
                asks = first < hi  # some document with this stretch comes after the first one
                pos, first = pos[asks], first[asks]
                out += [(int(first[a]), sid, int(pos[a]), lo, cut(pos, a, b)) for a, b in _runs(pos, first)]
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["home", "sid", "start", "least", "words"])

    joined = stretches.select("sid", "lo", "hi", "words").join(places, "sid").select("sid", "lo", "hi", "words", "pos", "first")
    return joined.mapInArrow(run, "home bigint, sid bigint, start int, least bigint, words binary")


class Automaton:
    """Suffix automaton of several word sequences; each state knows the least id of its occurrences."""

    def __init__(self):
        self.words: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [np.iinfo(np.int64).max]

    def _state(self, step: dict[int, int], link: int, length: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.least.append(np.iinfo(np.int64).max)
        return len(self.link) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of the longest word of ``p`` and ``c``, taken out of the state that ``c`` leads to if need be."""
        q = self.step[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        own = self._state(dict(self.step[q]), self.link[q], self.length[p] + 1)
        self.link[q] = own
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = own
            p = self.link[p]
        return own

    def add(self, words: list[bytes], least: int) -> None:
        known, step, link, length, ids = self.words, self.step, self.link, self.length, self.least
        none, last = np.iinfo(np.int64).max, 0
        for word in words:
            c = known.setdefault(word, len(known))
            if c in step[last]:
                last = self._split(last, c)
            else:
                p, new = last, len(link)
                step.append({})
                length.append(length[last] + 1)
                link.append(0)
                ids.append(none)
                while p >= 0 and c not in step[p]:
                    step[p][c] = new
                    p = link[p]
                if p >= 0:
                    link[new] = self._split(p, c)
                last = new
            if least < ids[last]:
                ids[last] = least

    def close(self) -> None:
        """Hand the least ids on to the suffixes."""
        for v in np.argsort(-np.array(self.length), kind="stable").tolist()[:-1]:
            up = self.link[v]
            self.least[up] = min(self.least[up], self.least[v])

    def pack(self) -> bytes:
        import zstandard

        degree = np.array([len(s) for s in self.step], "<i8")
        flat = chain.from_iterable
        edges = np.fromiter(flat(flat(s.items()) for s in self.step), "<i8", 2 * degree.sum())
        text = b" ".join(self.words)
        sizes = np.array([len(degree), degree.sum(), len(text)], "<i8")
        parts = [sizes, degree, edges, *(np.array(x, "<i8") for x in (self.link, self.length, self.least))]
        return zstandard.ZstdCompressor(level=3).compress(b"".join(p.tobytes() for p in parts) + text)

    @classmethod
    def unpack(cls, packed: bytes) -> Automaton:
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(packed)
        n, m, size = np.frombuffer(raw, "<i8", 3).tolist()
        numbers = np.frombuffer(raw, "<i8", 3 + 4 * n + 2 * m)[3:]
        out = cls()
        out.words = {w: i for i, w in enumerate(raw[len(raw) - size:].split())}
        ends, edges = np.cumsum(numbers[:n]).tolist(), numbers[n:n + 2 * m].tolist()
        out.step = [dict(zip(edges[2 * a:2 * b:2], edges[2 * a + 1:2 * b:2], strict=True)) for a, b in zip([0, *ends], ends, strict=False)]
        out.link, out.length, out.least = (x.tolist() for x in numbers[n + 2 * m:].reshape(3, n))
        return out

    def matches(self, words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the windows that the automaton has, and the least id of each."""
        known, step, link, length, least = self.words.get, self.step, self.link, self.length, self.least
        places, ids, v, held = [], [], 0, 0
        for i, word in enumerate(words):
            c = known(word)
            to = step[v].get(c)
            while to is None and v:
                v = link[v]
                held = length[v]
                to = step[v].get(c)
            if to is None:
                continue
            v, held = to, held + 1
            if held >= window:
                while length[link[v]] >= window:  # the state of the last ``window`` words
                    v = link[v]
                    held = length[v]
                places.append(i - window + 1)
                ids.append(least[v])
        return np.array(places, np.int64), np.array(ids, np.int64)


def _automata(reference: DataFrame) -> DataFrame:
    """``shard, automaton`` of the rows ``shard, home, least, words``."""
    parts = reference.groupBy("shard").agg(F.ceil(F.sum(F.octet_length("words")) / F.lit(_WORD * AUTOMATON)).cast("int").alias("parts"))
    dealt = reference.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("words"), F.col("parts")).cast("int"))

    def build(rows: pa.Table) -> pa.Table:
        found = Automaton()
        for least, words in zip(rows.column("least").to_pylist(), rows.column("words").to_pylist(), strict=True):
            found.add(words.split(), least)
        found.close()
        return pa.table({"shard": rows.column("shard").slice(0, 1), "automaton": pa.array([found.pack()], pa.binary())})

    return dealt.select("shard", "part", "least", "words").groupBy("shard", "part").applyInArrow(build, "shard bigint, automaton binary")


def _matched(asking: DataFrame, automata: DataFrame, window: int) -> DataFrame:
    """``sid, a, b, least``: windows a to b of a stretch, and the first document that has them."""
    keys = ["shard", "part"]

    def stream(rows: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        asked = [(sid, start, text.split()) for sid, start, text in zip(*(rows.column(c).to_pylist() for c in ("sid", "start", "words")), strict=True)]
        for packed in held.column("automaton").to_pylist():
            automaton = Automaton.unpack(packed)
            for sid, start, words in asked:
                places, least = automaton.matches(words, window)
                out += [(sid, start + int(places[a]), start + int(places[b - 1]), int(least[a])) for a, b in _runs(places, least)]
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("sid", "a", "b", "least"), columns, kinds, strict=True)})

    size = F.octet_length("words")
    parts = asking.groupBy("shard").agg(F.ceil(F.sum(size) / F.lit(_WORD * STREAMED)).cast("int").alias("parts"))
    dealt = asking.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("sid", "start"), F.col("parts")).cast("int")).drop("parts")
    copies = automata.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return dealt.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(stream, "sid bigint, a int, b int, least bigint")


def repeated_spans(df: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, spans``: word ranges ``a, b`` (b excluded) of a text that an earlier document holds; ``doc`` is the
    hash of id and text. Each range is a maximal run of repeated windows with one first document; ranges may overlap."""
    rows = _rows(df, id_col, text_col)
    entries = settle(_entries(rows, window), "anchors")
    # a row has an anchor once, so two entries are two rows
    several = entries.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    shared = entries.join(several, "h").groupBy("doc").agg(F.collect_set("h").alias("own"))
    held = settle(_stretches(_packed(rows.where("__doc IS NOT NULL")), shared, window), "stretches")

    distinct = held.groupBy("digest").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.first("words").alias("words"))
    distinct = settle(distinct.withColumn("sid", F.monotonically_increasing_id()), "distinct_stretches")
    windows = _windows(distinct, window)
    heads = windows.groupBy("w").agg(F.min("lo").alias("first"), F.max("hi").alias("last")).where("first < last").select("w", "first")
    places = windows.select("w", "sid", "pos").join(heads, "w")
    # both lists are made by one aggregate over the same rows in the same order
    places = places.groupBy("sid").agg(F.collect_list("pos").alias("pos"), F.collect_list("first").alias("first"))
    dealt = settle(_dealt(distinct, places, window), "dealt")

    reference = dealt.where("sid IS NULL")
    total = reference.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    shard = F.pmod(F.xxhash64("home"), F.lit(max(1, total // (_WORD * SHARD_WINDOWS)))).cast("bigint").alias("shard")
    automata = settle(_automata(reference.select(shard, "least", "words")), "automata")
    asking = dealt.where("sid IS NOT NULL").select(shard, "sid", "start", "words")
    matched = settle(_matched(asking, automata, window), "matched")

    owners = held.select("doc", "id", "start", "digest").join(distinct.select("digest", "sid"), "digest").drop("digest")
    spans = owners.join(matched, "sid").where("least < id")
    a, b = F.col("start") + F.col("a"), F.col("start") + F.col("b") + window
    return spans.select("doc", a.alias("a"), b.alias("b")).distinct().groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def remove_repeats(df: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns, the kept words joined by one space as text, and ``n_words`` (before) and ``n_removed``.

    A word is removed if a window of ``window`` consecutive words that covers it also starts in a document
    with a smaller id, judged on the input. Rows of one id are one document and do not count for each other.
    Rows without an id lose nothing and are no reference. A null text has no words. Every row stays.
    """
    spans = settle(repeated_spans(df, window, id_col, text_col), "spans").withColumnRenamed("doc", "__doc").withColumnRenamed("spans", "__spans")
    others = [c for c in df.columns if c not in (text_col, "n_words", "n_removed")]
    doc = F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col, text_col))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in others)

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pressed = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches, 1, _TOGETHER):
            packed = [pressed(b" ".join(encoded(t).split())) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array(packed, pa.binary()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["__doc", "__packed", *others])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_ = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, 0, _TOGETHER // 2):
            texts, before, removed = [], [], []
            for packed, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = open_(packed)
                words = text.split()
                before.append(len(words))
                if spans:
                    depth = np.zeros(len(words) + 1, np.int64)
                    np.add.at(depth, [s["a"] for s in spans], 1)
                    np.add.at(depth, [s["b"] for s in spans], -1)
                    keep = np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()
                    text, removed_here = b" ".join([words[i] for i in keep]), len(words) - len(keep)
                removed.append(removed_here if spans else 0)
                texts.append(text.decode("utf-8"))
            arrays = [*batch.columns[2:], pa.array(texts, pa.string()), pa.array(before, pa.int64()), pa.array(removed, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*others, text_col, "n_words", "n_removed"])

    slim = df.select(doc.alias("__doc"), F.col(text_col).alias("__text"), *others)
    packed = slim.mapInArrow(press, "__doc bigint, __packed binary" + (f", {schema}" if others else ""))
    joined = packed.join(spans, "__doc", "left").select("__packed", "__spans", *others)
    out = joined.mapInArrow(cut, (f"{schema}, " if others else "") + f"`{text_col}` string, n_words bigint, n_removed bigint")
    return out.select(*[c for c in df.columns if c not in ("n_words", "n_removed")], "n_words", "n_removed")


#: All windows of all documents, grouped by their words.
REPEATS_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM t),
g AS (SELECT doc_id, pos, w[pos] AS word, CASE WHEN pos + 12 <= len(w) THEN array_to_string(w[pos:pos + 12], ' ') END AS win FROM p),
f AS (SELECT win, min(doc_id) AS first FROM g WHERE win IS NOT NULL GROUP BY win),
m AS (SELECT g.doc_id, g.pos, g.word, coalesce(f.first < g.doc_id, false) AS seen FROM g LEFT JOIN f ON g.win = f.win),
c AS (SELECT doc_id, pos, word, bool_or(seen) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM m)
SELECT t.doc_id, count(c.pos) AS n_words, count(c.pos) FILTER (WHERE c.gone) AS n_removed,
  sha256(coalesce(string_agg(c.word, ' ' ORDER BY c.pos) FILTER (WHERE NOT c.gone), '')) AS kept_sha256
FROM t LEFT JOIN c ON t.doc_id = c.doc_id GROUP BY t.doc_id
"""


@query(REPEATS_SQL)
def op11_substring_dedup(spark, sf):
    """Every document without the words of 13-word windows that an earlier document has."""
    out = remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
