"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A signature has 64 MinHash symbols of 16 bits, in 16 chunks of 4. If at most 31 symbols differ, then,
as 31 < 2 * 16, some chunk has at most one error (pigeonhole). The join enumerates that error: each
chunk gives four keys, one for each symbol left out, so every pair within distance 31 shares a key.
Two documents at similarity 0.75 differ in 16 symbols on average and are beyond 31 with a
probability of about 1e-5; as the chunks need not all be that bad, about one pair in 1e9 shares no key.

Links are confirmed on the full shingle sets and only looked for where they can change something:

1. documents with equal sets form a class, and one representative of a class goes on;
2. in every bucket (documents of one key) all are compared with the first and with the last one;
3. where the rest of a bucket is still spread over several components, its members are compared in
   blocks of bounded size, each pair in the first bucket that it shares, skipping linked ones.

A link between documents that are linked already through others is not needed for the components;
no other link is left out. What is shuffled for the comparison are compressed words, a third of the
size of their shingle hashes; a task makes the set anew where it needs it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import query, short_batches, table, tidy, words
from lectern.llm.components import components
from lectern.plans.scratch import settle

SHINGLE, CHUNKS, WIDTH = 5, 16, 4
SYMBOLS = CHUNKS * WIDTH
#: Pairs farther apart than this are not compared: over five standard deviations from similarity 0.75.
REACH = 34
#: Shingles of the members of one block, and pairs of a hot document that one task compares.
BLOCK_SHINGLES, HOT_PAIRS = 500_000, 500
#: Shingles of the sets that a task remembers between pairs.
HELD_SHINGLES = 2_000_000
#: Bits of the bitmap (16 MB) that keeps texts without any candidate out of the shuffle.
SIEVE_BITS = 1 << 27
_P = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct five-word shingles; a shorter text is one shingle."""
    return _hashed(words(text))


def _hashed(found: list[bytes]) -> np.ndarray:
    import xxhash

    if not found:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = min(SHINGLE, len(found))
    out = np.full(len(found) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ hashed[i:len(hashed) - n + 1 + i]) * _P
        out ^= out >> np.uint64(32)
    return np.unique(_mixed(out))


def signature(shingles: np.ndarray) -> bytes:
    """Low 16 bits of the least value of each of the hash functions."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(least, (shingles[at:at + 4096, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    return (_mixed(least) & np.uint64(0xFFFF)).astype(">u2").tobytes()


def sketches(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, n, same, sig``: set size, 128-bit digest of the set, signature (null without words)."""
    short_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([signature(s) if len(s) else None for s in sets], pa.binary()),
            ], ["id", "n", "same", "sig"])

    slim = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(tidy(run), "id bigint, n bigint, same binary, sig binary")


def _packed(df: DataFrame) -> DataFrame:
    """``id, n, packed``: set size and compressed words of the rows ``id, text`` that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            ids, sizes, packed = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = words(text)
                if found:
                    ids.append(i)
                    sizes.append(len(_hashed(found)))
                    packed.append(press.compress(b" ".join(found)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], ["id", "n", "packed"]
            )

    return df.mapInArrow(tidy(run), "id bigint, n bigint, packed binary")


def _unpacked(packed: bytes) -> np.ndarray:
    """The shingle set of compressed words."""
    import zstandard

    return _hashed(zstandard.ZstdDecompressor().decompress(packed).split())


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= 75 * (len(a) + len(b) - common)


def _sieved(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows ``id, text`` whose id is among ``ids``, and some others, without a shuffle of the texts.

    The sieve is a bitmap of fixed size over a hash of the id: no wanted row is lost, and with more
    ids more others pass. The caller joins exactly.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(SIEVE_BITS)).cast("bigint")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int"))
    found = ids.select(place.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bitmap = np.zeros(SIEVE_BITS // 64, np.int64)
    bitmap[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    held = texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy(zero_copy_only=False)
            passes = pa.array(((held.value[at >> 6] >> (at & 63)) & 1).astype(bool))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(passes), batch.column(1).filter(passes)], ["id", "text"])

    return texts.select("id", "text", place).mapInArrow(tidy(run), "id bigint, text string")


def _entries(classes: DataFrame) -> DataFrame:
    """``id, bucket`` for every key of a signature: number of chunk and left-out symbol, then the other symbols."""
    slot = np.arange(SYMBOLS, dtype=np.int64) << 16 * (WIDTH - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").astype(np.int64).reshape(-1, CHUNKS, WIDTH)
            keys = np.zeros(sig.shape, np.int64)
            for out in range(WIDTH):
                for i in range(WIDTH):
                    if i != out:
                        keys[:, :, out] = keys[:, :, out] << 16 | sig[:, :, i]
            ids = np.repeat(batch.column(0).to_numpy(), SYMBOLS)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((keys.reshape(-1, SYMBOLS) | slot).ravel())], ["id", "bucket"])

    return classes.select("id", "sig").mapInArrow(tidy(run), "id bigint, bucket bigint")


def _near(a: str, b: str):
    """Signature distance within reach and set sizes that allow a similarity of 0.75."""
    same = sum(
        (F.substring(f"sig_{a}", 2 * i + 1, 2) == F.substring(f"sig_{b}", 2 * i + 1, 2)).cast("int") for i in range(SYMBOLS)
    )
    sizes = 4 * F.least(f"n_{a}", f"n_{b}") >= 3 * F.greatest(f"n_{a}", f"n_{b}")
    return sizes & (same >= SYMBOLS - REACH)


def _confirmed(both: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of the rows ``a, b, p_a, p_b`` whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}
        held = 0
        for batch in batches:
            left, right = [], []
            for a, b, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sets = []
                for p in packed:
                    found = known.get(p)
                    if found is None:
                        found = _unpacked(p)
                        if held + len(found) > HELD_SHINGLES:
                            known.clear()
                            held = 0
                        known[p] = found
                        held += len(found)
                    sets.append(found)
                if _similar(*sets):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return both.select("a", "b", "p_a", "p_b").mapInArrow(tidy(run), "a bigint, b bigint")


def _star_links(pairs: DataFrame, classes: DataFrame, packed: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar; a hot ``a`` is spread over several tasks."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    near = pairs.join(side("b"), "b").join(side("a"), "a").where(_near("a", "b")).select("a", "b", "n_a", "n_b")
    near = settle(near.distinct(), "near")
    parts = near.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(HOT_PAIRS)).cast("int").alias("parts"))
    text = lambda x: packed.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("packed").alias(f"p_{x}"))
    first = text("a").join(parts, "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = near.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    both = dealt.drop("parts").join(text("b"), ["b", "n_b"]).join(first.drop("parts"), ["a", "n_a", "part"])
    return _confirmed(both).distinct()


def _pairs(rows: pa.Table, first: int, second: int, slot: int) -> Iterator[tuple[int, int]]:
    """Places of the members of two blocks of a bucket that are to be compared.

    They have different components, signatures within reach, and this bucket as their first common one.
    """
    block, label, n = (rows.column(c).to_numpy() for c in ("block", "component", "n"))
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), dtype=">u2").reshape(-1, SYMBOLS)
    others = np.flatnonzero(block == second)
    for i in np.flatnonzero(block == first).tolist():
        rest = others[others > i] if first == second else others
        equal = sig[rest] == sig[i]
        ok = (equal.sum(axis=1) >= SYMBOLS - REACH) & (label[rest] != label[i])
        ok &= 4 * np.minimum(n[rest], n[i]) >= 3 * np.maximum(n[rest], n[i])
        rest, chunks = rest[ok], equal[ok].reshape(-1, CHUNKS, WIDTH)
        chunk = (chunks.sum(axis=2) >= WIDTH - 1).argmax(axis=1)
        missing = np.argmin(chunks[np.arange(len(rest)), chunk], axis=1)  # the differing symbol, 0 if none differs
        for j in rest[chunk * WIDTH + missing == slot].tolist():
            yield i, j


def _compare(rows: pa.Table, first: int, second: int, slot: int) -> tuple[list[int], list[int]]:
    """Links between two blocks of one bucket; pairs that are linked already are skipped."""
    rows = rows.sort_by([("id", "ascending")])
    ids, label = rows.column("id").to_pylist(), rows.column("component").to_pylist()
    packed = rows.column("packed").to_pylist()
    set_of = cache(lambda i: _unpacked(packed[i]))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while x in parent:
            x = parent[x]
        return x

    left, right = [], []
    for i, j in _pairs(rows, first, second, slot):
        x, y = root(label[i]), root(label[j])
        if x == y:
            continue
        if _similar(set_of(i), set_of(j)):
            parent[max(x, y)] = min(x, y)
            left.append(ids[i])
            right.append(ids[j])
    return left, right


def _in_blocks(members: DataFrame, more: DataFrame) -> DataFrame:
    """The rows ``bucket, id, component, n`` with the columns of ``more`` (a row per id) and the blocks of a bucket.

    Each pair of blocks is a group. A document meets its signature or words once, however many buckets it is in.
    """
    sizes = members.groupBy("bucket").agg(F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)).cast("int").alias("blocks"))
    # at most a bucket for every key of a signature
    own = members.join(sizes, "bucket").groupBy("id", "component", "n").agg(F.collect_list(F.struct("bucket", "blocks")).alias("own"))

    def groups(x: Column) -> Column:
        block = F.pmod(F.xxhash64("id"), x["blocks"]).cast("int")
        pair = lambda other: F.struct(
            x["bucket"].alias("bucket"), F.least(block, other).alias("first"), F.greatest(block, other).alias("second"), block.alias("block"))
        return F.transform(F.sequence(F.lit(0), x["blocks"] - 1), pair)

    full = own.join(more, "id")
    return full.select(*[c for c in full.columns if c != "own"], F.inline(F.flatten(F.transform("own", groups))))


def _block_links(rest: DataFrame, classes: DataFrame, packed: DataFrame) -> DataFrame:
    """Links among the rows ``bucket, id, component, n`` of buckets with several components.

    Signatures alone show first which members have anything to be compared with; only these rows
    are joined with their words.
    """
    keys = ["bucket", "first", "second"]

    def meet(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        bucket, first, second = (k.as_py() for k in key)
        rows = rows.sort_by([("id", "ascending")])
        met = sorted({k for pair in _pairs(rows, first, second, bucket >> 16 * (WIDTH - 1)) for k in pair})
        return rows.select(["bucket", "id", "component", "n"]).take(pa.array(met, pa.int64()))

    def compare(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        bucket, first, second = (k.as_py() for k in key)
        left, right = _compare(rows, first, second, bucket >> 16 * (WIDTH - 1))
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    slim = _in_blocks(rest, classes.select("id", "sig")).select(*keys, "id", "component", "block", "n", "sig")
    some = slim.groupBy(*keys).applyInArrow(meet, "bucket bigint, id bigint, component bigint, n bigint")
    some = settle(some.distinct(), "met")
    whole = classes.join(packed, ["id", "n"]).select("id", "sig", "packed")
    full = _in_blocks(some, whole).select(*keys, "id", "component", "block", "n", "sig", "packed")
    return full.groupBy(*keys).applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` of every row.

    Rows with one id are one document, linked wherever one of its texts is. Documents without words
    or without an id are linked with nothing (without an id: component null, kept). Repeated rows
    stay. Texts of fewer than five words are one shingle. Further columns are not read.
    """
    found = settle(sketches(df, id_col, text_col), "sketches")
    linked = found.where("id IS NOT NULL AND same IS NOT NULL")
    classes = linked.groupBy("same").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("sig").alias("sig"))
    classes = settle(classes, "classes")
    # dealt out once; the heads and the join below both use it
    entries = _entries(classes).repartition("bucket")
    heads = entries.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    shared = settle(entries.join(heads, "bucket"), "buckets")

    texts = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    met = shared.select("id").distinct()
    packed = settle(_packed(_sieved(texts, met)).join(met, "id", "left_semi"), "packed")

    low = shared.where("id > low").select(F.col("low").alias("a"), F.col("id").alias("b"))
    high = shared.where("id < high AND id > low").select(F.col("high").alias("a"), F.col("id").alias("b"))
    links = settle(_star_links(low.union(high).distinct(), classes, packed), "stars")
    label = settle(components(links), "labels")
    known = classes.select("id", "n").join(label, "id", "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    inner = shared.where("id > low AND id < high").join(known, "id").select("bucket", "id", "component", "n")
    # a bucket with the same members as one of an earlier slot is the first common bucket of no pair
    members = [F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("id")).alias("h"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("g")]
    mixed = inner.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), *members).where("x < y")
    mixed = mixed.groupBy("k", "h", "g").agg(F.min("bucket").alias("bucket"))  # slots are the upper bits of a bucket
    rest = settle(inner.join(mixed.select("bucket"), "bucket"), "rest")
    links = links.union(_block_links(rest, classes.select("id", "n", "sig"), packed))

    # an id with several texts joins their classes
    owner = linked.join(classes.select("same", F.col("id").alias("owner")), "same").select("id", "same", "owner")
    owner = settle(owner, "owners")
    several = owner.groupBy("id").agg(F.min("owner").alias("x"), F.max("owner").alias("y")).where("x < y").select("id")
    links = links.union(owner.join(several, "id", "left_semi").select("id", "owner"))
    final = components(links)

    of_doc = owner.join(final.withColumnRenamed("id", "owner"), "owner", "left")
    of_doc = of_doc.groupBy("id").agg(F.min(F.coalesce("component", "owner")).alias("component"))
    out = found.join(of_doc, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


#: The same by joining all shingles; the words and shingles are SQL lists.
NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m, any_value(x.n) AS p, any_value(y.n) AS q
  FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c WHERE 100 * m >= 75 * (p + q - m)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, k.component_id, s.doc_id = k.component_id AS kept
FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) k ON k.a = s.doc_id
"""


@query(NEAR_SQL)
def op3_near_dedup(spark, sf):
    """Components of documents at a five-word shingle similarity of 0.75 or more."""
    return near_duplicates(table(spark, sf, "documents"))
