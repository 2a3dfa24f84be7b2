"""Exact nearest binary codes by incremental multi-index hashing.

A code of 64 bits is cut into ``m`` segments; a code within Hamming distance ``m * (r + 1) - 1`` of a
query agrees with it up to ``r`` bits in one of the segments (pigeonhole). The search grows ``r``: in each
step a query looks up the occupied values of every segment at distance exactly ``r``, verifies the
whole codes found there, and stops once its kth distance is covered by the radius reached.

Codes are dealt by a hash into parts of bounded size, each with its own index, and queries into
blocks; every block meets every part, and the ``k`` best of the parts are merged. Codes are stored once
with their smallest ids, of which no more than ``k + 1`` can matter, so a code that many rows share is
no hot group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import query, short_batches, table
from lectern.plans.scratch import settle

BITS = 64
#: Bits of a segment: an index of occupied values stays below 2 ** WIDTH entries per segment.
WIDTH = 16
#: Codes of a part and queries of a block.
PART, BLOCK = 10_000, 10_000


def sign_code(vector: Column | str) -> Column:
    """64 bits from the first 64 components: 1 where the component is positive (missing ones are 0)."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bits = F.transform(F.slice(v, 1, BITS), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def _first_ids(rows: DataFrame, n: int) -> DataFrame:
    """``code, ids``: the ``n`` smallest distinct ids of every code."""
    distinct = rows.groupBy("code", "id").agg(F.lit(1).alias("one"))
    place = F.row_number().over(W.partitionBy("code").orderBy("id"))
    return distinct.withColumn("rn", place).where(F.col("rn") <= n).groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))


class SegmentIndex:
    """Codes by the values of their segments."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = []
        for s in range(BITS // WIDTH):
            part = ((codes >> np.uint64(s * WIDTH)) & np.uint64((1 << WIDTH) - 1)).astype(np.uint32)
            order = np.argsort(part, kind="stable")
            values, starts = np.unique(part[order], return_index=True)
            self.tables.append((values, starts, np.append(starts[1:], len(codes)), order))

    def search(self, code: int, k: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of all codes that may be among the ``k`` nearest rows.

        ``rows`` tells how many rows of each code count for this query.
        """
        seen = np.zeros(len(self.codes), bool)
        found, distances = np.empty(0, np.int64), np.empty(0, np.int64)
        near = [np.bitwise_count(v ^ np.uint32(code >> s * WIDTH & (1 << WIDTH) - 1)) for s, (v, *_) in enumerate(self.tables)]
        for radius in range(WIDTH + 1):
            for (_, starts, ends, order), far in zip(self.tables, near, strict=True):
                at = np.flatnonzero(far == radius)
                sizes = ends[at] - starts[at]
                if not len(at):
                    continue
                # the stored places of all these values, one run after the other
                runs = np.repeat(starts[at] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
                places = order[runs]
                places = places[~seen[places]]
                seen[places] = True
                found = np.append(found, places)
                distances = np.append(distances, np.bitwise_count(self.codes[places] ^ np.uint64(code)))
            covered = len(self.tables) * (radius + 1) - 1
            inside = distances <= covered
            if rows[found[inside]].sum() >= k:
                return found[inside], distances[inside]
        return found, distances


def _dealt(df: DataFrame, column: str, size: int, name: str) -> tuple[DataFrame, int]:
    """``df`` with ``name``, a part number by the hash of ``column``, and the number of parts."""
    parts = max(1, -(-df.count() // size))
    return df.withColumn(name, F.pmod(F.xxhash64(column, F.lit(3)), F.lit(parts)).cast("int")), parts


def search_codes(codes: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, id, distance``: the ``k`` nearest codes of every query, but the query's own row.

    Both tables hold ``id`` and ``code`` (bigint). Ties go to the smaller id; with fewer rows all are
    returned. Rows without an id or code take no part, repeated rows count once. Exact at every size.
    """
    short_batches(codes.sparkSession)
    clean = lambda df: df.select("id", "code").where("id IS NOT NULL AND code IS NOT NULL").distinct()
    index, parts = _dealt(settle(_first_ids(clean(codes), k + 1), "codes"), "code", PART, "part")
    asked, blocks = _dealt(settle(clean(queries).withColumnRenamed("id", "query_id"), "queries"), "query_id", BLOCK, "block")
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def search(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if len(left) and len(right):
            stored = SegmentIndex(left.column("code").to_numpy().view(np.uint64))
            lists = left.column("ids").combine_chunks()
            ids, starts = lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            counts = np.diff(starts)
            owner = dict(zip(left.column("code").to_pylist(), range(len(left)), strict=True))
            for q, code in zip(right.column("query_id").to_pylist(), right.column("code").to_pylist(), strict=True):
                rows = counts
                if (own := owner.get(code)) is not None and q in ids[starts[own]:starts[own + 1]]:
                    rows = counts.copy()
                    rows[own] -= 1
                at, far = stored.search(code & (1 << BITS) - 1, k, rows)
                # the nearest codes that hold k rows, and all at the same distance
                order = np.argsort(far, kind="stable")
                last = int(np.searchsorted(np.cumsum(rows[at[order]]), k))
                limit = far[order[min(last, len(order) - 1)]]
                order = order[far[order] <= limit]
                some = [(int(d), i) for p, d in zip(at[order].tolist(), far[order].tolist(), strict=True) for i in ids[starts[p]:starts[p + 1]].tolist() if i != q]
                for d, i in sorted(some)[:k]:
                    for column, value in zip(out, (q, i, d), strict=True):
                        column.append(value)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "id": pa.array(out[1], pa.int64()), "distance": pa.array(out[2], pa.int32())})

    keys = ["part", "block"]
    found = index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, "query_id bigint, id bigint, distance int")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


CODES_SQL = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x > 0 AS INT)) AS b FROM embeddings
  WHERE embedding IS NOT NULL),
d AS (SELECT q.vec_id AS query_id, c.vec_id,
  list_sum(list_transform(list_zip(q.b, c.b), lambda x: CAST(x[1] <> x[2] AS INT))) AS distance
  FROM c q JOIN c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, CAST(distance AS INT) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) WHERE rank <= 5
"""


@query(CODES_SQL)
def op4_hamming_topk(spark, sf):
    """The five nearest sign codes by Hamming distance for every fiftieth embedding."""
    rows = table(spark, sf, "embeddings").where("embedding IS NOT NULL")
    codes = rows.select(F.col("vec_id").alias("id"), sign_code("embedding").alias("code"))
    out = search_codes(codes, codes.where(F.col("id") % 50 == 0))
    return out.withColumnRenamed("id", "vec_id")
