"""Approximate nearest neighbours by an inverted multi-index.

Unit vectors are cut into two halves, each quantised by its own centroids; a pair of centroids is a
cell, so few centroids make many cells. A query walks the pairs of centroids by summed distance with a
heap until the cells it has met hold enough rows, then all of their rows are reranked by the exact
measure. The cells of one centroid of the first half are stored together and meet the queries that
visit any of them; where they hold many rows, these are dealt into parts of bounded size. Centroids
come from a bounded sample of rows in hash order; cell sizes (at most the squared number of
centroids) are the only other thing that reaches the driver.

How many rows are enough depends on the data: vectors without structure inside their clusters need
a large share for a recall of 0.9, as their nearest row is hardly nearer than many others.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import query, short_batches, table
from lectern.plans.scratch import settle

#: Rows of one part of the cells of a first centroid.
PART_ROWS = 4000


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v`` (doubles) of the vectors with finite components, not all zero, of the usual length."""
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")
    )
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~bad & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (usual.n if usual else 0))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares of large components stay finite
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)[None], 0)


def k_means(x: np.ndarray, k: int, rounds: int = 15, seed: int = 11) -> np.ndarray:
    """Centroids by Lloyd's rounds from seeded distinct rows; an empty one moves to the farthest row."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centroids = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        d = _distances(x, centroids)
        own = d.argmin(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centroids))
        far = np.argsort(-d[np.arange(len(x)), own], kind="stable")
        for i, c in enumerate(np.flatnonzero(n == 0)):
            sums[c], n[c] = x[far[i % len(far)]], 1
        centroids = sums / n[:, None]
    return centroids


@dataclass
class MultiIndex:
    """Centroids of the two halves."""

    first: np.ndarray
    second: np.ndarray

    def split(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        unit = _unit(v)
        return _distances(unit[:, :self.first.shape[1]], self.first), _distances(unit[:, self.first.shape[1]:], self.second)

    def cells(self, v: np.ndarray) -> np.ndarray:
        a, b = self.split(v)
        return a.argmin(axis=1) * len(self.second) + b.argmin(axis=1)


def walk(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
    """Occupied cells by rising sum of the distances ``a`` and ``b``, until they hold ``enough`` rows."""
    order_a, order_b = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
    heap, met, held, out = [(a[order_a[0]] + b[order_b[0]], 0, 0)], {(0, 0)}, 0, []
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = order_a[i] * len(order_b) + order_b[j]
        if sizes[cell]:
            out.append(cell)
            held += int(sizes[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(order_a) and y < len(order_b) and (x, y) not in met:
                met.add((x, y))
                heapq.heappush(heap, (a[order_a[x]] + b[order_b[y]], x, y))
    return out


def _matrix(column) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def fit_index(rows: DataFrame, centroids: int, sample_rows: int) -> MultiIndex | None:
    """Centroids from at most ``sample_rows`` rows ``id, v`` in hash order."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").collect()
    if not sample:
        return None
    x = _unit(np.array([r.v for r in sample]))
    half = max(1, x.shape[1] // 2)
    return MultiIndex(k_means(x[:, :half], centroids), k_means(x[:, half:], centroids))


def nearest(
    df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    centroids: int = 64, sample_rows: int = 20_000, share: float = 0.45,
) -> DataFrame:
    """``query_id, rank, id_col, score``: the ``k`` rows found with the largest cosine, but the query's own.

    Ties go to the smaller id. Vectors that are null, zero, of another length than most, or hold null
    or non-finite components take no part, neither do rows without an id. Repeated rows of an id count once.
    A query visits cells until they hold the ``share`` of all rows, at any number of rows, and ``k`` rows at least.
    """
    short_batches(df.sparkSession)
    spark = df.sparkSession
    schema = f"query_id bigint, rank int, `{id_col}` bigint, score double"
    rows = settle(usable(df, id_col, vector_col).dropDuplicates(["id"]), "vectors")
    index = fit_index(rows, centroids, sample_rows)
    if index is None:
        return spark.createDataFrame([], schema)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                first, second = np.divmod(index.cells(_matrix(batch.column(1))).astype(np.int32), len(index.second))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(first), pa.array(second)], ["id", "v", "first", "second"]
                )

    stored = settle(rows.mapInArrow(assign, "id bigint, v array<double>, first int, second int"), "index")
    sizes = np.zeros((len(index.first), len(index.second)), np.int64)
    for r in stored.groupBy("first", "second").count().collect():
        sizes[r.first, r.second] = r["count"]
    parts = -(-sizes.sum(axis=1) // PART_ROWS)
    enough = max(k, int(share * sizes.sum())) + 1  # the query's own row does not count

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v = batch.column(0).to_pylist(), batch.column(1)
            if not ids:
                continue
            a, b = index.split(_matrix(v))
            where, first, second = [], [], []
            for i in range(len(ids)):
                met: dict[int, list[int]] = {}
                for cell in walk(a[i], b[i], sizes.ravel(), enough):
                    x, y = divmod(cell, len(index.second))
                    met.setdefault(x, []).append(y)
                for x, ys in met.items():
                    where.append(i)
                    first.append(x)
                    second.append(ys)
            at = pa.array(where, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), v.take(at), pa.array(first, pa.int32()), pa.array(second, pa.list_(pa.int32())), pa.array(parts[first].astype(np.int32))],
                ["query_id", "v", "first", "seconds", "parts"],
            )

    asked = usable(queries, id_col, vector_col).dropDuplicates(["id"]).join(rows.select("id"), "id", "left_semi")
    visits = asked.mapInArrow(visit, "query_id bigint, v array<double>, first int, seconds array<int>, parts int")
    visits = visits.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    n_parts = F.array(*[F.lit(int(p)) for p in parts])
    dealt = stored.withColumn("part", F.pmod(F.xxhash64("id"), F.get(n_parts, F.col("first")).cast("bigint")).cast("int"))

    def rerank(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_id, out_s = [], [], []
        if len(left) and len(right):
            ids, v = left.column("id").to_numpy(), _matrix(left.column("v"))
            order = np.argsort(ids, kind="stable")
            ids, v, cell = ids[order], v[order], left.column("second").to_numpy()[order]
            norms = np.sqrt((v * v).sum(axis=1))
            asked_ids, asked_v = right.column("query_id").to_numpy(), _matrix(right.column("v"))
            for q, x, seconds in zip(asked_ids.tolist(), asked_v, right.column("seconds").to_pylist(), strict=True):
                open_ = np.zeros(len(index.second), bool)
                open_[seconds] = True
                some = np.flatnonzero(open_[cell] & (ids != q))
                # the sum along a row does not depend on the other rows: equal vectors get equal scores
                score = (v[some] * x).sum(axis=1) / (norms[some] * np.sqrt((x * x).sum()))
                best = np.lexsort((ids[some], -score))[:k]
                out_q += [q] * len(best)
                out_id += ids[some[best]].tolist()
                out_s += score[best].tolist()
        return pa.table({"query_id": pa.array(out_q, pa.int64()), id_col: pa.array(out_id, pa.int64()), "score": pa.array(out_s, pa.float64())})

    keys = ["first", "part"]
    found = dealt.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(rerank, f"query_id bigint, `{id_col}` bigint, score double")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), id_col))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", id_col, "score")


@query()
def op2_nearest(spark, sf):
    """The five nearest rows by cosine for every fiftieth embedding."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where(F.col("vec_id") % 50 == 0))
