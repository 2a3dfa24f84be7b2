"""Line deduplication against levelled sorted runs of line hashes, with DataFrame operations only.

Documents come in batches, the largest ids first. A run holds one row per line key of its batches: a
128-bit hash, the number of documents and the largest document. A new batch is merge-joined with
the runs so far: keys that no run has (the anti join) are added with their largest document, the
others only add to the count, as a larger document holds them already. Runs are bucketed and sorted
by hash, so neither the join nor the compaction shuffles them again. When a level has ``fanout`` runs,
they are merged into one run of the next level.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import query, table
from lectern.plans.scratch import scratch_path, settle

_SPACE = "\t\n\x0b\x0c\r "
KEY = ["h1", "h2"]


def _key(line):
    """The line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_SPACE)), string.ascii_uppercase, string.ascii_lowercase)


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashed(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``id, body, pos, h1, h2`` of every line that is long enough; ``body`` tells texts of one id apart."""
    rows = df.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("body"), F.posexplode(_lines(F.col(text_col))).alias("pos", "line")
    )
    # a cheap bound first: the key is never longer than the line
    rows = rows.where(F.length("line") >= min_chars).withColumn("key", _key(F.col("line")))
    rows = rows.where(F.length("key") >= min_chars)
    return rows.select("id", "body", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), F.col("key")).alias("h2"))


class Runs:
    """Sorted runs ``h1, h2, docs, top`` in levels."""

    def __init__(self, spark, fanout: int):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.names: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        sorted_rows = rows.repartition(self.buckets, "h1").sortWithinPartitions(*KEY)
        writer = sorted_rows.write.bucketBy(self.buckets, "h1").sortBy(*KEY)
        writer.option("path", scratch_path(self.spark, name)).saveAsTable(name)
        self.names.append(name)
        return name

    def all(self) -> DataFrame | None:
        """Every key of the runs, once."""
        tables = [self.spark.table(n) for level in self.levels for n in level]
        if not tables:
            return None
        rows = tables[0]
        for more in tables[1:]:
            rows = rows.unionByName(more)
        return rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.max("top").alias("top"))

    def add(self, batch: DataFrame) -> None:
        """Add a batch ``h1, h2, docs, top`` whose documents come before those of the runs."""
        have = self.all()
        if have is not None:
            known = have.select(*KEY, F.lit(True).alias("known"))
            batch = batch.join(known, KEY, "left")
            batch = batch.select(*KEY, "docs", F.when(F.col("known").isNull(), F.col("top")).alias("top"))
        self._put(0, self._write(batch))

    def _put(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            rows = self.spark.table(self.levels[level][0])
            for other in self.levels[level][1:]:
                rows = rows.unionByName(self.spark.table(other))
            merged = rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.max("top").alias("top"))
            self.levels[level] = []
            self._put(level + 1, self._write(merged))

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def repeated_lines(
    lines: DataFrame, min_docs: int, batches: int = 4, fanout: int = 2
) -> DataFrame:
    """``h1, h2, top`` of the keys that at least ``min_docs`` documents hold."""
    spark = lines.sparkSession
    held = settle(lines.select("id", *KEY).groupBy(*KEY, "id").agg(F.lit(1).alias("one")).drop("one"), "held")
    cuts = held.approxQuantile("id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    cuts = sorted({int(c) for c in cuts}, reverse=True)
    runs = Runs(spark, fanout)
    for low, high in zip([*cuts, None], [None, *cuts], strict=True):
        part = held
        part = part if low is None else part.where(F.col("id") > low)
        part = part if high is None else part.where(F.col("id") <= high)
        runs.add(part.groupBy(*KEY).agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("top")))
    out = settle(runs.all().where(F.col("docs") >= min_docs).select(*KEY, "top"), "repeated")
    runs.close()
    return out


def dedupe_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3,
    batches: int = 4, fanout: int = 2,
) -> DataFrame:
    """All columns, the text without the repeated lines, and ``n_lines`` (before) and ``n_dropped``.

    A line whose key has at least ``min_chars`` code points and occurs in at least ``min_docs``
    documents stays only in the largest ``id_col`` that holds it, there with all its copies. A null or
    empty text is one empty line. Rows of one id are one document. Rows without an id lose nothing
    and do not count as documents. Every row stays.
    """
    lines = _hashed(df, id_col, text_col, min_chars)
    repeated = repeated_lines(lines, min_docs, batches, fanout)
    dropped = lines.join(repeated, KEY).where("id < top").groupBy("id", "body").agg(F.collect_set("pos").alias("__drop"))
    dropped = dropped.select(F.col("id").alias("__id"), F.col("body").alias("__body"), "__drop")
    rows = df.join(dropped, (F.col(id_col) == F.col("__id")) & (F.xxhash64(text_col) == F.col("__body")), "left")
    split = _lines(F.col(text_col))
    kept = F.filter(split, lambda line, i: ~F.array_contains("__drop", i))
    text = F.when(F.col("__drop").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(kept, "\n"))
    columns = [text.alias(c) if c == text_col else F.col(c) for c in df.columns if c not in ("n_lines", "n_dropped")]
    n_dropped = F.coalesce(F.size("__drop"), F.lit(0))
    return rows.select(
        *columns, F.size(split).cast("bigint").alias("n_lines"),
        F.when(F.col("__drop").isNull(), 0).otherwise(n_dropped).cast("bigint").alias("n_dropped"),
    )


LINES_SQL = r"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM t),
k AS (SELECT doc_id, line, pos, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE r.top > k.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE r.top IS NULL OR r.top = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN r ON k.key = r.key GROUP BY k.doc_id
"""


@query(LINES_SQL)
def op10_line_dedup(spark, sf):
    """Every document without the lines that at least three documents share."""
    out = dedupe_lines(table(spark, sf, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
