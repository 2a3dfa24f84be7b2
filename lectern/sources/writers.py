"""Sinks: tables, audit logs, reports, vocabularies, run manifests."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = None) -> None:
    """Overwrite a table: parquet, json (lines, characters unescaped) or csv (with header).

    CSV has no nested values, so arrays, maps and structs become JSON text there.
    """
    out = df
    if fmt == "csv":
        nested = (ArrayType, MapType, StructType)
        out = df.select(
            *[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema]
        )
    writer = out.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if fmt == "json":
        writer = writer.option("ignoreNullFields", False)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.format(fmt).save(path)


def append_audit(df: DataFrame, path: str) -> None:
    """Append events as JSON lines. On a stream use :func:`audit_batches`, as a repeated batch would append twice."""
    df.write.mode("append").json(path)


def audit_batches(path: str):
    """A ``foreachBatch`` sink for events as JSON lines that survives a repeated batch: every batch owns one
    partition of the log and overwrites it, so a batch that is run again after a failure gives its rows once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch_id={int(batch_id)}")

    return write


def write_report(df: DataFrame, path: str) -> None:
    """Long report rows as one JSON document per section.

    A report is an aggregate; its rows are bounded by label sets and sources.
    """
    keys = [c for c in df.columns if c != "section"]
    rows = F.sort_array(F.collect_list(F.struct(*keys)))
    df.groupBy("section").agg(rows.alias("rows")).write.mode("overwrite").json(path)


def write_vocab(aligned: DataFrame, path: str) -> None:
    """Vocabulary and aligned matrix as one table ``idx, word, found, vec`` in index order."""
    aligned.repartitionByRange(F.col("idx")).sortWithinPartitions("idx").write.mode("overwrite").parquet(path)


def run_manifest(spark: SparkSession, conf: Mapping[str, object], counts: Mapping[str, int]) -> DataFrame:
    """One row that describes a run: time, settings, split sizes."""
    settings = {str(k): str(v) for k, v in conf.items()}
    rows = spark.createDataFrame(
        [(settings, {k: int(v) for k, v in counts.items()})], "settings map<string,string>, counts map<string,long>"
    )
    return rows.withColumn("written_at", F.current_timestamp())
