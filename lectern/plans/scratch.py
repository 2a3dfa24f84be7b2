"""Written intermediate tables and the session they belong to."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CONF = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; ``plans.session`` names one for a local session."""
    root = spark.conf.get(_CONF, None)
    if not root:
        raise RuntimeError(f"set {_CONF} to a folder that every executor can reach")
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts the lineage so that several consumers share one evaluation, survives executor loss
    (the files are in the shared folder), and gives Catalyst the real size of the table, so a
    later plain join broadcasts it only when it is below ``autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace columns that are evaluated exactly once per row.

    Catalyst copies the expression of a column into every filter on it. A generator is a border
    for that, so costly columns (parsing, regular expressions, Python) that are filtered on and
    selected afterwards are not computed again.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))
