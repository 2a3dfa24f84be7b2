"""What the operators of this subpackage share: the query registry, tables, folds and batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Rows of an Arrow batch. Texts vary from nothing to megabytes, so a batch is kept short.
BATCH_ROWS = 200


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL when there is one."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows that one Arrow batch brings to Python; a session setting, never raised here."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; a null id counts as the empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return (F.crc32(text.cast("binary")) % folds).cast("int")


_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable):
    """What a worker process keeps for the tasks that follow, until :func:`tidy` begins a task that keeps something else."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def let_go(keeps: str | None) -> None:
    """Drop what is kept under other names; a function of the module, as tasks get their own copies of what closures name."""
    for name in [n for n in _KEPT if n != keeps]:
        del _KEPT[name]


def tidy(run: Callable, keeps: str | None = None) -> Callable:
    """``run`` over batches; what it leaves free goes back to the system, as workers outlive their tasks, and so
    does what tasks of other steps have kept."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(keeps)
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        pa.system_memory_pool().release_unused()

    return whole


def keep_rows(df: DataFrame, text_col: str, scorer: Callable, keep: Callable) -> DataFrame:
    """The rows, with all their columns, for which ``keep`` of the score of the text holds.

    ``scorer`` is called once per task and returns a function from a list of texts to scores.
    """
    short_batches(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for batch in batches:
            if len(batch):
                yield batch.filter(pa.array(keep(score(batch.column(at).to_pylist())), pa.bool_()))

    return df.mapInArrow(tidy(run), df.schema)


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased, as UTF-8."""
    return encoded(text).lower().split()


def encoded(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "replace")


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows in parts whose values in ``column`` have at most ``most`` bytes together; a longer value is alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held + size > most and i > start:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)
