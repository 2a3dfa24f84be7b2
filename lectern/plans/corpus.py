"""The corpus build: sources to final rows, sized and free of duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern import fixed
from lectern.operators.dedupe import first_texts
from lectern.operators.generate import generate_balanced
from lectern.operators.rows import to_final_emotions, to_final_extra, to_final_questions, union_rows
from lectern.operators.selection import sample_n, trim_to_target
from lectern.plans.ranking import number_by_key
from lectern.plans.scratch import settle


def _ranked(df: DataFrame, source_rank: int) -> DataFrame:
    """Order of the sources first, the source's own order second."""
    return df.withColumn("source_rank", F.lit(source_rank))


def _stacked(
    questions: DataFrame | None, emotions: DataFrame | None, seed: int, max_emotions: int | None
) -> DataFrame:
    parts = []
    if questions is not None:
        parts.append(_ranked(to_final_questions(questions), 0))
    if emotions is not None and max_emotions != 0:
        texts = to_final_emotions(emotions)
        parts.append(_ranked(texts if max_emotions is None else sample_n(texts, max_emotions, seed), 1))
    if not parts:
        raise ValueError("at least one of questions and emotions is needed")
    return union_rows(*parts)


def _first(df: DataFrame) -> DataFrame:
    """First row per text in the order of the sources, with the text's key."""
    return first_texts(df.withColumn("__o", F.struct("source_rank", "ord")), order="__o").drop("__o")


def real_rows(
    questions: DataFrame | None, emotions: DataFrame | None, seed: int = 42, max_emotions: int | None = None
) -> DataFrame:
    """Final rows of the labelled questions and of the emotion texts: all, or a seeded sample of ``max_emotions``.

    Inputs carry ``ord``. The result carries ``source_rank, ord`` as its order.
    """
    return _first(_stacked(questions, emotions, seed, max_emotions)).drop("__key")


def _written(df: DataFrame, name: str) -> DataFrame:
    """Written once; ``__row`` tells rows of one source apart."""
    return settle(df.withColumn("__row", F.struct("source_rank", F.monotonically_increasing_id().alias("at"))), name)


def _generated(spark, n: int, seed: int, source_rank: int) -> DataFrame:
    rows = generate_balanced(spark, n, seed)
    return _ranked(rows.withColumn("ord", F.col("synthetic_provenance.index")), source_rank)


def build_corpus(
    questions: DataFrame | None,
    emotions: DataFrame | None,
    extra: DataFrame | None = None,
    target: int = 10_000,
    seed: int = 42,
    max_emotions: int | None = None,
    synthetic_rows: int | None = None,
) -> DataFrame:
    """Real rows, extra synthetic rows and generated rows, brought to ``target`` rows.

    Adds a global ``ord``. Generated rows fill the gap; too many rows are trimmed with the real
    ones first; rows lost to duplicates are topped up once with another seed.

    A source that comes first keeps its row, so one pass over all given rows finds their first texts, and
    generated rows only have to miss the keys of the rows before them: no later step moves the texts.
    """
    spark = (questions if questions is not None else emotions).sparkSession
    given = _stacked(questions, emotions, seed, max_emotions)
    if extra is not None:
        given = union_rows(given, _ranked(to_final_extra(extra), 2))
    parts = [_written(_first(given), "real")]
    n_rows = parts[0].count()

    def generate(n: int, at: int, source_rank: int) -> int:
        fresh = _first(_generated(spark, n, at, source_rank))
        for known in list(parts):
            fresh = fresh.join(known.select("__key"), "__key", "left_anti")
        parts.append(_written(fresh, "generated"))
        return parts[-1].count()

    missing = target - n_rows if synthetic_rows is None else synthetic_rows
    if missing > 0:
        n_rows += generate(missing, seed, 3)
    trimmed = n_rows > target
    if n_rows < target:
        generate(target - n_rows, seed + fixed.TOPUP_SEED_STEP, 4)
    rows = union_rows(*parts)
    order = [F.asc("source_rank"), F.asc("ord"), F.asc("__row")]
    numbered = number_by_key(rows, "__row", ["source_rank", "ord"], order, out="__n")
    rows = numbered.withColumn("ord", F.col("__n")).drop("__n", "__row", "__key")
    return (trim_to_target(rows, target) if trimmed else rows).drop("source_rank")
