"""Ranked, quota-based and deficit-limited selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern import fixed
from lectern.functions.arrays import clamp, literal_array
from lectern.functions.labels import is_synthetic
from lectern.plans.ranking import null_safe_join, number_by_hash, number_by_key, number_rows
from lectern.plans.scratch import settle


def quotas(profile: str = "default", overrides: Mapping[str, int] | None = None) -> dict[str, int]:
    """Domain floors of a profile; non-negative integer overrides win."""
    merged = dict(fixed.DOMAIN_QUOTA["aggressive" if profile == "aggressive" else "default"])
    for name, value in (overrides or {}).items():
        if isinstance(name, str) and isinstance(value, int) and value >= 0:
            merged[name] = value
    return merged


def quota_frame(df: DataFrame, wanted: Mapping[str, int], domain: str = "domain") -> DataFrame:
    return df.sparkSession.createDataFrame(list(wanted.items()), f"`{domain}` string, quota long")


def allocate(df: DataFrame, wanted: Mapping[str, int], total: int, domain: str = "domain") -> DataFrame:
    """Rows each domain may take: its floor, scaled down when the floors exceed the budget.

    Per domain: ``n_rows``, ``want`` = min(floor, n_rows), ``alloc``.
    """
    budget = max(0, total - max(12, total // 30))
    sizes = df.groupBy(domain).agg(F.count(F.lit(1)).alias("n_rows"))
    known = sizes.join(F.broadcast(quota_frame(df, wanted, domain)), domain, "left")
    want = F.least(F.coalesce(F.col("quota"), F.lit(0)), F.col("n_rows"))
    sums = known.select(domain, "n_rows", want.alias("want")).withColumn(
        "all_want", F.sum("want").over(W.partitionBy())
    )
    scale = F.try_divide(F.lit(float(budget)), F.col("all_want"))
    scaled = F.floor(F.col("want") * scale).cast("long")
    fits = (F.col("all_want") <= budget) | (F.col("all_want") == 0)
    return sums.withColumn("alloc", F.when(fits, F.col("want")).otherwise(scaled)).drop("all_want")


def question_order() -> list[Column]:
    """Urgent first, then advanced, then score (outliers clamped), then newest."""
    return [
        F.desc("urgency_signal"), F.desc("advanced_signal"),
        clamp("score", -2, 10).desc(), F.desc("creation_date"), F.asc("ord"),
    ]


def rank_candidates(df: DataFrame, domain: str = "domain", out: str = "rn") -> DataFrame:
    return number_rows(df, question_order(), [domain], out)


def interleaved_rank(rank: Column, is_high: Column, n_low: Column, n_high: Column) -> Column:
    """0-based place of a row when two ranked lists are merged two low, one high.

    ``rank`` is the 0-based rank within the row's own list. A low row is preceded by one high
    per two lows before it, a high row by two lows per high up to it, as far as they exist.
    """
    low_place = rank + F.least(n_high, F.floor(rank / 2))
    high_place = rank + F.least(n_low, 2 * rank + 2)
    return F.when(is_high, high_place).otherwise(low_place).cast("long")


def rank_diverse(df: DataFrame, domain: str = "domain", high_score: int = 10, out: str = "place") -> DataFrame:
    """Rank per domain with two low or middle scores for each high one."""
    scored = df.withColumn("__high", F.coalesce(F.col("score") > high_score, F.lit(False)))
    numbered = number_rows(scored, question_order(), [domain, "__high"], "__r")
    sizes = scored.groupBy(domain).agg(
        F.count_if(~F.col("__high")).alias("__n_low"), F.count_if("__high").alias("__n_high")
    )
    joined = null_safe_join(numbered, settle(sizes, "sizes"), [domain])
    place = interleaved_rank(F.col("__r") - 1, F.col("__high"), F.col("__n_low"), F.col("__n_high"))
    return joined.withColumn(out, place).drop("__r", "__high", "__n_low", "__n_high")


def select_balanced(
    df: DataFrame, total: int, wanted: Mapping[str, int] | None = None, domain: str = "domain"
) -> DataFrame:
    """Up to ``total`` rows: domain floors first, then the strongest of the rest.

    Adds ``picked_by`` (``floor`` or ``fill``). ``question_id`` must be unique.
    """
    # the signals behind these columns read whole texts: computed once, used by every step
    slim = df.select(
        "question_id", "ord", "score", "urgency_signal", "advanced_signal", "creation_date",
        F.coalesce(F.col(domain), F.lit("general")).alias(domain),
    )
    ready = settle(slim, "candidates")
    alloc = settle(allocate(ready, wanted or quotas(), total, domain), "alloc")
    placed = rank_diverse(ready, domain).join(alloc.select(domain, "alloc"), domain)
    marked = settle(placed.withColumn("__floor", F.col("place") < F.col("alloc")), "placed")
    floor_rows = marked.where("__floor").select("question_id", F.lit("floor").alias("picked_by"))
    need = total - alloc.agg(F.coalesce(F.sum("alloc"), F.lit(0))).first()[0]
    rest = marked.where(~F.col("__floor"))
    order = [F.desc("urgency_signal"), F.desc("advanced_signal"), F.desc("creation_date"), F.asc("ord")]
    fill = number_rows(rest, order, out="__f").where(F.col("__f") <= need)
    fill_rows = fill.select("question_id", F.lit("fill").alias("picked_by"))
    # ranking ran on slim rows; the wide ones are only joined with the chosen ids
    return df.join(settle(floor_rows.unionByName(fill_rows), "chosen"), "question_id")


def calibration_score(need_advanced: bool, need_high: bool, need_low: bool) -> Column:
    """Weight of a row's useful signals; only axes that still lack rows count."""
    weights = ((need_advanced, "advanced", 100), (need_high, "high_urgency", 50), (need_low, "low_urgency", 30))
    parts = [F.when(F.col(name), w).otherwise(0) for needed, name, w in weights if needed]
    return sum(parts, F.lit(0)).cast("int")


def rank_calibration(
    df: DataFrame, need_advanced: bool = True, need_high: bool = True, need_low: bool = True,
    most: int | None = None, out: str = "rn",
) -> DataFrame:
    """Rows with a useful signal, the strongest first, at most ``most`` of them."""
    scored = df.withColumn("cal_score", calibration_score(need_advanced, need_high, need_low))
    # written before ranking, as range sampling would evaluate the text signals a second time
    useful = settle(scored.where(F.col("cal_score") > 0), "useful")
    ranked = number_rows(useful, [F.desc("cal_score"), F.asc("ord")], out=out)
    return ranked if most is None else ranked.where(F.col(out) <= most)


def calibration_candidates(df: DataFrame) -> DataFrame:
    """Rows with any of the three signals, unranked."""
    return df.where(F.col("advanced") | F.col("high_urgency") | F.col("low_urgency"))


def rank_consensus(df: DataFrame, most: int | None = None, out: str = "rn") -> DataFrame:
    """Rows that miss a target label their text hints at; advanced, urgent, score, date first."""
    useful = settle(df.where(F.col("advanced") | F.col("high_urgency")), "useful")
    order = [
        F.col("advanced").cast("int").desc(), F.col("high_urgency").cast("int").desc(),
        clamp("score", None, 10).desc(), F.desc("creation_date"), F.asc("ord"),
    ]
    ranked = number_rows(useful, order, out=out)
    return ranked if most is None else ranked.where(F.col(out) <= most)


def accept_within_deficit(
    df: DataFrame, axes: Mapping[str, Column], deficits: Mapping[str, int],
    order: Sequence[Column], id_col: str = "ord",
) -> DataFrame:
    """(id, axis) of accepted changes: per axis the first rows in ``order`` up to its deficit.

    Taking rows in order while a counter lasts is the same as the rank among proposing rows
    staying within the counter, and no axis reads another one's counter.
    """
    bound = F.create_map(*[F.lit(x) for axis in axes for x in (axis, int(deficits[axis]))])
    marks = [F.when(flag, F.lit(axis)) for axis, flag in axes.items()]
    long = df.withColumn("axis", F.explode(F.array_compact(F.array(*marks))))
    ranked = number_rows(long, list(order), ["axis"], "__a")
    return ranked.where(F.col("__a") <= F.element_at(bound, F.col("axis"))).select(id_col, "axis")


def assign_round_robin(df: DataFrame, names: Sequence[str], start: int = 0, out: str = "model") -> DataFrame:
    """Row i (in ``ord`` order) goes to name ``(start + i) mod k``."""
    numbered = number_by_key(df, "ord", [], [F.asc("ord")], out="__i")
    table = literal_array(names)
    place = (F.col("__i") - 1 + start) % len(names)
    return numbered.withColumn(out, F.get(table, place.cast("int"))).drop("__i")


def trim_to_target(df: DataFrame, target: int, source: str = "fuente") -> DataFrame:
    """At most ``target`` rows: real rows in order, then synthetic ones in order."""
    marked = df.withColumn("__s", is_synthetic(source).cast("int"))
    order = [F.asc("__s"), F.asc("ord")]
    return number_by_key(marked, "ord", ["__s"], order, out="__t", most=target).drop("__s", "__t")


def sample_n(df: DataFrame, n: int, seed: int, id_col: str = "ord") -> DataFrame:
    """``n`` rows in seeded hash order."""
    return number_by_hash(df, id_col, seed, out="__s").where(F.col("__s") < n).drop("__s")
