"""Array, map and number column functions (all JVM-side)."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import fixed


def _column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def literal_array(items: Sequence[str] | Sequence[float]) -> Column:
    """Constant array of strings or doubles; one literal that the optimizer folds, however long the list is."""
    kind = "double" if items and isinstance(items[0], float) else "string"
    return F.from_json(F.lit(json.dumps(list(items))), f"array<{kind}>")


def literal_map(mapping: Mapping) -> Column:
    """Constant map; string keys are passed as one literal that the optimizer folds."""
    keys, values = list(mapping), list(mapping.values())
    for kind, name in ((str, "string"), (int, "int")):
        if all(isinstance(k, str) for k in keys) and all(type(v) is kind for v in values):
            return F.from_json(F.lit(json.dumps(dict(mapping))), f"map<string,{name}>")
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def map_value(col: Column | str, mapping: Mapping[str, str], default: str | None = None) -> Column:
    """Constant lookup table with a default for missing keys."""
    found = F.try_element_at(literal_map(mapping), _column(col))
    return found if default is None else F.coalesce(found, F.lit(default))


def map_ids(col: Column | str, names: Sequence[str] = fixed.EMOTION_IDS) -> Column:
    """Ids to names; an id outside the list becomes ``unknown``."""
    table = literal_array(names)
    return F.transform(_column(col), lambda i: F.coalesce(F.get(table, i), F.lit("unknown")))


def pick_by_priority(
    col: Column | str,
    mapping: Mapping[str, str] = fixed.EMOTION_MAP,
    order: Sequence[str] = fixed.EMOTION_PRIORITY,
    default: str = "neutral",
) -> Column:
    """Map every element, then take the first of ``order`` that is present."""
    mapped = F.transform(_column(col), lambda x: map_value(x, mapping, default))
    present = F.array_intersect(literal_array(order), mapped)
    return F.coalesce(F.get(present, F.lit(0)), F.lit(default))


def majority_domain(
    tags: Column | str, mapping: Mapping[str, str] = fixed.TAG_DOMAIN, default: str = "general"
) -> Column:
    """Most frequent mapped value; ties go to the one seen first."""
    mapped = F.transform(_column(tags), lambda t: map_value(F.lower(t), mapping))
    known = F.filter(mapped, lambda d: d.isNotNull())
    seen = F.array_distinct(known)
    votes = F.transform(seen, lambda d: F.size(F.filter(known, lambda x: x == d)))
    best = F.array_position(votes, F.array_max(votes))
    return F.coalesce(F.try_element_at(seen, best.cast("int")), F.lit(default))


def clamp(col: Column | str, low: int | None, high: int) -> Column:
    value = F.least(_column(col), F.lit(high))
    return value if low is None else F.greatest(value, F.lit(low))


def softmax(arr: Column | str) -> Column:
    """Stable softmax: the maximum is subtracted first; empty stays empty."""
    values = _column(arr)
    top = F.array_max(values)
    powers = F.transform(values, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(powers, lambda x: x / total)


def log_softmax_at(arr: Column | str, index: Column | str) -> Column:
    """Log probability of one class."""
    values = _column(arr)
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return F.get(values, _column(index)) - top - F.ln(total)


def argmax(arr: Column | str) -> Column:
    """0-based position of the maximum, the lowest on ties."""
    values = _column(arr)
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def geo_mean(arr: Column | str) -> Column:
    """Geometric mean of the positive values; 0 when there are none."""
    kept = F.filter(_column(arr), lambda x: x > 0)
    logs = F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + F.ln(x))
    return F.when(F.size(kept) > 0, F.exp(logs / F.size(kept))).otherwise(F.lit(0.0))


def add_bias(logits: Column | str, bias: Column | Sequence[float]) -> Column:
    values = bias if isinstance(bias, Column) else F.array(*[F.lit(float(b)) for b in bias])
    return F.zip_with(_column(logits), values, lambda a, b: a + b)


def safe_pct(part: Column | str, total: Column | str) -> Column:
    """Percentage with two digits, 0 for an empty total."""
    return F.round(F.when(_column(total) > 0, _column(part) / _column(total) * 100).otherwise(0.0), 2)


def safe_fraction(part: Column | str, total: Column | str, digits: int = 6) -> Column:
    """Rounded share, 0 for an empty total."""
    return F.round(F.when(_column(total) > 0, _column(part) / _column(total)).otherwise(0.0), digits)


def pct_display(col: Column | str) -> Column:
    """Confidence as a whole percentage, halves to even; values above 1 are percentages already."""
    value = _column(col)
    return F.bround(F.when(value.between(0.0, 1.0), value * 100).otherwise(value)).cast("int")


def pad_ids(col: Column | str, length: int = fixed.MAX_LEN, pad: int = fixed.PAD_ID) -> Column:
    """Cut to ``length`` and fill up on the right."""
    kept = F.slice(_column(col), 1, length)
    return F.concat(kept, F.array_repeat(F.lit(pad), F.lit(length) - F.size(kept)))


def token_views(tokens: Column | str, length: int = fixed.MAX_LEN, mode: str = "score") -> Column:
    """Windows over a long token list: head; tail and head+tail halves; middle.

    ``mode`` is ``head``, ``head_tail`` or ``score``. Returns an array of token arrays.
    """
    if mode not in ("head", "head_tail", "score"):
        raise ValueError(f"unknown view mode {mode!r}")
    toks = _column(tokens)
    size = F.size(toks)
    views = F.array(F.slice(toks, 1, length))
    if mode == "head":
        return views
    half = max(1, length // 2)
    rest = length - half
    # a zero-length tail slice means the whole list in the contract, hence the guard
    tail_half = F.slice(toks, -rest, rest) if rest else toks
    ends = F.slice(F.concat(F.slice(toks, 1, half), tail_half), 1, length)
    none = F.array().cast("array<array<string>>")
    views = F.concat(
        views,
        F.when(size > length, F.array(F.slice(toks, -length, length), ends)).otherwise(none),
    )
    if mode == "head_tail":
        return views
    start = F.greatest(F.lit(0), F.floor(size / 2) - length // 2).cast("int")
    middle = F.array(F.slice(toks, start + 1, F.lit(length)))
    return F.concat(views, F.when(size > 2 * length, middle).otherwise(none))
