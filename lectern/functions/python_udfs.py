"""The few functions that Spark has no exact built-in for, as Arrow UDFs."""

from __future__ import annotations

import html
import sys
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# ship these functions with the task, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text that are Python strings at one time; the rest of a batch stays in Arrow's form.
SLICE_BYTES = 1 << 20


def fold_text(text: str) -> str:
    """Lower case, compatibility decomposition, without combining marks."""
    parts = unicodedata.normalize("NFKD", text.lower())
    return "".join(ch for ch in parts if not unicodedata.combining(ch))


def in_slices(texts: pa.Array, change: Callable[[str], str]) -> pa.Array:
    """``change`` of every text, a slice of about ``SLICE_BYTES`` at a time; null stays null."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    number = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(texts)]
    return pa.concat_arrays([
        pa.array([None if t is None else change(t) for t in texts.slice(a, b - a).to_pylist()], texts.type)
        for a, b in zip(cuts, cuts[1:])
    ])


@F.arrow_udf(StringType())
def unescape_udf(texts: pa.Array) -> pa.Array:
    return in_slices(texts, html.unescape)


@F.arrow_udf(StringType())
def fold_udf(texts: pa.Array) -> pa.Array:
    return in_slices(texts, fold_text)
