"""Arrow columns for what Python models return."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

SCORE_LIST = T.ArrayType(T.StructType().add("label", "string").add("score", "double"))
_ENTRY = pa.struct([("label", pa.string()), ("score", pa.float64())])


def score_column(matrix: np.ndarray, labels: Sequence[str], missing: np.ndarray) -> pa.Array:
    """One score list per row of ``matrix`` (text, label); NULL where ``missing``."""
    rows, width = matrix.shape
    names = pa.array(np.arange(rows * width) % max(width, 1), pa.int32())
    label = pa.DictionaryArray.from_arrays(names, pa.array(list(labels))).cast(pa.string())
    entries = pa.StructArray.from_arrays([label, pa.array(matrix.ravel())], fields=list(_ENTRY))
    offsets = pa.array(np.arange(0, rows * width + 1, max(width, 1), dtype=np.int32)[: rows + 1])
    return pa.ListArray.from_arrays(offsets, entries, mask=pa.array(missing))


def no_scores(rows: int) -> pa.Array:
    return pa.nulls(rows, pa.list_(_ENTRY))
