"""Checks of nested model output: error codes, warnings and cleaned values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.scores import SCORES, entry

# Sum tolerance: 0.01 absolute plus 1e-5 relative.
SUM_TOLERANCE = 0.01 + 1e-5


def unwrap(nested: Column) -> Column:
    """First inner list of a list of lists."""
    return F.get(nested, F.lit(0))


def _number(value: Column) -> Column:
    return value.try_cast("double")


def _outside_unit(value: Column) -> Column:
    return ~value.between(0.0, 1.0)


def kept_scores(entries: Column, min_confidence: float = 0.0) -> Column:
    """Entries with label and numeric score of at least ``min_confidence``."""
    whole = F.filter(
        entries,
        lambda x: x["label"].isNotNull()
        & _number(x["score"]).isNotNull()
        & (_number(x["score"]) >= min_confidence),
    )
    return F.transform(whole, lambda x: entry(x["label"], _number(x["score"]))).cast(SCORES)


SCORE_ERRORS = ["null_output", "empty_output", "missing_label", "missing_score", "score_not_numeric", "below_confidence"]
SCORE_WARNINGS = ["score_out_of_range", "unexpected_label"]


def scores_error(entries: Column, min_confidence: float = 0.0) -> Column:
    """Code of the first error of a score list, NULL when it is usable."""
    item_codes = F.transform(
        entries,
        lambda x: F.when(x["label"].isNull(), "missing_label")
        .when(x["score"].isNull(), "missing_score")
        .when(_number(x["score"]).isNull(), "score_not_numeric"),
    )
    first = F.get(F.array_compact(item_codes), F.lit(0))
    return (
        F.when(entries.isNull(), F.lit("null_output"))
        .when(F.size(entries) == 0, F.lit("empty_output"))
        .when(first.isNotNull(), first)
        .when(F.size(kept_scores(entries, min_confidence)) == 0, F.lit("below_confidence"))
    )


def scores_warnings(
    entries: Column, expected_labels: Sequence[str] | None = None, min_confidence: float = 0.0
) -> Column:
    """Warning codes of a score list."""
    codes = [
        F.when(
            F.exists(entries, lambda x: _outside_unit(_number(x["score"]))), F.lit("score_out_of_range")
        )
    ]
    if expected_labels is not None:
        unknown = F.exists(
            kept_scores(entries, min_confidence), lambda x: ~x["label"].isin(list(expected_labels))
        )
        codes.append(F.when(unknown, F.lit("unexpected_label")))
    return F.array_compact(F.array(*codes))


def prediction_error(label: Column) -> Column:
    return F.when(label.isNull(), F.lit("null_label"))


def probability_warnings(
    probabilities: Column, label: Column | None = None, expected_labels: Sequence[str] | None = None
) -> Column:
    """Warning codes of one row of class probabilities and, if given, its label."""
    mass = F.aggregate(probabilities, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    codes = [
        F.when(F.exists(probabilities, lambda x: x.isNull()), F.lit("null_value")),
        F.when(F.exists(probabilities, _outside_unit), F.lit("probability_out_of_range")),
        F.when(F.abs(mass - 1.0) > SUM_TOLERANCE, F.lit("sum_not_one")),
    ]
    if label is not None and expected_labels is not None:
        codes.insert(0, F.when(~label.isin(list(expected_labels)), F.lit("unexpected_label")))
    return F.array_compact(F.array(*codes))


def as_vector(vector: Column, element: str = "double") -> Column:
    """The vector with elements of the wanted type."""
    return vector.cast(f"array<{element}>")


def vector_error(vector: Column, dim: int | None = None) -> Column:
    """Code of the first error of a feature vector."""
    code = (
        F.when(vector.isNull(), F.lit("null_vector"))
        .when(F.exists(vector, lambda x: x.isNull()), F.lit("null_value"))
        .when(F.exists(vector, F.isnan), F.lit("nan_value"))
        .when(F.exists(vector, lambda x: F.abs(x) == float("inf")), F.lit("inf_value"))
    )
    return code if dim is None else code.when(F.size(vector) != dim, F.lit("wrong_dimension"))
