"""Data-quality jobs: split rows by their checks, report and fail fast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def check(df: DataFrame, error: Column, warnings: Column | None = None) -> DataFrame:
    """Add ``error`` (code or NULL) and ``warnings`` (list of codes)."""
    none = F.array().cast("array<string>")
    return df.withColumns(
        {"error": error, "warnings": none if warnings is None else F.coalesce(warnings, none)}
    )


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean rows and violations of a checked frame."""
    clean = checked.filter(F.col("error").isNull()).drop("error", "warnings")
    return clean, checked.filter(F.col("error").isNotNull())


def require(checked: DataFrame, key: str) -> DataFrame:
    """The same rows; the job fails on the first row with an error."""
    stop = F.raise_error(F.concat(F.col("error"), F.lit(" at "), F.col(key).cast("string")))
    return checked.filter(F.when(F.col("error").isNull(), F.lit(True)).otherwise(stop.cast("boolean")))


def report(checked: DataFrame) -> DataFrame:
    """``level, code, n`` over all rows."""
    found = F.concat(
        F.when(
            F.col("error").isNotNull(),
            F.array(F.struct(F.lit("error").alias("level"), F.col("error").alias("code"))),
        ).otherwise(F.array().cast("array<struct<level:string,code:string>>")),
        F.transform("warnings", lambda w: F.struct(F.lit("warning").alias("level"), w.alias("code"))),
    )
    return (
        checked.select(F.inline(found))
        .groupBy("level", "code")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def match_rows(labels: DataFrame, probabilities: DataFrame, key: str) -> DataFrame:
    """Full outer join by ``key`` with ``row_error``: a label without probabilities or the reverse."""
    left = labels.withColumn("_has_label", F.lit(True))
    right = probabilities.withColumn("_has_probabilities", F.lit(True))
    return (
        left.join(right, key, "full_outer")
        .withColumn(
            "row_error",
            F.when(F.col("_has_label").isNull(), "missing_label_row").when(
                F.col("_has_probabilities").isNull(), "missing_probability_row"
            ),
        )
        .drop("_has_label", "_has_probabilities")
    )


class TooManyErrors(ValueError):
    """More rows have errors than allowed; ``counts`` says which."""

    def __init__(self, counts: dict[tuple[str, str], int], rows: int):
        bad = sum(n for (level, _), n in counts.items() if level == "error")
        super().__init__(f"{bad} of {rows} rows have errors: {counts}")
        self.counts, self.rows = counts, rows


def write_clean(
    checked: DataFrame, path: str, errors: Sequence[str], warnings: Sequence[str] = (), most_errors: float = 1.0
) -> DataFrame:
    """Write the clean rows and report on all of them in the same pass: ``level, code, n`` as ``report``.

    The counts are observed while the rows go by, so nothing is read twice; in a stream, call it on each
    batch. Codes that are not listed count as ``other``. With more than ``most_errors`` of the rows in error it
    raises ``TooManyErrors``; the rows are then written, and the caller leaves them unpublished.
    """
    kinds = {("error", c): F.count_if(F.col("error") == c) for c in errors}
    kinds["error", "other"] = F.count_if(F.col("error").isNotNull() & ~F.col("error").isin(list(errors)))
    kinds |= {("warning", c): F.sum(F.size(F.filter("warnings", lambda w: w == c))) for c in warnings}  # noqa: B023
    kinds["warning", "other"] = F.sum(F.size(F.filter("warnings", lambda w: ~w.isin(list(warnings)))))
    seen = Observation()
    named = [n.alias(f"n{i}") for i, n in enumerate(kinds.values())]
    watched = checked.observe(seen, F.count(F.lit(1)).alias("rows"), *named)
    split(watched)[0].write.parquet(path)
    found = seen.get
    counts = {kind: found[f"n{i}"] for i, kind in enumerate(kinds) if found[f"n{i}"]}
    bad = sum(n for (level, _), n in counts.items() if level == "error")
    if bad > most_errors * found["rows"]:
        raise TooManyErrors(counts, found["rows"])
    return checked.sparkSession.createDataFrame([(*kind, n) for kind, n in counts.items()], "level string, code string, n long")
