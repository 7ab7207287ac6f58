"""Weakly labelled training rows from raw grievances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline import vocab
from wardline.functions.rules import weak_severity, weak_urgency
from wardline.functions.text import compose_text


def _field(df: DataFrame, name: str, missing: str):
    """The column with NULL as blank, or a constant where the table lacks it."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) if name in df.columns else F.lit(missing)


def build_weak_labels(df: DataFrame, *keep: str) -> DataFrame:
    """``text, category, severity, urgency`` per grievance; a narrow projection.

    ``df`` has the columns ``vocab.RAW_COLUMNS``; ``keep`` names columns to carry along.
    """
    category, sub_category, ward, remarks = vocab.RAW_COLUMNS
    text = compose_text(
        _field(df, category, "Unknown"),
        _field(df, sub_category, "Unknown"),
        _field(df, ward, "Unknown"),
        _field(df, remarks, ""),
    )
    rule_fields = _field(df, sub_category, ""), _field(df, remarks, "")
    return df.select(
        *keep,
        text.alias("text"),
        F.coalesce(F.col(f"`{category}`").cast("string"), F.lit("")).alias("category"),
        weak_severity(*rule_fields).alias("severity"),
        weak_urgency(*rule_fields).alias("urgency"),
    )
