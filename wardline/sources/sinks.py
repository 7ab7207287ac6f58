"""Writers for the log and for exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_log(df: DataFrame, path: str) -> None:
    """Append log rows as Parquet, one folder per day, so date filters skip folders.

    ``created_ts`` keeps the time in UTC beside the text. Rows are rebalanced by day before they are
    written: small days share tasks and become one file each, a day that holds much of the table is
    split into files of the advised size.
    """
    rows = dated(df).hint("rebalance", F.col("created_date"))
    rows.write.mode("append").partitionBy("created_date").parquet(path)


def dated(df: DataFrame) -> DataFrame:
    """``df`` with ``created_ts``, a UTC time, and ``created_date``, its day or ``unknown``."""
    time = F.try_to_timestamp(F.col("created_at").cast("string"))
    day = F.coalesce(F.to_date(time).cast("string"), F.lit("unknown"))
    return df.withColumns({"created_ts": time, "created_date": day})


def append_csv(df: DataFrame, path: str) -> None:
    """Append part files with a header each; readers see one table."""
    _writer(df, "append").csv(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Replace ``path`` by the whole table; missing folders are created."""
    _writer(df, "overwrite").csv(path)


def _writer(df: DataFrame, mode: str):
    return df.write.mode(mode).option("header", True).option("escape", '"')
