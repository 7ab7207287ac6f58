"""The analyse-append-refresh loop as streams."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardline.operators.dashboard import event_time


def read_stream(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    """New Parquet files below ``path`` as a stream."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what has arrived to Parquet and stop; a restart goes on from the checkpoint."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )


def enrich_stream(stream: DataFrame, enrich: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Enrichment has no state: the batch function runs on the stream as it is."""
    return enrich(stream)


def live_daily_urgency(stream: DataFrame) -> DataFrame:
    """Counts per day and urgency over all rows so far, however late; for complete output."""
    return (
        stream.select(F.to_date(event_time(stream)).alias("day"), "urgency")
        .filter(F.col("day").isNotNull() & F.col("urgency").isNotNull())
        .groupBy("day", "urgency")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions below ``path``, oldest first, from the names of folders alone."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(conf)
    if not files.exists(root):
        return []
    names = [s.getPath().getName() for s in files.listStatus(root)]
    found = [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]
    return sorted(v for v in found if files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/version={v}/_SUCCESS")))


def refresh_table(df: DataFrame, path: str, checkpoint: str, keep: int = 2) -> StreamingQuery:
    """Keep complete results of a streaming aggregation as versions of a Parquet table.

    Every refresh writes a version of its own, named by the time and always above the versions there,
    so a new checkpoint on an old path goes on and does not start below. A version counts once its
    writer has finished; the last ``keep`` stay for readers, older ones are removed.
    """
    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        there = _versions(spark, path)
        number = max(int(time.time() * 1000), there[-1] + 1 if there else 0)
        batch.write.parquet(f"{path}/version={number}")
        for old in there[: len(there) + 1 - keep]:
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={old}")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    return (
        df.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("complete")
        .trigger(availableNow=True)
        .start()
    )


def read_refreshed(spark: SparkSession, path: str) -> DataFrame:
    """The newest finished version of a refreshed table; no other version is read."""
    return spark.read.parquet(f"{path}/version={_versions(spark, path)[-1]}")


def open_and_closed(counted: DataFrame, closed: DataFrame) -> DataFrame:
    """All windows of a live table with ``closed``: whether ``windowed_urgency`` has emitted them."""
    key = ["window_start", "window_end", "urgency"]
    done = closed.select(*key, F.col("n").alias("_n"))
    return counted.join(done, key, "left").select(
        *key, F.coalesce("_n", "n").alias("n"), F.col("_n").isNotNull().alias("closed")
    )


def windowed_urgency(
    stream: DataFrame, lateness: str = "1 day", width: str = "1 day", slide: str | None = None
) -> DataFrame:
    """Counts per window and urgency with bounded state.

    Rows later than ``lateness`` are dropped. In append mode a window is emitted once, when it is
    closed; in complete mode (``refresh_table``) all windows so far stand, open ones included, and
    ``open_and_closed`` puts both together.
    """
    timed = stream.select(event_time(stream).cast("timestamp").alias("ts"), "urgency")
    return (
        timed.filter(F.col("ts").isNotNull() & F.col("urgency").isNotNull())
        .withWatermark("ts", lateness)
        .groupBy(F.window("ts", width, slide), "urgency")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "urgency",
            "n",
        )
    )
