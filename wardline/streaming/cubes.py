"""All dashboards kept up to date from new rows alone.

The state is the log cube: rows counted per issue, severity, urgency, location and day. A batch is
counted and its counts become a piece of the state; the log is not read again. When a level holds
``fanout`` pieces they are added up to one of the next level, so a refresh reads and writes a few pieces
and every count is rewritten about once per level. Batch numbers fence off repeated batches.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from wardline.operators.dashboard import CUBE_SCHEMA, log_cube, merge_cubes
from wardline.sources.commits import Commits, Version


class LiveCube:
    """The cube below ``path``: ``add`` batches, ``read`` the counts so far."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = 8):
        self.spark, self.fanout, self.commits = spark, fanout, Commits(spark, path)

    def add(self, rows: DataFrame, batch: int, source: str = "batch") -> bool:
        """Count a batch of log rows; False if the source's batch is in already."""
        if batch <= self.commits.latest().fences.get(source, -1):
            return False
        name = self.commits.new_folder()
        log_cube(rows).write.parquet(self.commits.folder(name))

        def change(base: Version) -> Version | None:
            if batch <= base.fences.get(source, -1):
                return None
            return Version(0, {**base.fences, source: batch}, [*base.pieces, {"folder": name, "level": 0}])

        done = any(p["folder"] == name for p in self.commits.publish(change).pieces)
        while self._merge_level():
            pass
        return done

    def _merge_level(self) -> bool:
        levels = defaultdict(list)
        for piece in self.commits.latest().pieces:
            levels[piece["level"]].append(piece["folder"])
        full = next((level for level, names in sorted(levels.items()) if len(names) >= self.fanout), None)
        if full is None:
            return False
        old, name = set(levels[full]), self.commits.new_folder()
        merge_cubes(self._pieces(sorted(old))).write.parquet(self.commits.folder(name))

        def change(now: Version) -> Version | None:
            kept = [p for p in now.pieces if p["folder"] not in old]
            if len(now.pieces) - len(kept) != len(old):
                return None
            return Version(0, now.fences, [*kept, {"folder": name, "level": full + 1}])

        self.commits.publish(change)
        return True

    def _pieces(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], CUBE_SCHEMA)
        return self.spark.read.schema(CUBE_SCHEMA).parquet(*[self.commits.folder(n) for n in names])

    def read(self) -> DataFrame:
        """The cube of all batches so far, one row per combination."""
        return merge_cubes(self._pieces([p["folder"] for p in self.commits.latest().pieces]))


def live_cube(stream: DataFrame, cube: LiveCube, checkpoint: str) -> StreamingQuery:
    """Count what has arrived; a restart goes on from the checkpoint."""
    return (
        stream.writeStream.foreachBatch(lambda rows, batch: cube.add(rows, batch, checkpoint) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
