"""Tables made of committed folders: each batch counts once, readers see one version.

Writers put rows in a new folder first and then publish a version, a small file that lists all folders in
use and, per source, the last batch taken in. What is not listed does not exist for readers, so a writer
that dies leaves nothing behind that counts, and a batch that arrives again is told by its number. A
version is put in place by a rename that fails if another writer was faster; the slower one reads the new
version and publishes again. Versions name folders, never rows: they stay small.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Callable
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wardline.sources.sinks import dated


class Version(NamedTuple):
    number: int
    fences: dict[str, int]  # source -> last batch taken in
    pieces: list[dict]  # folders in use


class Commits:
    """The versions of the table below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def _numbers(self) -> list[int]:
        folder = self._path("versions")
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def load(self, number: int) -> Version:
        stream = self._files.open(self._path(f"versions/{number:012}.json"))
        try:
            content = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(number, content["fences"], content["pieces"])

    def latest(self) -> Version:
        numbers = self._numbers()
        return self.load(numbers[-1]) if numbers else Version(0, {}, [])

    def publish(self, change: Callable[[Version], Version | None]) -> Version:
        """The version after ``change``, which is asked again whenever another writer came first."""
        while True:
            base = self.latest()
            wanted = change(base)
            if wanted is None:
                return base
            number = base.number + 1
            if self._put(number, json.dumps({"fences": wanted.fences, "pieces": wanted.pieces})):
                return Version(number, wanted.fences, wanted.pieces)

    def _put(self, number: int, content: str) -> bool:
        draft, target = self._path(f"versions/_{uuid.uuid4().hex}"), self._path(f"versions/{number:012}.json")
        out = self._files.create(draft, False)
        out.write(content.encode())
        out.close()
        kind = getattr(self._hadoop, "Options$Rename")
        context = self._hadoop.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, target, self.spark._sc._gateway.new_array(kind, 0))
        except Py4JJavaError as error:
            self._files.delete(draft, False)
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            return False
        return True

    def new_folder(self) -> str:
        return uuid.uuid4().hex

    def folder(self, name: str) -> str:
        return f"{self.root}/data/commit={name}"

    def children(self, name: str) -> list[tuple[str, int, int]]:
        """``(name, files, bytes)`` of the folders in a commit's folder."""
        path = self._path(f"data/commit={name}")
        out = []
        for status in self._files.listStatus(path) if self._files.exists(path) else []:
            if status.isDirectory():
                sizes = [s.getLen() for s in self._files.listStatus(status.getPath()) if s.getPath().getName().startswith("part-")]
                out.append((status.getPath().getName(), len(sizes), sum(sizes)))
        return sorted(out)

    def vacuum(self, keep: int = 2) -> None:
        """Remove all but the last ``keep`` versions and the folders only older ones use.

        Not for use while a writer is at work: what it has not published yet would go, too.
        """
        numbers = self._numbers()
        used = {p["folder"] for n in numbers[-keep:] for p in self.load(n).pieces}
        for n in numbers[:-keep]:
            self._files.delete(self._path(f"versions/{n:012}.json"), False)
        data = self._path("data")
        for status in self._files.listStatus(data) if self._files.exists(data) else []:
            if status.getPath().getName().removeprefix("commit=") not in used:
                self._files.delete(status.getPath(), True)


class CommittedLog:
    """The enriched log as committed folders by day.

    ``append`` takes a batch in once, however often it is written. ``compact`` packs the small files of
    a day together, cut by time of day, so that a range of hours reads a part of a day's files.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.schema, self.commits = spark, dated(spark.createDataFrame([], schema)).schema, Commits(spark, path)

    def append(self, rows: DataFrame, batch: int, source: str = "batch") -> bool:
        """Whether the rows were new: batches of a source are numbered upwards."""
        if batch <= self.commits.latest().fences.get(source, -1):
            return False
        name = self.commits.new_folder()
        spread = dated(rows).hint("rebalance", F.col("created_date"))
        spread.write.partitionBy("created_date").parquet(self.commits.folder(name))
        return self._publish(name, source, batch)

    def _publish(self, name: str, source: str, batch: int) -> bool:
        mine = self._pieces(name)

        def change(base: Version) -> Version | None:
            if batch <= base.fences.get(source, -1):
                return None
            return Version(0, {**base.fences, source: batch}, base.pieces + mine)

        return self.commits.publish(change).fences[source] == batch

    def _pieces(self, name: str) -> list[dict]:
        return [
            {"folder": name, "day": day.removeprefix("created_date="), "files": files, "bytes": size}
            for day, files, size in self.commits.children(name)
        ]

    def read(self, version: Version | None = None) -> DataFrame:
        """The rows of one version, by default of the newest; days prune folders."""
        pieces = (version or self.commits.latest()).pieces
        if not pieces:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.commits.folder(p['folder'])}/created_date={p['day']}" for p in pieces]
        stored = T.StructType([*[f for f in self.schema if f.name != "created_date"], T.StructField("created_date", T.StringType())])
        rows = self.spark.read.schema(stored).option("basePath", f"{self.commits.root}/data").parquet(*paths)
        return rows.select(self.schema.names)

    def files(self) -> dict[str, int]:
        """Number of files per day."""
        out: dict[str, int] = defaultdict(int)
        for piece in self.commits.latest().pieces:
            out[piece["day"]] += piece["files"]
        return dict(out)

    def compact(self, target: int = 128 << 20) -> list[str]:
        """Rewrite the days that have more files than their bytes need; returns these days.

        All such days are one job. A day becomes bytes / ``target`` + 1 files at most, each a span of hours.
        """
        base = self.commits.latest()
        by_day = defaultdict(list)
        for piece in base.pieces:
            by_day[piece["day"]].append(piece)
        parts = {day: sum(p["bytes"] for p in ps) // target + 1 for day, ps in by_day.items()}
        # What was packed for this target stays until something comes in beside it.
        full = [
            day
            for day, ps in by_day.items()
            if sum(p["files"] for p in ps) > parts[day] and any(p.get("packed") != target for p in ps)
        ]
        if not full:
            return []
        old = [p for day in full for p in by_day[day]]
        rows = self.read(Version(base.number, {}, old))
        sizes = self.spark.createDataFrame([(day, parts[day]) for day in full], "created_date string, _parts long")
        second = F.pmod(F.coalesce(F.unix_seconds("created_ts"), F.xxhash64(*rows.columns)), F.lit(86400))
        placed = rows.join(F.broadcast(sizes), "created_date").withColumn("_part", F.floor(second * F.col("_parts") / 86400))
        name = self.commits.new_folder()
        packed = placed.repartition(max(1, sum(parts[d] for d in full)), "created_date", "_part")
        packed = packed.sortWithinPartitions("created_date", "created_ts").drop("_parts", "_part")
        packed.write.partitionBy("created_date").parquet(self.commits.folder(name))
        new, gone = [{**p, "packed": target} for p in self._pieces(name)], {(p["folder"], p["day"]) for p in old}

        def change(now: Version) -> Version | None:
            kept = [p for p in now.pieces if (p["folder"], p["day"]) not in gone]
            if len(now.pieces) - len(kept) != len(gone):
                return None  # another compaction was faster
            return Version(0, now.fences, kept + new)

        return sorted(full) if self.commits.publish(change).pieces[-len(new) :] == new else []


def commit_stream(stream: DataFrame, log: CommittedLog, checkpoint: str) -> StreamingQuery:
    """Take in what has arrived, each batch once; a restart goes on from the checkpoint."""
    return (
        stream.writeStream.foreachBatch(lambda rows, batch: log.append(rows, batch, checkpoint) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
