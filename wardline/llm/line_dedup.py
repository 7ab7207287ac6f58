"""Line dedup: levelled sorted runs of line hashes, merged batch by batch.

Built-in functions only. A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with
A-Z in lower case; it travels as two 64-bit hashes. A run is a table of keys, each with its first
document, bucketed and sorted by key, so that the anti join of the next batch reads it without a
shuffle. Runs hold disjoint keys.

Defined cases: a null or empty text is one empty line; keys shorter than ``min_chars`` are never
dropped; all lines of the first document that holds a key stay, repeats too; rows with equal or null
ids are documents of their own in the order of id (nulls last) and text hash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import Scratch, ascii_lower, numbered, unpacked

BLANK = " \t\n\x0b\f\r"
KEY = ["h1", "h2"]


def line_entries(rows: DataFrame, min_chars: int) -> DataFrame:
    """``_rid, pos, h1, h2`` of every line of ``_rid, _text`` with a key of ``min_chars`` code points."""
    lines = rows.select("_rid", F.posexplode(F.split(ascii_lower(F.coalesce("_text", F.lit(""))), "\n", -1)))
    keys = lines.select("_rid", "pos", F.btrim("col", F.lit(BLANK)).alias("key"))
    return keys.where(F.char_length("key") >= min_chars).select(
        "_rid", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
    )


class LineRuns:
    """The keys seen so far, as sorted runs in levels.

    A batch adds one run to level 0. ``fanout`` runs of a level become one run of the next, so n
    batches leave about ``fanout * log(n)`` runs to look into and each key is rewritten log(n) times.
    """

    def __init__(self, scratch: Scratch, fanout: int):
        self.scratch, self.fanout = scratch, fanout
        self.buckets = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.written: list[str] = []

    def runs(self) -> list[DataFrame]:
        return [self.scratch.spark.table(name) for level in self.levels for name in level]

    def _write(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        out = keys.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet")
        out.option("path", self.scratch.path(name)).saveAsTable(name)
        self.written.append(name)
        return name

    def add(self, entries: DataFrame) -> DataFrame:
        """Take in a batch; its lines to drop as ``_rid, pos``."""
        fresh = entries.groupBy(*KEY).agg(F.min("_rid").alias("first"))
        for run in self.runs():
            fresh = fresh.join(run, KEY, "left_anti")
        name = self._write(fresh)
        # Read as a plain table, so that a line in very many documents is split over tasks.
        own = self.scratch.read(fresh.schema, name)
        dropped = entries.join(own, KEY, "left").where(~F.col("first").eqNullSafe(F.col("_rid")))
        self._push(name, 0)
        return dropped.select("_rid", "pos")

    def _push(self, name: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            merged = None
            for run in self.levels[level]:
                keys = self.scratch.spark.table(run)
                merged = keys if merged is None else merged.union(keys)
            new = self._write(merged.repartition(self.buckets, *KEY))
            for run in self.levels[level]:
                self.scratch.spark.sql(f"DROP TABLE {run}")
            self.levels[level] = []
            self._push(new, level + 1)

    def close(self) -> None:
        """Forget the runs and remove their files: what they led to is stored."""
        for level in self.levels:
            for run in level:
                self.scratch.spark.sql(f"DROP TABLE {run}")
        self.scratch.drop(*self.written)
        self.levels, self.written = [[]], []


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 3
) -> DataFrame:
    """``docs`` with ``_kept``, ``_n_lines`` and ``_n_dropped``, packed (see ``common.packed``).

    Documents go through in ``batches`` of ascending ids, so what is in a run comes from a smaller id.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    rows = numbered(docs, key, scratch, text)
    body = F.col("_row").getField(text)
    slim = rows.select("_rid", body.alias("_text"))
    entries = scratch.save(line_entries(slim, min_chars), "entries")
    cuts = [F.lit(i / batches) for i in range(1, batches)]
    edges = slim.agg(F.percentile_approx("_rid", F.array(*cuts), F.lit(1000))).first()[0] if cuts else []
    bounds = [None, *sorted(set(edges or [])), None]
    runs, schema = LineRuns(scratch, fanout), None
    for low, high in zip(bounds, bounds[1:]):
        batch = entries
        if low is not None:
            batch = batch.where(F.col("_rid") > low)
        if high is not None:
            batch = batch.where(F.col("_rid") <= high)
        dropped = runs.add(batch)
        scratch.save(dropped, "dropped", "append")
        schema = dropped.schema
    runs.close()
    scratch.drop("entries")
    lists = scratch.read(schema, "dropped").groupBy("_rid").agg(F.collect_list("pos").alias("_drop"))
    return kept_lines(rows.join(lists, "_rid", "left"), body)


def kept_lines(rows: DataFrame, text: Column) -> DataFrame:
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    number = F.size(lines)
    # The set difference of positions is linear in the lines, whatever is dropped.
    stay = F.array_except(F.sequence(F.lit(0), number - 1), F.coalesce("_drop", F.array().cast("array<int>")))
    kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    return rows.select(
        "_row",
        F.when(F.col("_drop").isNull(), F.coalesce(text, F.lit(""))).otherwise(kept).alias("_kept"),
        number.cast("long").alias("_n_lines"),
        F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("long").alias("_n_dropped"),
    )


def deduplicated_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The columns of ``docs`` with repeated lines gone; ``n_chars`` follows where there is one."""
    done = dedup_lines(docs, text=text, **options)
    was = F.col("_row").getField(text)
    changed = {text: F.when(was.isNotNull(), F.col("_kept"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(was.isNotNull(), F.char_length("_kept").cast(docs.schema["n_chars"].dataType))
    return unpacked(done, docs.columns, **changed)
