"""Shared pieces: tables in the shared folder, unique row numbers, sized broadcasts, components."""

from __future__ import annotations

from collections.abc import Mapping
from types import MappingProxyType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.session import shared_dir

# A table is broadcast only after its rows have been counted and their bytes stay below this.
BROADCAST_BYTES = 16_000_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one run below the folder that the cluster shares.

    A written table cuts the lineage: a lost executor costs the tasks it was running, not the steps
    that led there. ``drop`` removes a table that a later one replaces.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = shared_dir(spark, name)
        # Spark removes the shuffle files of earlier queries once the JVM has collected their plans.
        spark._jvm.System.gc()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, mode: str = "errorifexists", conf: Mapping[str, str] = MappingProxyType({})) -> DataFrame:
        """``df`` written and read back; ``conf`` holds while it is written."""
        # Once the table is written, nobody reads the shuffle files that led to it.
        conf = {CLEANUP: "true", **conf}
        before = {k: self.spark.conf.get(k, "false" if k == CLEANUP else None) for k in conf}
        for k, v in conf.items():
            self.spark.conf.set(k, v)
        try:
            df.write.mode(mode).option("compression", "zstd").parquet(self.path(name))
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        return self.read(df.schema, name)

    def read(self, schema: T.StructType, name: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def packed(df: DataFrame, **internal: Column) -> DataFrame:
    """All columns of ``df`` as the struct ``_row`` beside internal ones, so that no names clash."""
    names = [F.col(f"`{c}`") for c in df.columns]
    return df.select(F.struct(*names).alias("_row"), *[c.alias(n) for n, c in internal.items()])


def unpacked(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of ``_row`` again, some of them replaced."""
    return df.select(*[changed.get(c, F.col("_row").getField(c)).alias(c) for c in columns])


def numbered(df: DataFrame, key: str, scratch: Scratch, by: str | None = None) -> DataFrame:
    """``df`` packed, with ``_rid``: a unique number in the order of ``key``.

    Where every key is there and unique, the key itself is the number. Otherwise rows are sorted by
    key (nulls last) and ``by`` and numbered, so that repeated keys and repeated rows are rows of
    their own with a place in the order.
    """
    k = F.col(f"`{key}`")
    ids = df.select(k.alias("_k"))
    odd = ids.groupBy("_k").count().where("_k is null or count > 1")
    if odd.isEmpty():
        return packed(df, _rid=k.cast("long"))
    rows = packed(df, _k=k, _b=F.xxhash64(F.col(f"`{by or key}`")))
    dealt = rows.repartitionByRange(F.col("_k").asc_nulls_last(), F.col("_b"))
    ordered = dealt.sortWithinPartitions(F.col("_k").asc_nulls_last(), "_b")
    return scratch.save(ordered.select("_row", F.monotonically_increasing_id().alias("_rid")), "numbered")


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if its counted rows stay below the bound, else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else untouched."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """``node, component`` for every node of ``edges`` (``src, dst`` long): the smallest node reached.

    Alternating large and small stars: neighbours hang themselves under the smallest node they see,
    until nothing moves. Every step aggregates a minimum per node, so a node with very many links
    arrives as one row per task; links are joined back by node, where adaptive execution splits a
    large one. Rounds grow with the logarithm of the longest chain.
    """
    src, dst = F.col("src"), F.col("dst")
    pairs = edges.where(src != dst).select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    now, seen, turn = scratch.save(pairs.distinct(), f"{name}-0"), None, 0
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        lower = large.join(floor, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        turn += 1
        after = scratch.save(lower.union(floor.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{turn}")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{turn - 1}")
        if state == seen:
            break
        now, seen = after, state
    roots = after.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return after.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
