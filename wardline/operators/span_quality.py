"""Quality of entity spans: predicted ones against annotated ones, per label.

Spans are rows ``key, label, start, end``, offsets half-open. Two scores:

* *exact*: same key, label and offsets; of repeated spans as many count as both sides have;
* *overlap*: spans of a label in the same text that share a character, matched one to one, the pair with
  the largest share of common characters (common / joint length) first, then by offsets.

Spans of both sides meet by text and label in one shuffle. There they are dealt over cells of ``CELL``
characters and a pair counts in the first cell that both reach, so texts with many spans give pairs only
where spans meet. Only the pairs of one label in one text are brought together for the matching.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.text import let

CELL = 64
_SPAN = "struct<start:int,end:int,twin:int>"
_PAIRS = f"array<struct<share:double,p:{_SPAN},a:{_SPAN}>>"


def span_rows(df: DataFrame, key: str, entities: str = "entities") -> DataFrame:
    """``key, label, start, end`` of an entity list, labels in upper case."""
    rows = df.select(F.col(key).alias("key"), F.explode(entities).alias("e"))
    return rows.select("key", F.upper("e.label").alias("label"), F.col("e.start").alias("start"), F.col("e.end").alias("end"))


def one_label(spans: DataFrame, labels: Sequence[str], name: str) -> DataFrame:
    """Several labels under one ``name``."""
    return spans.withColumn("label", F.when(F.col("label").isin(list(labels)), name).otherwise(F.col("label")))


def _sides(predicted: DataFrame, annotated: DataFrame) -> DataFrame:
    """``key, label, start, end, p, a``: how often a span is predicted and how often annotated."""

    def side(spans: DataFrame, p: int, a: int) -> DataFrame:
        rows = spans.where("key is not null and label is not null and start is not null and end is not null")
        ends = [F.col(c).cast("int").alias(c) for c in ("start", "end")]
        return rows.select("key", "label", *ends, F.lit(p).alias("p"), F.lit(a).alias("a"))

    # Everything that follows goes by text and label, so this is the only shuffle of spans.
    both = side(predicted, 1, 0).union(side(annotated, 0, 1)).repartition("key", "label")
    return both.groupBy("key", "label", "start", "end").agg(F.sum("p").cast("int").alias("p"), F.sum("a").cast("int").alias("a"))


def _pairs(spans: Column, cell: Column) -> Column:
    """Pairs of a cell's ``spans`` of both sides that share a character and have their first cell here."""

    def of(side: str) -> Column:
        def twins(s: Column) -> Column:
            return F.transform(F.sequence(F.lit(1), s[side]), lambda t: F.struct(s["start"].alias("start"), s["end"].alias("end"), t.alias("twin")))

        return F.flatten(F.transform(F.filter(spans, lambda s: s[side] > 0), twins))

    def met(p: Column, a: Column) -> Column:
        first = F.floor(F.greatest(p["start"], a["start"]) / CELL)
        return (p["start"] < a["end"]) & (a["start"] < p["end"]) & (cell == first)

    def ranked(p: Column, a: Column) -> Column:
        common = F.least(p["end"], a["end"]) - F.greatest(p["start"], a["start"])
        joint = F.greatest(p["end"], a["end"]) - F.least(p["start"], a["start"])
        return F.struct((-(common / joint)).alias("share"), p.alias("p"), a.alias("a"))

    def with_one(p: Column, others: Column) -> Column:
        return F.transform(F.filter(others, lambda a: met(p, a)), lambda a: ranked(p, a))

    none = F.array().cast(_PAIRS)
    return F.when(
        F.exists(spans, lambda s: s["p"] > 0) & F.exists(spans, lambda s: s["a"] > 0),
        let(of("a"), lambda others: F.flatten(F.transform(of("p"), lambda p: with_one(p, others)))),
    ).otherwise(none)


def _matched(pairs: Column) -> Column:
    """How many pairs a one-to-one matching of largest shares first keeps."""
    none = F.array().cast(f"array<{_SPAN}>")

    def take(kept: Column, pair: Column) -> Column:
        free = ~(F.array_contains(kept["p"], pair["p"]) | F.array_contains(kept["a"], pair["a"]))
        more = F.struct(F.array_append(kept["p"], pair["p"]).alias("p"), F.array_append(kept["a"], pair["a"]).alias("a"))
        return F.when(free, more).otherwise(kept)

    start = F.struct(none.alias("p"), none.alias("a"))
    chosen = F.aggregate(F.sort_array(pairs), start, take, lambda kept: F.size(kept["p"]))
    return F.when(F.size(pairs) > 1, chosen).otherwise(F.size(pairs)).cast("long")


def _text_counts(sides: DataFrame) -> DataFrame:
    """``label`` and the four counts of every text and label."""
    # A span without characters has its cell, too, so that it is counted; pairs leave it out.
    last = F.greatest(F.floor((F.col("end") - 1) / CELL), F.floor(F.col("start") / CELL))
    dealt = sides.select("*", F.posexplode(F.sequence(F.floor(F.col("start") / CELL), last)).alias("number", "cell"))
    once = lambda c: F.sum(F.when(F.col("number") == 0, c).otherwise(0))
    spans = F.collect_list(F.when(F.col("end") > F.col("start"), F.struct("start", "end", "p", "a")))
    cells = dealt.groupBy("key", "label", "cell").agg(
        once(F.col("p")).alias("predicted"), once(F.col("a")).alias("annotated"),
        once(F.least("p", "a")).alias("exact"), spans.alias("spans"),
    )
    cells = cells.select("*", _pairs(F.col("spans"), F.col("cell")).alias("pairs"))
    sums = [F.sum(c).alias(c) for c in ("predicted", "annotated", "exact")]
    texts = cells.groupBy("key", "label").agg(*sums, F.flatten(F.collect_list("pairs")).alias("pairs"))
    return texts.select("label", "predicted", "annotated", "exact", _matched(F.col("pairs")).alias("overlap"))


def span_quality(predicted: DataFrame, annotated: DataFrame) -> DataFrame:
    """A row per label, and ``*`` for all: counts, precision, recall and F1 of both scores.

    Spans that lack a key, label or offset count for neither side; empty spans can only match exactly.
    A rate without anything to divide by is NULL.
    """
    names = ["predicted", "annotated", "exact", "overlap"]
    counts = _text_counts(_sides(predicted, annotated))
    per_label = counts.groupBy("label").agg(*[F.sum(n).alias(n) for n in names])
    total = lambda what: F.coalesce(F.sum(what), F.lit(0)).alias(what)
    table = per_label.rollup("label").agg(F.grouping("label").alias("_all"), *[total(n) for n in names])

    def rate(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole)

    rates = []
    for kind in ("exact", "overlap"):
        hit, given, wanted = F.col(kind), F.col("predicted"), F.col("annotated")
        rates += [
            rate(hit, given).alias(f"{kind}_precision"),
            rate(hit, wanted).alias(f"{kind}_recall"),
            rate(2 * hit, given + wanted).alias(f"{kind}_f1"),
        ]
    return table.select(F.when(F.col("_all") == 1, "*").otherwise(F.col("label")).alias("label"), *names, *rates)
