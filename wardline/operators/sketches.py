"""Dashboard figures from mergeable sketches: frequent terms with a proof, distinct counts for any range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import vocab
from wardline.functions.text import words
from wardline.operators.dashboard import event_day, top_terms

GROUPS = 64  # sketches of tasks meet in so many groups before they meet in one
# A frequent-items sketch of m slots is off by 3.5 / m of all items at most. It lists for sure what
# occurs more than twice as often.
SURE = 7.0


def heavy_terms(
    df: DataFrame,
    text: str = "complaint_text",
    limit: int = 200,
    stop_words: Sequence[str] = tuple(vocab.STOP_WORDS),
    tracked: int = 10_000,
) -> DataFrame:
    """The rows of ``top_terms``, without shuffling every distinct term.

    Each task keeps a sketch of ``tracked`` terms. Terms on the merged sketch's list are counted exactly in
    a second pass. A term that is not listed occurs at most ``SURE`` / slots of all words; where the last
    row counts more, the rows are proven. Where that proof fails, all terms are counted.
    """
    terms = df.select(F.explode(words(F.col(text))).alias("term")).filter(~F.col("term").isin(list(stop_words)))
    slots = 1 << (int(tracked / 0.75 - 1e-9)).bit_length()
    listed = max(1, int(slots / SURE))
    per_group = terms.groupBy((F.spark_partition_id() % GROUPS).alias("at")).agg(
        F.expr(f"approx_top_k_accumulate(term, {tracked})").alias("s"), F.count(F.lit(1)).alias("n")
    )
    merged = per_group.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(s, {tracked})").alias("s"), F.sum("n").alias("n"))
    found = merged.select("n", F.expr(f"approx_top_k_estimate(s, {min(listed, tracked)})").alias("top")).first()
    if found is None:
        return top_terms(df, text, limit, stop_words)
    most = SURE * found.n / slots  # no term that is not listed occurs more often
    names = df.sparkSession.createDataFrame([(t.item,) for t in found.top], "term string")
    counted = terms.join(F.broadcast(names), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.orderBy(F.desc("n"), "term").limit(limit).collect()
    if most < 1 or (len(rows) == limit and rows[-1].n > most):
        return df.sparkSession.createDataFrame(rows, counted.schema).orderBy(F.desc("n"), "term")
    return top_terms(df, text, limit, stop_words)


def daily_distinct(df: DataFrame, columns: Sequence[str], lg_slots: int = 12) -> DataFrame:
    """``day`` and one distinct-count sketch per column, to store and to merge for any range of days.

    Beyond small sets the standard error is about 1.04 / 2^(``lg_slots`` / 2): 1.6 % with 4,096 slots.
    """
    sketches = [F.hll_sketch_agg(F.col(c), lg_slots).alias(c) for c in columns]
    return df.select(event_day(df).alias("day"), *columns).groupBy("day").agg(*sketches)


def merged_distinct(sketches: DataFrame, columns: Sequence[str], days: Column | None = None) -> DataFrame:
    """One row: distinct values of each column over the days asked for; NULL values do not count."""
    chosen = sketches if days is None else sketches.where(days)
    return chosen.agg(*[F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).cast("long").alias(c) for c in columns])
