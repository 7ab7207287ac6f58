"""Discriminative linear heads: softmax regression on the long term table.

A text is a row of word counts scaled to length one, beside a bias of one under the empty term. The loss is
the mean cross-entropy of every head over the rows labelled for it, plus ``l2`` / 2 times the squared weights.

One round is two joins and two sums: weights meet terms and are summed per text, residuals meet terms and
are summed per term. The terms are stored twice, in buckets by text and by term, and never move again: a round
shuffles sums per text, sums per term and the few rows they meet. The number of buckets follows the cores, not
the rows, so what a round moves grows no faster than texts and vocabulary. Residuals of a head add up to zero,
and so do its weights; the last label of a head is left out of all tables until the end. Weights, gradient and the last steps stay a table by term, written every round, so a
lost executor costs one round at most and no vector as long as the vocabulary reaches the driver. The
direction is that of L-BFGS: it is a sum of stored vectors, so the driver only sees their inner products,
a few dozen numbers, and returns coefficients. A step that does not lower the loss enough is halved. What a
round leaves behind is removed once the next one is stored, so the folder does not grow with the rounds.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from itertools import combinations_with_replacement
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.text import let, term_counts, words
from wardline.operators.heads import Heads, _softmax
from wardline.operators.joins import BROADCAST_BYTES, lookup_join, measured_bytes

PARTITIONS = "spark.sql.shuffle.partitions"
KEPT = 4  # steps and gradient changes that the direction is made of
BUCKETS_A_CORE = 2
LESS = 1e-4  # share of the promised decrease that a step has to bring
SHORTEST = 1e-6  # a direction without a lower loss down to this share of a step is given up


class SoftmaxHeads(NamedTuple):
    """``weights`` has ``term, weights`` with one weight per label of every head."""

    weights: DataFrame
    heads: Mapping[str, Sequence[str]]
    loss: float
    rounds: int


def scaled_terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, x``: counts of distinct words over their length as a vector, and the bias."""
    counted = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), term_counts(words(F.col(text))).alias("t"))
    norm = F.sqrt(F.aggregate("t", F.lit(0.0), lambda s, t: s + t["n"] * t["n"]))

    def scaled(n: Column) -> Column:
        bias = F.array(F.struct(F.lit("").alias("term"), F.lit(1.0).alias("x")))
        return F.concat(F.transform("t", lambda t: F.struct(t["term"].alias("term"), (t["n"] / n).alias("x"))), bias)

    return counted.select("key", F.inline(let(norm, scaled)))


def _at(name: str, i: int) -> Column:
    return F.get(name, F.lit(i))


def _dot(a: str, b: str, slots: Sequence[Sequence[int]]) -> Column:
    """Inner product over all labels; those left out are minus the sum of their head's others."""
    each = [_at(a, i) * _at(b, i) for own in slots for i in own]
    last = [sum([_at(a, i) for i in own], F.lit(0.0)) * sum([_at(b, i) for i in own], F.lit(0.0)) for own in slots]
    return F.sum(sum([*each, *last], F.lit(0.0)))


@contextmanager
def _partitions(spark: SparkSession, number: int) -> Iterator[None]:
    """Shuffles have as many partitions as the stored tables have buckets, so that they meet as they lie."""
    before = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, number)
    try:
        yield
    finally:
        spark.conf.set(PARTITIONS, before)


class _Problem:
    """The stored terms and labels of a training set, and what a round asks of them."""

    def __init__(self, df: DataFrame, key: str, text: str, heads: Heads, path: str, l2: float, buckets: int):
        self.spark, self.path, self.l2, self.heads = df.sparkSession, path, l2, heads
        free, self.slots = 0, []
        for labels in heads.values():
            self.slots.append(list(range(free, free + len(labels) - 1)))
            free += len(labels) - 1
        self.width, self.buckets, self.tables = free, buckets, {}
        self.terms = self._bucketed(scaled_terms(df, key, text), "terms", "key")
        self.by_term = self._bucketed(self.terms, "terms-by-term", "term")
        place = [F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(h).cast("string")).cast("int") - 1 for h, labels in heads.items()]
        known = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.array(*[F.coalesce(p, F.lit(-1)) for p in place]).alias("truth"))
        self.truth = self._stored(known, "truth")
        counts = self.truth.agg(*[F.count_if(_at("truth", h) >= 0) for h in range(len(heads))]).first()
        self.labelled = [c or 0 for c in counts]

    def _stored(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def _bucketed(self, df: DataFrame, name: str, by: str) -> DataFrame:
        """Stored in buckets, so that a join on ``by`` finds its rows where they lie."""
        table = f"softmax_{uuid.uuid4().hex}"
        out = df.repartition(self.buckets, by).write.bucketBy(self.buckets, by).format("parquet")
        out.option("path", f"{self.path}/{name}").saveAsTable(table)
        self.tables[name] = table
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        """Removes stored tables that nothing reads any more."""
        for name in names:
            if name in self.tables:
                self.spark.sql(f"DROP TABLE {self.tables.pop(name)}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        for table in self.tables.values():
            self.spark.sql(f"DROP TABLE {table}")

    def start(self) -> DataFrame:
        """``term, w``: no weights yet."""
        zero = F.array_repeat(F.lit(0.0), self.width)
        return self.by_term.select("term").distinct().select("term", zero.alias("w"))

    def measured(self, state: DataFrame, name: str) -> tuple[DataFrame, float]:
        """``state`` with the gradient ``g`` at its weights ``w``, stored, and the cross-entropy there."""
        margins = self._joined("term", state.select("term", "w")).groupBy("key").agg(
            *[F.sum(F.col("x") * _at("w", i)).alias(f"m{i}") for i in range(self.width)]
        )
        parts, losses = [], []
        for number, (slots, n) in enumerate(zip(self.slots, self.labelled)):
            every = [F.col(f"m{i}") for i in slots]
            every.append(-sum(every, F.lit(0.0)))
            top = F.greatest(*every) if len(every) > 1 else every[0]
            mass = sum([F.exp(m - top) for m in every], F.lit(0.0))
            truth, given = _at("truth", number), _at("truth", number) >= 0
            hit = [F.when(truth == j, F.lit(1.0)).otherwise(0.0) for j in range(len(every))]
            share = 1.0 / max(n, 1)
            parts += [F.when(given, (F.exp(m - top) / mass - h) * share).otherwise(0.0) for m, h in zip(every[:-1], hit)]
            mine = sum([m * h for m, h in zip(every, hit)], F.lit(0.0))
            losses.append(F.when(given, (F.log(mass) + top - mine) * share).otherwise(0.0))
        residuals = margins.join(self.truth, "key").select("key", F.array(*parts).alias("r"), sum(losses[1:], losses[0]).alias("loss"))
        residuals = self._stored(residuals, f"residuals-{name}")
        loss = residuals.agg(F.sum("loss")).first()[0] or 0.0
        sums = self._joined("key", residuals.select("key", "r")).groupBy("term").agg(
            *[F.sum(F.col("x") * _at("r", i)).alias(f"g{i}") for i in range(self.width)]
        )
        gradient = F.array(*[F.col(f"g{i}") + self.l2 * _at("w", i) for i in range(self.width)])
        stored = self._bucketed(state.join(sums, "term").select(*state.columns, gradient.alias("g")), f"state-{name}", "term")
        self.drop(f"residuals-{name}")
        return stored, loss

    def _joined(self, by: str, lookup: DataFrame) -> DataFrame:
        """The terms with a lookup by key or term: a small one goes to all of them, else its buckets to theirs.

        Terms that a small lookup goes to lie as their sums are grouped next, so those are not shuffled either.
        """
        if measured_bytes(lookup) <= BROADCAST_BYTES:
            return (self.terms if by == "term" else self.by_term).join(F.broadcast(lookup), by)
        return (self.by_term if by == "term" else self.terms).join(lookup.hint("shuffle_hash"), by)


def _coefficients(products: dict[tuple[str, str], float], steps: list[tuple[str, str]]) -> dict[str, float]:
    """Two-loop recursion of L-BFGS on inner products: the direction as a sum of stored vectors."""
    names = ["g", *[n for pair in steps for n in pair]]
    at = {n: i for i, n in enumerate(names)}
    gram = np.array([[products[min(a, b), max(a, b)] for b in names] for a in names])
    q, alphas = np.zeros(len(names)), {}
    q[at["g"]] = -1.0
    for s, y in reversed(steps):
        alphas[s] = (gram[at[s]] @ q) / gram[at[s], at[y]]
        q[at[y]] -= alphas[s]
    if steps:
        s, y = steps[-1]
        q *= gram[at[s], at[y]] / gram[at[y], at[y]]
    for s, y in steps:
        q[at[s]] += alphas[s] - (gram[at[y]] @ q) / gram[at[s], at[y]]
    return dict(zip(names, q.tolist()))


def train_softmax(
    df: DataFrame, key: str, text: str, heads: Heads, path: str, l2: float = 1e-3, rounds: int | None = None, tolerance: float = 1e-7
) -> SoftmaxHeads:
    """Softmax regression for several heads; each is a column of ``df`` with its labels, NULL leaves a row out.

    ``key`` names one row each. Everything is written below ``path``, an own folder. Training ends when two rounds in
    a row lower the loss by no more than ``tolerance`` of it, however many that takes; only a caller who names
    ``rounds`` gets the weights of that round instead.
    """
    spark = df.sparkSession
    buckets = BUCKETS_A_CORE * spark.sparkContext.defaultParallelism
    with _partitions(spark, buckets):
        problem = _Problem(df, key, text, heads, path, l2, buckets)
        loss, done = _descend(problem, rounds, tolerance)
        problem.drop(*problem.tables, "truth")
        problem.close()
    weights = spark.read.schema("term string, weights array<double>").parquet(f"{path}/weights")
    return SoftmaxHeads(weights, heads, loss, done)


def _descend(problem: _Problem, rounds: int | None, tolerance: float) -> tuple[float, int]:
    """Rounds until the loss stays; writes the weights, gives the loss and the number of rounds."""
    l2 = problem.l2
    state, loss = problem.measured(problem.start(), "0")
    steps: list[tuple[str, str]] = []
    done, still, at = 0, 0, "state-0"
    products: dict[tuple[str, str], float] = {}
    while (rounds is None or done < rounds) and not math.isclose(loss, 0.0) and still < 2:
        names = ["g", "w", *[n for pair in steps for n in pair]]
        known = {pair: v for pair, v in products.items() if {"g", "w"}.isdisjoint(pair)}  # earlier steps stay as they are
        pairs = [(min(a, b), max(a, b)) for a, b in combinations_with_replacement(names, 2)]
        pairs = [pair for pair in pairs if pair not in known]
        row = state.agg(*[_dot(a, b, problem.slots) for a, b in pairs]).first()
        products = known | {pair: v or 0.0 for pair, v in zip(pairs, row)}
        if products["g", "g"] <= 1e-18:
            break
        steps = [(s, y) for s, y in steps if products[min(s, y), max(s, y)] > 0]  # no curvature, nothing to learn
        ways = _coefficients(products, steps)
        along = lambda v: sum(c * products[min(v, n), max(v, n)] for n, c in ways.items())  # noqa: E731, B023
        slope, square = along("g"), sum(c * along(n) for n, c in ways.items())
        size = 1.0 if steps else min(1.0, 1.0 / math.sqrt(products["g", "g"]))
        done += 1
        while True:
            move = lambda i: sum([c * size * F.get(F.col(n), i) for n, c in ways.items()], F.lit(0.0))  # noqa: E731, B023
            step = F.transform(F.sequence(F.lit(0), F.lit(problem.width - 1)), move)
            moved = state.select(
                "term", F.zip_with("w", step, lambda w, d: w + d).alias("w"), F.col("g").alias("before"), step.alias(f"s{done}"),
                *[n for pair in steps[-KEPT + 1 :] for n in pair],
            )
            name = f"{done}-{size:g}"
            tried, value = problem.measured(moved, name)
            value += l2 / 2 * (products["w", "w"] + 2 * size * along("w") + size * size * square)
            lower = value <= loss + LESS * size * slope
            if lower or size < SHORTEST:
                break
            problem.drop(f"state-{name}")
            size /= 2
        if not lower:
            problem.drop(f"state-{name}")
            if not steps:  # not even the gradient leads down
                break
            steps = []
            continue
        problem.drop(at)
        at = f"state-{name}"
        steps = [*steps[-KEPT + 1 :], (f"s{done}", f"y{done}")]
        kept = [n for pair in steps[:-1] for n in pair]
        state = tried.select("term", "w", "g", f"s{done}", F.zip_with("g", "before", lambda a, b: a - b).alias(f"y{done}"), *kept)
        still = still + 1 if loss - value <= tolerance * abs(loss) else 0
        loss = value
    every: list[Column] = []
    for slots in problem.slots:
        own = [_at("w", i) for i in slots]
        every += [*own, -sum(own, F.lit(0.0))]
    state.select("term", F.array(*every).alias("weights")).write.mode("overwrite").parquet(f"{problem.path}/weights")
    return loss, done


def score_softmax(df: DataFrame, model: SoftmaxHeads, key: str, text: str) -> DataFrame:
    """``key`` and one score list ``<head>_scores`` per head; a missing text gives no row."""
    width = sum(len(labels) for labels in model.heads.values())
    sums = lookup_join(scaled_terms(df, key, text), model.weights, "term").groupBy("key").agg(
        *[F.sum(F.col("x") * _at("weights", i)).alias(f"_s{i}") for i in range(width)]
    )
    columns, start = [], 0
    for head, labels in model.heads.items():
        columns.append(_softmax([F.col(f"_s{i}") for i in range(start, start + len(labels))], labels).alias(f"{head}_scores"))
        start += len(labels)
    return sums.select(F.col("key").alias(key), *columns)
