"""Linear model heads over word counts: training, scoring and evaluation.

A model is a table ``term, weights`` with one weight per slot, a slot being one label of one head.
The empty term carries the label priors, and every text has it once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wardline.functions.scores import entry
from wardline.functions.text import let, term_counts, words
from wardline.operators.arrays import SCORE_LIST, score_column
from wardline.operators.joins import BROADCAST_BYTES, lookup_join, measured_bytes
from wardline.session import shared_dir

Heads = Mapping[str, Sequence[str]]


@dataclass(frozen=True)
class LinearHeads:
    """The stored weights of all heads."""

    weights: DataFrame
    heads: Heads

    @property
    def slots(self) -> list[tuple[str, str]]:
        return [(head, label) for head, labels in self.heads.items() for label in labels]


def train_naive_bayes(
    df: DataFrame,
    text: str,
    heads: Heads,
    path: str,
    smoothing: float = 1.0,
) -> LinearHeads:
    """Multinomial naive Bayes for several heads in one pass over the words.

    Each head is a column of ``df`` with its possible labels; a NULL label leaves the row out of
    that head. Words are counted by label of every head in one shuffle, of one row per word and task, so
    a frequent word is as many rows as there are tasks. The counts are written below ``path``, as are the weights: a lost executor costs no retraining, and scoring reads
    the stored model. Only the totals, one number per label, pass through the driver. A head without
    a labelled row has NULL weights.
    """
    def hits(head: str) -> Column:
        value = F.col(f"`{head}`").cast("string")
        return F.array(
            *[F.sum(F.when(value == x, F.lit(1).cast("long")).otherwise(0)) for x in heads[head]]
        ).alias(head)

    every_text = F.when(F.col(text).isNotNull(), F.array(F.lit("")))
    counts = (
        df.select(*heads, F.explode(F.concat(words(F.col(text)), every_text)).alias("term"))
        .groupBy("term")
        .agg(*[hits(head) for head in heads])
    )
    counts.write.mode("overwrite").parquet(f"{path}/counts")
    written = df.sparkSession.read.schema(counts.schema).parquet(f"{path}/counts")

    is_word = F.col("term") != ""

    def known(head: str) -> Column:
        return F.array_max(F.col(f"`{head}`")) > 0

    sums = []
    for number, (head, labels) in enumerate(heads.items()):
        sums.append(F.count_if(is_word & known(head)).alias(f"k{number}"))
        for at in range(len(labels)):
            n = F.get(F.col(f"`{head}`"), F.lit(at))
            sums.append(F.sum(F.when(is_word, n).otherwise(0)).alias(f"n{number}_{at}"))
            sums.append(F.sum(F.when(is_word, 0).otherwise(n)).alias(f"d{number}_{at}"))
    totals = written.agg(*sums).first().asDict()

    parts = []
    for number, (head, labels) in enumerate(heads.items()):
        mass = [totals[f"n{number}_{i}"] + smoothing * totals[f"k{number}"] for i in range(len(labels))]
        texts = [totals[f"d{number}_{i}"] for i in range(len(labels))]
        if not sum(texts):
            # Nothing was labelled: no weights, so that the head gives NULL and the fallback applies.
            parts.append(F.array(*[F.lit(None).cast("double")] * len(labels)))
            continue
        prior = [math.log(n / sum(texts)) if n else -math.inf for n in texts]
        word = F.zip_with(
            F.col(f"`{head}`"),
            F.array(*[F.lit(float(m)) for m in mass]),
            lambda n, m: F.log((n + smoothing) / m),
        )
        unknown = F.array(*[F.lit(0.0)] * len(labels))
        parts.append(
            F.when(~is_word, F.array(*[F.lit(p) for p in prior])).when(known(head), word).otherwise(unknown)
        )
    weights = written.select("term", F.concat(*parts).alias("weights"))
    weights.write.mode("overwrite").parquet(f"{path}/weights")
    return load_heads(df.sparkSession, path, heads)


def load_heads(spark: SparkSession, path: str, heads: Heads) -> LinearHeads:
    """A trained model from where training has written it."""
    schema = "term string, weights array<double>"
    return LinearHeads(spark.read.schema(schema).parquet(f"{path}/weights"), {h: list(x) for h, x in heads.items()})


def model_table(model: LinearHeads) -> DataFrame:
    """``term, head, label, weight``, one row per weight."""
    names = F.array(
        *[F.struct(F.lit(h).alias("head"), F.lit(label).alias("label")) for h, label in model.slots]
    )
    return model.weights.select("term", F.posexplode("weights").alias("slot", "weight")).select(
        "term", F.get(names, F.col("slot"))["head"].alias("head"),
        F.get(names, F.col("slot"))["label"].alias("label"), "weight",
    )


def _softmax(values: Sequence[Column], labels: Sequence[str]) -> Column:
    """Score list from log scores; one exponential per label, shifted by the largest."""
    return let(
        F.array(*values),
        lambda v: let(
            F.transform(v, lambda x: F.exp(x - F.array_max(v))),
            lambda e: F.transform(
                F.arrays_zip(F.array(*[F.lit(x) for x in labels]).alias("label"), e.alias("e")),
                lambda z: entry(z["label"], z["e"] / F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)),
            ),
        ),
    )


def score_heads(df: DataFrame, model: LinearHeads, key: str, text: str) -> DataFrame:
    """``key`` and one score list ``<head>_scores`` per head, for keys that name one row each.

    Words are counted inside the row, so the join sees each word of a text once. A missing text gives
    no row. ``row_scorer`` scores rows in place, whatever their keys, while the model is small.
    """
    terms = F.concat(
        term_counts(words(F.col(text))),
        F.array(F.struct(F.lit("").alias("term"), F.lit(1).alias("n"))),
    )
    # A missing text has no list and so no rows; a filter would compute a derived text twice.
    facts = df.select(key, F.inline(terms).alias("term", "n"))
    joined = lookup_join(facts, model.weights, "term")
    sums = joined.groupBy(key).agg(
        *[
            F.sum(F.col("n") * F.get("weights", F.lit(i))).alias(f"_s{i}")
            for i in range(len(model.slots))
        ]
    )
    columns, at = [], 0
    for head, labels in model.heads.items():
        values = [F.col(f"_s{i}") for i in range(at, at + len(labels))]
        columns.append(F.when(values[0].isNotNull(), _softmax(values, labels)).alias(f"{head}_scores"))
        at += len(labels)
    return sums.select(key, *columns)


def row_scorer(model: LinearHeads, text: str = "cleaned_text") -> Callable[[DataFrame], DataFrame]:
    """A scorer for rows in place: one scan, no shuffle, other columns untouched.

    The weights go to the workers once as a matrix, which is why their bytes are counted first; with a
    larger model the rows are numbered and stored and go through ``score_heads``. Each batch looks a
    distinct word up once. A missing text has no scores.
    """
    if measured_bytes(model.weights) > BROADCAST_BYTES:
        return _numbered_scorer(model, text)
    rows = model.weights.toArrow()
    terms = {t: i for i, t in enumerate(rows.column("term").to_pylist())}
    width = len(model.slots)
    flat = pc.list_flatten(rows.column("weights")).to_numpy(zero_copy_only=False).astype(float)
    weights = np.vstack([flat.reshape(-1, width), np.zeros(width)])
    shared = model.weights.sparkSession.sparkContext.broadcast((terms, weights))
    heads = model.heads

    def score(df: DataFrame) -> DataFrame:
        schema = T.StructType(list(df.schema.fields))
        for head in heads:
            schema = schema.add(f"{head}_scores", SCORE_LIST)
        with_terms = df.withColumn("_terms", words(F.col(text)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, matrix = shared.value
            none = len(matrix) - 1
            for batch in batches:
                lists = batch.column(batch.num_columns - 1)
                spelled = pc.dictionary_encode(pc.list_flatten(lists))
                codes = np.array([index.get(t, none) for t in spelled.dictionary.to_pylist()], dtype=np.int64)
                owner = pc.list_parent_indices(lists).to_numpy()
                sums = np.tile(matrix[index[""]] if "" in index else matrix[none], (batch.num_rows, 1))
                if len(spelled):
                    np.add.at(sums, owner, matrix[codes[spelled.indices.to_numpy()]])
                missing = np.asarray(pc.is_null(lists))
                columns, at = list(batch.columns[:-1]), 0
                for labels in heads.values():
                    part = sums[:, at : at + len(labels)]
                    at += len(labels)
                    with np.errstate(invalid="ignore"):
                        raw = np.exp(part - part.max(axis=1, keepdims=True)) if len(part) else part
                        columns.append(score_column(raw / raw.sum(axis=1, keepdims=True), labels, missing | np.isnan(part).any(axis=1)))
                yield pa.RecordBatch.from_arrays(columns, schema=to_arrow_schema(schema))

        return with_terms.mapInArrow(run, schema)

    return score


def _numbered_scorer(model: LinearHeads, text: str) -> Callable[[DataFrame], DataFrame]:
    """The scorer of a model too large to send out. Rows are stored, so that both scans see one number."""

    def score(df: DataFrame) -> DataFrame:
        key = "_number"
        while key in df.columns:
            key += "_"
        path = shared_dir(df.sparkSession, "numbered-rows")
        numbered = df.withColumn(key, F.monotonically_increasing_id())
        numbered.write.parquet(path)
        stored = df.sparkSession.read.schema(numbered.schema).parquet(path)
        return stored.join(score_heads(stored, model, key, text), key, "left").drop(key)

    return score


def evaluate(df: DataFrame, head: Column, truth: Column, predicted: Column) -> DataFrame:
    """``head, n, accuracy, weighted_f1`` from one row per head and prediction.

    The rows shrink to a confusion table first; everything after it is as small as the label sets.
    """
    confusion = (
        df.select(head.alias("head"), truth.alias("truth"), predicted.alias("predicted"))
        .filter(F.col("truth").isNotNull())
        .groupBy("head", "truth", "predicted")
        .agg(F.count("*").alias("n"))
    )
    hit = F.when(F.col("truth").eqNullSafe(F.col("predicted")), F.col("n")).otherwise(0)
    roles = F.array(
        F.struct(
            F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("claimed"),
            hit.cast("bigint").alias("hit"),
        ),
        F.struct(
            F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("claimed"),
            F.lit(0).cast("bigint").alias("hit"),
        ),
    )
    per_label = (
        confusion.select("head", F.inline(roles))
        .groupBy("head", "label")
        .agg(F.sum("support").alias("support"), F.sum("claimed").alias("claimed"), F.sum("hit").alias("hit"))
        .withColumn("f1", 2.0 * F.col("hit") / (F.col("support") + F.col("claimed")))
    )
    return per_label.groupBy("head").agg(
        F.sum("support").alias("n"),
        (F.sum("hit") / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
    )
