"""Feature blocks: TF-IDF, pooled embeddings, hashed embeddings, keyword counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline import vocab
from wardline.functions.text import keyword_counts, let, ngrams, term_counts, words
from wardline.operators.joins import lookup_join


def _grams(text: Column, orders: Sequence[int] = (1, 2)) -> Column:
    """All n-grams of the given orders in one list."""
    return let(
        words(text),
        lambda tokens: F.concat(*[tokens if n == 1 else ngrams(tokens, n) for n in orders]),
    )


def _term_rows(df: DataFrame, key: str, text: str, orders: Sequence[int]) -> DataFrame:
    return df.select(key, F.inline(term_counts(_grams(F.col(text), orders))).alias("term", "n"))


def fit_tfidf(
    df: DataFrame,
    text: str,
    max_features: int = vocab.MAX_FEATURES,
    orders: Sequence[int] = (1, 2),
) -> DataFrame:
    """``term, idx, cf, df, idf`` of the most frequent terms.

    Ties go to the smaller term, and ``idx`` follows the order of the terms. Counts per text come
    from inside the row, so the one shuffle moves combined counts per term. The empty term counts
    the texts; it rides along in the same aggregation.
    """
    every_text = F.array(F.struct(F.lit("").alias("term"), F.lit(0).alias("n")))
    counts = term_counts(_grams(F.col(text), orders))
    ranked = (
        df.select(F.inline(F.concat(counts, every_text)).alias("term", "n"))
        .groupBy("term")
        .agg(F.sum("n").alias("cf"), F.count(F.lit(1)).alias("df"))
        .orderBy((F.col("term") != "").cast("int"), F.desc("cf"), "term")
        .limit(max_features + 1)
    )
    # At most max_features + 1 rows from here on.
    everything = Window.partitionBy(F.lit(0))
    texts = F.max(F.when(F.col("term") == "", F.col("df"))).over(everything)
    position = F.row_number().over(everything.orderBy("term")) - 2
    return ranked.select(
        "term",
        position.cast("int").alias("idx"),
        "cf",
        "df",
        (F.log((texts + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"),
    ).filter(F.col("term") != "")


def transform_tfidf(
    df: DataFrame,
    vocabulary: DataFrame,
    key: str,
    text: str,
    orders: Sequence[int] = (1, 2),
) -> DataFrame:
    """``key, idx, value``: tf-idf weights, each text scaled to length one.

    ``vocabulary`` is a stored table; it is broadcast if its counted bytes are few. Terms arrive
    counted; the window for the norm is then the only shuffle of them.
    """
    rows = _term_rows(df, key, text, orders)
    found = lookup_join(rows, vocabulary.select("term", "idx", "idf"), "term").select(key, "idx", (F.col("n") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return found.select(key, "idx", (F.col("w") / norm).alias("value"))


def mean_pool(df: DataFrame, key: str, vector: str, mask: Column | None = None) -> DataFrame:
    """``key, pooled``: mean per dimension over rows, weighted by ``mask``.

    Sums combine before the shuffle, one row per key and dimension. A key without any weight pools
    to zeros.
    """
    weight = F.lit(1.0) if mask is None else mask.cast("double")
    cells = df.select(key, weight.alias("_m"), F.posexplode(vector).alias("dim", "x"))
    sums = cells.groupBy(key, "dim").agg(
        F.sum(F.col("_m") * F.col("x")).alias("s"), F.sum("_m").alias("c")
    )
    means = sums.select(key, "dim", (F.col("s") / F.greatest(F.col("c"), F.lit(1e-9))).alias("x"))
    return (
        means.groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("_cells"))
        .select(key, F.transform("_cells", lambda c: c["x"]).alias("pooled"))
    )


def keyword_block(
    df: DataFrame, key: str, text: str, keywords: Sequence[str] = tuple(vocab.FEATURE_KEYWORDS)
) -> DataFrame:
    """``key, idx, value`` for keywords that occur."""
    counts = F.array(*keyword_counts(F.col(text), keywords))
    return (
        df.select(key, F.posexplode(counts).alias("idx", "value"))
        .filter(F.col("value") > 0)
        .select(key, "idx", F.col("value").cast("double").alias("value"))
    )


def hash_block(df: DataFrame, key: str, text: str, dim: int = 32) -> DataFrame:
    """``key, idx, value``: mean of hashed one-hot words over the whole text.

    The stand-in encoder without a model; ``encode_texts`` runs a real one.
    """
    bucket = F.conv(F.left(F.md5("term"), F.lit(8)), 16, 10).cast("bigint") % dim
    counted = let(
        words(F.col(text)),
        lambda tokens: F.transform(
            term_counts(tokens),
            lambda t: F.struct(t["term"].alias("term"), t["n"].alias("n"), F.size(tokens).alias("words")),
        ),
    )
    return (
        df.select(key, F.inline(counted).alias("term", "n", "words"))
        .groupBy(key, bucket.cast("int").alias("idx"))
        .agg((F.sum("n") / F.max("words")).alias("value"))
    )


def concat_blocks(blocks: Sequence[tuple[DataFrame, int]], key: str) -> DataFrame:
    """Blocks ``key, idx, value`` side by side; each comes with its width."""
    shifted, offset = [], 0
    for block, width in blocks:
        shifted.append(block.select(key, (F.col("idx") + offset).alias("idx"), "value"))
        offset += width
    result = shifted[0]
    for block in shifted[1:]:
        result = result.unionByName(block)
    return result


# An encoder maps a list of texts to token vectors [batch, token, dim] and a mask [batch, token].
Encoder = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def encode_texts(
    df: DataFrame,
    load: Callable[[], Encoder],
    key: str,
    text: str,
    batch_size: int = 16,
    max_words: int = 256,
) -> DataFrame:
    """``key, embedding`` from a user's token encoder, mean-pooled over the whole text.

    ``load`` runs once per task, inside the worker. Texts longer than the encoder can take are cut
    into windows of ``max_words`` words, and the windows are pooled together.
    """
    key_type = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load()
        for frame in frames:
            pieces, owner = [], []
            for row, body in enumerate(frame[text]):
                tokens = body.split()
                for at in range(0, max(len(tokens), 1), max_words):
                    pieces.append(" ".join(tokens[at : at + max_words]))
                    owner.append(row)
            sums, counts = None, np.zeros(len(frame))
            for at in range(0, len(pieces), batch_size):
                vectors, mask = encoder(pieces[at : at + batch_size])
                part = owner[at : at + batch_size]
                if sums is None:
                    sums = np.zeros((len(frame), vectors.shape[2]))
                np.add.at(sums, part, (vectors * mask[:, :, None]).sum(axis=1))
                np.add.at(counts, part, mask.sum(axis=1))
            if sums is not None:
                pooled = sums / np.maximum(counts, 1e-9)[:, None]
                yield pd.DataFrame({key: frame[key], "embedding": list(pooled)})

    texts = df.filter(F.col(text).isNotNull()).select(key, text)
    return texts.mapInPandas(run, f"{key} {key_type}, embedding array<double>")
